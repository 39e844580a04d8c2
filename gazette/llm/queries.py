"""The registered queries of the subpackage, each over its whole tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gazette.llm import decontaminate, grammar, near_duplicates, packing, phrases, prefix_counts, quality, resampling, toxicity, url_rules, vectors, warc, whitening
from gazette.llm.tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns that a query needs of a given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality and whether it is kept."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = quality.score(docs, quality.train(docs), "quality", keep_text=False)
    return scored.withColumn("kept", F.col("quality") >= quality.THRESHOLD)


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, path, deciding rule and verdict."""
    return url_rules.judge(table(spark, sf_dir, "pages", "page_id", "url"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, weights, keep_text=False)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted.alias("predicted"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words and items of the benchmark that it holds."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), keep_text=False)
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its WARC record gives it back."""
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html")))


@query
def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the grammar-compressed id files give it back."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return grammar.read_documents(grammar.write_ids(docs, tokenizer_path("byte_bpe_50k.json")))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its bytes, tokens, and how much of it fits the limit."""
    return prefix_counts.measure(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


@query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and its component."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates and whether it stays."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on its first whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and its likeness to that and to the next document."""
    return phrases.compare_with_next(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark texts, its score, and its place among the drawn."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ranked = resampling.resample(docs, table(spark, sf_dir, "benchmark", "text"), keep_text=False)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op2_url_filter"] = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
  r AS (SELECT *, CASE WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
    CASE WHEN '.' || host LIKE '%.tracker.%' THEN '*.tracker.* **' WHEN path LIKE '%/login%' THEN '* **/login**' WHEN path LIKE '%/ads/%' THEN '* **/ads/**' WHEN '.' || host LIKE '%.ads.%' THEN '*.ads.* **'
      WHEN path LIKE '%.zip' THEN '* **.zip' WHEN path LIKE '%.exe' THEN '* **.exe' ELSE '**' END AS fallback FROM p)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
    ELSE CASE WHEN fallback = '**' THEN 'allow' ELSE 'block' END END AS verdict,
  CASE WHEN rule IS NULL THEN fallback ELSE '*.' || split_part(rule, '/', 1) || ' /' || substr(rule, instr(rule, '/') + 1) || '**' END AS matched_glob
FROM r"""

ORACLES["op5_warc_bundles"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages), h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
  d AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hex) AS first,
    list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || rpad(substr(hex, CAST(i * 5 // 4 + 1 AS INTEGER), 2), 2, '0') AS BIGINT) // (2 ** (3 - i * 5 % 4))::BIGINT) % 32 AS INTEGER), 1)), lambda a, b: a || b) AS payload_digest FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op9_decontamination"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  i AS MATERIALIZED (SELECT DISTINCT item_id, size, w[j:j + size - 1] AS words FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
  s AS (SELECT DISTINCT size FROM i),
  t AS (SELECT doc_id, size, j, w[j:j + size - 1] AS words FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS j FROM d, s WHERE len(w) >= size)),
  o AS MATERIALIZED (SELECT t.doc_id, t.j, t.size, i.item_id FROM t JOIN i ON t.size = i.size AND t.words = i.words),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + size)) AS p FROM o) GROUP BY doc_id),
  it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""

_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))), lambda j: CAST('0x' || substr(hex(encode(f)), 2 * j + 1, 2) AS BIGINT))), "
    "lambda c, b: xor(c >> 8, steps[1 + xor(c, b) % 256])), 4294967295::BIGINT)"
)
ORACLES["op11_importance_resampling"] = f"""
WITH k AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS steps),
  d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
  df AS MATERIALIZED (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) AS f FROM d),
  bf AS MATERIALIZED (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) AS f FROM b),
  h AS MATERIALIZED (SELECT f, {_CRC} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), k),
  s AS (SELECT bucket, count(*) AS n FROM df JOIN h USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bf JOIN h USING (f) GROUP BY bucket),
  g AS MATERIALIZED (SELECT i AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM range(10000) x(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
  p AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY r),
  v AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN p USING (r)),
  o AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM v)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 25 // 100 THEN place END AS rank FROM o"""
