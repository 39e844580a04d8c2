"""Quotas, merging, drafts, export lines and incremental ingestion."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window as W, functions as F

from cases import sqlkit as k
from cases.board_cases import preferences
from cases.linkage_cases import changes_sql, match_ctes
from cases.plan_cases import KEYED_CTES, QUALITY, _decisions, scored_sql
from cases.registry import Tables, query
from cases.views import NOW
from gazette import vocabulary as V
from gazette.operators import extract, merge, normalize, quota
from gazette.plans import collect, proposals
from gazette.sources import files
from gazette.scale import number_rows, shared_folder, written
from gazette.streaming import jobs

# --- quotas --------------------------------------------------------------------------
# Next window start of every event by as-of join, then the chain from each user's first event.
_CHAIN = """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id AS key, epoch_us(ts) // 1000 AS ms FROM events),
  d AS MATERIALIZED (SELECT DISTINCT key, ms FROM e),
  nx AS MATERIALIZED (SELECT d.key, d.ms, n.ms AS next_ms FROM (SELECT *, ms + 14400000 AS due FROM d) d ASOF LEFT JOIN d n ON d.key = n.key AND n.ms >= d.due),
  starts AS (SELECT key, min(ms) AS ms FROM d GROUP BY key UNION ALL SELECT nx.key, nx.next_ms FROM starts JOIN nx ON nx.key = starts.key AND nx.ms = starts.ms WHERE nx.next_ms IS NOT NULL),
  w AS (SELECT e.*, s.ms AS window_start, row_number() OVER (PARTITION BY e.key, s.ms ORDER BY e.ms, e.event_id) AS r FROM e ASOF JOIN starts s ON e.key = s.key AND s.ms <= e.ms),
  q AS (SELECT event_id, key, window_start, least(r, 3) AS count, r <= 2 AS allowed, CASE WHEN r <= 2 THEN 2 - r ELSE 0 END AS remaining,
    CASE WHEN r <= 2 THEN 0 ELSE greatest(1, ceil((window_start + 14400000 - ms) / 1000.0)) END::BIGINT AS retry_after_seconds FROM w)"""


def _fixed(t: Tables):
    return quota.fixed_window_quota(t.raw("events"), "user_id", 2, 4 * 3_600)


@query("fixed_window_quota", f"{_CHAIN} SELECT * FROM q")
def _(t: Tables):
    return _fixed(t)


@query(
    "quota_usage",
    f"""{_CHAIN}, u AS (SELECT key, window_start, count(*) AS n, count(*) FILTER (NOT allowed) AS refused, max(count) AS c FROM q GROUP BY ALL)
    SELECT key, count(*) AS windows, sum(n)::BIGINT AS requests, sum(refused)::BIGINT AS refused, max(c) AS max_count, max(c) > 2 AS exceeded FROM u GROUP BY key""",
)
def _(t: Tables):
    return quota.quota_usage(_fixed(t), 2)


@query("sliding_quota")
def _(t: Tables):
    return quota.sliding_quota(t.raw("events"), "user_id", 3, 6 * 3_600)


# --- merging -----------------------------------------------------------------------------
_C = ("candidates",)
_IDENT = f"""CASE WHEN source_job_id <> '' THEN 'id:' || {k.fold('source_job_id')} WHEN notification_link <> '' THEN 'notice:' || coalesce({k.canon('notification_link')}, 'null')
  ELSE 'job:' || {k.fold('title')} || ':' || {k.clean('last_date')} END"""
_SCORE = (
    f"(CASE WHEN {k.has('title', V.GENERIC_TITLE)} THEN 0 ELSE 10 END + CASE WHEN {k.has('title', V.JOB_SIGNAL)} THEN 10 ELSE 0 END"
    " + CASE WHEN length(title) BETWEEN 15 AND 240 THEN 5 ELSE 0 END - CASE WHEN length(title) > 320 THEN 10 ELSE 0 END)"
)


def _first(c: str) -> str:
    return f"arg_min({c}, pos) FILTER ({c} <> '') AS {c}"


@query(
    "merge_notices",
    f"""WITH c AS MATERIALIZED (SELECT *, {_IDENT} AS identity, {_SCORE} AS score FROM candidates)
    SELECT source_id, identity, arg_min(title, (-score, length(title), pos)) AS title, {', '.join(_first(c) for c in ('qualification', 'salary', 'location', 'last_date', 'apply_link', 'source_job_id'))},
      arg_min(notification_link, (NOT {k.has('notification_link', V.PDF_LINK)}, pos)) FILTER (notification_link <> '') AS notification_link, sha256({k.clean("arg_min(raw_text, (-length(raw_text), pos))")}) AS content_hash,
      bool_or(is_corrigendum) AS is_corrigendum, min(pos) AS pos, count(*) AS merged FROM c GROUP BY source_id, identity""",
    _C,
)
def _(t: Tables):
    return merge.merge_notices(t.candidates).select(
        "source_id", "identity", "title", "qualification", "salary", "location", "last_date", "apply_link", "source_job_id",
        "notification_link", "content_hash", "is_corrigendum", "pos", "merged",
    )


@query(
    "first_per_identity",
    f"""WITH c AS MATERIALIZED (SELECT *, {_IDENT} AS identity, CASE WHEN extraction_method = 'PDF' THEN 1 ELSE 0 END AS part FROM candidates)
    SELECT source_id, identity, cand_id, title, extraction_method FROM c QUALIFY row_number() OVER (PARTITION BY source_id, identity ORDER BY part, pos) = 1""",
    _C,
)
def _(t: Tables):
    c = t.candidates
    out = merge.first_per_identity(c.where("extraction_method = 'HTML'"), c.where("extraction_method = 'PDF'"))
    return out.select("source_id", "identity", "cand_id", "title", "extraction_method")


@query(
    "source_content_hash",
    f"""WITH p AS (SELECT source_id, pos AS n, part FROM (SELECT id AS source_id, -1 AS pos, md5(name) AS part FROM sources
        UNION ALL SELECT source_id, pos, sha256({k.clean('raw_text')}) FROM candidates))
    SELECT source_id, sha256(string_agg(part, '|' ORDER BY n, part)) AS content_hash FROM p GROUP BY source_id""",
    ("candidates", "sources"),
)
def _(t: Tables):
    pages = t.sources.select(F.col("id").alias("source_id"), F.md5("name").alias("content_hash"))
    return merge.source_content_hash(normalize.with_content_hash(t.candidates), pages)


# Detail pages: candidates of one customer's source share the page of their listing title.
@query(
    "closest_detail",
    f"""WITH b AS MATERIALIZED (SELECT id AS base_id, title AS page_id, {k.fold('source_job_id')} AS job, {k.fold('title')} AS ft FROM listings),
    d AS MATERIALIZED (SELECT cand_id AS detail_id, pos, trim(replace(replace(title, 'Corrigendum: ', ''), ' last date extension', '')) AS page_id, {k.fold('source_job_id')} AS d_job, {k.fold('title')} AS d_ft, count(*) OVER (PARTITION BY trim(replace(replace(title, 'Corrigendum: ', ''), ' last date extension', ''))) AS n FROM candidates)
    SELECT base_id, arg_min(detail_id, (r, pos)) AS detail_id FROM (SELECT *, CASE WHEN job <> '' AND job = d_job THEN 1 WHEN contains(d_ft, ft) OR contains(ft, d_ft) THEN 2 WHEN n = 1 THEN 3 END AS r FROM b JOIN d USING (page_id)) WHERE r IS NOT NULL GROUP BY base_id""",
    ("listings", "candidates"),
)
def _(t: Tables):
    page = F.trim(F.replace(F.replace("title", F.lit("Corrigendum: "), F.lit("")), F.lit(" last date extension"), F.lit("")))
    base = t.listings.select(F.col("id").alias("base_id"), F.col("title").alias("page_id"), "source_job_id", "title")
    details = t.candidates.select(F.col("cand_id").alias("detail_id"), "pos", page.alias("page_id"), "source_job_id", "title")
    return merge.closest_detail(base, details)


_STRONG = f"length(d.title) BETWEEN 12 AND 220 AND NOT regexp_matches(d.title, {k.q(V.BROKEN_TITLE_TEXT)}) AND NOT {k.has('d.title', V.TABLE_TITLE)} AND {k.has('d.title', V.STRONG_TITLE)}"


@query(
    "enrich_notice",
    f"""WITH c AS MATERIALIZED (SELECT * FROM candidates), d AS MATERIALIZED (SELECT id, title, salary, location, notification_link, description AS raw_text, featured AS is_corrigendum FROM listings)
    SELECT c.cand_id, CASE WHEN d.id IS NOT NULL AND regexp_matches({k.fold('c.title')}, {k.q(V.GENERIC_LISTING_TITLE)}) AND {_STRONG} THEN d.title ELSE c.title END AS title,
      CASE WHEN c.salary <> '' THEN c.salary ELSE coalesce(d.salary, c.salary) END AS salary, CASE WHEN c.location <> '' THEN c.location ELSE coalesce(d.location, c.location) END AS location,
      CASE WHEN d.id IS NOT NULL AND (coalesce(c.notification_link, '') = '' OR ({k.has('d.notification_link', V.PDF_LINK)} AND NOT {k.has('c.notification_link', V.PDF_LINK)})) THEN coalesce(d.notification_link, c.notification_link) ELSE c.notification_link END AS notification_link,
      CASE WHEN d.id IS NOT NULL THEN {k.has('c.title', V.LISTING_AMENDMENT)} OR coalesce(d.is_corrigendum, false) ELSE c.is_corrigendum END AS is_corrigendum,
      sha256({k.clean("CASE WHEN length(d.raw_text) > length(c.raw_text) THEN d.raw_text ELSE c.raw_text END")}) AS content_hash FROM c LEFT JOIN d ON d.id = c.cand_id""",
    ("candidates", "listings"),
)
def _(t: Tables):
    notices = t.candidates.withColumn("notice_id", F.col("cand_id"))
    details = t.listings.select(
        F.col("id").alias("notice_id"), "title", "salary", "location", "notification_link", F.col("description").alias("raw_text"), F.col("featured").alias("is_corrigendum")
    )
    out = merge.enrich_notice(notices, details)
    return out.select("cand_id", "title", "salary", "location", "notification_link", "is_corrigendum", "content_hash")


# --- drafts ----------------------------------------------------------------------------------
def _drafts(t: Tables):
    # Every review item is asked for once: stale for every fifth row, with a corrected deadline for every second.
    prepared = proposals.prepare_candidates(t.candidates)
    asked = F.when(F.col("pos") % 5 == 0, F.lit("0" * 64)).otherwise(F.col("snapshot_hash"))
    first = prepared.groupBy("source_id", "candidate_key", asked.alias("snapshot_hash")).agg(F.min("pos").alias("pos"))
    fixed = F.when(F.col("pos") % 2 == 0, F.create_map(F.lit("last_date"), F.lit("2027-01-01")))
    requests = first.select("source_id", "candidate_key", "snapshot_hash", F.coalesce(fixed, F.create_map().cast("map<string,string>")).alias("corrections"))
    return proposals.create_drafts(requests, prepared, t.spread("listings"), t.sources, _decisions(prepared), NOW)


_AGAIN = ", ".join(f"{e} AS {c}" for c, e in k.CLEANED.items())
_SECOND_MATCH = re.sub(r"\b(lk|ck|ct|lt|amended|hits|matches)\b", r"\g<1>2", match_ctes("again", "listings"))
_DRAFT_CTES = f"""{KEYED_CTES},
  req AS MATERIALIZED (SELECT source_id, candidate_key, CASE WHEN pos % 5 = 0 THEN repeat('0', 64) ELSE snapshot_hash END AS asked, min(pos) % 2 = 0 AS fix FROM keyed GROUP BY 1, 2, 3),
  cur AS MATERIALIZED (SELECT r.source_id, r.candidate_key, r.asked, r.fix, arg_min(struct_pack(cand_id := y.cand_id, snapshot_hash := y.snapshot_hash), (y.snapshot_hash <> r.asked, y.pos)) AS item
    FROM req r JOIN keyed y ON y.source_id = r.source_id AND y.candidate_key = r.candidate_key GROUP BY 1, 2, 3, 4),
  live AS MATERIALIZED (SELECT c.*, cur.candidate_key, cur.asked AS snapshot_hash, cur.fix FROM cur JOIN cleaned c ON c.cand_id = cur.item.cand_id WHERE cur.item.snapshot_hash = cur.asked),
  patched AS MATERIALIZED (SELECT * REPLACE (CASE WHEN fix THEN '2027-01-01' ELSE last_date END AS last_date) FROM live),
  again AS MATERIALIZED (SELECT * REPLACE ({_AGAIN}) FROM patched),
  {match_ctes('live', 'listings')}, {_SECOND_MATCH},
  judged AS MATERIALIZED (SELECT s.*, {QUALITY} AS q, coalesce(m.listing_id, m2.listing_id) AS listing_id, d.decision FROM ({scored_sql('again')}) s LEFT JOIN matches m ON m.cand_id = s.cand_id LEFT JOIN matches2 m2 ON m2.cand_id = s.cand_id
    LEFT JOIN decisions d ON d.source_id = s.source_id AND d.candidate_key = s.candidate_key AND d.snapshot_hash = s.snapshot_hash),
  compared AS MATERIALIZED (SELECT j.*, CASE WHEN j.listing_id IS NOT NULL THEN {changes_sql('j', 'l')} END AS changes FROM judged j LEFT JOIN listings l ON l.id = j.listing_id),
  drafts AS MATERIALIZED (SELECT cand_id, pos, source_id, candidate_key, snapshot_hash, listing_id, title, last_date,
      CASE WHEN fix AND {k.day('application_start_date')} > '2027-01-01' THEN 'INVALID_CORRECTION' WHEN decision = 'REJECTED' OR (decision = 'NEEDS_CORRECTION' AND NOT fix) THEN 'REVIEW_REQUIRED'
        WHEN (is_corrigendum AND listing_id IS NULL) OR q <> 'pass' OR source_id <= 0 THEN 'NOT_ELIGIBLE' WHEN listing_id IS NOT NULL AND changes <> '' THEN 'WOULD_UPDATE' WHEN listing_id IS NOT NULL THEN 'DUPLICATE' ELSE 'DRAFT_CREATED' END AS outcome FROM compared),
  made AS MATERIALIZED (SELECT *, (SELECT max(id) FROM listings) + row_number() OVER (ORDER BY pos) AS id FROM drafts WHERE outcome = 'DRAFT_CREATED')"""


@query(
    "create_drafts",
    f"""WITH {_DRAFT_CTES} SELECT cand_id, source_id, candidate_key, snapshot_hash, listing_id, outcome FROM drafts
    UNION ALL SELECT item.cand_id, source_id, candidate_key, item.snapshot_hash, NULL, 'STALE' FROM cur WHERE item.snapshot_hash <> asked""",
    ("candidates", "listings", "sources"),
)
def _(t: Tables):
    return _drafts(t).select("cand_id", "source_id", "candidate_key", "snapshot_hash", "listing_id", "outcome")


@query(
    "draft_rows",
    f"WITH {_DRAFT_CTES} SELECT id, cand_id, trim(title) AS title, 'DRAFT' AS status, 'MANUAL_VERIFIED' AS review_status, CAST(NULL AS TIMESTAMP) AS published_at, source_id, {k.deadline('last_date')} AS last_date FROM made",
    ("candidates", "listings", "sources"),
)
def _(t: Tables):
    outcomes = written(_drafts(t).drop("raw_text"), "drafts")
    rows = proposals.draft_rows(outcomes, t.listings, NOW, 3)
    return rows.select("id", "cand_id", "title", "status", "review_status", "published_at", "source_id", "last_date")


@query(
    "draft_items",
    f"""WITH {_DRAFT_CTES} SELECT 'r3' AS run_id, d.source_id, s.name AS source_name, d.title AS candidate_title, CASE d.outcome WHEN 'DRAFT_CREATED' THEN 'ADDED' WHEN 'WOULD_UPDATE' THEN 'SKIPPED' ELSE 'DUPLICATE' END AS action,
      coalesce(made.id, d.listing_id) AS job_id, d.outcome AS kind FROM drafts d JOIN sources s ON s.id = d.source_id LEFT JOIN made ON made.cand_id = d.cand_id WHERE d.outcome IN ('DRAFT_CREATED', 'WOULD_UPDATE', 'DUPLICATE')""",
    ("candidates", "listings", "sources"),
)
def _(t: Tables):
    outcomes = written(_drafts(t).drop("raw_text"), "drafts")
    return proposals.draft_items(outcomes, proposals.draft_rows(outcomes, t.listings, NOW, 3), "r3")


# --- export -----------------------------------------------------------------------------------
def _cell(expression: str) -> str:
    guarded = f"CASE WHEN regexp_matches(x, '^[=+\\-@\\t\\r]') THEN '''' || x ELSE x END"
    return k.let(f"coalesce(CAST({expression} AS VARCHAR), '')", lambda x: "'\"' || replace(" + guarded.replace("x,", f"{x},").replace("|| x", f"|| {x}").replace("ELSE x", f"ELSE {x}") + ", '\"', '\"\"') || '\"'")


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.000Z')"
_CELLS = " || ',' || ".join(
    _cell("strftime(last_date, '%Y-%m-%d')" if c == "last_date" else _ISO.format(c) if c in ("created_at", "updated_at") else c)
    for _, c in V.CSV_COLUMNS
)


_HEADER = ",".join(f'"{title}"' for title, _ in V.CSV_COLUMNS)


@query("csv_lines", f"SELECT 1 AS part, id, {_CELLS} AS line FROM listings UNION ALL SELECT 0, NULL, chr(65279) || {k.q(_HEADER)}", ("listings",))
def _(t: Tables):
    return files.csv_lines(t.listings).select("part", "id", "line")


# --- incremental ingestion ----------------------------------------------------------------------
@query("ingest_pages")
def _(t: Tables):
    prepared = proposals.prepare_candidates(t.candidates)
    out = jobs.ingest_pages(t.pages_in, t.spread("listings"), t.sources, _decisions(prepared), NOW, 9)
    return out.select("id", "title", "status", "source_job_id", "automation_run_id")


# --- files and streams -------------------------------------------------------------------------
@query(
    "backup_round_trip",
    "SELECT row_number() OVER (ORDER BY id) - 1 AS place, id, title, category, department, status, featured FROM listings",
    ("listings",),
)
def _(t: Tables):
    path = f"{shared_folder(t.spark).rstrip('/')}/backup-{uuid.uuid4().hex}"
    files.export_json(t.spread("listings"), path, "gzip")
    shown = ["id", "title", "category", "department", "status", "featured"]
    return number_rows(files.read_backup(t.spark, path).select("seq", *shown), [], "seq", "place").select("place", *shown)


@query("snapshot_round_trip", "SELECT id, title, status, last_date, source_id, updated_at FROM listings", ("listings",))
def _(t: Tables):
    path = f"{shared_folder(t.spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    files.write_snapshot(t.spread("listings"), path, 7)
    return files.read_snapshot(t.spark, path, 7).select("id", "title", "status", "last_date", "source_id", "updated_at")


# The counters over a log that is complete: the same plan as over a stream.
@query("run_counters", "SELECT CAST(created_at AS DATE) AS day, source_id, action, count(*) AS n FROM run_items GROUP BY ALL", ("run_items",))
def _(t: Tables):
    return jobs.stream_run_counters(t.run_items).withColumn("day", F.col("day").cast("date"))


# --- order and figures of a collection, over the candidate table ----------------------------------
@query("united_records", "SELECT cand_id, pos + CASE WHEN cand_id % 2 = 0 THEN 0 ELSE 2147483648 END AS pos, title FROM candidates", _C)
def _(t: Tables):
    rows = t.candidates.select("cand_id", "pos", "title")
    return merge.ordered_union(rows.where("cand_id % 2 = 0"), rows.where("cand_id % 2 <> 0"))


# Every third record stands behind a second link; notices of some titles are dropped as outcomes.
@query(
    "source_metrics",
    f"""WITH c AS MATERIALIZED (SELECT *, {_IDENT} AS identity, {_SCORE} AS score FROM candidates), n AS MATERIALIZED (SELECT source_id, identity, arg_min(title, (-score, length(title), pos)) AS title FROM c GROUP BY ALL),
    alive AS MATERIALIZED (SELECT * FROM n WHERE NOT {k.has('title', V.RESULT_ONLY_TITLE)} AND length(title) % 5 <> 0), raw AS (SELECT source_id, count(*) + count(*) FILTER (cand_id % 3 = 0) AS raw_links FROM c GROUP BY source_id),
    rec AS (SELECT c.source_id, count(*) AS recruitment_links FROM c JOIN alive a ON a.source_id = c.source_id AND a.identity = c.identity GROUP BY c.source_id), u AS (SELECT source_id, count(*) AS unique_notices FROM alive GROUP BY source_id)
    SELECT source_id, raw_links, coalesce(recruitment_links, 0) AS recruitment_links, coalesce(unique_notices, 0) AS unique_notices, greatest(0, raw_links - coalesce(recruitment_links, 0)) AS rejected_noise
    FROM raw LEFT JOIN rec USING (source_id) LEFT JOIN u USING (source_id)""",
    _C,
)
def _(t: Tables):
    records = t.candidates
    links = records.select("source_id").unionAll(records.where("cand_id % 3 = 0").select("source_id"))
    return merge.collection_metrics(links, records, extract.drop_result_only(merge.merge_notices(records)).where("length(title) % 5 <> 0"))


# One source per page by its adapter, and one notice interface with a payload per document.
_SITE = "'https://s' || CAST(page_id AS {0}) || '.example.org/list'"


@query(
    "collect",
    """SELECT page_id AS source_id, 'document' AS adapter, 'Engagement of keepers at site ' || page_id AS title, 'PDF' AS extraction_method, true AS is_first FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, CASE page_id % 3 WHEN 1 THEN 'government_html' ELSE 'generic_html' END, 'Engagement of clerks for page ' || page_id, 'HTML', true FROM pages WHERE page_id % 3 <> 0
    UNION ALL SELECT -1, 'notice_api', 'Recruitment of clerks ' || doc_id, 'HTML', doc_id = (SELECT min(doc_id) FROM documents) FROM documents""",
)
def _(t: Tables):
    raw = t.raw("pages").withColumns({"at": F.expr(_SITE.format("STRING")), "kind": F.col("page_id") % 3})
    parser = F.when(F.col("kind") == 0, "PDF_NOTIFICATION").when(F.col("kind") == 1, "GOVERNMENT_HTML").otherwise("GENERIC_HTML")
    sources = raw.select(
        F.col("page_id").alias("id"), F.concat(F.lit("Engagement of keepers at site "), F.col("page_id").cast("string")).alias("name"), F.lit("example.org").alias("domain"),
        "at", parser.alias("parser_type"), F.lit(True).alias("enabled"),
    ).withColumnRenamed("at", "start_url")
    board = t.spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("Board").alias("name"), F.lit(V.API_DOMAIN).alias("domain"), F.lit(f"https://{V.API_DOMAIN}/home").alias("start_url"), F.lit("GOVERNMENT_HTML").alias("parser_type"), F.lit(True).alias("enabled"))
    html = F.coalesce("html", F.lit(""))
    row = F.concat(F.lit("<td>Advt No P-"), F.col("page_id").cast("string"), F.lit("/x</td><td><a href='/n'>Engagement of clerks for page "), F.col("page_id").cast("string"), F.lit("</a></td><td>apply</td>"))
    pages = raw.where("kind <> 0").select("page_id", F.col("at").alias("url"), F.concat(row, html).alias("html"))
    papers = raw.where("kind = 0").select(F.col("at").alias("url"), html.alias("text"))
    record = F.to_json(F.array(F.struct(F.concat(F.lit("Recruitment of clerks "), F.col("doc_id").cast("string")).alias("subject"), F.concat(F.lit("/apply/"), F.col("doc_id").cast("string")).alias("applyLink"), F.col("text").alias("description"))))
    payloads = t.raw("documents").select(F.col("doc_id").alias("payload_id"), F.lit(f"https://{V.API_DOMAIN}/api").alias("url"), record.alias("payload"))
    candidates, _ = collect.collect(sources.unionByName(board), pages, papers, payloads, NOW)
    first = F.col("pos") == F.min("pos").over(W.partitionBy("source_id"))
    return candidates.select("source_id", "adapter", "title", "extraction_method", first.alias("is_first"))
