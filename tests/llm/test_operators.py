"""The operators on small tables with nulls, empty and long texts, ties, repeated rows, no rows and odd columns."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gazette.llm import components, decontaminate, grammar, near_duplicates, packing, prefix_counts, quality, toxicity, url_rules, vectors, warc
from gazette.llm.tokens import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(n: int, seed: int) -> list[str]:
    r = np.random.default_rng(seed)
    return ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(n)]


EDGES = [(None, "no id at all"), (1, None), (2, ""), (3, "!!! ... ???"), (4, "one"), (5, "Ünï 漢字 ok"), (6, "same text here"), (6, "same text here"), (7, "long " * 60_000)]


# Decontamination


def brute_marks(text, items):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    hit, found = set(), set()
    for item, t in items:
        v = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        size = min(10, len(v))
        for j in range(len(v) - size + 1 if v else 0):
            for k in range(len(w) - size + 1):
                if w[k : k + size] == v[j : j + size]:
                    hit.update(range(k, k + size))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [8_000_000, 60])
def test_marks_agree_with_brute_force(spark, block_bytes):
    a, b = words(25, 1), words(12, 2)
    items = [(1, " ".join(a)), (2, " ".join(b)), (10, "short item"), (11, None), (12, "..."), (None, "unnamed one"), (2, " ".join(b))]
    rows = [
        (1, " ".join(words(30, 3) + a[3:15] + words(5, 4))), (2, "X " + " ".join(b).upper() + " y " + " ".join(a[:10])), (3, " ".join(a[:9])),
        (4, "a SHORT, item. and short item"), (5, "an unnamed one"), *EDGES[:5],
    ]
    docs = docs_of(spark, rows).withColumnRenamed("source", "n_hit").withColumns({c: F.lit("own") for c in ("_runs", "_items", "hit_items", "_text", "a.b")})  # clashing names
    got = decontaminate.mark(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(
        (i is None, i or 0, *brute_marks(t, items)) for i, t in rows
    )
    assert [*got[0].asDict()] == ["doc_id", "text", "lang", "n_chars", "_runs", "_items", "hit_items", "_text", "a.b", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_runs"]
    assert {got[0][c] for c in ("_runs", "_items", "hit_items", "_text", "a.b")} == {"own"} and all(sum(x.end - x.begin for x in r.hit_runs) == r.n_hit for r in got)


def test_marks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.mark(docs_of(spark, []), none).count() == 0
    assert not any(r.contaminated for r in decontaminate.mark(docs_of(spark, EDGES), none).collect())


# Near-duplicates


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(v[i : i + 5]) for i in range(max(len(v) - 4, 1))} if v else set() for v in (a.lower().split(), b.lower().split()))
    return len(x & y) / max(len(x | y), 1)


def test_classes_of_copies_near_copies_and_others(spark):
    base = words(200, 5)
    near = [[*base[:k], "changed", *base[k + 1 :]] for k in range(0, 200, 9)]
    far = [[w if i % 6 else f"x{k}" for i, w in enumerate(base)] for k in range(12)]
    texts = [" ".join(w) for w in (base, *near, *far, words(50, 8), words(50, 9))] + [" ".join(base).upper() + "!"]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + EDGES
    got = near_duplicates.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    # Brute force over plain shingles: no pair here is near the threshold.
    label = {i: i for i, _ in rows[: len(texts)]}
    for i, t in rows[: len(texts)]:
        for j, u in rows[: len(texts)]:
            similarity = jaccard(t.strip("!"), u.strip("!"))
            assert not 0.75 < similarity < 0.85
            if similarity >= 0.8:
                low = min(label[i], label[j])
                label = {k: low if v in (label[i], label[j]) else v for k, v in label.items()}
    assert {i: found[i].class_id for i in label} == label
    assert [found[i].class_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4] and found[6].class_size == 2 and found[None].class_id is None
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_one_of_each_class_stays(spark):
    rows = [*EDGES, (9, "same text here"), (10, "Same text, here"), (11, ""), (12, None)]
    kept = near_duplicates.keep_one(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, i) for i in (1, 2, 3, 4, 5, 6, 7, 11, 12)] + [(True, 0)]
    assert near_duplicates.keep_one(docs_of(spark, [])).count() == 0
    assert near_duplicates.near_duplicates(docs_of(spark, [])).count() == 0
    odd = near_duplicates.keep_one(docs_of(spark, rows).withColumnsRenamed({"lang": "_k1", "source": "_k2", "n_chars": "_winner"}))
    assert odd.columns == ["doc_id", "text", "_k1", "_k2", "_winner"] and odd.count() == 10 and {r["_k1"] for r in odd.collect()} == {"en"}


def test_large_buckets_are_cut_into_blocks(spark):
    base = words(120, 6)
    rows = [(i, " ".join([*base[:i], f"word{i}", *base[i + 1 :]])) for i in range(90)] + [(500 + i, " ".join(words(60, 100 + i))) for i in range(20)]
    found, _ = near_duplicates.classes(docs_of(spark, rows), block=16)
    keys = {r.doc_id: r.class_key for r in found.collect()}
    assert len({keys[i] for i in range(90)}) == 1 and len(set(keys.values())) == 21


def test_work_of_a_large_bucket_grows_with_its_texts(spark):
    sizes = {}
    for n in (1000, 4000, 16_000):
        bucket = spark.range(n).select(F.lit(7).cast("bigint").alias("key"), F.lit(n).cast("bigint").alias("n"), F.xxhash64("id").alias("k1"), F.col("id").alias("k2"))
        work = near_duplicates._first_work(bucket, 256)
        sizes[n] = work.count()
        assert sizes[n] == n + near_duplicates.REPRESENTATIVES * -(-n // 256)
        # All in the main group but three texts, which meet everything once.
        labels = bucket.select("key", "k1", "k2", F.when(F.col("k2") > 2, F.lit(1).cast("bigint")).alias("r1"), F.when(F.col("k2") > 2, F.lit(2).cast("bigint")).alias("r2"))
        assert near_duplicates._rest_work(labels, 256).count() <= n + 3 * (2 + n // 256)
        assert near_duplicates._rest_work(labels.where("k2 > 2"), 256).count() == 0
    assert sizes[16_000] < 16.1 * sizes[1000]


def test_texts_outside_the_main_group_meet_everything(spark):
    # Pieces of work over numbered texts: every pair that is not inside the main group meets, once.
    n, block = 60, 8
    bucket = spark.range(n).select(F.lit(1).cast("bigint").alias("key"), F.lit(n).cast("bigint").alias("n"), (F.col("id") * 7919).alias("k1"), F.col("id").alias("k2"))
    group = F.when(F.col("k2") < 40, F.lit(5)).when(F.col("k2") < 50, F.lit(6)).cast("bigint")
    work = near_duplicates._rest_work(bucket.select("key", "k1", "k2", group.alias("r1"), group.alias("r2")), block).collect()
    met = {}
    for a in work:
        for b in work:
            if (a.left, a.right) == (b.left, b.right) and a.k2 < b.k2 and (a.left == a.right or a.block != b.block):
                met[a.k2, b.k2] = met.get((a.k2, b.k2), 0) + 1
    assert met == {(i, j): 1 for i in range(n) for j in range(max(i + 1, 40), n)}


@pytest.mark.parametrize("others", [0, 14, 300])
@pytest.mark.parametrize("length", [60, 3000])
def test_pairs_at_the_threshold_are_judged_alike_in_small_and_large_buckets(others, length):
    # Weighted Jaccard by brute force; the threshold is set to that of a pair, just over it, and just under.
    r = np.random.default_rng(length)
    base = r.integers(1, 1 << 60, length).astype(np.uint64)
    texts = [base, np.concatenate([base[: length * 9 // 10], r.integers(1, 1 << 60, length // 10).astype(np.uint64)])]
    texts += [r.integers(1, 1 << 60, 50).astype(np.uint64) for _ in range(others)]
    weight = {v: 1 + float(w) for v, w in zip(np.concatenate(texts).tolist(), r.random(sum(map(len, texts))))}
    weights = [np.array([weight[v] for v in t.tolist()]) for t in texts]
    shared = sum(weight[v] for v in {*texts[0].tolist()} & {*texts[1].tolist()})
    exact = shared / (weights[0].sum() + weights[1].sum() - shared)
    for threshold, linked in ((exact, True), (exact - 1e-7, True), (exact + 1e-7, False)):
        found = near_duplicates._linked(texts, weights, np.zeros(len(texts), int), False, threshold)
        assert (found[1] == 0) == linked and (found[2:] == np.arange(2, len(texts))).all()


def test_classes_agree_with_weighted_brute_force(spark):
    from gazette.llm.words import buffer_of

    r = np.random.default_rng(12)
    base = words(60, 40)
    texts = []
    for i in range(50):
        own = [*base]
        for at in r.choice(60, i % 6, replace=False):
            own[at] = f"swap{r.integers(4)}"
        texts.append(" ".join(own * (1 + i % 2)))
    texts += [" ".join(words(30, 60 + i)) for i in range(6)]
    docs = docs_of(spark, list(enumerate(texts)))
    got = {x.doc_id: x.class_id for x in near_duplicates.near_duplicates(docs).collect()}
    idf = near_duplicates.inverse(*near_duplicates.document_frequencies(docs))
    values, counts, mean, first, _ = near_duplicates.weighted(*buffer_of(pa.array(texts)), idf)
    bags = [{v: (1 + np.log(c)) * m for v, c, m in zip(values[a:b].tolist(), counts[a:b].tolist(), mean[a:b].tolist())} for a, b in zip(first, first[1:])]
    label = [*range(len(texts))]
    for i, x in enumerate(bags):
        for j, y in enumerate(bags):
            low = sum(min(x.get(v, 0), y.get(v, 0)) for v in x)
            if low >= 0.8 * (sum(x.values()) + sum(y.values()) - low):
                label = [min(label[i], label[j]) if v in (label[i], label[j]) else v for v in label]
    assert got == dict(enumerate(label))


def test_samples_agree_as_often_as_texts_are_alike():
    import pyarrow as pa

    from gazette.llm.words import buffer_of

    base = words(300, 7)
    texts = [" ".join(base), " ".join([*base[:280], *words(20, 8)])]
    idf = np.ones(1 << near_duplicates.SLOT_BITS)
    values, counts, mean, first, _ = near_duplicates.weighted(*buffer_of(pa.array(texts)), idf)
    shared = len(set(values[: first[1]].tolist()) & set(values[first[1] :].tolist()))
    true = shared / (len(values) - shared)
    drawn = near_duplicates.samples(values, mean, first)
    assert abs((drawn[0] == drawn[1]).mean() - true) < 0.17


@pytest.mark.parametrize("edges,want", [
    ([], {}), ([(1, 1), (None, 2)], {}), ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)}),
    ([(5, 3), (3, 5), (9, 5), (7, 8)], {3: 3, 5: 3, 9: 3, 7: 7, 8: 7}), ([(0, i) for i in range(1, 300)], {i: 0 for i in range(300)}),
])
def test_components(spark, edges, want):
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


# Vectors


def test_links_of_vectors(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 16))
    v = [centres[i % 6] + r.normal(size=16) * 0.06 * (i % 5) for i in range(240)]
    v = [x.astype(np.float32).tolist() for x in v]
    rows = [(i, x) for i, x in enumerate(v)] + [(300, v[0]), (301, v[0]), (302, [x * 4 for x in v[0]]), (302, [x * 4 for x in v[0]])]
    odd = [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, [float("inf")] + v[1][1:]), (405, []), (406, v[0][:3]), (None, v[0])]
    table = spark.createDataFrame([(a, b, 1) for a, b in rows + odd], "vec_id bigint, embedding array<float>, label int")
    got = vectors.near_duplicates(table, block=20, nearest=6, shared=1).collect()
    assert len(got) == len(rows) + len(odd)
    unit = np.array([x for _, x in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    true = link.sum()
    ids = [i for i, _ in rows]
    found = sorted((x.vec_id, x.n_links) for x in got if x.vec_id is not None and x.vec_id < 400)
    want = sorted(zip(ids, link.sum(1).tolist(), strict=True))
    assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True)) and sum(n for _, n in found) >= 0.9 * true
    by_id = {x.vec_id: x for x in got}
    assert by_id[300].component_id == by_id[302].component_id == 0 and not by_id[300].kept
    for i in range(400, 407):
        assert (by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert (by_id[None].n_links, by_id[None].component_id, by_id[None].kept) == (0, None, False)
    assert vectors.near_duplicates(table.limit(0)).count() == 0
    assert vectors.near_duplicates(table.where("vec_id = 400")).count() == 1


def test_links_of_a_dense_group_among_many_pivots(spark):
    r = np.random.default_rng(7)
    centre = r.normal(size=32)
    v = [centre + r.normal(size=32) * 0.1 for _ in range(2000)] + [*r.normal(size=(1000, 32))]
    unit = np.array(v)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    got = vectors.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>"), block=100)
    rows = sorted(got.collect(), key=lambda x: x.vec_id)
    assert [x.n_links for x in rows] == link.sum(1).tolist()
    assert {x.component_id for x in rows[:2000]} == {0} and all(x.kept for x in rows[2000:])


def test_vectors_of_every_length_are_linked(spark):
    r = np.random.default_rng(9)
    v = [(r.normal(size=6) + 5 * (i % 2)).tolist() for i in range(120)] + [[float(i % 3 == j) for j in range(3)] for i in range(9)] + [[2.0] * 4, [3.0] * 4, [1.0]]
    got = vectors.near_duplicates(spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<double>"), block=50).collect()
    want = []
    for x in v:
        near = [np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95 for y in v if len(y) == len(x)]
        want.append(sum(near) - 1)
    found = sorted((x.vec_id, x.n_links, x.component_id) for x in got)
    assert [n for _, n, _ in found[120:]] == want[120:] == [2] * 9 + [1, 1, 0] and [c for _, _, c in found[120:]] == [120, 121, 122] * 3 + [129, 129, 131]
    linked = sum(n for _, n, _ in found[:120])
    assert all(a[1] <= b for a, b in zip(found, want, strict=True)) and linked >= 0.9 * sum(want[:120])


def test_pivots_keep_apart():
    r = np.random.default_rng(8)
    sample = vectors._unit(np.concatenate([r.normal(size=(600, 16)), 1 + 0.01 * r.normal(size=(600, 16))])[r.permutation(1200)])
    kept = vectors.thinned(sample)
    cosines = kept @ kept.T
    np.fill_diagonal(cosines, -1)
    assert cosines.max() < vectors.APART and (sample @ kept.T).max(axis=1).min() >= vectors.APART
    assert kept[-1].sum() > 3.9


# Models


def test_toxicity_learns_words_and_pairs(spark):
    plain = [" ".join(words(40, 200 + i)) for i in range(300)]
    rows = [(i, t + (" vile" if i % 3 == 0 else "")) for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, rows + EDGES).withColumnRenamed("lang", "score")
    weights = toxicity.train(docs, labels)
    got = toxicity.score(docs, weights).withColumn("held", toxicity.held_out()).collect()
    assert len(got) == len(rows) + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id < 300]
    assert {r.held for r in got if r.doc_id is not None and r.doc_id < 300} == {True, False}
    assert all((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in held if r.doc_id > 7)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    again = toxicity.train(docs.repartition(7), labels)
    assert np.array_equal(weights, again)


def test_toxicity_without_labels_is_zero(spark):
    docs = docs_of(spark, EDGES)
    weights = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert weights is None and {r.score for r in toxicity.score(docs, weights).collect()} == {0.0}
    assert toxicity.score(docs_of(spark, []), weights).count() == 0


def test_quality_rejects_junk(spark):
    r = np.random.default_rng(9)
    good = [" ".join(words(80, 400 + i)).capitalize() + "." for i in range(200)]
    junk = [" ".join(f"{w}%%%" for w in words(60, 700 + i)) for i in range(12)] + [" ".join(w.upper() + "!!" for w in words(60, 800 + i)) for i in range(12)]
    junk += [" ".join([w] * 60) for w in words(12, 900)]
    rows = [(i, t) for i, t in enumerate(good)] + [(1000 + i, t) for i, t in enumerate(junk)] + EDGES[:7]
    docs = docs_of(spark, [rows[i] for i in r.permutation(len(rows))]).withColumnRenamed("lang", "quality")
    got = quality.score(docs, quality.train(docs)).collect()
    kept = {x.doc_id for x in got if x.quality >= quality.THRESHOLD}
    assert len(got) == len(rows) and set(range(8, 200)) <= kept and not kept & set(range(1000, 1000 + len(junk)))
    assert quality.score(docs.limit(0), quality.train(docs.limit(0))).count() == 0


def test_accuracies_of_labellers():
    good, bad = quality.GOOD * 3**6, quality.BAD * (3**1 + 3**6)
    label, accuracy = quality.posteriors({good: 900, bad: 90, 0: 10})
    assert label[good] > 0.5 > label[bad] and label[0] == 0.5 and accuracy[1] > 0.9
    assert quality.posteriors({})[0] == {}


# URLs


def brute_rule(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_urls_follow_the_rules(spark):
    urls = [
        None, "", "nothing", "http://", "http://a.net", "http://a.net/", "http://NET/x", "http://example.net/en/1?q#f", "https://m.Example.NET/en/", "http://example.net/e",
        "http://bad-example.net/en/", "http://x.example.com/de/a", "http://example.com/fr/", "http://a.org/fr/b", "http://org/fr", "http://a.net:80/x", "ftp://u@a.net/x?y",
        "http://host.com/x.net/y", "a://b://c.net/d", "http://ünï.net/é", "http://x.com/setup.exe", "http://x.com/" + "a" * 5000, "http://h.com\0.net/x", "http://a.org\0/fr/b", "http://a.net/", "http://a.net/",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    for r in url_rules.judge(pages).collect():
        host, path, best = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]), urls[r.page_id]
        assert r.verdict in ("allow", "block") and (best is None or r.verdict == best[1])
    assert url_rules.judge(pages.limit(0)).count() == 0
    # Of equally long rules the first decides, of equally long globs the last.
    ties = (url_rules.host_rule("a.net/", "allow"), url_rules.host_rule("b.net/", "block"), url_rules.Rule(f"*.a.*{url_rules.SEPARATOR}/**", "block", "b.com/"))
    globs = (url_rules.Rule(f"*{url_rules.SEPARATOR}**xx", "allow"), url_rules.Rule(f"*{url_rules.SEPARATOR}xx**", "block"))
    table = spark.createDataFrame([(1, "http://a.net/"), (2, "http://c.fr/xx"), (3, "http://c.fr/xx"), (4, "http://c.frxx/xx")], "page_id bigint, url string")
    assert [r.verdict for r in url_rules.judge(table, host_rules=ties, globs=globs).orderBy("page_id").collect()] == ["allow"] * 4


# Files and tokens


def test_archives_round_trip(spark):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://c/", None), (4, "u", ""), (None, "n", "x"), (7, "t\r\ne", "é" * 400_000), (9, "r", "dup"), (9, "r", "dup"), (8, "r", "dup")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, _first string")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages)).collect()), key=str)
    want = []
    for page, _, html in rows:
        equal = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        data = (html or "").encode()
        revisit = page != max(equal)
        want.append((page or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", max(equal) if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_id_files_round_trip(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    got = grammar.read_documents(grammar.write_ids(docs_of(spark, EDGES), path, shard_ids=50)).collect()
    ordered = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for i, t in ordered:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert grammar.read_documents(grammar.write_ids(docs_of(spark, []), path)).count() == 0


def test_token_measures(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    counter = prefix_counts.PrefixCounter(path)
    docs = docs_of(spark, [*EDGES, (20, "a <|endoftext|> b")]).withColumnRenamed("lang", "n_bytes")
    got = prefix_counts.measure(docs, path, limit=3).collect()
    texts = {i: t or "" for i, t in [*EDGES, (20, "a <|endoftext|> b")]}
    for r in got:
        t = texts[r.doc_id]
        n = len(counter.library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 3)
        assert len(counter.library.encode(t[: r.fit_chars], add_special_tokens=False).ids) <= 3
    assert prefix_counts.prefix_table(docs.where("doc_id = 4"), path).first().prefix_tokens == [1, 1, 1]
    assert prefix_counts.measure(docs.limit(0), path).count() == 0


def test_pieces_cover_every_document(spark):
    path = tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rows = [*EDGES[1:6], EDGES[8], (30, "Über ALLES 12 it's")]
    got = packing.pack_documents(docs_of(spark, rows), path, with_ids=True, group_tokens=5000).collect()
    sizes: dict[int, int] = {}
    for r in got:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum((r.ids for r in own), []) == ids and {r.doc_tokens for r in own} == {len(ids)}
    assert packing.pack_documents(docs_of(spark, []), path).count() == 0


# Pipeline


def test_the_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "near-duplicates", "benchmark decontamination", "packing"]
    item = words(30, 31)
    clean = [(i, " ".join(words(60, 1000 + i)).capitalize() + ".") for i in range(120)]
    # A text of unknown words scores as the share of toxic labels, which has to lie under the threshold.
    toxic = [(200 + i, " ".join(words(60, 2000 + i)) + " vile") for i in range(24)]
    junk = [(300 + i, " ".join(f"{w}$$$" for w in words(60, 3000 + i))) for i in range(6)]
    leak = [(400, " ".join(words(30, 4000) + item[:12]))]
    rows = clean + toxic + junk + leak + [(500, clean[0][1]), (501, clean[1][1] + " more"), (None, None), (502, ""), *EDGES[4:6]]
    docs = docs_of(spark, rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "_k1")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = {r.doc_id for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "score", "_k1", "n_chars"]
    kept = {i for i, _ in clean}
    assert {n: kept - ids for n, ids in seen.items()} == dict.fromkeys(seen, set())
    assert not seen["packing"] & {400, 500, 501, *(i for i, _ in toxic), *(i for i, _ in junk)}
    assert 400 in seen["near-duplicates"] and 500 in seen["quality classifier"] and {None, 502} <= seen["packing"]


def test_the_queries_carry_the_columns_asked_for(spark):
    from gazette.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op9_decontamination"](spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] and got.count() == 200
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) and len(QUERIES) == 13
