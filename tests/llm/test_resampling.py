"""Importance resampling against a brute-force walk over the words, whatever the dictionary holds."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gazette.llm import resampling
from gazette.llm.words import buffer_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text) -> tuple[list[str], list[str]]:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_force(rows, target, buckets, least, percent):
    count = lambda texts: np.bincount([zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1]], minlength=buckets)
    s, t = count([x for _, x in rows]).tolist(), count(target).tolist()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        w, f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for place, r in enumerate(enough[: len(enough) * percent // 100]):
        r[5] = place + 1
    return out


def test_composed_checksums():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 63, 64, 65, 4096, 300_001):
        a, b = r.bytes(7), r.bytes(n)
        got = resampling.crc_join(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert int(got[0]) == zlib.crc32(a + b)


@pytest.mark.parametrize("known", [[], ["one"], ["one", "two", "ne", "o", "a1"], "all"])
def test_scans_emit_every_word_whatever_the_dictionary_holds(known):
    texts = ["One two,  two-one", None, "", "...", "o ne oné 漢字 x A1 a1!", "neone one", "two " * 50, "x" * 300_000 + " one"]
    if known == "all":
        known = sorted({w.encode().decode("latin-1") for t in texts for w in features(t)[0] if len(w) < 64})
    else:
        known = [w.encode().decode("latin-1") for w in known]
    data, offsets = buffer_of(pa.array(texts, pa.string()))
    crc, size, first = resampling.Payloads(known).scan(data, offsets)
    want = [[(zlib.crc32(w.encode()), len(w.encode())) for w in features(t)[0]] for t in texts]
    assert [[*zip(crc[a:b].tolist(), size[a:b].tolist())] for a, b in zip(first, first[1:])] == want


ROWS = [(None, "no id at all"), (1, None), (2, ""), (3, "!!!"), (4, "one"), (5, "Ünï 漢字 ok"), (6, "same text here"), (6, "same text here"), (7, "long " * 60_000), (None, "no id again")]


def test_draws_agree_with_brute_force(spark):
    r = np.random.default_rng(5)
    vocabulary = ["".join(r.choice(list("abcdé"), 3)) for _ in range(60)]
    rows = ROWS + [(100 + i, " ".join(r.choice(vocabulary, r.integers(1, 40)))) for i in range(150)]
    target = [None, "", " ".join(vocabulary[:20]), "Same TEXT"]
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id bigint, text string, `rank` string, `_key` int, `a.b` int").repartition(3)
    wanted = brute_force(rows, target, 50, 2, 40)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), buckets=50, least_words=2, percent=40)
    assert got.columns == ["doc_id", "text", "_key", "a.b", "n_words", "n_features", "weight", "score", "rank"]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(([x.doc_id, x.n_words, x.n_features, x.weight, x.score, x["rank"]] for x in got.collect()), key=key) == sorted(wanted, key=key)


def test_draws_from_nothing_and_towards_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    assert resampling.resample(none, some).count() == 0
    assert {x.weight for x in resampling.resample(some, none).where("n_words = 0").collect()} == {0}
    assert resampling.resample(some, none, least_words=0, percent=100).where("rank is null").count() == 0
