"""Locally consistent parsing against a walk symbol by symbol, and fingerprints against whole sets of phrases."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gazette.llm import phrases
from gazette.llm.queries import QUERIES
from gazette.llm.words import buffer_of


def toss(own: int, before: int) -> int:
    place = 0
    while (own >> place) & 1 == (before >> place) & 1:
        place += 1
    return 2 * place + ((own >> place) & 1)


def walk(x: list[int]) -> list[int]:
    """Begins of the phrases of one sequence, one symbol at a time."""
    same = [i > 0 and x[i] == x[i - 1] for i in range(len(x))]
    label = x
    for _ in range(4):
        label = [label[i] & 1 if i == 0 or same[i] else toss(label[i], label[i - 1]) for i in range(len(x))]
    run = [same[i] or (i + 1 < len(x) and same[i + 1]) for i in range(len(x))]
    begins, start = [], 0
    for i in range(len(x)):
        if run[i] and not same[i]:
            start = i
        peak = 0 < i < len(x) - 1 and not run[i] and label[i - 1] < label[i] > label[i + 1]
        if i == 0 or peak or (run[i] and (i - start) % 3 == 0) or (run[i - 1] and not run[i]):
            begins.append(i)
    return begins


def content(text: str, level: int) -> list[tuple]:
    """The phrases of a level, each as nested tuples of bytes."""
    symbols, names = [*text.encode()], [*text.encode()]
    for _ in range(level):
        begins = walk(names)
        symbols = [tuple(symbols[a:b]) for a, b in zip(begins, [*begins[1:], len(symbols)])]
        names = [int(v) for v in phrases.name(np.array(names, np.uint64 if max(names, default=0) > 255 else np.uint8), np.array(begins, np.int64))]
    return symbols


def random_text(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghijklé"), r.integers(1, 9))) for _ in range(n))


TEXTS = ["", "a", "ab", "aa", "aaaaaaa", "abababab", "漢字かな", random_text(1, 40), "x" * 50 + "yz" + "x" * 50, "long " * 200, random_text(2, 3)]


def test_phrases_agree_with_the_walk():
    data, offsets = buffer_of(pa.array(TEXTS, pa.string()))
    levels = phrases.parse(data, offsets, 4)
    for i, text in enumerate(TEXTS):
        for level, (names, first) in enumerate(levels, 1):
            want, got = content(text, level), names[first[i] : first[i + 1]].tolist()
            # Equal content has equal names, other content others.
            assert len(want) == len(got) and len({*zip(want, got)}) == len({*want}) == len({*got})


def test_equal_substrings_share_their_inner_phrases_at_any_offset():
    shared = random_text(3, 300)
    one, two = random_text(4, 57) + shared + random_text(5, 9), "é" + shared + random_text(6, 100)
    data, offsets = buffer_of(pa.array([one, two, shared], pa.string()))
    for names, first in phrases.parse(data, offsets):
        a, b, c = (Counter(names[x:y].tolist()) for x, y in zip(first, first[1:]))
        assert (a & c).total() >= c.total() - 16 and (b & c).total() >= c.total() - 16


def whole_likeness(a: str, b: str) -> float | None:
    tops = [Counter(content(t, 3)) for t in (a, b)]
    if min(t.total() for t in tops) < phrases.SHORT:
        return None
    return (tops[0] & tops[1]).total() / (tops[0] | tops[1]).total()


def test_likeness_estimates_the_share_of_phrases():
    base = random_text(7, 400)
    for keep in (0, 100, 1000, len(base)):
        other = base[:keep] + random_text(8, 400)[keep:]
        data, offsets = buffer_of(pa.array([base, other], pa.string()))
        got = phrases.likeness(*phrases.sketches(data, offsets))
        assert abs(got - whole_likeness(base, other)) < 0.2
        assert got == phrases.likeness(*(phrases.read_form(phrases.written_form(s)) for s in phrases.sketches(data, offsets)))
    assert phrases.likeness(*[phrases.sketches(*buffer_of(pa.array([base])))[0]] * 2) == 1


ROWS = [(None, "no id at all"), (None, None), (1, None), (2, ""), (3, "!!!"), (4, "one"), (5, "Ünï 漢字 ok"), (6, "same text here"), (6, "same text here"), (7, "long " * 60_000), (-5, "below zero")]


@pytest.mark.parametrize("part_bytes", [1 << 25, 400])
def test_rows_meet_their_followers_across_parts(spark, part_bytes):
    r = np.random.default_rng(9)
    rows = [(i, t) for i, t in ROWS if i not in (6, None)] + [(int(i), random_text(100 + int(i), 5 + int(i) % 60)) for i in r.permutation(np.arange(10, 80))]
    docs = spark.createDataFrame([(*x, "a") for x in rows], "doc_id bigint, text string, fingerprint string").repartition(7)
    got = {x.doc_id: x for x in phrases.compare_with_next(docs, part_bytes=part_bytes).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: -x[0])
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        changed = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        forms = [phrases.written_form(s) for x in (t, changed) for s in phrases.sketches(*buffer_of(pa.array([x])))]
        assert [got[i].fingerprint, got[i].edited_fingerprint] == forms
        for near, other in ((got[i].near_edited, changed), (got[i].near_next, after)):
            want = whole_likeness(t, other) if len(t) < 2000 and len(other) < 2000 else None
            assert 0 <= near <= 1 and (want is None or abs(near - want) < 0.25)


def test_odd_rows(spark):
    schema = "doc_id bigint, text string"
    got = phrases.compare_with_next(spark.createDataFrame(ROWS, schema)).collect()
    assert sorted(x.doc_id is None for x in got) == sorted(i is None for i, _ in ROWS) and len(got) == len(ROWS)
    assert len({x.fingerprint for x in got if x.doc_id == 6}) == 1 and 1 in [x.near_next for x in got if x.doc_id == 6]
    single = phrases.compare_with_next(spark.createDataFrame([(1, "abcdefghi")], schema)).first()
    assert single.edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest() and single.near_next == 1
    assert phrases.compare_with_next(spark.createDataFrame([(1, ""), (2, None)], schema)).where("near_edited = 1 and near_next = 1").count() == 2
    assert phrases.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(1, "again and again")] * 9, schema).repartition(3)
    assert phrases.compare_with_next(same, part_bytes=20).where("near_next = 1").count() == 9
    marked = phrases.fingerprints(spark.createDataFrame(ROWS, schema).withColumn("n_chars", phrases.F.lit("x")))
    assert marked.columns == ["doc_id", "text", "n_chars", "fingerprint"] and marked.where("doc_id = 5").first().n_chars == 9
    pairs = marked.select(phrases.F.col("fingerprint").alias("a"), phrases.F.col("fingerprint").alias("b")).select(phrases.alike("a", "b").alias("x"))
    assert {x.x for x in pairs.collect()} == {1.0}


def test_the_query_tells_edits_from_neighbours(spark):
    got = QUERIES["op12_document_fingerprints"](spark, "/root/testdata/sf0.001").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()), reverse=True)
    by_id = {x.doc_id: x for x in got}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        assert by_id[i].edited_sha256 == hashlib.sha256(phrases.edited(t, after).encode()).hexdigest()
        if len(t) > 60 and t != after:
            assert by_id[i].near_edited > max(0.25, by_id[i].near_next) or by_id[i].near_next > 0.5
