"""Target-distribution importance resampling over hashed word runs.

A dictionary of words, each bounded by delimiters, carries per word the CRC-32 and
the length of its bytes as payload. One Aho-Corasick scan of a folded text emits
the payloads in order. CRCs compose: crc(a + b) is crc(a) shifted by the length of
b, xor crc(b), so the bucket of every run of two words follows from neighbouring
payloads without touching the text again. Words between two emitted ones, which
the bounded dictionary does not hold, get their payload on the spot, so results
don't depend on what it holds. Buckets of all documents and of all target texts are
counted in Spark; the gains (one whole number a bucket) go back to the tasks.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gazette.llm.words import FOLD, append_columns, buffer_of, row_chunks, without
from gazette.scale import number_rows, written

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Words of the dictionary, bytes of the longest, and distinct words that a task counts at a time.
DICTIONARY, LONGEST, HELD = 1 << 16, 64, 1 << 18

_SPACED = np.where(FOLD == 0, 32, FOLD).astype(np.uint8)


# CRC-32 composition


def _crc_steps(reach: int = 64, bits: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """What a CRC becomes by 0..reach-1 zero bytes, and by 64, 128, ... of them, byte by byte of the CRC."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    table = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    small = []
    for _ in range(reach):
        small.append(table)
        table = (table >> 8) ^ one[table & 255]
    large = []
    for _ in range(bits):
        large.append(table)
        table = _moved(table, table)
    return np.stack(small), np.stack(large)


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_SMALL, _LARGE = _crc_steps()
_SPACE = np.uint32(zlib.crc32(b" "))


def crc_join(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of joined byte strings from theirs and the length of the second."""
    at = (size & 63) * 1024
    flat = _SMALL.reshape(-1)
    out = flat[at + (first & 255)] ^ flat[at + 256 + ((first >> 8) & 255)] ^ flat[at + 512 + ((first >> 16) & 255)] ^ flat[at + 768 + (first >> 24)]
    rest, bit = size >> 6, 0
    while rest.any():
        out = np.where(rest & 1, _moved(out, _LARGE[bit]), out)
        rest, bit = rest >> 1, bit + 1
    return out ^ second


# The dictionary


class Payloads:
    """The automaton over a bounded list of words (bytes as Latin-1 characters) and their payloads."""

    def __init__(self, words: list[str]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            self.automaton.add_word(f" {w} ", i)
        if words:
            self.automaton.make_automaton()
        raw = [w.encode("latin-1") for w in words]
        self.crc = np.array([zlib.crc32(w) for w in raw], np.uint32)
        self.size = np.array([len(w) for w in raw], np.int64)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC and length of every word of a chunk of texts, in order, and per text the number of its first word (n + 1 values)."""
        lengths = np.diff(offsets)
        spaced = np.full(len(data) + len(lengths) + 1, 32, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths) + 1] = _SPACED[data]
        text = spaced.tobytes().decode("latin-1")
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2) if len(self.crc) else np.zeros((0, 2), np.int64)
        code, end = found[:, 1], found[:, 0]
        begin = end - self.size[code]
        # Between the space after one word and the space before the next only unknown words can stand.
        opens, closes = np.append(0, end) + 1, np.append(begin - 1, len(text) - 1)
        at, crc, size = [], [], []
        for i in np.flatnonzero(closes > opens).tolist():
            place = int(opens[i])
            for word in text[place : int(closes[i])].split(" "):
                if word:
                    raw = word.encode("latin-1")
                    at.append(place)
                    crc.append(zlib.crc32(raw))
                    size.append(len(raw))
                place += len(word) + 1
        begin = np.concatenate([begin, np.array(at, np.int64)])
        order = np.argsort(begin, kind="stable")
        crc = np.concatenate([self.crc[code], np.array(crc, np.uint32)])[order]
        size = np.concatenate([self.size[code], np.array(size, np.int64)])[order]
        return crc, size, np.searchsorted(begin[order], offsets + np.arange(len(offsets)))

    def buckets(self, data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all words and of all pairs of neighbours, per text the number of its first word, and which words lead a pair."""
        crc, size, first = self.scan(data, offsets)
        last = np.zeros(len(crc), bool)
        last[first[1:][first[1:] > first[:-1]] - 1] = True
        lead = np.flatnonzero(~last)
        spaced = crc_join(crc[lead], _SPACE, np.ones(len(lead), np.int64))
        pairs = crc_join(spaced, crc[lead + 1] if len(lead) else crc[:0], size[lead + 1] if len(lead) else size[:0])
        return crc % buckets, pairs % buckets, first, lead


_built: dict[str, Payloads] = {}


def _payloads(state) -> Payloads:
    """The automaton of a worker process, built once for all its tasks."""
    key, words = state.value[:2]
    if key not in _built:
        _built.clear()
        _built[key] = Payloads(words)
    return _built[key]


def _word_counts(batches):
    """Words that a task meets more than once, with their counts."""
    held: Counter = Counter()

    def told():
        known = [(w, n) for w, n in held.items() if n > 1 and 0 < len(w) <= LONGEST]
        return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in known], pa.string()), "n": pa.array([n for _, n in known], pa.int64())})

    for batch in batches:
        data, offsets = buffer_of(batch.column(0))
        for a, b in row_chunks(offsets):
            for i in range(a, b):
                held.update(_SPACED[data[offsets[i] : offsets[i + 1]]].tobytes().decode("latin-1").split(" "))
            if len(held) > HELD:
                yield told()
                held.clear()
    yield told()


def dictionary(texts: list[DataFrame], size: int = DICTIONARY) -> list[str]:
    """The `size` most frequent words of the texts, as Latin-1 characters; which words it holds changes the speed only."""
    counts = texts[0].mapInArrow(_word_counts, "word string, n bigint")
    for t in texts[1:]:
        counts = counts.unionAll(t.mapInArrow(_word_counts, "word string, n bigint"))
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return top.select("word").toArrow().column(0).to_pylist()


# Counting and scoring


def bucket_counts(texts: DataFrame, state, buckets: int) -> np.ndarray:
    """How often all texts hold each bucket."""

    def run(batches):
        payloads, total = _payloads(state), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = buffer_of(batch.column(0))
            for a, b in row_chunks(offsets):
                words, pairs, _, _ = payloads.buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                total += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1) / (T + B)) / ((s + 1) / (S + B)))) of every bucket."""
    s_all, t_all = float(int(source.sum()) + len(source)), float(int(target.sum()) + len(target))
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _scorer(state):
    def make(data, offsets):
        gain = state.value[2]
        words, pairs, first, lead = _payloads(state).buckets(data, offsets, len(gain))
        sums = lambda v, at: np.append(0, np.cumsum(v))[at]
        # As many pairs come before a text as words before it lead one.
        before = np.searchsorted(lead, first)
        total = np.diff(sums(gain[words], first)) + np.diff(sums(gain[pairs], before))
        n_words = np.diff(first)
        features = n_words + np.diff(before)
        return n_words, features, np.where(features > 0, total // np.maximum(features, 1), 0)

    return make


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, keep_text: bool = True) -> DataFrame:
    """Every document row with n_words, n_features and weight, the floored mean gain of its features (none: 0).

    A word is a run of ASCII letters (lower-cased), digits and non-ASCII
    characters; features are words and pairs of neighbours, with repeats. Null and
    wordless texts have no features. Other columns pass through, those with the
    names of added ones are replaced.
    """
    context = docs.sparkSession.sparkContext
    sides = [docs.select(F.col(text).alias("t")), target.select(F.col(target_text).alias("t"))]
    key, words = uuid.uuid4().hex, dictionary(sides)
    state = context.broadcast((key, words))
    source, wanted = (bucket_counts(side, state, buckets) for side in sides)
    state.unpersist()
    scoring = context.broadcast((key, words, gains(source, wanted)))
    return append_columns(docs, text, _scorer(scoring), "n_words bigint, n_features bigint, weight bigint", keep_text)


def gumbel(doc_id: str, seed: int = SEED) -> F.Column:
    """floor(-1000 ln(-ln u)) with u from the SHA-256 of seed and id, the same on every machine."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, keep_text: bool = True,
) -> DataFrame:
    """Every document row with n_words, n_features, weight, score and rank.

    Of the documents of `least_words` words or more, floor(percent * N / 100) are
    drawn: those of the highest score (weight plus a Gumbel number of seed and
    id), ties to the smaller id. `rank` counts them from 1; it is null for all
    others. Null texts have no words and weight 0; a null id counts as an empty
    one in the Gumbel number and comes last in ties; repeated rows are separate
    documents. With an empty target every bucket's gain follows the documents
    alone. Other columns pass through, those with the names of added ones are
    replaced; without `keep_text` the text is left out.
    """
    added = ["n_words", "n_features", "weight", "score", "rank", "_key", "_range", "_rank", "_offset"]
    columns = [c for c in docs.columns if keep_text or c != text]
    kept = without(columns, added[:5])
    # Columns of the table may carry any name, so they are numbered meanwhile.
    numbered = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    scored = weigh(numbered, target, "_text", target_text, buckets, keep_text=False)
    scored = written(scored.withColumn("score", F.col("weight") + gumbel("_id", seed)), "weighed")
    enough = F.col("n_words") >= least_words
    draws = scored.where(enough).count() * percent // 100
    key = F.struct(-F.col("score"), F.col("_id").isNull(), F.col("_id"), F.col("n_features"), F.col("weight"))
    ranked = number_rows(scored.where(enough).withColumn("_key", key), [], "_key", "rank").withColumn("rank", F.when(F.col("rank") < draws, F.col("rank") + 1))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("bigint"))
    out = ranked.drop("_key").unionByName(rest)
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)), *added[:5])
