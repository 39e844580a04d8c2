"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A word enters whole and by its first four and five bytes, a plain stem that
joins inflected forms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gazette.llm.linear import fit, sigmoid
from gazette.llm.words import FOLD, append_columns, mix, split_words
from gazette.scale import written

DIMENSION_BITS = 18
#: Words, neighbours, and pairs with one or two words between.
GAPS = (1, 2, 3)
STEMS = (4, 5)
#: Labelled rows to learn from, taken by the order of a hash of their id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
HELD_OUT = 2


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of every word, neighbour pair and skip pair."""
    hashes, starts, ends, first = split_words(data, offsets)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = np.uint64(64 - DIMENSION_BITS)
    texts, features = [text], [mix(hashes) >> shift]
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        stem = np.full(len(long), size, np.uint64)
        for j in range(size):
            stem = stem * np.uint64(256) + FOLD[data[starts[long] + j]]
        texts.append(text[long])
        features.append(mix(stem) >> shift)
    for gap in GAPS:
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, bool)
        pair = mix(hashes[: len(same)] * np.uint64(2 * gap + 1) + mix(hashes[len(hashes) - len(same) :] + np.uint64(gap)))
        texts.append(text[: len(same)][same])
        features.append(pair[same] >> shift)
    return np.concatenate(texts), np.concatenate(features).astype(np.int64)


def featurize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each feature of a text once, with value 1."""
    text, feature = _hashed(data, offsets)
    keys = np.unique((text << DIMENSION_BITS) + feature)
    starts = np.searchsorted(keys, np.arange(len(offsets)) << DIMENSION_BITS)
    return keys & ((1 << DIMENSION_BITS) - 1), np.ones(len(keys)), starts


def held_out(doc_id: str = "doc_id"):
    """Rows no label is learned from: crc32 of the id as text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """Weights and bias from the labelled rows that are not held out; None without labels of both kinds.

    At most `sample_rows` labels are used, those whose ids hash lowest. An id
    labelled twice counts as toxic if any label says so; null labels are left
    out. The picked ids are at most `sample_rows`, so they are sent to all tasks.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    picked = (
        usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .select("doc_id", F.xxhash64("doc_id").alias("shard_key"), F.col("toxic").cast("double").alias("target"))
        .orderBy("shard_key", "doc_id").limit(sample_rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = written(texts.join(F.broadcast(picked), "doc_id").select("shard_key", "text", "target"), "toxicity-sample")
    if sample.select("target").distinct().count() < 2:
        return None
    return fit(sample, featurize, 1 << DIMENSION_BITS, alpha=0.3, l1=1.0, l2=0.1, shards=4, rounds=6)


def scorer(weights: np.ndarray | None):
    """The scores of a chunk of texts; only the nonzero weights travel."""
    kept = None if weights is None else np.flatnonzero(weights[:-1])
    value, bias = (None, 0.0) if weights is None else (weights[kept], float(weights[-1]))

    def make(data, offsets):
        n = len(offsets) - 1
        if kept is None:
            return (np.zeros(n),)
        table = np.zeros(1 << DIMENSION_BITS)
        table[kept] = value
        text, feature = _hashed(data, offsets)
        at = np.flatnonzero(table[feature])
        keys = np.unique((text[at] << DIMENSION_BITS) + feature[at])
        sums = np.bincount(keys >> DIMENSION_BITS, table[keys & ((1 << DIMENSION_BITS) - 1)], minlength=n) if len(keys) else np.zeros(n)
        return (sigmoid(sums + bias),)

    return make


def score(docs: DataFrame, weights: np.ndarray | None, column: str = "score", keep_text: bool = True) -> DataFrame:
    """Every row with its toxicity, from 0 to 1, as a function of the text alone.

    Null and wordless texts score as the bias does. Without both kinds of
    labels (`weights` None) every score is 0. Rows, ids (null and repeated
    ones too) and other columns pass through; one with the name of the score is
    replaced.
    """
    return append_columns(docs, "text", scorer(weights), f"{column} double", keep_text)
