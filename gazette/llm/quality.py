"""Quality: heuristic labellers weighed by expectation maximisation, then a hashed linear scorer.

Overlapping heuristics vote good, bad or nothing on every document. The votes
of all documents are counted by pattern (at most 3^10 patterns, whatever the
corpus), and expectation maximisation over those counts estimates the accuracy
of each labeller. The posterior of a pattern is the label of its documents; a
bounded sample of them trains a linear scorer over hashed character-shape
trigrams, which judges every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gazette.llm.linear import fit, sigmoid
from gazette.llm.words import append_columns, buffer_of, per_text, row_chunks, split_words
from gazette.scale import written

GOOD, BAD = 1, 2
LABELLERS = ("capitals", "symbols", "bars", "shouting", "repeats", "echoes", "plainness", "word length", "no words", "digits")
#: Documents the scorer learns from, those whose text hashes lowest.
SAMPLE_ROWS = 10_000
DIMENSION_BITS = 12
#: Factor on the log odds of the posterior labels.
SHARPEN = 3.0
THRESHOLD = 0.3
_ROWS = 256

_byte = np.arange(256)
_IS = {
    "upper": (_byte >= 65) & (_byte <= 90), "letter": ((_byte | 32) >= 97) & ((_byte | 32) <= 122) & (_byte < 128),
    "symbol": np.isin(_byte, [ord(c) for c in "#$%&*@^~=<>{}[]\\"]), "bar": _byte == ord("|"), "shout": _byte == ord("!"),
    "digit": (_byte >= 48) & (_byte <= 57),
}
_IS["plain"] = _IS["letter"] | (_byte >= 128) | np.isin(_byte, [ord(c) for c in " \n.,;:'\"-()?"])
#: Shape of a byte: capitals, small letters, digits and bytes of other alphabets are one sign each.
SHAPE = np.where(_IS["upper"], 65, np.where(_IS["letter"], 97, np.where(_IS["digit"], 48, np.where(_byte >= 128, 128, _byte)))).astype(np.int64)
_REPEAT = 0


def _measures(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    hashes, starts, ends, first = split_words(data, offsets)
    words = np.diff(first)
    place = np.arange(len(hashes)) - np.repeat(first[:-1], words)
    same, echo = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (place[1:] >= 1)
    echo[2:] = (hashes[2:] == hashes[:-2]) & (place[2:] >= 2)
    out = {k: per_text(v[data].astype(np.int64), offsets) for k, v in _IS.items()}
    return out | {"same": per_text(same, first), "echo": per_text(echo, first), "word_bytes": per_text(ends - starts, first), "bytes": np.diff(offsets)}, words


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The pattern of votes of every text: a number in base 3, one digit per labeller."""
    m, words = _measures(data, offsets)
    over = lambda k, d: m[k] / np.maximum(d, 1)
    some = words >= 5

    def vote(bad, good=False):
        return np.where(some & bad, BAD, np.where(some & good, GOOD, 0))

    mean, plain = over("word_bytes", words), over("plain", m["bytes"])
    each = [
        vote((over("upper", m["letter"]) > 0.3) & (m["letter"] >= 20)),
        vote(over("symbol", words) > 0.05),
        vote(over("bar", words) > 0.03),
        vote(over("shout", words) > 0.15),
        vote(over("same", words) > 0.15),
        vote(over("echo", words) > 0.15),
        vote(plain < 0.9, plain > 0.97),
        vote((mean > 14) | (mean < 2)),
        np.where(words == 0, BAD, 0),
        vote(over("digit", m["bytes"]) > 0.3),
    ]
    return sum(v * 3**j for j, v in enumerate(each))


def pattern_counts(docs: DataFrame) -> dict[int, int]:
    """How many of all documents show each pattern of votes."""

    def run(batches):
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            data, offsets = buffer_of(batch.column(0))
            for a, b in row_chunks(offsets):
                total += np.bincount(votes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pattern", "n"])

    found = docs.select("text").mapInArrow(run, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r.pattern: r.n for r in found.collect()}  # at most 3^10 rows


def posteriors(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """P(good) of every pattern and the accuracy of every labeller, by expectation maximisation.

    A labeller that votes is right with its own probability, on good and bad
    documents alike; one that does not vote says nothing. Both classes are
    equally likely beforehand, so a pattern without votes has 0.5. All
    accuracies start at 0.8, held there by ten imagined votes.
    """
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    vote = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    sign = (vote == GOOD).astype(float) - (vote == BAD)
    accuracy = np.full(len(LABELLERS), 0.8)
    for _ in range(rounds):
        q = sigmoid(sign @ np.log(accuracy / (1 - accuracy)))
        right = (n * q) @ (vote == GOOD) + (n * (1 - q)) @ (vote == BAD)
        accuracy = np.clip((right + 8) / (n @ (vote != 0) + 10), 0.05, 0.99)
    return dict(zip(patterns.tolist(), q.tolist(), strict=True)), accuracy


def _shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text log(1 + count per 1,000 bytes) of every hashed shape trigram, and of repeated words in the first column."""
    n, size = len(offsets) - 1, 1 << DIMENSION_BITS
    m, words = _measures(data, offsets)
    shape = SHAPE[data]
    out = np.zeros((n, size))
    if len(data) >= 3:
        gram = ((shape[:-2] * 0x9E3779B1 + shape[1:-1]) * 0x85EBCA77 + shape[2:]) * 0xC2B2AE3D & 0xFFFFFFFF
        row = np.repeat(np.arange(n), np.diff(offsets))
        inside = row[:-2] == row[2:]
        at = 1 + (gram >> (32 - DIMENSION_BITS)) % (size - 1)
        out += np.bincount(row[:-2][inside] * size + at[inside], minlength=n * size).reshape(n, size)
    out *= 1000 / np.maximum(np.diff(offsets), 200)[:, None]
    out[:, _REPEAT] = 1000 * m["same"] / np.maximum(words, 20)
    return np.log1p(out)


def _blocks(offsets: np.ndarray):
    for a in range(0, len(offsets) - 1, _ROWS):
        yield a, min(a + _ROWS, len(offsets) - 1)


def featurize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    columns, values, counts = [], [], []
    for a, b in _blocks(offsets):
        block = _shapes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        row, column = np.nonzero(block)
        columns.append(column)
        values.append(block[row, column])
        counts.append(np.bincount(row, minlength=b - a))
    return np.concatenate(columns), np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """Weights of the scorer from the votes on all documents; None for an empty table.

    Counts and accuracies cover all documents; the scorer learns from at most
    `sample_rows` texts.
    """
    label, _ = posteriors(pattern_counts(docs))
    if not label:
        return None
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("shard_key", F.xxhash64("text"))
    # The bound is found on hashes alone; of equal texts one is taken.
    last = texts.select("shard_key").distinct().orderBy("shard_key").limit(sample_rows).agg(F.max("shard_key")).first()[0]
    picked = written(texts.where(F.col("shard_key") <= last).dropDuplicates(["shard_key"]), "quality-sample")

    # The scorer learns the more likely class; how sure the votes are only softens it.
    target = {p: float(sigmoid(SHARPEN * np.log(q / (1 - q)))) for p, q in label.items()}

    def make(data, offsets):
        return (np.array([target[p] for p in votes(data, offsets).tolist()]),)

    sample = append_columns(picked, "text", make, "target double").select("shard_key", "text", "target")
    return fit(sample, featurize, 1 << DIMENSION_BITS, alpha=0.3, l1=0.02, l2=0.1, rounds=6, shards=4)


def score(docs: DataFrame, weights: np.ndarray | None, column: str = "quality", keep_text: bool = True) -> DataFrame:
    """Every row with its quality, from 0 to 1, as a function of the text alone.

    Null, empty and wordless texts are scored as empty: by the bias. For an
    empty table the result is empty. Ids are not read; other columns pass through, but one with
    the name of the score is replaced.
    """

    def make(data, offsets):
        return (np.concatenate([
            sigmoid(_shapes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) @ weights[:-1] + weights[-1]) for a, b in _blocks(offsets)
        ]),)

    return append_columns(docs, "text", make, f"{column} double", keep_text)
