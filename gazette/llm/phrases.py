"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases, phrases are named by their content, and the
names are cut again, level by level. Cuts follow from the neighbourhood only: every
symbol gets a label from the lowest bit in which it differs from the symbol before
(deterministic coin tossing, repeated until six labels are left) and a phrase begins
at each label greater than both neighbours; a run of equal symbols is cut into
threes from its start. So equal substrings get equal phrases but for a few at their
ends, wherever they stand. A fingerprint keeps the smallest hashes of the phrases of
the third level (some thirteen bytes each), counted with repeats; short texts keep
those of the lower levels too.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gazette.llm.words import BYTE_HASH, CHUNK_BYTES, append_columns, buffer_of, mix, row_chunks
from gazette.scale import written

LEVELS = 3
#: Hashes kept of a level; texts of fewer top phrases than `SHORT` keep the lower levels, and are compared on the second from `PLAIN` phrases on.
KEPT, SHORT, PLAIN = 64, 12, 6
#: Bytes of text in a part of the sorted table.
PART_BYTES = 32 << 20

_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.multiply.accumulate(np.full(64, _STEP))


def _toss(size: int) -> np.ndarray:
    """Labels of (own, before): twice the place of the lowest differing bit, plus the own bit there; equal ones as if the lowest differed."""
    own, before = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    low = (own ^ before) & -(own ^ before)
    place = np.log2(np.maximum(low, 1)).astype(np.int64)
    return (2 * place + ((own >> place) & 1)).astype(np.uint8)


_BYTES, _NAMES = _toss(256), _toss(128)


def _labels(x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Labels 0..5, different for neighbours that differ; `fresh` symbols have no neighbour before them."""
    before = np.empty_like(x)
    before[0], before[1:] = x[0], x[:-1]
    if x.dtype == np.uint8:
        label = _BYTES[x, before]
        label[fresh] = x[fresh] & 1
    else:
        differ = x ^ before
        differ[fresh] = 1
        low = differ & (~differ + np.uint64(1))
        place = (low.astype(np.float64).view(np.int64) >> 52) - 1023
        place[place < 0] = 0
        label = (2 * place + ((x >> place.astype(np.uint64)) & np.uint64(1)).astype(np.int64)).astype(np.uint8)
    for _ in range(3):
        before = np.empty_like(label)
        before[0], before[1:] = label[0], label[:-1]
        label = np.where(fresh, label & 1, _NAMES[label, before])
    return label


def cut(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the phrases of a sequence of symbols begin; `first` are the positions of its texts (n + 1 values)."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    lead = np.zeros(n, bool)
    lead[first[:-1][first[:-1] < first[1:]]] = True
    same = np.zeros(n, bool)
    same[1:] = (x[1:] == x[:-1]) & ~lead[1:]
    label = _labels(x, lead | same)
    run = same.copy()
    run[:-1] |= same[1:]
    begin = lead.copy()
    peak = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~lead[1:-1] & ~lead[2:] & ~run[1:-1]
    begin[1:-1] |= peak
    begin[1:] |= run[:-1] & ~run[1:]
    at = np.flatnonzero(run)
    if len(at):
        opens = ~same[at]
        start = np.maximum.accumulate(np.where(opens, at, 0))
        begin[at[(at - start) % 3 == 0]] = True
    return np.flatnonzero(begin)


def name(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name of the content of every phrase."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(begin, len(x)))
    place = np.arange(len(x)) - np.repeat(begin, sizes)
    symbols = BYTE_HASH[x] if x.dtype == np.uint8 else x
    return mix(np.add.reduceat(symbols * _POWERS[place], begin) + sizes.astype(np.uint64))


def parse(data: np.ndarray, offsets: np.ndarray, levels: int = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the names of the phrases of a chunk of texts and, per text, the number of its first phrase (n + 1 values)."""
    out, x, first = [], data, offsets
    for _ in range(levels):
        begin = cut(x, first)
        x, first = name(x, begin), np.searchsorted(begin, first)
        out.append((x, first))
    return out


def _smallest(names: np.ndarray, first: np.ndarray, kept: int) -> list[np.ndarray]:
    """Per text the smallest 40-bit hashes of its phrases, the repeats of a phrase counted as phrases of their own."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((names, text))
    names, text = names[order], text[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    nth = np.arange(len(names)) - np.maximum.accumulate(np.where(new, np.arange(len(names)), 0)) if len(names) else np.zeros(0, np.int64)
    value = mix(names + nth.astype(np.uint64) * _STEP) >> np.uint64(24)
    value = value[np.lexsort((value, text))]
    return [value[a : min(b, a + kept)] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


#: Of a level: how many phrases a text has, and its smallest hashes.
Sketch = tuple[int, np.ndarray]


def sketches(data: np.ndarray, offsets: np.ndarray) -> list[list[Sketch]]:
    """Per text its sketch of the top level, and those of the lower ones below it if it is short."""
    levels = parse(data, offsets)
    names, first = levels[-1]
    out = [[(int(n), own)] for n, own in zip(np.diff(first), _smallest(names, first, KEPT), strict=True)]
    short = np.flatnonzero(np.diff(first) < SHORT)
    for names, first in levels[-2::-1]:
        sizes = np.diff(first)[short]
        picked = np.repeat(first[short] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        for i, n, own in zip(short.tolist(), sizes.tolist(), _smallest(names[picked], np.append(0, np.cumsum(sizes)), KEPT), strict=True):
            out[i].append((n, own))
    return out


def written_form(sketch: list[Sketch]) -> str:
    """The fingerprint as text: per level the number of phrases and the hashes, ten digits each."""
    return "|".join(f"{n}:{own.astype('>u8').view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()}" for n, own in sketch)


def read_form(fingerprint: str) -> list[Sketch]:
    """The sketches of a fingerprint."""
    out = []
    for part in fingerprint.split("|"):
        n, digits = part.split(":")
        raw = np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 3:] = raw
        out.append((int(n), wide.view(">u8").ravel().astype(np.uint64)))
    return out


def likeness(a: list[Sketch], b: list[Sketch]) -> float:
    """Shared phrases of all phrases (with repeats), estimated from the smallest; 1 for two empty texts."""
    level = 0
    if len(a) > 1 and len(b) > 1:
        level = 1 if min(a[1][0], b[1][0]) >= PLAIN else 2
    (n, one), (m, two) = a[level], b[level]
    if not n or not m:
        return float(n == m)
    both = np.sort(np.concatenate([one, two]))
    twice = np.append(both[1:] == both[:-1], False)
    new = np.append(True, ~twice[:-1])
    union, shared = both[new], twice[new]
    # A level kept whole on both sides is compared whole; else the smallest of the union stand for it.
    if n > len(one) or m > len(two):
        shared = shared[:KEPT]
    return float(shared.sum() / len(shared)) if len(union) else 1.0


def fingerprints(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Every document row with n_chars (code points) and fingerprint.

    A null text counts as empty; equal texts have equal fingerprints. Other
    columns pass through, those with the names of added ones are replaced.
    """

    def make(data, offsets):
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        return np.diff(chars), [written_form(s) for s in sketches(data, offsets)]

    return append_columns(docs, text, make, "n_chars bigint, fingerprint string", keep_text)


def alike(a: str, b: str) -> Column:
    """The likeness of two fingerprint columns, null where one is null."""

    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(read_form(p), read_form(q)) for p, q in zip(x, y)], dtype="float64")

    return compare(F.col(a), F.col(b))


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _sorted_parts(docs: DataFrame, doc_id: str, text: str, part_bytes: int) -> DataFrame | None:
    """Rows (borrowed, doc_id, text) in parts by falling id; after the rows of a part stands the first one of the next."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.withColumns({"unnamed": F.col("doc_id").isNull(), "back": F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("bigint")), "h": F.xxhash64("text")})
    slim = written(keyed.select("unnamed", "back", "h", F.octet_length("text").cast("bigint").alias("size")), "keys")
    n, size = slim.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return None
    parts = max(1, min(n, math.ceil(size / part_bytes)))
    # One bound per part: its first row.
    key = F.struct("unnamed", "back", "h")
    least = slim.repartitionByRange(parts, "unnamed", "back", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("key")).collect()
    bounds = sorted((r.key.unnamed, r.key.back, r.key.h) for r in least)
    state = docs.sparkSession.sparkContext.broadcast(bounds)

    def deal(batches):
        bounds = state.value
        for batch in batches:
            keys = [*zip(*(batch.column(c).to_pylist() for c in ("unnamed", "back", "h")))]
            part = np.array([bisect_right(bounds, k) - 1 for k in keys], np.int32)
            again = np.array([i for i, k in enumerate(keys) if bounds[part[i]] == k], np.int64)
            for at, to, borrowed in ((None, part, False), (again, (part[again] - 1) % len(bounds), True)):
                own = batch if at is None else batch.take(pa.array(at))
                if own.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(to), borrowed)), *own.columns], names=["part", "borrowed", *own.schema.names])

    dealt = keyed.mapInArrow(deal, "part int, borrowed boolean, doc_id bigint, text string, unnamed boolean, back bigint, h bigint")
    return dealt.repartitionById(len(bounds), F.col("part")).sortWithinPartitions("borrowed", "unnamed", "back", "h").select("borrowed", "doc_id", "text")


def _compare(batches):
    """The rows of one part in order, each with its edited text and the row after it."""

    def settle(ids, texts):
        # The last text is only the follower of the one before it.
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        found = []
        for group in (texts, changed):
            data, offsets = buffer_of(pa.array(group, pa.large_string()))
            found.append([s for a, b in row_chunks(offsets) for s in sketches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])])
        own, other = found
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": [written_form(s) for s in own[:-1]], "edited_fingerprint": [written_form(s) for s in other],
            "near_edited": [likeness(a, b) for a, b in zip(own, other)], "near_next": [likeness(a, b) for a, b in zip(own, own[1:])],
        })

    ids, texts, size = [], [], 0
    for batch in batches:
        borrowed, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            if borrowed[i]:
                # Of the first rows of the next part only the first follows.
                if ids:
                    yield settle(ids, [*texts, batch.column(2)[i].as_py()])
                ids, texts = [], []
                continue
            text = batch.column(2)[i].as_py()
            if size > CHUNK_BYTES:
                yield settle(ids, [*texts, text])
                ids, texts, size = [], [], 0
            ids.append(numbers[i])
            texts.append(text)
            size += len(text)


_COMPARED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Every document against its edited text and against the next document, by falling id.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The last third of the code points of the edited text are the first
    ones of the next document's; the next of the last is the first, so a single
    document follows itself. Null texts count as empty; two empty texts have
    likeness 1, an empty and another one 0. Null ids come last; rows of equal id
    follow each other by the hash of their text, and repeated rows are documents
    of their own. Other columns are not read.

    Texts are moved once, to the part of their id; the first row of every part is
    also sent to the part before it. No part holds more than the rows between two
    of its bounds, and a task holds about a megabyte of text and its two longest
    neighbours at a time.
    """
    parts = _sorted_parts(docs, doc_id, text, part_bytes)
    if parts is None:
        return docs.sparkSession.createDataFrame([], _COMPARED)
    return parts.mapInArrow(_compare, _COMPARED)
