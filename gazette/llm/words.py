"""Words of whole texts as arrays: Arrow text buffers in, word hashes and shingles out.

A word is a run of ASCII letters (lower-cased), digits and bytes of non-ASCII
characters. Everything works on one chunk of rows at a time, so memory follows
the chunk and the longest single text, not the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SHINGLE = 5

_byte = np.arange(256)
FOLD = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, 0)
FOLD = np.where(((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128), _byte, FOLD).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_HASH = mix(_byte.astype(np.uint64) + np.uint64(1))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        out = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        out[0] = 1
        known = _powers[base] = np.multiply.accumulate(out)
    return known[:n]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and per text the number of its first word (n + 1 values)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    folded = FOLD[data]
    word = folded != 0
    near = np.empty(n, bool)
    near[0], near[1:] = False, word[:-1]
    near[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(word & ~near)
    near[-1], near[:-1] = False, word[1:]
    near[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~near) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_HASH[folded] * powers(n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(n, _INVERSE)[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words, with the position of its first word; a text of fewer words, but not none, is one run."""
    n = len(hashes)
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(n)
    lead = np.zeros(n, bool)
    lead[first[:-1][counts > 0]] = True
    at = np.flatnonzero((left >= k) | (lead & (left < k)))
    reach = np.minimum(left[at], k)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = reach.astype(np.uint64)
    for j in range(k):
        out = out + np.where(reach > j, padded[at + j], np.uint64(0)) * _STEPS[j + 1]
    return mix(out), at


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive positions in `first`."""
    kind = values.dtype if values.dtype.kind in "uf" else np.int64
    total = np.concatenate([np.zeros(1, kind), np.cumsum(values, dtype=kind)])
    return total[first[1:]] - total[first[:-1]]


def without(columns: list[str], replaced: list[str]) -> list[str]:
    """The columns that keep their place beside new ones."""
    new = {c.lower() for c in replaced}
    return [c for c in columns if c.lower() not in new]


def append_columns(df, text: str, make: Callable, schema: str, keep_text: bool = True):
    """Every row of `df` with the columns of `schema` after its own, without the text unless `keep_text`.

    `make(data, offsets)` gets a chunk of texts and returns one sequence per
    new column. A column of the table that has the name of a new one is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(schema)
    names = df.columns
    handed = without([c for c in names if keep_text or c != text], extra.names)

    def run(batches):
        added = to_arrow_schema(extra)
        for batch in batches:
            data, offsets = buffer_of(batch.column(names.index(text)))
            for a, b in row_chunks(offsets):
                new = make(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = batch.slice(a, b - a)
                arrays = [*(rows.column(names.index(c)) for c in handed), *(v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(new, added, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*handed, *added.names])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in handed), *extra.fields]))
