"""Token ids in grammar-compressed binary shards.

Every shard is compressed by Re-Pair: the frequent neighbour pairs of symbols
are replaced by new symbols (nonterminals), again and again, until no pair has
`LEAST_USES` uses or the symbol space is used up: 2^16 symbols of two bytes where
they leave `LEAST_ROOM` beside the vocabulary, else 2^24 of three. Pairs never reach over the end of a
document. A round replaces the most frequent pairs together, left to right, so
a shard takes a few passes over its ids. The file keeps the rules, the length
each symbol expands to, and where each document begins, both in symbols and in
ids, so one document, or a range of ids in it, is decoded alone.

Layout (little endian): magic, five counts, document ids, null marks, symbol
and id offsets of the documents, rules, expansion lengths, symbols.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gazette.llm.files import RangeReader, new_folder, partition_id, write_whole
from gazette.llm.tokens import pieces_of
from gazette.scale import written

MAGIC = b"RPGRAM01"
END_ID = 0
#: Ids of one file; a longer document makes a file of its own.
SHARD_IDS = 1 << 22
#: Bytes of a symbol that are tried, and rules that must fit beside the vocabulary.
WIDTHS, LEAST_ROOM = (2, 3, 4), 1 << 12
PAIRS_A_ROUND = 2500
#: A pair of fewer uses saves hardly more than its rule takes.
LEAST_USES = 16
_BITS = 20


def _frequent(symbols: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places (but `ends`) of the `most` frequent neighbour pairs, the rank of the pair at each, and the pairs."""
    wide = symbols.view(np.uint64)
    key = wide[:-1] << np.uint64(32)
    key |= wide[1:]
    slot = key >> np.uint64(29)
    slot ^= key
    slot *= np.uint64(0x9E3779B97F4A7C15)
    slot >>= np.uint64(64 - _BITS)
    slot = slot.view(np.int64)
    slot[ends] = 1 << _BITS
    rough = np.bincount(slot, minlength=(1 << _BITS) + 1).astype(np.int32)
    rough[1 << _BITS] = 0

    def counted(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(slots[slot])
        codes, distinct = pd.factorize(key[at])
        return at, codes, distinct, np.bincount(codes, minlength=len(distinct))

    # A pair has no more uses than its slot, and `most` pairs of the fullest slots have `least`: the others
    # of its rank or a better one are in slots of as many.
    least, slots = LEAST_USES, np.flatnonzero(rough >= LEAST_USES)
    if len(slots) > 2 * most:
        full = np.zeros(len(rough), bool)
        full[slots[np.argpartition(rough[slots], -2 * most)[-2 * most :]]] = True
        uses = counted(full)[3]
        if len(uses) >= most:
            least = max(LEAST_USES, int(np.partition(uses, -most)[-most]))
    at, codes, distinct, uses = counted(rough >= least)
    best = np.lexsort((distinct, -uses))[:most]
    best = best[uses[best] >= LEAST_USES]
    rank = np.full(len(distinct), -1, np.int64)
    rank[best] = np.arange(len(best))
    ranks = rank[codes]
    hit = ranks >= 0
    return at[hit], ranks[hit], distinct[best]


def symbol_bytes(terminals: int) -> int:
    """Bytes of a symbol in files over a vocabulary of `terminals` ids."""
    return next(w for w in WIDTHS if terminals + LEAST_ROOM <= 1 << 8 * w)


def compress(ids: np.ndarray, first: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where documents begin among them (n + 1 values), and the rules as (left, right) rows."""
    symbols, starts, rules = ids.astype(np.int64), first.astype(np.int64), []
    known, space = 0, 1 << 8 * symbol_bytes(terminals)
    while len(symbols) > 1 and (room := min(PAIRS_A_ROUND, space - terminals - known)) > 0:
        ends = starts[1:] - 1
        at, rank, pairs = _frequent(symbols, ends[(ends >= 0) & (ends < len(symbols) - 1)], room)
        if not len(at):
            break
        # Of overlapping places every second one is taken, from the left.
        lead = np.concatenate([[True], np.diff(at) != 1])
        run = np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
        taken = (np.arange(len(at)) - run) % 2 == 0
        at = at[taken]
        symbols[at] = terminals + known + rank[taken]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        starts = starts - np.searchsorted(at + 1, starts)
        symbols = symbols[keep]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64))
        known += len(pairs)
    return symbols, starts, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for; a rule uses only terminals and earlier rules."""
    out = np.ones(terminals + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[terminals + i] = out[a] + out[b]
    return out[terminals:]


def encode_shard(doc_ids: list, ids: np.ndarray, first: np.ndarray, terminals: int) -> bytes:
    """One file of documents in the order given."""
    symbols, starts, rules = compress(ids, first, terminals)
    width = symbol_bytes(terminals)
    missing = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        MAGIC, np.array([len(doc_ids), terminals, len(rules), len(symbols), width], "<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), missing.tobytes(), starts.astype("<u8").tobytes(), first.astype("<u8").tobytes(),
        rules.astype("<u4").tobytes(), expansion_lengths(rules, terminals).astype("<u4").tobytes(), symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes(),
    ])


@dataclass
class Shard:
    """An open file: the index in memory, the symbols read as needed."""

    reader: RangeReader

    def __post_init__(self):
        if self.reader.read(0, 8) != MAGIC:
            raise ValueError("not a grammar shard")
        n, self.terminals, n_rules, n_symbols, self.width = np.frombuffer(self.reader.read(8, 40), "<u8").astype(int).tolist()
        at = 48

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(dtype).itemsize * count
            at += size
            return np.frombuffer(self.reader.read(at - size, size), dtype)

        ids, missing = take("<i8", n), take("u1", n)
        self.doc_ids = [None if m else d for d, m in zip(ids.tolist(), missing.tolist(), strict=True)]
        self.starts, self.first = take("<u8", n + 1).astype(np.int64), take("<u8", n + 1).astype(np.int64)
        rules, lengths = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64), take("<u4", n_rules).astype(np.int64)
        self.symbols_at = at
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), lengths])
        self.place = np.cumsum(self.lengths) - self.lengths
        flat = np.empty(self.place[-1] + self.lengths[-1], np.uint32)
        flat[: self.terminals] = np.arange(self.terminals)
        for i, (a, b) in enumerate(rules.tolist()):
            p = self.place[self.terminals + i]
            q = p + self.lengths[a]
            flat[p:q] = flat[self.place[a] : self.place[a] + self.lengths[a]]
            flat[q : q + self.lengths[b]] = flat[self.place[b] : self.place[b] + self.lengths[b]]
        self.flat = flat

    def _symbols(self, a: int, b: int) -> np.ndarray:
        wide = np.zeros((b - a, 4), np.uint8)
        wide[:, : self.width] = np.frombuffer(self.reader.read(self.symbols_at + a * self.width, (b - a) * self.width), np.uint8).reshape(-1, self.width)
        return wide.view("<u4").ravel().astype(np.int64)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.lengths[symbols]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.place[symbols] - ends + sizes, sizes)]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of one document, or some of them: only the symbols that cover them are expanded."""
        stop = int(self.first[i + 1] - self.first[i]) if stop is None else stop
        symbols = self._symbols(self.starts[i], self.starts[i + 1])
        ends = np.cumsum(self.lengths[symbols])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = ends[a - 1] if a else 0
        return self._expand(symbols[a:b])[start - before : stop - before]

    def documents(self, least_symbols: int = 1 << 18):
        """All documents in order as (number, ids), read in runs."""
        n, i = len(self.doc_ids), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + least_symbols, side="right")) - 1)
            ids = self._expand(self._symbols(self.starts[i], self.starts[j]))
            for k in range(i, j):
                yield k, ids[self.first[k] - self.first[i] : self.first[k + 1] - self.first[i]]
            i = j


def write_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of all documents, `end_id` after each, in files by ascending id; one row per file.

    Gives (part, number, path, n_docs, n_ids, bytes, start), with `start` the
    ids in all files before. Null and empty texts are the end id alone; null ids
    come first, repeated ids follow one another by text. Other columns are not
    read. A task holds one file's ids and the batch they come from.
    """
    folder = new_folder(docs.sparkSession, "token-ids")

    def run(batches):
        tokenizer = pieces_of(path)
        part, number = partition_id(), 0
        terminals = tokenizer.library.get_vocab_size()

        def flush(keys, parts):
            nonlocal number
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            name, size = write_whole(folder, f"part-{part:06d}-{number:06d}.rpg", [encode_shard(keys, np.concatenate(parts), first, terminals)])
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [name], "n_docs": [len(keys)], "n_ids": [int(first[-1])], "bytes": [size]})
            number += 1
            return row

        keys, parts, held = [], [], 0
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(ids_of), 256):
                flat, first = tokenizer.encode([t or "" for t in texts.slice(a, 256).to_pylist()])
                for i in range(len(first) - 1):
                    own = np.append(flat[first[i] : first[i + 1]], np.uint32(end_id))
                    if parts and held + len(own) > shard_ids:
                        yield flush(keys, parts)
                        keys, parts, held = [], [], 0
                    keys.append(ids_of[a + i])
                    parts.append(own)
                    held += len(own)
        if parts:
            yield flush(keys, parts)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = written(ordered.mapInArrow(run, "part bigint, number bigint, path string, n_docs bigint, n_ids bigint, bytes bigint"), "token-files")
    # One row per file.
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with RangeReader(name) as reader:
                    shard = Shard(reader)
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in shard.documents()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids, pa.int64()), pa.array(start + shard.first[:-1]), pa.array(np.diff(shard.first)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # A file is a unit of work; as many tasks read them as wrote them.
    tasks = files.select("part").distinct().count()
    return files.select("path", "start").repartition(max(tasks, 1)).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
