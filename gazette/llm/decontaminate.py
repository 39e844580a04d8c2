"""Benchmark decontamination as a prefix-filtered set join.

Every window of ten consecutive item words (all words of a shorter item) must
be contained whole, so the necessary prefix of a window, its words ordered by
rarity over all documents, is its single rarest word. Documents are probed for
those words only; a hit word at place j of a window bounds where the window
would begin and end inside the document (position and length bounds), and what
is left is compared word by word.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gazette.llm.words import append_columns, buffer_of, row_chunks, split_words, without
from gazette.scale import written

WINDOW = 10
BLOCK_BYTES = 8_000_000
_FOUND = "hit_items array<string>"


class _Windows:
    """The windows of one block of items, word by word."""

    def __init__(self, rows: list[tuple[str, str]], width: int):
        self.items = [i for i, _ in rows]
        data, offsets = buffer_of(pa.array([t for _, t in rows], pa.large_string()))
        hashes, _, _, first = split_words(data, offsets)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        words, lengths, owner = [], [], []
        for item in range(len(rows)):
            own = ids[first[item] : first[item + 1]]
            size = min(width, len(own))
            if size:
                view = np.full((len(own) - size + 1, width), -1, np.int64)
                view[:, :size] = np.lib.stride_tricks.sliding_window_view(own, size)
                words.append(view)
                lengths.append(np.full(len(view), size))
                owner.append(np.full(len(view), item))
        self.words = np.concatenate(words) if words else np.zeros((0, width), np.int64)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        # One bit per 18-bit word prefix keeps most document words away from the search.
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.vocabulary >> np.uint64(46)).astype(np.int64)] = True

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that no item has."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(46)).astype(np.int64)])
        if len(at) and len(self.vocabulary):
            place = np.searchsorted(self.vocabulary, hashes[at]).clip(max=len(self.vocabulary) - 1)
            out[at] = np.where(self.vocabulary[place] == hashes[at], place, -1)
        return out

    def order(self, frequency: np.ndarray) -> None:
        """Index every window by its rarest word."""
        rank = np.empty(len(frequency) + 1, np.int64)
        rank[np.argsort(frequency, kind="stable")] = np.arange(len(frequency))
        rank[-1] = np.iinfo(np.int64).max  # padding of short windows
        place = np.argmin(rank[self.words], axis=1) if len(self.words) else np.zeros(0, np.int64)
        rarest = self.words[np.arange(len(place)), place]
        by = np.argsort(rarest, kind="stable")
        self.listed, self.place = by, place[by]
        self.first = np.searchsorted(rarest[by], np.arange(len(frequency) + 1))

    def find(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word position and window number of every occurrence."""
        at = np.flatnonzero(ids >= 0)
        at = at[self.first[ids[at] + 1] > self.first[ids[at]]]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = self.first[ids[at] + 1] - self.first[ids[at]]
        entry = np.repeat(self.first[ids[at]] - np.cumsum(lists) + lists, lists) + np.arange(lists.sum())
        text = np.searchsorted(first, at, side="right") - 1
        begin = np.repeat(at, lists) - self.place[entry]
        window = self.listed[entry]
        fits = (begin >= np.repeat(first[text], lists)) & (begin + self.lengths[window] <= np.repeat(first[text + 1], lists))
        begin, window = begin[fits], window[fits]
        for j in range(self.words.shape[1]):
            want = self.words[window, j]
            same = (want < 0) | (ids[np.minimum(begin + j, len(ids) - 1)] == want)
            begin, window = begin[same], window[same]
        return begin, window


def _frequencies(docs: DataFrame, text: str, windows: _Windows) -> np.ndarray:
    """In how many documents every item word occurs; as many rows as the block has words."""

    def run(batches):
        total = np.zeros(len(windows.vocabulary), np.int64)
        for batch in batches:
            data, offsets = buffer_of(batch.column(0))
            for a, b in row_chunks(offsets):
                hashes, _, _, first = split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = windows.look_up(hashes)
                at = np.flatnonzero(ids >= 0)
                text_no = np.searchsorted(first, at, side="right")
                seen = np.unique(text_no * len(total) + ids[at]) if len(at) else at
                total += np.bincount(seen % max(len(total), 1), minlength=len(total))
        word = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(total[word])], names=["word", "n"])

    out = np.zeros(len(windows.vocabulary), np.int64)
    for word, n in docs.select(text).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    """The items in blocks of about `block_bytes` of text, each safe to hold in a task."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for block in range(n):
        yield n, [(r.i, r.t) for r in (rows if n == 1 else rows.where(part == block)).collect()]


def mark(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = True,
) -> DataFrame:
    """Every document row with the words that lie inside an occurrence of an item window.

    Adds n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined item
    ids), contaminated and hit_runs (half-open ranges of word numbers). Null and
    wordless texts have no words and no hits; items without words have no window;
    a null item id counts as the empty string; equal item rows count once. Other
    columns pass through; those with the names of added ones are replaced.

    Items go to the tasks in blocks of `block_bytes`; with more than one block
    the documents are passed once per block, keeping the runs found so far.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_runs"]
    names = without([c for c in docs.columns if keep_text or c != text], added)
    # Columns of the table may carry any name, so they are numbered meanwhile.
    columns = [f"_c{i}" for i in range(len(names))]
    docs = docs.select(*(F.col(f"`{n}`").alias(c) for n, c in zip(names, columns, strict=True)), *([] if text in names else [F.col(f"`{text}`").alias("_text")]))
    text = columns[names.index(text)] if text in names else "_text"
    state = "hit_runs array<struct<begin:bigint,end:bigint>>, " + _FOUND + ", n_words bigint"
    out = docs
    for number, (n, rows) in enumerate(_blocks(items, item_id, item_text, block_bytes)):
        windows = _Windows(rows, window)
        windows.order(_frequencies(docs, text, windows))
        if number:
            out = out.withColumnsRenamed({"hit_runs": "_runs", "hit_items": "_items"}).drop("n_words")
        out = append_columns(out, text, _finder(windows), state, keep_text or number < n - 1)
        if number:
            out = out.withColumn("hit_runs", F.concat("_runs", "hit_runs")).withColumn("hit_items", F.concat("_items", "hit_items")).drop("_runs", "_items")
        if n > 1:
            out = written(out, "marked")
    return _digest(out, columns, n > 1).withColumnsRenamed(dict(zip(columns, names, strict=True)))


def _finder(windows: _Windows):
    def make(data, offsets):
        hashes, _, _, first = split_words(data, offsets)
        begin, window = windows.find(windows.look_up(hashes), first)
        n_texts = len(offsets) - 1
        runs: list = [[] for _ in range(n_texts)]
        found: list = [[] for _ in range(n_texts)]
        if len(begin):
            change = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + windows.lengths[window], -1)
            hit = np.cumsum(change[:-1]) > 0
            lead = np.zeros(len(hashes), bool)
            lead[first[:-1][first[:-1] < len(hashes)]] = True
            before = np.concatenate([[False], hit[:-1]]) & ~lead
            after = np.concatenate([hit[1:] & ~lead[1:], [False]])
            text = np.searchsorted(first, begin, side="right") - 1
            starts, stops = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
            owner = np.searchsorted(first, starts, side="right") - 1
            for t, a, b in zip(owner.tolist(), (starts - first[owner]).tolist(), (stops - first[owner]).tolist(), strict=True):
                runs[t].append({"begin": a, "end": b})
            for key in np.unique(text * len(windows.items) + windows.owner[window]).tolist():
                found[key // len(windows.items)].append(windows.items[key % len(windows.items)])
        return runs, found, np.diff(first)

    return make


def _digest(out: DataFrame, columns: list[str], blocks: bool) -> DataFrame:
    run = "struct<begin:bigint,end:bigint>"
    # Runs of several blocks may overlap: sort, then merge neighbours.
    merged = F.expr(
        f"aggregate(array_sort(hit_runs), cast(array() as array<{run}>), (done, r) -> case when size(done) > 0 and r.begin <= element_at(done, -1).end "
        f"then concat(slice(done, 1, size(done) - 1), array(named_struct('begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, r.end)))) "
        f"else concat(done, array(r)) end)"
    )
    if blocks:
        out = out.withColumn("hit_runs", F.when(F.size("hit_runs") > 1, merged).otherwise(F.col("hit_runs")))
    items = F.array_sort(F.array_distinct("hit_items"))
    hit = F.aggregate("hit_runs", F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["begin"])
    return out.select(
        *columns, "n_words", hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hit_runs") > 0).alias("contaminated"), "hit_runs",
    )


def item_digest(ids: list[str]) -> str:
    """The digest of a set of item ids, as `mark` gives it."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
