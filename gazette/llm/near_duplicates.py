"""Near-duplicate documents: consistent weighted sampling over TF-IDF word shingles.

The shingles of a text (five words) weigh by their count and by the mean
inverse document frequency of their words, counted over all documents in hashed
slots. Improved consistent weighted sampling draws 48 samples of the weighted
shingles; two texts agree in a sample with the probability of their weighted
Jaccard similarity. Texts that agree in a band of four samples meet in a
bucket. In the tasks the pairs of a bucket are verified by their true weighted
Jaccard similarity, except pairs that are already connected, and only a
spanning set of links leaves the task. A large bucket is cut into blocks that all
get the same few representatives: texts connected with one another over a
representative need no more comparing, so only those left over meet the other
blocks. Texts of equal words, by two 64-bit hashes, are one entry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gazette.llm.components import components
from gazette.llm.words import SHINGLE, append_columns, buffer_of, mix, per_text, powers, row_chunks, shingles, split_words
from gazette.scale import written

THRESHOLD = 0.8
BANDS, ROWS = 12, 4
SLOT_BITS = 18
#: Texts of a bucket that are compared with one another in one piece of work, and representatives that every block of a large bucket gets.
BLOCK, REPRESENTATIVES = 256, 8
#: Bits of the filter that keeps texts out that no bucket holds.
FILTER_BITS = 1 << 26
#: Texts a task remembers to hand on equal ones once.
SEEN = 1_000_000

_seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _gamma(size: int) -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2, P(x) = 1 - (1 + x) exp(-x), by bisection."""
    p = (np.arange(size) + 0.5) / size
    low, high = np.zeros(size), np.full(size, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low


_STEP = _gamma(1 << 12).astype(np.float32)
_STEP_INVERSE = (1 / _STEP).astype(np.float32)
_LOG = np.log(_gamma(1 << 16)).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts the words of each hashed slot occur, and the number of texts: 2^18 counts for any corpus."""

    def run(batches):
        total = np.zeros(1 << SLOT_BITS, np.int64)
        texts = 0
        for batch in batches:
            data, offsets = buffer_of(batch.column(0))
            texts += batch.num_rows
            for a, b in row_chunks(offsets):
                hashes, _, _, first = split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                whose = np.repeat(np.arange(b - a), np.diff(first))
                once = pd.unique(whose << SLOT_BITS | slot)
                total += np.bincount(once & ((1 << SLOT_BITS) - 1), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], texts))], names=["slot", "n"])

    got = docs.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[slot[slot >= 0]] = n[slot >= 0]
    return out, int(n[slot < 0].sum())


def inverse(frequencies: np.ndarray, texts: int) -> np.ndarray:
    """Inverse document frequency from 1 (a word in all texts) to 2 (in none), so that no rare word outweighs many others."""
    return 1 + np.log((texts + 1) / (frequencies + 1)) / np.log(texts + 2)


def _keys(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of all words of every text, 0 for none."""
    words = np.diff(start)
    back = np.arange(len(hashes)) - np.repeat(start[:-1], words)
    keys = []
    for p in (powers(len(hashes) + 1), powers(len(hashes) + 1, 0xC2B2AE3D27D4EB4F | 1)):
        k = mix(per_text(hashes * p[back], start) + words.astype(np.uint64))
        keys.append(np.where(words > 0, k, np.uint64(0)).view(np.int64))
    return keys[0], keys[1]


def weighted(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of every text in order, their counts and mean idf, and the keys of the texts.

    Gives (shingle, count, idf, first, keys): shingles of text i lie from
    first[i] to first[i + 1]; keys are two hashes of all words, 0 for none.
    """
    hashes, _, _, start = split_words(data, offsets)
    n, n_texts = len(hashes), len(offsets) - 1
    words = np.diff(start)
    whose = np.repeat(np.arange(n_texts), words)
    values, at = shingles(hashes, start)
    share = np.concatenate([[0.0], np.cumsum(idf[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)])])
    end = np.minimum(at + SHINGLE, np.repeat(start[1:], words)[at] if n else at)
    mean = (share[end] - share[at]) / np.maximum(end - at, 1)
    own = whose[at]
    codes, distinct = pd.factorize(values ^ mix(own.astype(np.uint64) + np.uint64(7)))
    lead = np.empty(len(distinct), np.int64)
    lead[codes[::-1]] = np.arange(len(codes))[::-1]
    counts = np.bincount(codes, minlength=len(distinct))
    # factorize numbers by first place, so the texts stay in order.
    return values[lead], counts, mean[lead], np.searchsorted(own[lead], np.arange(n_texts + 1)), _keys(hashes, start)


def samples(values: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: (texts with shingles, 48) identities, for texts from `first` that have shingles."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), BANDS * ROWS), np.uint32)
    if not len(starts):
        return out
    log_weight = np.log(weight).astype(np.float32)
    for k, seed in enumerate(_seeds):
        u = (values ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        u ^= u >> np.uint64(31)
        u *= np.uint64(0x94D049BB133111EB)
        step = (u >> np.uint64(52)).astype(np.int64)
        shift = ((u >> np.uint64(36)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        r = _STEP[step]
        level = np.floor(log_weight * _STEP_INVERSE[step] + shift)
        key = _LOG[((u >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (level - shift + 1)
        bits = key.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))
        identity = (u ^ (u >> np.uint64(32))).astype(np.uint32) + level.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        out[:, k] = np.minimum.reduceat(bits.astype(np.uint64) << np.uint64(32) | identity, starts).astype(np.uint32)
    return out


def _sketch(idf: np.ndarray):
    def make(data, offsets):
        values, counts, mean, first, (k1, k2) = weighted(data, offsets, idf)
        some = np.diff(first) > 0
        drawn = samples(values, (1 + np.log(counts)) * mean, first).astype(np.uint64).reshape(-1, BANDS, ROWS)
        bands = np.zeros((len(drawn), BANDS), np.uint64)
        for j in range(ROWS):
            bands = mix(bands * np.uint64(31) + drawn[:, :, j] + np.uint64(j + 1))
        bands = mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32), pa.array(bands.ravel()))
        return pa.array(k1, mask=~some), pa.array(k2, mask=~some), lists

    return make


def _layers(values: np.ndarray, counts: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that a text has or has not, whose shared weight is the minimum of the weights: one per occurrence of a shingle."""
    level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    gain = np.where(level == 0, 1.0, np.log1p(1 / np.maximum(level, 1)))
    names = np.repeat(values, counts)
    return np.where(level == 0, names, mix(names + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), gain * np.repeat(mean, counts)


def _linked(features: list[np.ndarray], weights: list[np.ndarray], block: np.ndarray, cross: bool, threshold: float) -> np.ndarray:
    """The number of the first text that each is connected with, by links inside one piece of work."""
    m = len(features)
    label = np.arange(m)
    total = np.array([w.sum() for w in weights])

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)

    if m <= 12:
        for i in range(m):
            for j in range(i + 1, m):
                if (cross and block[i] == block[j]) or min(total[i], total[j]) < threshold * max(total[i], total[j]) or find(i) == find(j):
                    continue
                _, at, _ = np.intersect1d(features[i], features[j], assume_unique=True, return_indices=True)
                shared = weights[i][at].sum()
                if shared >= threshold * (total[i] + total[j] - shared) - 1e-9:
                    join(i, j)
        return np.array([find(i) for i in range(m)])
    owner = np.repeat(np.arange(m), [len(f) for f in features])
    codes, distinct = pd.factorize(np.concatenate(features))
    weight = np.concatenate(weights)
    # Shared weight of all pairs, a few thousand columns at a time; features of one text are left out.
    often = np.flatnonzero(np.bincount(codes, minlength=len(distinct)) > 1)
    column = np.full(len(distinct), -1, np.int64)
    column[often] = np.arange(len(often))
    at = np.flatnonzero(column[codes] >= 0)
    at = at[np.argsort(column[codes[at]], kind="stable")]
    own, col, root = owner[at], column[codes[at]], np.sqrt(weight[at])
    shared = np.zeros((m, m))
    for low in range(0, len(often), 4096):
        a, b = np.searchsorted(col, [low, low + 4096])
        dense = np.zeros((m, min(4096, len(often) - low)))
        dense[own[a:b], col[a:b] - low] = root[a:b]
        shared += dense @ dense.T
    whole = total[:, None] + total[None, :]
    over = shared - threshold * (whole - shared)
    # Sums of products err by far less than this share of the weights; pairs so close to the threshold are summed as small pieces of work are.
    link = over >= -1e-6 * whole
    if cross:
        link &= block[:, None] != block[None, :]
    for i, j in zip(*np.nonzero(np.triu(link, 1)), strict=True):
        if find(i) != find(j):
            if over[i, j] <= 1e-6 * whole[i, j]:
                _, place, _ = np.intersect1d(features[i], features[j], assume_unique=True, return_indices=True)
                exact = weights[i][place].sum()
                if exact < threshold * (total[i] + total[j] - exact) - 1e-9:
                    continue
            join(i, j)
    return np.array([find(i) for i in range(m)])


_FOUND = "key bigint, k1 bigint, k2 bigint, r1 bigint, r2 bigint, link boolean"


def _verify(rows: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Spanning links of every piece of work; rows (key, left, right, block, k1, k2, text) come sorted by the work.

    Where a piece holds representatives (block -1), every other text of it also
    gives a row without `link`: the first representative it is connected with, or nulls.
    """

    def run(batches):
        pending: list[pa.RecordBatch] = []
        for batch in batches:
            pending.append(batch)
            table = pa.Table.from_batches(pending).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("key", "left", "right")])
            turns = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            # The last piece of work may go on in the next batch.
            if len(turns):
                yield from judge(table.slice(0, int(turns[-1])))
                pending = table.slice(int(turns[-1])).to_batches()
        if pending:
            yield from judge(pa.Table.from_batches(pending))

    def judge(table):
        keys = np.stack([table.column(c).to_numpy() for c in ("key", "left", "right")])
        edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
        k1, k2, blocks = (table.column(c).to_numpy() for c in ("k1", "k2", "block"))
        data, offsets = buffer_of(table.column("text"))
        features: list = []
        weights: list = []
        done = 0
        # Rows as positions: (of the text, of its root or representative or -1, whether a link).
        told: list[tuple[np.ndarray, np.ndarray, bool]] = []
        for a, b in row_chunks(offsets):
            values, counts, mean, first, _ = weighted(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], idf)
            for i in range(b - a):
                own = slice(first[i], first[i + 1])
                f, w = _layers(values[own], counts[own], mean[own])
                features.append(f)
                weights.append(w)
            while done + 1 < len(edges) and edges[done + 1] <= b:
                low, high = int(edges[done]), int(edges[done + 1])
                found = _linked(features[low:high], weights[low:high], blocks[low:high], bool(keys[1, low] != keys[2, low]), threshold)
                moved = np.flatnonzero(found != np.arange(high - low))
                told.append((low + moved, low + found[moved], True))
                stands = blocks[low:high] < 0
                if stands.any():
                    first_of = np.full(high - low, -1)
                    at = np.flatnonzero(stands)[::-1]
                    first_of[found[at]] = at
                    others = np.flatnonzero(~stands)
                    label = first_of[found[others]]
                    told.append((low + others, np.where(label < 0, -1, low + label), False))
                features[low:high] = weights[low:high] = [None] * (high - low)
                done += 1
        own, to = (np.concatenate([t[i] for t in told]).astype(np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[0][own]), pa.array(k1[own]), pa.array(k2[own]), pa.array(k1[to], mask=to < 0), pa.array(k2[to], mask=to < 0), pa.array(np.concatenate([np.full(len(t[0]), t[2]) for t in told]))],
            names=["key", "k1", "k2", "r1", "r2", "link"],
        )

    return rows.mapInArrow(run, _FOUND)


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over (k1, k2): 8 to 16 bits a key up to `FILTER_BITS`, beyond which it lets more through."""
    bits = min(FILTER_BITS, 1 << max(10, (8 * keys.count()).bit_length()))
    at = F.explode(F.array(*[F.pmod(F.col(k), F.lit(bits)) for k in ("k1", "k2")]))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _may_hold(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(64 * len(filter_) - 1)
    return filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) != 0


def _once_a_task(docs: DataFrame, keep: list[str], by_id: bool, among: np.ndarray | None = None) -> DataFrame:
    """Rows with their text keys (_k1, _k2); rows equal to one the task has handed on are left out if it remembers it.

    `among` is a filter of the keys that are asked for; rows outside it are left out.
    """

    def run(batches):
        seen: set = set()
        for batch in batches:
            data, offsets = buffer_of(batch.column(keep.index("text")))
            for a, b in row_chunks(offsets):
                hashes, _, _, start = split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                k1, k2 = _keys(hashes, start)
                asked = np.ones(b - a, bool) if among is None else _may_hold(among, k1) & _may_hold(among, k2)
                ids = batch.column(keep.index("doc_id")).slice(a, b - a).to_pylist() if by_id else [0] * (b - a)
                take = []
                for i, key in enumerate(zip(k1.tolist(), k2.tolist(), ids, strict=True)):
                    if not asked[i]:
                        continue
                    if key[0] or key[1]:
                        if key in seen:
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                    take.append(i)
                rows = batch.slice(a, b - a).take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(k1[take]), pa.array(k2[take])], names=[*keep, "_k1", "_k2"])

    return docs.select(*keep).mapInArrow(run, StructType([*(docs.schema[c] for c in keep), StructField("_k1", LongType()), StructField("_k2", LongType())]))


def _first_work(buckets: DataFrame, block: int) -> DataFrame:
    """(key, left, right, block, k1, k2): every text of a bucket (key, n, k1, k2) once, in a block, and the representatives of a large bucket in all its blocks."""
    place = F.xxhash64("k1", "k2", "key")
    own = buckets.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("block", F.pmod(place, F.col("blocks")))
    large = own.where("blocks > 1")
    # One representative per remainder of the hash: as many groups as representatives share a hot bucket's rows.
    stand = large.groupBy("key", F.pmod(F.hash("k2", "k1"), F.lit(REPRESENTATIVES)).alias("r")).agg(F.min(F.struct(place.alias("place"), "k1", "k2")).alias("s"), F.max("blocks").alias("blocks"))
    stand = stand.select("key", "s.k1", "s.k2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("left"))
    rows = own.select("key", F.col("block").alias("left"), F.col("block").alias("right"), "block", "k1", "k2")
    return rows.unionAll(stand.select("key", "left", F.col("left").alias("right"), F.lit(-1).cast("bigint").alias("block"), "k1", "k2"))


def _rest_work(labels: DataFrame, block: int) -> DataFrame:
    """The work left over in large buckets: texts outside the bucket's main group against one another and against the group.

    `labels` (key, k1, k2, r1, r2) holds every text of a large bucket with its
    representative. The main group is that of the representative of most texts; it is
    connected, so its pairs are done. Blocks of the others come first in number.
    """
    sizes = labels.groupBy("key", "r1", "r2").agg(F.count(F.lit(1)).alias("m"))
    known = F.when(F.col("r1").isNotNull(), F.struct("m", "r1", "r2"))
    main = sizes.groupBy("key").agg(F.max(known).alias("main"), F.sum("m").alias("n"))
    n_main = F.coalesce("main.m", F.lit(0))
    main = main.where(F.col("n") > n_main).select(
        "key", F.col("main.r1").alias("m1"), F.col("main.r2").alias("m2"), F.ceil((F.col("n") - n_main) / block).alias("others"), F.ceil(n_main / block).alias("blocks")
    )
    own = labels.join(main, "key").withColumn("inside", F.coalesce((F.col("r1") == F.col("m1")) & (F.col("r2") == F.col("m2")), F.lit(False)))
    place = F.xxhash64("k1", "k2", "key")
    own = own.withColumn("block", F.when(F.col("inside"), F.col("others") + F.pmod(place, F.col("blocks"))).otherwise(F.pmod(place, F.col("others"))))
    reach = F.when(F.col("inside"), F.col("others")).otherwise(F.col("others") + F.col("blocks"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), reach - 1)))
    return own.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "k1", "k2")


def _judged(docs: DataFrame, work: DataFrame, wanted: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The links and labels of all pieces of work, stored."""
    # Only texts that are compared are moved.
    texts = _once_a_task(docs, ["doc_id", "text"], by_id=False, among=_filter(wanted)).select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "text")
    # Sorted joins at every size: texts are dealt out by their key once, whatever fits a broadcast today.
    texts = texts.join(wanted.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    rows = texts.join(work.hint("merge"), ["k1", "k2"]).repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "k1", "k2")
    return written(_verify(rows.select("key", "left", "right", "block", "k1", "k2", "text"), idf, threshold), "text-links")


def classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, k1, k2, class_key) of every row of (doc_id, text), and the idf of all slots.

    Rows of one class_key (two hashes) are near-duplicates of one another, directly
    or over others; it is null for texts without words, which are in no class.
    """
    docs = docs.select("doc_id", "text")
    idf = inverse(*document_frequencies(docs))
    keyed = written(append_columns(docs, "text", _sketch(idf), "k1 bigint, k2 bigint, bands array<bigint>", keep_text=False), "sketches")
    nodes = written(keyed.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(F.first("bands").alias("bands")), "texts")
    banded = nodes.select("k1", "k2", F.explode("bands").alias("key"))
    # Buckets of the same texts in several bands are one bucket; those of one text are none.
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("k1", "k2")).alias("x"), F.sum(F.hash("k1", "k2").cast("bigint")).alias("s")).where("n > 1")
    kept = written(sizes.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    buckets = written(banded.join(kept, "key"), "bucket-texts")
    found = _judged(docs, _first_work(buckets, block), written(buckets.select("k1", "k2").distinct(), "compared"), idf, threshold)
    rest = written(_rest_work(found.where(~F.col("link")).drop("link"), block), "rest-work")
    if not rest.isEmpty():
        found = found.unionAll(_judged(docs, rest, written(rest.select("k1", "k2").distinct(), "compared"), idf, threshold))
    links = found.where("link").select(F.struct("k1", "k2").alias("a"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("b"))
    groups = components(links).select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "component")
    out = keyed.select("doc_id", "k1", "k2").join(groups, ["k1", "k2"], "left")
    return out.select("doc_id", "k1", "k2", F.when(F.col("k1").isNotNull(), F.coalesce("component", F.struct("k1", "k2"))).alias("class_key")), idf


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, class_id (the smallest id of its class), class_size, kept.

    Texts of equal words are of one class, as are those linked by a weighted
    Jaccard similarity of `threshold` or more; a text of one to four words is one
    shingle. Null, empty and wordless texts are classes of their own. Null ids
    count as larger than any other; a class of them alone has a null id. `kept`
    marks the rows whose id is the class id. Other columns are not read.
    """
    found = written(classes(docs, threshold)[0], "classes")
    least = found.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = found.join(least, "class_key", "left")
    own = F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", own.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` without near-duplicates: of every class the one of smallest id, and all wordless texts.

    Ties of one id go by the hash of the text; of rows that repeat both, one stays.
    Other columns pass through, whatever their names.
    """
    names = docs.columns
    others = {n: f"_c{i}" for i, n in enumerate(names) if n not in ("doc_id", "text")}
    docs = docs.withColumnsRenamed(others)
    columns = docs.columns
    found, _ = classes(docs, threshold)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "k1", "k2")).alias("w")
    winners = written(found.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(best).select("w.doc_id", "w.k1", "w.k2"), "kept-texts")
    rows = _once_a_task(docs, columns, by_id=True)
    wordless = (F.col("_k1") == 0) & (F.col("_k2") == 0)
    chosen = rows.where(~wordless).join(winners.withColumnRenamed("doc_id", "_winner"), (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("_winner")))
    kept = chosen.dropDuplicates(["_k1", "_k2"]).select(*columns).unionByName(rows.where(wordless).select(*columns))
    return kept.withColumnsRenamed({c: n for n, c in others.items()})
