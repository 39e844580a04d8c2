"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by the ordered list of the pivots (reference vectors)
nearest to it. Inverted lists hold, per pivot, the vectors that have it among
their nearest. Inside a list, pairs sharing enough pivots are verified by their
cosine in double precision; a pair is judged only in the list of the smallest
pivot it shares, so none is counted twice. Pivots keep a least angle from one
another, so a dense group shares its few pivots and is judged whole. Long lists
are cut into blocks, and pairs of blocks are separate work; tasks hand back counts
and local components, never pairs. Equal vectors are one entry with a count. Every
length has pivots of its own; lengths of no more vectors than a block are one list.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gazette.llm.components import components
from gazette.scale import written

THRESHOLD = 0.95
#: Nearest pivots that describe a vector, and how many of them a pair must share.
NEAREST = 10
SHARED = 2
#: Pivots are the vectors whose hashes are lowest; their number follows the square root of all vectors up to a bound.
LEAST_PIVOTS, MOST_PIVOTS = 16, 16_384
#: Cosine of the least angle between two pivots.
APART = 0.8
#: Rows of a block; lists of more than `BLOCKS` blocks have larger ones, up to `LARGEST` times as large.
BLOCK, BLOCKS, LARGEST = 1024, 8, 16


def usable(embedding: str) -> F.Column:
    """Not null, not empty, no null, NaN or infinite component, not all zero."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def permutations(vectors: DataFrame, pivots: dict[int, tuple[int, np.ndarray]], nearest: int) -> DataFrame:
    """Every row with `pivots`, the numbers of its nearest pivots, nearest first.

    `pivots` holds, per length, the number of the first pivot and the pivots. A
    length without pivots has one list, numbered by the length below zero.
    """
    keep = vectors.columns

    def described(column: pa.Array, k: int) -> list[np.ndarray]:
        first, own = pivots.get(k, (-k, None))
        if own is None:
            return [np.array([-k], np.int32)] * len(column)
        return [*(np.argsort(-(_unit(_matrix(column)) @ own.T), axis=1, kind="stable")[:, :nearest] + first).astype(np.int32)]

    def run(batches):
        for batch in batches:
            out = [None] * batch.num_rows
            column, lengths = batch.column(keep.index("embedding")), batch.column(keep.index("k")).to_numpy()
            for k in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == k)
                for a in range(0, len(at), 1024):
                    for i, near in zip(at[a : a + 1024], described(column.take(pa.array(at[a : a + 1024])), k), strict=True):
                        out[i] = near
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out) if out else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*keep, "pivots"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("pivots", ArrayType(IntegerType()))]))


def thinned(sample: np.ndarray, apart: float = APART) -> np.ndarray:
    """Vectors of `sample` no two of which have a cosine of `apart` or more, those that stand for the most vectors last."""
    kept, stand = np.empty_like(sample), np.zeros(len(sample), np.int64)
    n = 0
    for a in range(0, len(sample), 512):
        part = sample[a : a + 512]
        old, inner, first = part @ kept[:n].T, part @ part.T, n
        near = old.argmax(axis=1) if n else None
        new = []
        for i in range(len(part)):
            if first and old[i, near[i]] >= apart:
                stand[near[i]] += 1
            elif new and inner[i, new].max() >= apart:
                stand[first + inner[i, new].argmax()] += 1
            else:
                kept[n] = part[i]
                new.append(i)
                n += 1
    return kept[:n][np.argsort(stand[:n], kind="stable")]


def _links(threshold: float, shared: int):
    def judge(table):
        pivot, left, right = (table.column(c)[0].as_py() for c in ("pivot", "left", "right"))
        table = table.take(np.argsort(table.column("node").to_numpy(), kind="stable"))
        size, node = table.column("size").to_numpy().astype(np.float64), table.column("node").to_numpy()
        embedding, lists = table.column("embedding").combine_chunks(), table.column("pivots").combine_chunks()
        held = lists.flatten().to_numpy().reshape(len(node), -1)
        block = table.column("block").to_numpy()
        ours, others = ([at[i : i + 1024] for i in range(0, len(at), 1024)] for at in (np.flatnonzero(block == left), np.flatnonzero(block == right)))
        if left == right:
            others = ours
        count, root = np.zeros(len(node)), np.arange(len(node))
        for i, a in enumerate(ours):
            one = _unit(_matrix(embedding.take(a)))
            for b in others[i:] if left == right else others:
                link = one @ _unit(_matrix(embedding.take(b))).T >= threshold
                if a is b:
                    np.fill_diagonal(link, False)
                if not link.any():
                    continue
                # Where there are few pivots, all vectors of the length have the same ones.
                least = min(shared, held.shape[1])
                known = np.intersect1d(held[a], held[b])
                has = []
                for rows in (held[a], held[b]):
                    place = np.minimum(np.searchsorted(known, rows), len(known) - 1)
                    has.append(np.zeros((len(rows), len(known)), np.float32))
                    at, nth = np.nonzero(known[place] == rows)
                    has[-1][at, place[at, nth]] = 1
                lower = known < pivot
                link &= (has[0] @ has[1].T >= least) & (has[0][:, lower] @ has[1][:, lower].T == 0)
                count[a] += link @ size[b]
                if a is not b:
                    count[b] += link.T @ size[a]
                while True:
                    best = root.copy()
                    best[a] = np.minimum(best[a], np.where(link, root[b][None, :], len(root)).min(axis=1))
                    best[b] = np.minimum(best[b], np.where(link, root[a][:, None], len(root)).min(axis=0))
                    if (best == root).all():
                        break
                    parent = np.arange(len(root))
                    np.minimum.at(parent, root, best)
                    while (parent[parent] != parent).any():
                        parent = parent[parent]
                    root = parent[root]
        at = np.flatnonzero(count > 0)
        return pa.table({"node": node[at], "h1": table.column("h1").take(at), "h2": table.column("h2").take(at), "k": table.column("k").take(at), "n": count[at].astype(np.int64), "label": node[root[at]]})

    return judge


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, nearest: int = NEAREST,
    shared: int = SHARED, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links join vectors of cosine `threshold` or more that share enough pivots;
    equal vectors are always linked. Null vectors, those with null or non-finite
    components, zero and empty ones link with nothing and are components of their
    own; vectors of different lengths are never linked. A row without an id links with
    nothing and has a null component. Repeated rows are separate vectors linked
    with each other. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"))
    linkable = F.col("vec_id").isNotNull() & usable("embedding")
    keyed = (
        rows.withColumn("h1", F.when(linkable, F.xxhash64("embedding"))).withColumn("h2", F.when(linkable, F.hash("embedding")))
        .withColumn("k", F.when(linkable, F.size("embedding")))
    )
    classes = written(
        keyed.where(F.col("h1").isNotNull()).groupBy("h1", "h2", "k")
        .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding")), "vectors",
    )
    # Lengths of more vectors than a block have pivots; these are few.
    pivots, numbered = {}, 0
    for k, n in classes.groupBy("k").count().where(F.col("count") > block).orderBy("k").collect():
        wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(2 * math.sqrt(n))))
        sample = classes.where(F.col("k") == k).select("embedding", "h1", "h2").orderBy("h1", "h2").limit(wanted).select("embedding")
        pivots[k] = numbered, thinned(_unit(_matrix(sample.toArrow().column(0))))
        numbered += len(pivots[k][1])
    described = written(permutations(classes, pivots, nearest), "permutations")
    # The smallest of the shared pivots is never among a vector's last ones; few pivots are the same for all vectors of a length.
    few = F.lit(1)
    for k, (_, own) in pivots.items():
        few = F.when(F.col("k") == k, F.lit(nearest - shared + 1 if len(own) > nearest else 1)).otherwise(few)
    posted = described.withColumn("pivot", F.explode(F.slice(F.array_sort("pivots"), F.lit(1), few)))
    # At most one row per pivot.
    blocks = {r.pivot: min(-(-r["count"] // block), max(BLOCKS, -(-r["count"] // (block * LARGEST)))) for r in posted.groupBy("pivot").count().where(F.col("count") > block).collect()}
    table = spark.createDataFrame([*blocks.items()] or [(0, 1)], "pivot int, blocks bigint")
    own = posted.join(F.broadcast(table), "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")))
    units = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    units = units.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    work = units.select("pivot", "left", "right", "block", "node", "h1", "h2", "k", "size", "embedding", "pivots").groupBy("pivot", "left", "right")
    found = written(work.applyInArrow(_links(threshold, shared), "node bigint, h1 bigint, h2 int, k int, n bigint, label bigint"), "vector-links")
    groups = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    counted = found.groupBy("h1", "h2", "k").agg(F.sum("n").alias("n"))
    result = classes.select("h1", "h2", "k", "node", "size").join(counted, ["h1", "h2", "k"], "left").join(groups, "node", "left")
    result = result.select("h1", "h2", "k", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = keyed.select("vec_id", "h1", "h2", "k").join(result, ["h1", "h2", "k"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
