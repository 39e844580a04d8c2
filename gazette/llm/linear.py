"""Linear models over hashed features, fitted by FTRL-proximal in parallel shards.

The training rows are a bounded sample. Every round each shard continues from
the common state over its own rows, in a fixed order; the changes of the
accumulators (z, n) are averaged coordinate by coordinate in Spark. What comes
to the driver and goes out again is one row per coordinate, so its size is the
number of hashed features, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gazette.llm.words import buffer_of, row_chunks


def weights_of(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float, alpha: float, beta: float, l2: float) -> np.ndarray:
    """FTRL-proximal weights: exactly 0 where |z| is within l1."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _learner(state, featurize: Callable, dim: int, alpha: float, beta: float, l1: float, l2: float) -> Callable:
    """The pass over one shard: from the common state to the changes of it."""

    def learn(table):
        z, n = (x.copy() for x in state.value)
        table = table.sort_by([("shard_key", "ascending"), ("text", "ascending")])
        data, offsets = buffer_of(table.column("text"))
        targets = table.column("target").to_numpy()
        for a, b in row_chunks(offsets):
            columns, values, starts = featurize(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i in range(b - a):
                own = slice(starts[i], starts[i + 1])
                at, x = np.append(columns[own], dim), np.append(values[own], 1.0)
                bound = np.full(len(at), l1)
                bound[-1] = 0.0
                zi, ni = z[at], n[at]
                w = weights_of(zi, ni, bound, alpha, beta, l2)
                g = (sigmoid(w @ x) - targets[a + i]) * x
                z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
                n[at] = ni + g * g
        dz, dn = z - state.value[0], n - state.value[1]
        at = np.flatnonzero((dz != 0) | (dn != 0))
        return pa.table({"at": pa.array(at, pa.int64()), "dz": dz[at], "dn": dn[at]})

    return learn


def fit(
    sample: DataFrame, featurize: Callable, dim: int,
    alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, shards: int = 8, rounds: int = 3,
) -> np.ndarray:
    """dim weights and the bias from rows (shard_key bigint, text string, target double).

    `featurize(data, offsets)` gives (columns, values, row starts). Rows of a
    shard are taken by (shard_key, text); their number is the caller's bound.
    """
    spark = sample.sparkSession
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    rows = sample.withColumn("shard", F.pmod("shard_key", F.lit(shards)).cast("int"))
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        moved = rows.groupBy("shard").applyInArrow(_learner(state, featurize, dim, alpha, beta, l1, l2), "at bigint, dz double, dn double").groupBy("at")
        # Sums of doubles depend on their order: sort the few values of a coordinate first.
        moved = moved.agg(F.array_sort(F.collect_list("dz")).alias("dz"), F.array_sort(F.collect_list("dn")).alias("dn"))
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        got = moved.select("at", total("dz").alias("dz"), total("dn").alias("dn")).toArrow()
        at = got.column("at").to_numpy()
        z[at] += got.column("dz").to_numpy() / shards
        n[at] += got.column("dn").to_numpy() / shards
        state.unpersist()
    bound = np.full(dim + 1, l1)
    bound[-1] = 0.0
    return weights_of(z, n, bound, alpha, beta, l2)
