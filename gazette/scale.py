"""Execution helpers shared by the iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


_job: ContextVar[str | None] = ContextVar("job_folder", default=None)


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """Tables written inside go to a folder of their own, which is removed when the job ends.

    For jobs that store their result themselves, such as a micro-batch: nothing
    that was written inside can be read afterwards.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    token = _job.set(folder)
    try:
        yield folder
    finally:
        _job.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`; a fresh local one only where unset."""
    if _job.get():
        return _job.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.startswith("local")
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = os.environ.get("GAZETTE_LOCAL_CHECKPOINTS") or tempfile.mkdtemp(prefix="gazette-")
        os.environ["GAZETTE_LOCAL_CHECKPOINTS"] = folder
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Materialise a table in the shared folder: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row, however many filters and columns use them.

    A filter is moved below the projection it looks at and repeats its expressions; it is not moved below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system is there."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def number_rows(df: DataFrame, keys: list[str], order: str, name: str = "n") -> DataFrame:
    """Gap-free zero-based `name` per `keys` in `order` (unique per key).

    Rows are dealt out and sorted by ranges, and numbered as they are written; the
    running counts of the ranges give each its offset, so a single task sees one row per range.
    """
    placed = df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    placed = written(placed.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranges")
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).drop("_rows", "_first")
    # Without keys there is one offset per range, which need not move the rows.
    offsets = offsets if keys else F.broadcast(offsets)
    return (
        placed.join(offsets, [*keys, "_range"])
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_range", "_row", "_offset")
    )


def in_order(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Whole numbers `name` that grow with `keys`: the range of a row and its place in it, with gaps between ranges.

    The bounds of the ranges are sampled before the rows are dealt out, so the rows are written first: what makes them runs once.
    """
    placed = written(df, "unordered").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(placed.withColumn(name, F.monotonically_increasing_id()), "ordered")
