"""Source registry jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gazette.operators.stats import unsafe_rule


def select_sources(sources: DataFrame, n: int, ids: list[int] | None = None) -> DataFrame:
    """Named sources, else the enabled ones; trusted first, then by name; at most `n` (a run's quota)."""
    chosen = sources.where(F.col("id").isin(ids)) if ids else sources.where("enabled")
    return chosen.orderBy(F.desc("trusted"), "name", "id").limit(n)


def registry_order(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.desc("enabled"), "name", "id")


def unsafe_sources(sources: DataFrame) -> DataFrame:
    return sources.where(unsafe_rule())


def new_sources(discovered: DataFrame, sources: DataFrame) -> DataFrame:
    """Unseen start URLs as disabled, untrusted, pending sources; the first finder is kept."""
    columns = [c for c in discovered.columns if c != "start_url"]
    first = discovered.groupBy("start_url").agg(F.min_by(F.struct(*columns), F.struct("source_id", "name")).alias("row"))
    fresh = first.select("start_url", "row.*").join(sources.select("start_url"), "start_url", "left_anti")
    return fresh.withColumns(
        {"enabled": F.lit(False), "trusted": F.lit(False), "auto_publish": F.lit(False), "review_status": F.lit("PENDING")}
    )


def guard_delete_sources(sources: DataFrame, listings: DataFrame) -> DataFrame:
    """Sources no listing refers to."""
    used = listings.where(F.col("source_id").isNotNull()).select(F.col("source_id").alias("id")).distinct()
    return sources.join(used, "id", "left_anti")


def edit_sources(sources: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next registry, rejected edits) for validated edits.

    An edit is rejected when it is invalid, names no source, or its start URL
    would belong to two sources.
    """
    fields = [c for c in sources.columns if c in edits.columns and c != "id"]
    valid = edits.where(F.col("error").isNull()).select("id", F.struct(*fields).alias("_edit"))
    joined = sources.join(valid, "id", "left")
    planned = joined.withColumn("_url", F.coalesce("_edit.start_url", "start_url"))
    owners = planned.groupBy("_url").agg(F.count(F.lit(1)).alias("_owners"))
    checked = planned.join(owners, "_url")
    apply = F.col("_edit").isNotNull() & (F.col("_owners") == 1)
    following = checked.withColumns(
        {c: F.when(apply, F.col(f"_edit.{c}")).otherwise(F.col(c)) for c in fields}
    ).select(*sources.columns)
    done = checked.where(apply).select("id")
    duplicate = checked.where(F.col("_edit").isNotNull() & (F.col("_owners") > 1)).select("id").withColumn("_dup", F.lit(True))
    rejected = (
        edits.join(done, "id", "left_anti")
        .join(duplicate, "id", "left")
        .select(
            "id",
            F.coalesce(
                "error", F.when(F.col("_dup"), "A source with this start URL already exists."), F.lit("Source not found.")
            ).alias("error"),
        )
    )
    return following, rejected
