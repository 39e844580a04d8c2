"""Counters and reports: one aggregation pass each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gazette import vocabulary as V
from gazette.functions.dates import days_between, is_past, ts
from gazette.operators.listing import active, active_rule, contains_text, tool_status_rule


def _soon(deadline: Column, now: Column) -> Column:
    return days_between(deadline, now).between(0, V.CLOSING_DAYS)


def listing_stats(df: DataFrame, now: datetime | str, public: bool = False) -> DataFrame:
    """Board totals; closing soon looks at the earliest deadline of published rows."""
    rows, now = (active(df, now) if public else df), ts(now)
    earliest = F.least("last_date", "expires_at")
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(contains_text("category", "government")).alias("government"),
        F.count_if(contains_text("category", "private")).alias("private"),
        F.count_if(active_rule(now)).alias("active"),
        F.count_if((F.col("status") == "PUBLISHED") & _soon(earliest, now)).alias("closing_soon"),
        F.count_if((F.col("status") == "EXPIRED") | is_past("last_date", now) | is_past("expires_at", now)).alias("expired"),
        F.count_if("featured").alias("featured"),
    )


def status_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("status") == "PUBLISHED").alias("published"),
        F.count_if(F.col("status") == "DRAFT").alias("drafts"),
        F.count_if("featured").alias("featured"),
    )


def distribution(counts: DataFrame, labels: dict[str, str], total: str = "total") -> DataFrame:
    """Counters of a one-row report as label, value and whole percentage of the total."""
    rows = F.array(*[F.struct(F.lit(text).alias("label"), F.col(c).alias("value")) for c, text in labels.items()])
    percent = F.least(F.lit(100), F.floor(F.col("value") * 100 / F.col("total") + F.lit(0.5)))
    return (
        counts.select(F.col(total).alias("total"), F.inline(rows))
        .withColumn("percentage", F.when(F.col("total") > 0, percent).otherwise(0).cast("bigint"))
        .drop("total")
    )


def tool_counts(df: DataFrame, now: datetime | str) -> DataFrame:
    status = tool_status_rule(ts(now))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(contains_text("category", "government")).alias("government"),
        F.count_if(contains_text("category", "private")).alias("private"),
        F.count_if(status == "Closing Soon").alias("closing_soon"),
        F.count_if(status == "Expired").alias("expired"),
    )


def home_counts(df: DataFrame, now: datetime | str) -> DataFrame:
    """Front-page counters over the publicly visible rows; only `last_date` can be closing."""
    return active(df, now).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(contains_text("category", "government")).alias("government"),
        F.count_if(contains_text("category", "private")).alias("private"),
        F.count_if(_soon(F.col("last_date"), ts(now))).alias("closing_soon"),
    )


def registry_counts(sources: DataFrame) -> DataFrame:
    return sources.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("enabled").alias("enabled"),
        F.count_if(F.col("review_status") == "PENDING").alias("pending"),
    )


def unsafe_rule() -> Column:
    approved = F.col("review_status") == "APPROVED"
    return (
        F.col("auto_publish")
        | (F.col("trusted") & ~approved)
        | (F.col("enabled") & ~(F.col("trusted") & approved))
    )


def readiness(sources: DataFrame, listings: DataFrame, runs: DataFrame, now: datetime | str) -> DataFrame:
    """Long-form launch checks over the data; `ready` needs every blocker passed."""
    at = ts(now)
    registry = sources.agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(unsafe_rule()).alias("unsafe"),
        F.count_if(F.col("enabled") & F.col("trusted") & (F.col("review_status") == "APPROVED")).alias("usable"),
    )
    board = listings.agg(F.count_if(active_rule(at)).alias("live"))
    last = runs.agg(F.max_by(F.struct("run_id", "status", "started_at"), F.struct("started_at", "run_id")).alias("run"))
    started = F.col("run.started_at")
    recent = F.coalesce(
        (F.col("run.status") == "COMPLETED") & (started <= at) & (started >= at - F.expr("INTERVAL '48' HOUR")),
        F.lit(False),
    )

    def check(key: str, passed: Column, severity: str, value: Column) -> Column:
        return F.struct(
            F.lit(key).alias("key"), passed.alias("passed"), F.lit(severity).alias("severity"),
            value.cast("string").alias("measured"),
        )

    # Three one-row aggregates side by side.
    facts = registry.join(board, F.lit(True)).join(last, F.lit(True))
    checks = F.array(
        check("source-safety", F.col("unsafe") == 0, "BLOCKER", F.col("unsafe")),
        check("content", F.col("live") > 0, "BLOCKER", F.col("live")),
        check("enabled-sources", F.col("usable") > 0, "WARNING", F.col("usable")),
        check("recent-run", recent, "WARNING", F.col("run.run_id")),
    )
    ready = F.forall(checks, lambda c: c["passed"] | (c["severity"] == "WARNING"))
    return facts.select(ready.alias("ready"), F.inline(checks))
