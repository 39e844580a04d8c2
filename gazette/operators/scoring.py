"""Confidence, quality gate and eligibility rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gazette import vocabulary as V
from gazette.functions.dates import parse_date, ts
from gazette.functions.text import clean, col, has, present
from gazette.functions.urls import canonical_url, same_domain

_SCORE = "decimal(4,2)"


def _points(condition: Column, weight: str) -> Column:
    return F.when(condition, F.lit(weight).cast(_SCORE)).otherwise(F.lit("0").cast(_SCORE))


def with_source(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach the registry row as struct `source`; candidates of unknown sources are dropped."""
    registry = sources.select(F.col("id").alias("source_id"), F.struct(*sources.columns).alias("source"))
    return candidates.join(registry, "source_id")


def score_confidence(df: DataFrame, now: datetime | str, threshold: str = V.HIGH_CONFIDENCE, auto_publish: bool = False) -> DataFrame:
    """Adds `confidence`, `reasons`, `high_confidence` and `eligible` to candidates with their `source`."""
    at = ts(now)
    staged = df.withColumns(
        {
            "_deadline": parse_date("last_date"),
            "_apply": canonical_url("apply_link").isNotNull(),
            "_notice": canonical_url("notification_link").isNotNull(),
            "_official": F.col("source.trusted") & same_domain("source_url", F.col("source.domain")),
            "_long": F.length(clean("raw_text")) >= V.LONG_TEXT_CHARS,
        }
    )
    future = F.coalesce(F.col("_deadline") > at, F.lit(False))
    parts = [_points(F.lit(True), V.BASE_SCORE), _points(F.col("_official"), V.TRUSTED_SCORE)]
    parts += [_points(clean(c) != "", w) for c, w in V.FACT_SCORES]
    parts += [
        _points(present("source_job_id"), V.NOTICE_ID_SCORE),
        _points(F.col("_long"), V.LONG_TEXT_SCORE),
        _points(F.col("_apply"), V.LINK_SCORE),
        _points(F.col("_notice"), V.LINK_SCORE),
        _points(future, V.DEADLINE_SCORE),
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    confidence = F.least(F.lit("1.00").cast("decimal(3,2)"), total).cast("decimal(3,2)")
    scored = staged.withColumn("confidence", confidence)
    high = F.col("confidence") >= F.lit(threshold).cast("decimal(3,2)")
    eligible = (
        F.lit(auto_publish) & F.col("source.trusted") & F.col("source.auto_publish")
        & (F.col("source.review_status") == "APPROVED") & high & future & (F.col("_apply") | F.col("_notice"))
    )
    text = V.SCORE_REASONS
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_official"), text["trusted"]).when(~F.col("source.trusted"), text["untrusted"]),
            F.when(F.col("_long"), text["text"]),
            F.when(future, text["future"]).when(F.col("_deadline").isNotNull(), text["past"]).otherwise(text["none"]),
            F.when(~F.col("eligible"), text["draft"]),
        )
    )
    return (
        scored.withColumns({"high_confidence": high, "eligible": eligible})
        .withColumn("reasons", reasons)
        .drop("_deadline", "_apply", "_notice", "_official", "_long")
    )


_PREVIEWED = [
    "title", "department", "qualification", "vacancy", "salary", "age_limit", "location", "application_fee",
    "selection_process",
]


def quality_rule(now: Column, minimum: str) -> Column:
    """struct(action, reason) of the first rule that applies."""
    text = V.QUALITY_REASONS
    title = F.trim("title")
    deadline = parse_date("last_date")
    percent = lambda c: F.round(c * 100).cast("int").cast("string")
    low = F.concat(
        F.lit("Confidence "), percent(F.col("confidence")), F.lit("% is below the "),
        percent(F.lit(minimum).cast("decimal(3,2)")), F.lit("% draft threshold."),
    )

    def outcome(action: str, reason: Column | str) -> Column:
        return F.struct(F.lit(action).alias("action"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    # One joined text: the patterns cannot match across the separator.
    layout = has(F.concat_ws("\n", *[col(c) for c in _PREVIEWED]), V.UNREADABLE)
    addressless = ~present("source_job_id") & canonical_url("notification_link").isNull() & canonical_url("apply_link").isNull()
    return (
        F.when(~has(title, V.RECOGNIZABLE_TITLE) | has(title, V.BARE_TITLE), outcome("LOW_CONFIDENCE", text["title"]))
        .when(layout, outcome("LOW_CONFIDENCE", text["layout"]))
        .when(F.coalesce(deadline < now, F.lit(False)), outcome("EXPIRED", text["expired"]))
        .when(has("title", V.QUALITY_RESULT_TITLE), outcome("REJECTED", text["result"]))
        .when(addressless, outcome("LOW_CONFIDENCE", text["url"]))
        .when(F.length(F.coalesce("raw_text", F.lit(""))) < 40, outcome("LOW_CONFIDENCE", text["text"]))
        .when(F.col("confidence") < F.lit(minimum).cast("decimal(3,2)"), outcome("LOW_CONFIDENCE", low))
        .otherwise(outcome("WOULD_ADD", text["pass"]))
    )


def classify_quality(df: DataFrame, now: datetime | str, minimum: str = V.MIN_DRAFT_CONFIDENCE) -> DataFrame:
    """Adds `action` and `reason` to scored candidates."""
    judged = df.withColumn("_quality", quality_rule(ts(now), minimum))
    return judged.withColumns({"action": F.col("_quality.action"), "reason": F.col("_quality.reason")}).drop("_quality")


def draft_eligibility(proposals: DataFrame, enabled: bool) -> DataFrame:
    """Adds `allowed` and `eligibility`, the first reason that applies."""
    key = "^[a-f0-9]{64}$"
    identified = (F.col("source_id") > 0) & F.col("candidate_key").rlike(key) & F.col("snapshot_hash").rlike(key)
    wrong_action = F.concat(
        F.lit("Only WOULD_ADD notices can become new drafts; this item is "), F.col("action"), F.lit(".")
    )
    reason = (
        F.when(~F.lit(enabled), V.DRAFT_REASONS["locked"])
        .when(F.col("action") != "WOULD_ADD", wrong_action)
        .when(~F.coalesce(identified, F.lit(False)), V.DRAFT_REASONS["identity"])
        .otherwise(V.DRAFT_REASONS["allowed"])
    )
    return proposals.withColumn("eligibility", reason).withColumn(
        "allowed", F.col("eligibility") == V.DRAFT_REASONS["allowed"]
    )


def action_counts(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def source_outcome(proposals: DataFrame, sources: DataFrame, failed: DataFrame) -> DataFrame:
    """Per source: PASS, NEEDS_REVIEW or BLOCKED_OR_FAILED.

    `failed` holds (source_id) of collections that broke; proposal errors are rows
    whose action is ERROR.
    """
    valid = F.col("action").isin("WOULD_ADD", "WOULD_UPDATE", "DUPLICATE")
    seen = proposals.groupBy("source_id").agg(
        F.bool_or(valid).alias("valid"),
        F.count_if(F.col("action") == "ERROR").alias("errors"),
        F.count(F.lit(1)).alias("proposals"),
    )
    broken = failed.select("source_id").distinct().withColumn("broken", F.lit(True))
    passed = F.coalesce("valid", F.lit(False)) & (F.coalesce("errors", F.lit(0)) == 0)
    return (
        sources.select(F.col("id").alias("source_id"))
        .join(seen, "source_id", "left")
        .join(broken, "source_id", "left")
        .select(
            "source_id",
            F.coalesce("proposals", F.lit(0)).alias("proposals"),
            F.when(F.col("broken"), "BLOCKED_OR_FAILED").when(passed, "PASS").otherwise("NEEDS_REVIEW").alias("outcome"),
        )
    )
