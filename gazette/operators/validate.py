"""Row validation: the first broken rule is reported in `error`."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gazette import vocabulary as V
from gazette.functions.dates import parse_date, ts
from gazette.functions.text import blank_to_null, col
from gazette.functions.urls import canonical_url, host, plain_http_url

_LINKS = [("apply_link", "Apply link"), ("notification_link", "Notification link"), ("official_website", "Official website")]


def _text(c: str) -> Column:
    return F.trim(F.coalesce(col(c), F.lit("")))


def validate_listings(df: DataFrame, now: datetime | str) -> DataFrame:
    """Listing records of text columns, cleaned and typed, with `error` where a rule is broken.

    Missing columns count as empty.  An unknown status becomes DRAFT.
    """
    at = ts(now)
    names = ["title", "category", *V.LISTING_LENGTH_CAPS, "application_start_date", "last_date", "status"]
    rows = df.withColumns({c: F.lit(None).cast("string") for c in names if c not in df.columns})
    if "featured" not in df.columns:
        rows = rows.withColumn("featured", F.lit(False))
    rows = rows.withColumns({c: _text(c) for c in names})
    rows = rows.withColumns({"_end": parse_date("last_date"), "_start": parse_date("application_start_date")})
    rows = rows.withColumn("status", F.when(F.col("status").isin(V.LISTING_STATUSES), F.col("status")).otherwise("DRAFT"))
    sized = (F.length("title").between(1, 300)) & (F.length("category").between(1, 100))
    rules: list[tuple[Column, str]] = [(~sized, "A title and category are required and must be reasonably sized.")]
    rules += [(F.length(c) > n, f"{c} is too long.") for c, n in V.LISTING_LENGTH_CAPS.items()]
    rules += [
        ((F.col("last_date") != "") & F.col("_end").isNull(), "Last date is invalid."),
        ((F.col("application_start_date") != "") & F.col("_start").isNull(), "Application start date is invalid."),
        (F.col("_start") > F.col("_end"), "Application start date must not be after the last date."),
    ]
    rules += [((F.col(c) != "") & ~plain_http_url(c), f"{label} must be a valid http/https URL.") for c, label in _LINKS]
    rules += [
        (
            (F.col("status") == "PUBLISHED") & (F.col("_end") < at),
            "A past-deadline job cannot be published. Mark it expired or archived.",
        )
    ]
    error = F.coalesce(*[F.when(broken, message) for broken, message in rules])
    cleaned = {c: blank_to_null(c) for c in V.LISTING_LENGTH_CAPS}
    cleaned |= {
        "last_date": F.col("_end"),
        "application_start_date": F.col("_start"),
        "featured": F.coalesce("featured", F.lit(False)),
    }
    return rows.withColumn("error", error).withColumns(cleaned).drop("_end", "_start")


def validate_sources(df: DataFrame) -> DataFrame:
    """Registry records with canonical start URL, domain and consistent trust flags."""
    sized = lambda c, low, high: F.length(F.trim(c)).between(low, high)
    rows = df.withColumns(
        {
            "review_status": F.coalesce("review_status", F.lit("PENDING")),
            "_url": F.when(plain_http_url("start_url"), canonical_url("start_url")),
        }
    )
    rules = [
        (~F.coalesce(sized("name", 2, 160), F.lit(False)), "name must have 2 to 160 characters."),
        (F.col("_url").isNull() | (F.length("start_url") > 2_000), "start_url must be a valid http/https URL."),
        (~F.coalesce(F.col("type").isin(V.SOURCE_TYPES), F.lit(False)), "type is not supported."),
        (~F.coalesce(sized("category", 2, 100), F.lit(False)), "category must have 2 to 100 characters."),
        (~F.coalesce(F.col("parser_type").isin(V.PARSER_TYPES), F.lit(False)), "parser_type is not supported."),
        (~F.col("review_status").isin(V.REVIEW_STATUSES), "review_status is not supported."),
    ]
    trusted = (F.col("review_status") == "APPROVED") & F.coalesce("trusted", F.lit(False))
    return (
        rows.withColumn("error", F.coalesce(*[F.when(broken, message) for broken, message in rules]))
        .withColumns(
            {
                "name": F.trim("name"),
                "category": F.trim("category"),
                "start_url": F.coalesce("_url", "start_url"),
                "domain": host("_url"),
                "enabled": F.coalesce("enabled", F.lit(False)),
                "trusted": trusted,
                "auto_publish": trusted & F.coalesce("auto_publish", F.lit(False)),
            }
        )
        .drop("_url")
    )


def validate_subscriptions(df: DataFrame, extra: str | None = None) -> DataFrame:
    """Alert subscriptions; `extra` names a column listing unknown keys of the request."""
    lists = ["keywords", "categories", "locations"]
    bounded = lambda c: (F.size(c) <= 20) & F.forall(c, lambda x: F.length(F.trim(x)).between(1, 80))
    rules = [
        (
            ~F.coalesce(F.trim("email").rlike("(?i)" + V.EMAIL_SHAPE) & ~F.col("email").contains("..") & (F.length("email") <= 320), F.lit(False)),
            "email is invalid.",
        )
    ]
    rules += [(~F.coalesce(bounded(c), F.lit(True)), f"{c} are invalid.") for c in lists]
    rules += [(F.length(F.trim("qualification")) > 150, "qualification is too long.")]
    if extra:
        rules += [(F.size(extra) > 0, "unknown fields.")]
    cleaned = {c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)) for c in lists}
    return df.withColumn("error", F.coalesce(*[F.when(b, m) for b, m in rules])).withColumns(
        {**cleaned, "email": F.trim("email"), "qualification": blank_to_null(F.trim("qualification"))}
    )
