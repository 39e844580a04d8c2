"""Listing queries: visibility, search, facets, paging, projections and page metadata."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gazette import vocabulary as V
from gazette.functions.dates import days_between, is_past, ts
from gazette.functions.text import blank_to_null, col, present

_SEARCHED = ["title", "department", "qualification", "category", "location"]


def _open(c: str, now: Column) -> Column:
    return F.col(c).isNull() | (F.col(c) >= now)


def _within(c: str, now: Column) -> Column:
    return F.col(c).between(now, now + F.expr(f"INTERVAL '{V.CLOSING_DAYS}' DAY"))


def active_rule(now: Column) -> Column:
    """Published and neither deadline has passed."""
    return (F.col("status") == "PUBLISHED") & _open("last_date", now) & _open("expires_at", now)


def contains_text(c: Column | str, needle: Column | str) -> Column:
    """Case-insensitive literal substring; a null column never matches."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.coalesce(F.lower(col(c)).contains(F.lower(needle)), F.lit(False))


# --- filters -------------------------------------------------------------------
def active(df: DataFrame, now: datetime | str) -> DataFrame:
    return df.where(active_rule(ts(now)))


def visible_legacy(df: DataFrame, now: datetime | str) -> DataFrame:
    """Category-page rule: published and no deadline at all, or any deadline still open."""
    now = ts(now)
    undated = F.col("last_date").isNull() & F.col("expires_at").isNull()
    still_open = (F.col("last_date") >= now) | (F.col("expires_at") >= now)
    return df.where((F.col("status") == "PUBLISHED") & (undated | F.coalesce(still_open, F.lit(False))))


def closing_soon(df: DataFrame, now: datetime | str) -> DataFrame:
    now = ts(now)
    return df.where(active_rule(now) & (_within("last_date", now) | _within("expires_at", now)))


def search(
    df: DataFrame, now: datetime | str, query: str = "", category: str = "", location: str = "", closing: bool = False
) -> DataFrame:
    """Active listings that contain `query` in any of five columns and equal the exact filters."""
    query, category, location = (
        (value or "").strip()[: V.SEARCH_LIMITS[name]]
        for name, value in (("query", query), ("category", category), ("location", location))
    )
    out = closing_soon(df, now) if closing else active(df, now)
    if query:
        hits = [contains_text(c, query) for c in _SEARCHED]
        matched = hits[0]
        for hit in hits[1:]:
            matched = matched | hit
        out = out.where(matched)
    if category:
        out = out.where(F.col("category") == category)
    if location:
        out = out.where(F.col("location") == location)
    return out


def sector(df: DataFrame, now: datetime | str, words: list[str] = V.SECTOR_WORDS) -> DataFrame:
    """Visible listings whose category contains any of the words."""
    pattern = "|".join("\\Q" + w.lower() + "\\E" for w in words)
    return visible_legacy(df, now).where(F.lower("category").rlike(pattern))


def private_sector(df: DataFrame, now: datetime | str) -> DataFrame:
    return visible_legacy(df, now).where(contains_text("category", "private"))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id"))


def featured(df: DataFrame, now: datetime | str) -> DataFrame:
    return newest_first(active(df, now).where("featured"))


def lookup(df: DataFrame, listing_id: int, now: datetime | str, admin: bool = False) -> DataFrame:
    return (df if admin else active(df, now)).where(F.col("id") == listing_id)


def _joined_text(columns: list[str]) -> Column:
    return F.lower(F.concat_ws(" ", *[blank_to_null(c) for c in columns]))


def home_cards(df: DataFrame, now: datetime | str, query: str = "", n: int = 3) -> DataFrame:
    """The newest `n` featured matches, or the newest `n` matches when none is featured."""
    rows = active(df, now)
    needle = query.strip().lower()
    if needle:
        text = _joined_text(["title", "category", "department", "qualification", "location"])
        rows = rows.where(text.contains(needle))
    top = rows.orderBy(F.desc("featured"), F.desc("created_at"), F.desc("id")).limit(n)
    any_featured = top.agg(F.coalesce(F.bool_or("featured"), F.lit(False)).alias("any_featured"))
    return top.join(any_featured, F.col("featured") == F.col("any_featured")).drop("any_featured")


def tool_status_rule(now: Column) -> Column:
    """Date outranks draft: Active / Expired / Closing Soon / Draft."""
    days = F.ceil(days_between(F.col("last_date"), now))
    return (
        F.when(F.col("last_date").isNull(), "Active")
        .when(F.col("last_date") < now, "Expired")
        .when(days <= V.CLOSING_DAYS, "Closing Soon")
        .when(F.col("status") == "DRAFT", "Draft")
        .otherwise("Active")
    )


def tool_status(df: DataFrame, now: datetime | str) -> DataFrame:
    return df.withColumn("tool_status", tool_status_rule(ts(now)))


def tool_search(
    df: DataFrame, now: datetime | str, query: str = "", category: str = "ALL", status: str = "ALL"
) -> DataFrame:
    out = df
    if query.strip():
        out = out.where(
            _joined_text(["title", "department", "category", "location"]).contains(query.strip().lower())
        )
    if category != "ALL":
        out = out.where(F.col("category") == category)
    if status != "ALL":
        out = out.where(tool_status_rule(ts(now)) == status)
    return out


def deadline_status(df: DataFrame, now: datetime | str) -> DataFrame:
    """Calendar-day badge: status, days left (today counts as one) and label."""
    left = F.datediff(F.col("last_date").cast("date"), ts(now).cast("date")) + 1
    status = (
        F.when(F.col("last_date").isNull(), F.lit(None))
        .when(left < 1, "EXPIRED")
        .when(left <= V.CLOSING_DAYS, "CLOSING_SOON")
        .otherwise("ACTIVE")
    )
    return (
        df.withColumn("days_left", left)
        .withColumn("deadline_status", status)
        .withColumn(
            "status_label",
            F.when(F.col("deadline_status") == "EXPIRED", "Expired")
            .when(F.col("deadline_status") == "CLOSING_SOON", "Closing Soon")
            .when(F.col("deadline_status") == "ACTIVE", "Active"),
        )
        .withColumn(
            "days_label",
            F.when(F.col("deadline_status") != "EXPIRED", F.concat(F.col("days_left").cast("string"), F.lit(" days left"))),
        )
    )


# --- projections -------------------------------------------------------------------
def project_public(df: DataFrame, shape: str = "full") -> DataFrame:
    """Only the columns that may leave the administration area."""
    return df.select(*(V.CARD_COLUMNS if shape == "card" else V.PUBLIC_COLUMNS))


def scan_listings(df: DataFrame, now: datetime | str, public: bool = True) -> DataFrame:
    return newest_first(project_public(active(df, now)) if public else df)


# --- paging and facets -----------------------------------------------------------------
def page_info(df: DataFrame, page: int = 1) -> DataFrame:
    """One row: total, page count, clamped page, first and last result number."""
    wanted = min(max(page, 1), V.MAX_PAGE)
    size = V.PAGE_SIZE
    return (
        df.agg(F.count(F.lit(1)).alias("total"))
        .withColumn("page_count", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint"))
        .withColumn("page", F.least(F.lit(wanted), F.col("page_count")).cast("bigint"))
        .withColumn("first_result", F.when(F.col("total") > 0, (F.col("page") - 1) * size + 1).otherwise(0).cast("bigint"))
        .withColumn("last_result", F.least(F.col("page") * size, F.col("total")).cast("bigint"))
    )


def page(df: DataFrame, page_number: int = 1) -> DataFrame:
    """One page of listing cards, featured first, then newest."""
    size = V.PAGE_SIZE
    number = min(max(page_number, 1), V.MAX_PAGE)
    if number > 1:
        number = min(number, max(1, -(-df.count() // size)))
    ordered = df.orderBy(F.desc("featured"), F.desc("created_at"), F.desc("id"))
    return ordered.offset((number - 1) * size).limit(size).select(*V.CARD_COLUMNS)


def facets(df: DataFrame, now: datetime | str) -> DataFrame:
    """Distinct categories and locations of active rows, long form, one shuffle."""
    return (
        active(df, now)
        .select(
            F.inline(
                F.array(
                    F.struct(F.lit("category").alias("facet"), F.trim("category").alias("value")),
                    F.struct(F.lit("location").alias("facet"), F.trim("location").alias("value")),
                )
            )
        )
        .where(present("value"))
        .distinct()
        .orderBy("facet", "value")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(present(column)).distinct().orderBy(column)


# --- page metadata ------------------------------------------------------------------------
def sitemap(df: DataFrame, site: str, now: datetime | str) -> DataFrame:
    """Static pages, then active listings newest change first; `seq` orders the sections."""
    static = df.sparkSession.createDataFrame(
        [(i, path, freq, prio) for i, (path, freq, prio) in enumerate(V.STATIC_PAGES)],
        "seq int, path string, change_frequency string, priority double",
    ).select(
        "seq",
        F.concat(F.lit(site), F.col("path")).alias("url"),
        F.when(F.col("change_frequency") == "daily", ts(now)).alias("last_modified"),
        "change_frequency",
        "priority",
    )
    rows = active(df, now).select(
        F.lit(len(V.STATIC_PAGES)).alias("seq"),
        F.concat(F.lit(site + "/jobs/"), F.col("id").cast("string")).alias("url"),
        F.col("updated_at").alias("last_modified"),
        F.lit("daily").alias("change_frequency"),
        F.lit(0.8).alias("priority"),
    )
    return static.unionByName(rows).orderBy("seq", F.desc("last_modified"), "url")


def _iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def structured_data(df: DataFrame, site: str) -> DataFrame:
    """(id, json): the JobPosting document of every sufficiently described listing."""
    posted = F.coalesce("posted_date", "published_at")
    links = [present(c) for c in ("apply_link", "notification_link", "official_website")]
    described = present("description") & present("department") & present("location") & posted.isNotNull()
    document = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("JobPosting").alias("@type"),
        "title",
        "description",
        _iso_text(posted).alias("datePosted"),
        _iso_text(F.col("last_date")).alias("validThrough"),
        F.struct(
            F.lit("Organization").alias("@type"),
            F.col("department").alias("name"),
            blank_to_null("official_website").alias("sameAs"),
        ).alias("hiringOrganization"),
        F.struct(
            F.lit("Place").alias("@type"),
            F.struct(
                F.lit("PostalAddress").alias("@type"),
                F.col("location").alias("addressLocality"),
                F.lit("IN").alias("addressCountry"),
            ).alias("address"),
        ).alias("jobLocation"),
        F.when(
            present("source_job_id"),
            F.struct(
                F.lit("PropertyValue").alias("@type"),
                F.col("department").alias("name"),
                F.col("source_job_id").alias("value"),
            ),
        ).alias("identifier"),
        F.concat(F.lit(site + "/jobs/"), F.col("id").cast("string")).alias("url"),
    )
    return df.where(described & (links[0] | links[1] | links[2])).select(
        "id", F.replace(F.to_json(document), F.lit("<"), F.lit("\\u003c")).alias("json")
    )


def listing_metadata(df: DataFrame, site: str) -> DataFrame:
    parts = [blank_to_null(c) for c in ("title", "department", "qualification", "location", "category")]
    return df.select(
        "id",
        "title",
        F.concat_ws(" | ", *parts, F.lit(V.METADATA_TAIL)).alias("description"),
        F.concat(F.lit(site + "/jobs/"), F.col("id").cast("string")).alias("canonical"),
    )
