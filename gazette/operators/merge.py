"""Merging the records of one notice, and page-level collection figures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gazette import vocabulary as V
from gazette.functions.identity import notice_identity
from gazette.functions.text import content_hash, fold, has, let, present
from gazette.functions.urls import is_pdf

FIRST_FIELDS = [
    "department", "qualification", "vacancy", "salary", "age_limit", "location", "application_fee",
    "selection_process", "description", "how_to_apply", "application_start_date", "last_date", "apply_link",
    "official_website", "source_job_id", "posted_date", "updated_date",
]


def with_candidate_columns(df: DataFrame) -> DataFrame:
    """Add the candidate facts an extractor did not produce as nulls."""
    missing = {c: F.lit(None).cast("string") for c in FIRST_FIELDS if c not in df.columns}
    return df.withColumns(missing) if missing else df


def title_score(title: Column) -> Column:
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    size = F.length(title)
    return (
        points(~has(title, V.GENERIC_TITLE), 10)
        + points(has(title, V.JOB_SIGNAL), 10)
        + points(size.between(15, 240), 5)
        - points(size > 320, 10)
    )


def _first(c: str, order: str) -> Column:
    """First non-empty value in encounter order."""
    return F.min_by(c, F.when(present(c), F.col(order))).alias(c)


def merge_notices(df: DataFrame, keys: list[str] | None = None, order: str = "pos", identity: Column | None = None) -> DataFrame:
    """One row per notice identity within `keys` (default: the source); `identity` names another one.

    Every field is an associative aggregate over (value, encounter order), so
    the copies of a hot notice are combined before the shuffle.
    """
    keys = keys or ["source_id"]
    rows = df.withColumn("identity", notice_identity() if identity is None else identity)
    title_rank = F.struct(-title_score(F.col("title")), F.length("title"), F.col(order))
    link_rank = F.when(present("notification_link"), F.struct(~is_pdf("notification_link"), F.col(order)))
    text_rank = F.struct(-F.length("raw_text"), F.col(order))
    aggregates = [_first(c, order) for c in FIRST_FIELDS if c in df.columns] + [
        F.min_by("title", title_rank).alias("title"),
        F.min_by("notification_link", link_rank).alias("notification_link"),
        F.min_by("raw_text", text_rank).alias("raw_text"),
        F.min_by("source_url", order).alias("source_url"),
        F.min_by("extraction_method", order).alias("extraction_method"),
        F.coalesce(F.bool_or("is_corrigendum"), F.lit(False)).alias("is_corrigendum"),
        F.min(order).alias(order),
        F.count(F.lit(1)).alias("merged"),
    ]
    return rows.groupBy(*keys, "identity").agg(*aggregates).withColumn("content_hash", content_hash("raw_text"))


def first_per_identity(primary: DataFrame, documents: DataFrame, order: str = "pos") -> DataFrame:
    """Page candidates then document candidates; the first record of an identity is kept whole."""
    both = primary.withColumn("_part", F.lit(0)).unionByName(
        documents.withColumn("_part", F.lit(1)), allowMissingColumns=True
    )
    rows = both.withColumn("identity", notice_identity())
    columns = [c for c in rows.columns if c not in ("_part", "identity", "source_id")]
    best = rows.groupBy("source_id", "identity").agg(
        F.min_by(F.struct(*columns), F.struct("_part", order)).alias("row")
    )
    return best.select("source_id", "identity", "row.*")


def ordered_union(structured: DataFrame, anchors: DataFrame, order: str = "pos") -> DataFrame:
    """Structured-data records of a page come before its anchors."""
    offset = F.col(order).cast("bigint")
    return structured.withColumn(order, offset).unionByName(
        anchors.withColumn(order, offset + (1 << 31)), allowMissingColumns=True
    )


def collection_metrics(links: DataFrame, records: DataFrame, notices: DataFrame) -> DataFrame:
    """Per source: raw links, links behind surviving notices, notices, rejected noise."""
    raw = links.groupBy("source_id").agg(F.count(F.lit(1)).alias("raw_links"))
    alive = notices.select("source_id", "identity").distinct()
    behind = (
        records.withColumn("identity", notice_identity())
        .join(alive, ["source_id", "identity"], "left_semi")
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("recruitment_links"))
    )
    unique = notices.groupBy("source_id").agg(F.count(F.lit(1)).alias("unique_notices"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        raw.join(behind, "source_id", "full")
        .join(unique, "source_id", "full")
        .select("source_id", zero("raw_links"), zero("recruitment_links"), zero("unique_notices"))
        .withColumn("rejected_noise", F.greatest(F.lit(0), F.col("raw_links") - F.col("recruitment_links")))
    )


def source_content_hash(candidates: DataFrame, page_hashes: DataFrame, order: str = "pos") -> DataFrame:
    """(source_id, content_hash): SHA-256 of the page hash and all candidate hashes in order, joined by `|`.

    The parts of a source are sorted, not collected: a task feeds them to the
    running hash one by one, so a long source takes time but no memory.
    """
    pages = page_hashes.select("source_id", F.lit(-1).cast("bigint").alias("pos"), F.col("content_hash").alias("part"))
    parts = pages.unionByName(
        candidates.select("source_id", F.col(order).cast("bigint").alias("pos"), F.col("content_hash").alias("part"))
    ).where(F.col("part").isNotNull())
    ordered = parts.repartition("source_id").sortWithinPartitions("source_id", "pos", "part").select("source_id", "part")
    return ordered.mapInArrow(_running_hashes, StructType([parts.schema["source_id"], StructField("content_hash", StringType())]))


def _running_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    source, running, begun = None, None, False
    for batch in batches:
        ids, out = [], []
        for key, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun and key == source:
                running.update(b"|" + part.encode())
                continue
            if begun:
                ids.append(source)
                out.append(running.hexdigest())
            source, running, begun = key, hashlib.sha256(part.encode()), True
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(out, pa.string())], names=["source_id", "content_hash"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([source], kind), pa.array([running.hexdigest()])], names=["source_id", "content_hash"])


# --- detail records ------------------------------------------------------------------------------
def closest_detail(base: DataFrame, details: DataFrame) -> DataFrame:
    """(base_id, detail_id): the detail record of the same page that fits a listing record best.

    Both sides carry `page_id`: the detail page the base record links to.  Same
    notice id first, then a title containing the other, then the only record; of
    several the first by `pos`.  Records of one page, id and title are one record
    before anything is joined, and titles meet only where the id found nothing,
    so a page of many copies costs what its distinct titles cost.
    """
    left = base.select("base_id", "page_id", fold("source_job_id").alias("id"), fold("title").alias("title"))
    right = details.select(
        "page_id", fold("source_job_id").alias("d_id"), fold("title").alias("d_title"), F.struct("pos", "detail_id").alias("d")
    )
    by_id = right.where("d_id <> ''").groupBy("page_id", F.col("d_id").alias("id")).agg(F.min("d").alias("by_id"))
    found = left.join(by_id, ["page_id", "id"], "left")
    open_titles = found.where(F.col("by_id").isNull()).select("page_id", "title").distinct()
    titles = right.groupBy("page_id", "d_title").agg(F.min("d").alias("d"))
    fits = F.col("d_title").contains(F.col("title")) | F.col("title").contains(F.col("d_title"))
    by_title = open_titles.join(titles, "page_id").where(fits).groupBy("page_id", "title").agg(F.min("d").alias("by_title"))
    alone = right.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("only")).where("n = 1").select("page_id", "only")
    best = F.coalesce("by_id", "by_title", "only")
    return (
        found.join(by_title, ["page_id", "title"], "left")
        .join(alone, "page_id", "left")
        .where(best.isNotNull())
        .select("base_id", best["detail_id"].alias("detail_id"))
    )


def strong_title(title: Column) -> Column:
    return (
        F.length(title).between(12, 220)
        & ~has(title, V.BROKEN_TITLE_TEXT, ignore_case=False)
        & ~has(title, V.TABLE_TITLE)
        & has(title, V.STRONG_TITLE)
    )


def enrich_notice(listings: DataFrame, details: DataFrame, key: str = "notice_id") -> DataFrame:
    """Listing records completed by their document record; without one the row is unchanged.

    The listing title stays unless it is a bare label and the document has a
    strong one.  Amendment status comes from the listing title or the document.
    """
    fields = [c for c in FIRST_FIELDS if c in listings.columns]
    carried = fields + ["title", "notification_link", "raw_text", "is_corrigendum"]
    other = details.select(key, F.struct(*[c for c in carried if c in details.columns]).alias("d"))
    has_field = set(details.columns)
    joined = listings.join(other, key, "left")
    found = F.col("d").isNotNull()
    generic = fold("title").rlike(V.GENERIC_LISTING_TITLE)
    filled = {
        c: F.when(present(c), F.col(c)).otherwise(F.coalesce(F.col(f"d.{c}"), F.col(c))) for c in fields if c in has_field
    }
    new_link, old_link = F.col("d.notification_link"), F.col("notification_link")
    better = ~present("notification_link") | (present(new_link) & is_pdf(new_link) & ~is_pdf(old_link))
    filled |= {
        "title": F.when(found & generic & strong_title(F.col("d.title")), F.col("d.title")).otherwise(F.col("title")),
        "notification_link": F.when(found & better, F.coalesce(new_link, old_link)).otherwise(old_link),
        "raw_text": F.when(F.length("d.raw_text") > F.length("raw_text"), F.col("d.raw_text")).otherwise(F.col("raw_text")),
        "is_corrigendum": F.when(
            found, has("title", V.LISTING_AMENDMENT) | F.coalesce(F.col("d.is_corrigendum"), F.lit(False))
        ).otherwise(F.col("is_corrigendum")),
    }
    return joined.withColumns(filled).drop("d").withColumn("content_hash", content_hash("raw_text"))
