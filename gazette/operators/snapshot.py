"""State-changing jobs: each takes the current snapshot and returns the next one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gazette import vocabulary as V
from gazette.functions.dates import day, is_past, parse_date, parsed_day, ts
from gazette.functions.identity import fingerprint
from gazette.functions.text import clean_or_null, present
from gazette.functions.urls import canonical_url
from gazette.scale import number_rows, written

_AUTOMATION_COLUMNS = {
    "canonical_apply_url": "string", "canonical_notice_url": "string", "raw_source_reference": "string",
    "first_seen_at": "timestamp_ntz", "last_seen_at": "timestamp_ntz", "source_updated_at": "timestamp_ntz",
    "automation_confidence": "decimal(3,2)", "expired_at": "timestamp_ntz", "source_hash": "string",
    "automation_run_id": "bigint",
}


def with_automation_columns(listings: DataFrame) -> DataFrame:
    """Add the provenance columns a plain listing table may lack."""
    missing = {c: F.lit(None).cast(t) for c, t in _AUTOMATION_COLUMNS.items() if c not in listings.columns}
    return listings.withColumns(missing) if missing else listings


def _facts(df: DataFrame, now: Column, run_id: int) -> DataFrame:
    """Listing values of scored candidates with their `source`."""
    dates = ["application_start_date", "last_date", "posted_date"]
    parsed = {f"new_{c}": parse_date(c) for c in dates}
    parsed |= {
        "new_source_updated_at": parse_date("updated_date") if "updated_date" in df.columns else F.lit(None).cast("timestamp_ntz"),
        "new_apply": canonical_url("apply_link"),
        "new_notice": canonical_url("notification_link"),
        "new_website": canonical_url("official_website"),
        "new_source_url": F.coalesce(canonical_url("source_url"), F.col("source.start_url")),
        "new_hash": fingerprint(
            "title", "department", "location", parsed_day("last_date"), "source_job_id"
        ),
        "new_reference": F.substring(F.concat(F.col("source_url"), F.lit("#sha256="), F.col("content_hash")), 1, 2_500),
    }
    return df.withColumns(parsed)


def insert_new(candidates: DataFrame, listings: DataFrame, now: datetime | str, run_id: int, order: str = "pos") -> DataFrame:
    """New listing rows for scored candidates; ids continue after the largest held id in batch order."""
    at = ts(now)
    top = listings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    published = F.col("eligible")
    text = {c: clean_or_null(c).alias(c) for c in V.TEXT_FACTS}
    made = _facts(candidates, at, run_id).select(
        F.col(order).alias("_place"),
        F.trim("title").alias("title"),
        *text.values(),
        F.col("new_application_start_date").alias("application_start_date"),
        F.col("new_last_date").alias("last_date"),
        F.col("new_last_date").alias("expires_at"),
        F.col("new_posted_date").alias("posted_date"),
        F.when(published, at).alias("published_at"),
        F.col("new_apply").alias("apply_link"),
        F.col("new_notice").alias("notification_link"),
        F.col("new_website").alias("official_website"),
        F.col("source.category").alias("category"),
        F.when(published, "PUBLISHED").otherwise("DRAFT").alias("status"),
        F.lit(False).alias("featured"),
        "source_id",
        F.col("source.name").alias("source_name"),
        F.col("new_source_url").alias("source_url"),
        clean_or_null("source_job_id").alias("source_job_id"),
        F.when(published, "AUTO_VERIFIED").otherwise("REVIEW_REQUIRED").alias("review_status"),
        F.col("new_hash").alias("source_hash"),
        F.lit(run_id).cast("bigint").alias("automation_run_id"),
        F.col("new_apply").alias("canonical_apply_url"),
        F.col("new_notice").alias("canonical_notice_url"),
        F.col("new_reference").alias("raw_source_reference"),
        at.alias("first_seen_at"),
        at.alias("last_seen_at"),
        F.col("new_source_updated_at").alias("source_updated_at"),
        F.col("confidence").alias("automation_confidence"),
        at.alias("created_at"),
        at.alias("updated_at"),
        "cand_id",
    )
    # The bounds of the ranges are sampled in a run of their own, so the rows are made before; a listing is narrower than its candidate.
    rows = number_rows(written(made, "unnumbered"), [], "_place")
    return rows.join(top, F.lit(True)).select((F.col("top") + F.col("n") + 1).alias("id"), *[c for c in made.columns if c != "_place"])


def upsert(listings: DataFrame, matched: DataFrame, now: datetime | str, run_id: int, order: str = "pos") -> DataFrame:
    """Next snapshot after the matched proposals (WOULD_UPDATE and DUPLICATE).

    Only non-empty values overwrite; several proposals for one listing fold in
    encounter order (last non-empty value per field).  A duplicate only touches
    `last_seen_at` and the run.
    """
    at = ts(now)
    updating = F.col("action") == "WOULD_UPDATE"
    rows = _facts(matched.where(F.col("action").isin("WOULD_UPDATE", "DUPLICATE")), at, run_id)
    seq = F.when(updating, F.col(order))

    def last(value: Column, given: Column, name: str) -> Column:
        return F.max_by(value, F.when(given, seq)).alias(name)

    always = F.lit(True)
    revives = F.coalesce(F.col("new_last_date") > at, F.lit(False))
    aggregates = [last(F.col(c), present(c), f"u_{c}") for c in ["title", *V.TEXT_FACTS]]
    aggregates += [
        last(F.col("new_application_start_date"), present("application_start_date"), "u_application_start_date"),
        F.max_by(F.struct(F.col("new_last_date").alias("v")), F.when(present("last_date"), seq)).alias("u_last_date"),
        F.max_by(F.struct(F.col("new_apply").alias("v")), F.when(present("apply_link"), seq)).alias("u_apply"),
        F.max_by(F.struct(F.col("new_notice").alias("v")), F.when(present("notification_link"), seq)).alias("u_notice"),
        F.max_by(F.struct(F.col("new_website").alias("v")), F.when(present("official_website"), seq)).alias("u_website"),
        last(clean_or_null("source_job_id"), present("source_job_id"), "u_source_job_id"),
        last(
            F.struct(
                "new_hash", "new_reference", "new_source_updated_at", "confidence", "eligible",
                F.col("source_id").alias("from_id"), F.col("source.name").alias("from_name"),
                F.col("new_source_url").alias("from_url"),
            ),
            always,
            "u_final",
        ),
        F.bool_or(updating & ~F.col("eligible")).alias("u_unpublish"),
        F.bool_or(updating & F.col("eligible")).alias("u_publish"),
        last(F.struct("eligible"), revives, "u_revive"),
    ]
    folded = rows.groupBy(F.col("listing_id").alias("id")).agg(*aggregates).withColumn("_touched", F.lit(True))
    base = with_automation_columns(listings).join(folded, "id", "left")
    updated = F.col("u_final").isNotNull()
    touched = F.coalesce("_touched", F.lit(False))
    pick = lambda new, old: F.coalesce(F.col(new), F.col(old))
    link = lambda new, old: F.when(F.col(new).isNotNull(), F.col(f"{new}.v")).otherwise(F.col(old))
    lacks_source = updated & F.col("source_id").isNull()
    unpublish = (F.col("status") == "PUBLISHED") & F.coalesce("u_unpublish", F.lit(False))
    publish = (
        (F.col("status") == "DRAFT")
        & ~F.col("review_status").eqNullSafe("REJECTED")
        & F.coalesce("u_publish", F.lit(False))
    )
    revive = (F.col("status") == "EXPIRED") & F.col("u_revive").isNotNull()
    revived_live = revive & F.col("u_revive.eligible")
    changes = {c: pick(f"u_{c}", c) for c in ["title", *V.TEXT_FACTS, "application_start_date", "source_job_id"]}
    changes |= {
        "last_date": link("u_last_date", "last_date"),
        "expires_at": link("u_last_date", "expires_at"),
        "apply_link": link("u_apply", "apply_link"),
        "canonical_apply_url": link("u_apply", "canonical_apply_url"),
        "notification_link": link("u_notice", "notification_link"),
        "canonical_notice_url": link("u_notice", "canonical_notice_url"),
        "official_website": link("u_website", "official_website"),
        "source_hash": pick("u_final.new_hash", "source_hash"),
        "raw_source_reference": pick("u_final.new_reference", "raw_source_reference"),
        "source_updated_at": F.when(updated, F.col("u_final.new_source_updated_at")).otherwise(F.col("source_updated_at")),
        "automation_confidence": pick("u_final.confidence", "automation_confidence"),
        "review_status": F.when(updated & F.col("u_final.eligible"), "AUTO_VERIFIED")
        .when(updated, "REVIEW_REQUIRED")
        .otherwise(F.col("review_status")),
        "automation_run_id": F.when(touched, F.lit(run_id).cast("bigint")).otherwise(F.col("automation_run_id")),
        "last_seen_at": F.when(touched, at).otherwise(F.col("last_seen_at")),
        "updated_at": F.when(touched, at).otherwise(F.col("updated_at")),
        "source_id": F.when(lacks_source, F.col("u_final.from_id")).otherwise(F.col("source_id")),
        "source_name": F.when(lacks_source, F.col("u_final.from_name")).otherwise(F.col("source_name")),
        "source_url": F.when(lacks_source, F.col("u_final.from_url")).otherwise(F.col("source_url")),
        "status": F.when(unpublish, "DRAFT")
        .when(publish | revived_live, "PUBLISHED")
        .when(revive, "DRAFT")
        .otherwise(F.col("status")),
        "featured": F.when(unpublish, F.lit(False)).otherwise(F.col("featured")),
        "published_at": F.when(publish | revived_live, at).otherwise(F.col("published_at")),
        "expired_at": F.when(~revive, F.col("expired_at")),
    }
    return base.withColumns(changes).select(*with_automation_columns(listings).columns)


def touch_duplicates(listings: DataFrame, matched: DataFrame, now: datetime | str, run_id: int) -> DataFrame:
    """Listings whose proposals changed nothing: last seen and run move, and with them the time of the last update."""
    seen = matched.where(F.col("action") == "DUPLICATE").select(F.col("listing_id").alias("id")).distinct()
    base = with_automation_columns(listings).join(seen.withColumn("_seen", F.lit(True)), "id", "left")
    touched = F.coalesce("_seen", F.lit(False))
    return base.withColumns(
        {
            "last_seen_at": F.when(touched, ts(now)).otherwise(F.col("last_seen_at")),
            "updated_at": F.when(touched, ts(now)).otherwise(F.col("updated_at")),
            "automation_run_id": F.when(touched, F.lit(run_id).cast("bigint")).otherwise(F.col("automation_run_id")),
        }
    ).drop("_seen")


# --- expiry and recovery ------------------------------------------------------------------
EXPIRY_REASON = "Application deadline passed"


def is_due(now: Column) -> Column:
    """Published, and past either deadline."""
    return (F.col("status") == "PUBLISHED") & (is_past("last_date", now) | is_past("expires_at", now))


def expire(listings: DataFrame, now: datetime | str) -> DataFrame:
    """Published listings past either deadline become EXPIRED."""
    due = is_due(ts(now))
    return listings.withColumn("_due", due).withColumns(
        {
            "status": F.when(F.col("_due"), "EXPIRED").otherwise(F.col("status")),
            "expired_at": F.when(F.col("_due"), ts(now)).otherwise(F.col("expired_at")),
            "featured": F.when(F.col("_due"), F.lit(False)).otherwise(F.col("featured")),
            "updated_at": F.when(F.col("_due"), ts(now)).otherwise(F.col("updated_at")),
        }
    ).drop("_due")


def expiry_items(listings: DataFrame, now: datetime | str, run_id: str, dry_run: bool = False) -> DataFrame:
    """Audit rows of `expire`."""
    reason = "Would mark expired; dry run made no job change" if dry_run else EXPIRY_REASON
    return audit_rows(
        listings.where(is_due(ts(now))).select(
            F.lit(run_id).alias("run_id"),
            "source_id",
            "source_name",
            F.col("title").alias("candidate_title"),
            F.lit("EXPIRED").alias("action"),
            F.col("id").alias("job_id"),
            F.lit(reason).alias("reason"),
        )
    )


def audit_rows(items: DataFrame) -> DataFrame:
    """Run items with their text caps applied; empty text is null."""
    capped = {
        c: F.nullif(F.substring(F.col(c), 1, n), F.lit("")) for c, n in V.LOG_LIMITS.items() if c in items.columns
    }
    return items.withColumns(capped)


def recover_stale_runs(runs: DataFrame, now: datetime | str, lease_minutes: int = V.RUN_LEASE_MINUTES) -> DataFrame:
    """RUNNING runs older than the lease become FAILED with a clamped duration."""
    at = ts(now)
    stale = (F.col("status") == "RUNNING") & (
        F.col("started_at") < at - F.make_interval(mins=F.lit(lease_minutes))
    )
    millis = F.timestamp_diff("MILLISECOND", F.col("started_at"), at)
    return runs.withColumn("_stale", stale).withColumns(
        {
            "status": F.when(F.col("_stale"), "FAILED").otherwise(F.col("status")),
            "completed_at": F.when(F.col("_stale"), at).otherwise(F.col("completed_at")),
            "duration_ms": F.when(F.col("_stale"), F.least(F.lit(V.MAX_INT), F.greatest(F.lit(0), millis))).otherwise(
                F.col("duration_ms")
            ).cast("bigint"),
            "error_message": F.when(F.col("_stale"), V.STALE_RUN_MESSAGE).otherwise(F.col("error_message")),
        }
    ).drop("_stale")


# --- manual changes ---------------------------------------------------------------------------
def manual_edit(listings: DataFrame, edits: DataFrame, now: datetime | str) -> DataFrame:
    """Replace listings by validated edits (`validate_listings` output without errors)."""
    at = ts(now)
    fields = [c for c in edits.columns if c in listings.columns and c != "id"]
    new = edits.select("id", F.struct(*fields).alias("_edit"))
    joined = listings.join(new, "id", "left")
    edited = F.col("_edit").isNotNull()
    status = F.col("_edit.status")
    changes = {c: F.when(edited, F.col(f"_edit.{c}")).otherwise(F.col(c)) for c in fields}
    changes |= {
        "expires_at": F.when(edited, F.col("_edit.last_date")).otherwise(F.col("expires_at")),
        "expired_at": F.when(edited & (status == "EXPIRED"), at).when(~edited, F.col("expired_at")),
        "published_at": F.when(edited & (status == "PUBLISHED") & F.col("published_at").isNull(), at).otherwise(
            F.col("published_at")
        ),
        "review_status": F.when(edited, "MANUAL_VERIFIED").otherwise(F.col("review_status")),
        "updated_at": F.when(edited, at).otherwise(F.col("updated_at")),
    }
    return joined.withColumns(changes).drop("_edit").select(*listings.columns)


def delete_listings(listings: DataFrame, ids: DataFrame) -> DataFrame:
    return listings.join(ids.select("id").distinct(), "id", "left_anti")


def orphan_nulling(items: DataFrame, listings: DataFrame, column: str = "job_id") -> DataFrame:
    """Audit rows survive a deleted listing with a null reference."""
    known = listings.select(F.col("id").alias(column), F.lit(True).alias("_known"))
    joined = items.join(known, column, "left")
    return joined.withColumn(column, F.when(F.col("_known"), F.col(column))).drop("_known")


def backfill(listings: DataFrame) -> DataFrame:
    """First fill of the provenance timestamps of an older snapshot."""
    return listings.withColumns(
        {
            "first_seen_at": F.col("created_at"),
            "last_seen_at": F.col("updated_at"),
            "expires_at": F.col("last_date"),
            "published_at": F.when(F.col("status") == "PUBLISHED", F.col("created_at")),
        }
    )


def import_backup(existing: DataFrame, incoming: DataFrame, now: datetime | str) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, one-row counts) of a validated backup.

    `incoming` is `validate_listings` output with `seq` (file order): rows with
    an `error` are skipped, a positive id upserts (the last record of an id
    wins), any other record is inserted with a new id after the largest one.
    """
    at = ts(now)
    valid = incoming.where(F.col("error").isNull())
    facts = [c for c in existing.columns if c in incoming.columns and c not in ("id", "expires_at", "review_status", "published_at")]
    record = F.struct(*facts)
    keyed = (
        valid.where(F.col("id") > 0)
        .groupBy("id")
        .agg(
            F.max_by(record, "seq").alias("_r"),
            F.min_by("status", "seq").alias("_first_status"),
        )
    )
    merged = existing.withColumn("_held", F.lit(True)).join(keyed, "id", "full")
    held, given = F.col("_held").isNotNull(), F.col("_r").isNotNull()
    changes = {c: F.when(given, F.col(f"_r.{c}")).otherwise(F.col(c)) for c in facts}
    changes |= {
        "expires_at": F.when(given, F.col("_r.last_date")).otherwise(F.col("expires_at")),
        "review_status": F.when(given, "MANUAL_VERIFIED").otherwise(F.col("review_status")),
        # A held listing keeps its publication time; a created one is stamped by its first record.
        "published_at": F.when(held, F.col("published_at")).when(F.col("_first_status") == "PUBLISHED", at),
        "created_at": F.when(held, F.col("created_at")).otherwise(at),
        "updated_at": F.when(given, at).otherwise(F.col("updated_at")),
    }
    upserted = merged.withColumns(changes).select(*existing.columns)
    top = existing.select("id").unionByName(keyed.select("id")).agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = number_rows(valid.where(F.coalesce(F.col("id") <= 0, F.lit(True))), [], "seq").join(top, F.lit(True))
    created = fresh.withColumns(
        {
            "id": F.col("top") + F.col("n") + 1,
            "expires_at": F.col("last_date"),
            "review_status": F.lit("MANUAL_VERIFIED"),
            "published_at": F.when(F.col("status") == "PUBLISHED", at),
            "created_at": at,
            "updated_at": at,
        }
    )
    created = created.select(*[c for c in existing.columns if c in created.columns])
    counts = incoming.agg(
        F.count_if(F.col("error").isNull()).alias("imported"), F.count_if(F.col("error").isNotNull()).alias("skipped")
    )
    return upserted.unionByName(created, allowMissingColumns=True), counts


def advance_source_hash(sources: DataFrame, collected: DataFrame, handled: DataFrame) -> DataFrame:
    """Store a source's collected hash only when all its candidates were handled without error.

    `handled` holds one row per candidate: (source_id, ok).
    """
    clean_runs = handled.groupBy(F.col("source_id").alias("id")).agg(F.bool_and("ok").alias("_ok"))
    hashes = collected.select(F.col("source_id").alias("id"), F.col("content_hash").alias("_hash"))
    joined = sources.join(hashes, "id", "left").join(clean_runs, "id", "left")
    advance = F.col("_hash").isNotNull() & F.coalesce("_ok", F.lit(True))
    return joined.withColumn(
        "last_content_hash", F.when(advance, F.col("_hash")).otherwise(F.col("last_content_hash"))
    ).drop("_hash", "_ok")
