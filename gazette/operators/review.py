"""Review ledger: decisions and corrections recorded in run items, and their use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gazette import vocabulary as V
from gazette.functions.dates import exact_correction_date, parse_date
from gazette.functions.text import clean, let
from gazette.functions.urls import correction_url
from gazette.operators.cleaning import clean_notice_fields

_DATES = ["application_start_date", "last_date"]
_LINKS = ["apply_link", "notification_link", "official_website"]
_ENTRY = "struct<field:string,value:string,error:string>"


# --- corrections --------------------------------------------------------------------
def _entry(field: Column, raw: Column, is_text: Column) -> Column:
    """struct(field, value, error) of one submitted correction."""

    def judge(value: Column) -> Column:
        date, link = exact_correction_date(value), correction_url(value)
        is_date, is_link = field.isin(_DATES), field.isin(_LINKS)
        shaped = value.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$")
        note = lambda text: F.concat(field, F.lit(text))
        error = (
            F.when(~field.isin(V.CORRECTION_FIELDS), F.concat(F.lit("Unsupported correction field: "), field))
            .when(~is_text, note(" must be text or blank."))
            .when(F.length(value) > 2_000, note(": maximum 2000 characters."))
            .when(is_date & (value != "") & ~shaped, note(": use YYYY-MM-DD or DD/MM/YYYY."))
            .when(is_date & (value != "") & date.isNull(), note(": invalid calendar date."))
            .when(
                is_link & (value != "") & ~value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"),
                note(": enter a complete HTTP or HTTPS URL."),
            )
            .when(is_link & (value != "") & link.isNull(), note(": enter an HTTP or HTTPS URL without credentials."))
        )
        final = F.when(value == "", F.lit(None)).when(is_date, date).when(is_link, link).otherwise(value)
        return F.struct(field.alias("field"), final.alias("value"), error.alias("error"))

    return let(clean(raw), judge)


def validate_corrections(df: DataFrame, column: str = "corrections") -> DataFrame:
    """Replace a `map<string,string>` or JSON-object column by its validated form.

    Adds `correction_error`, the first rule broken; blank values become explicit nulls.
    """
    if dict(df.dtypes)[column] == "string":
        parsed = F.from_json(column, "map<string,variant>")
        entries = F.transform(
            F.map_entries(parsed),
            lambda e: _entry(
                e["key"],
                F.try_variant_get(e["value"], "$", "string"),
                F.coalesce(F.schema_of_variant(e["value"]).isin("STRING", "VOID"), F.lit(True)),
            ),
        )
    else:
        entries = F.transform(F.map_entries(column), lambda e: _entry(e["key"], e["value"], F.lit(True)))
    checked = df.withColumn("_entries", entries)
    broken = F.filter("_entries", lambda e: e["error"].isNotNull())
    clean_map = F.map_from_entries(F.transform("_entries", lambda e: F.struct(e["field"], e["value"])))
    return (
        checked.withColumn("correction_error", F.try_element_at(broken, F.lit(1))["error"])
        .withColumn(column, F.when(F.col("correction_error").isNull(), clean_map))
        .drop("_entries")
    )


def overlay_corrections(candidates: DataFrame, corrections: DataFrame) -> DataFrame:
    """Patch candidates whose (candidate_key, snapshot_hash) has saved corrections.

    Only named fields change (a named null blanks the field); the row is cleaned
    again.  `corrected` marks patched rows, `correction_error` a start after the end.
    """
    patch = corrections.select("candidate_key", "snapshot_hash", F.col("corrections").alias("_m"))
    joined = candidates.join(patch, ["candidate_key", "snapshot_hash"], "left")
    patched = joined.withColumns(
        {
            c: F.when(F.map_contains_key("_m", c), F.try_element_at("_m", F.lit(c))).otherwise(F.col(c))
            for c in V.CORRECTION_FIELDS
        }
    )
    reversed_dates = parse_date("application_start_date") > parse_date("last_date")
    return (
        clean_notice_fields(patched)
        .withColumn("corrected", F.col("_m").isNotNull())
        .withColumn(
            "correction_error",
            F.when(F.col("corrected") & reversed_dates, "Application start date must not be after the last date."),
        )
        .drop("_m")
    )


# --- ledgers ---------------------------------------------------------------------------
def _newest(df: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return df
    rank = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("created_at"), F.desc("id")))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest_decisions(run_items: DataFrame, n: int | None = 500) -> DataFrame:
    """The newest valid decision per source and snapshot among the newest `n` skipped items."""
    fields = "kind string, candidateKey string, snapshotHash string, decision string, reason string"
    items = _newest(run_items.where(F.col("action") == "SKIPPED").select("source_id", "created_at", "id", "details"), n)
    parsed = items.select("source_id", "created_at", "id", F.from_json("details", fields).alias("d"))
    valid = parsed.where(
        (F.col("d.kind") == "manual-review-decision")
        & (F.col("d.candidateKey") != "")
        & (F.col("d.snapshotHash") != "")
        & F.col("d.decision").isin("REJECTED", "NEEDS_CORRECTION")
    )
    row = F.struct(
        "d.decision", F.coalesce("d.reason", F.lit("Persisted manual review decision.")).alias("reason"), "created_at"
    )
    return (
        valid.groupBy("source_id", F.col("d.candidateKey").alias("candidate_key"), F.col("d.snapshotHash").alias("snapshot_hash"))
        .agg(F.max_by(row, F.struct("created_at", "id")).alias("row"))
        .select("source_id", "candidate_key", "snapshot_hash", "row.*")
    )


def latest_corrections(run_items: DataFrame, n: int | None = 200) -> DataFrame:
    """The newest correction per source and snapshot; an invalid newest one hides older ones."""
    parsed = run_items.where(F.col("action") == "SKIPPED").select(
        "source_id",
        "created_at",
        "id",
        F.get_json_object("details", "$.kind").alias("kind"),
        F.get_json_object("details", "$.candidateKey").alias("candidate_key"),
        F.get_json_object("details", "$.snapshotHash").alias("snapshot_hash"),
        F.get_json_object("details", "$.corrections").alias("corrections"),
    )
    recent = _newest(parsed.where(F.col("kind") == "manual-review-correction"), n)
    newest = (
        recent.where(F.col("candidate_key").isNotNull() & F.col("snapshot_hash").isNotNull())
        .groupBy("source_id", "candidate_key", "snapshot_hash")
        .agg(F.max_by("corrections", F.struct("created_at", "id")).alias("corrections"))
    )
    checked = validate_corrections(newest)
    return checked.where(F.col("correction_error").isNull()).drop("correction_error")


_SNAPSHOT = ["source_id", "candidate_key", "snapshot_hash"]


def recorded(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(cand_id, recorded): the decisions on the snapshots of a candidate, for the candidates that have one.

    Only ids and hashes of the candidates are moved; `with_decision` picks from the list what belongs to a row, so equal hashes do no harm.
    """
    hashed = F.xxhash64(F.col("source_id").cast("bigint"), "candidate_key", "snapshot_hash").alias("hash")
    known = decisions.select(hashed, F.struct(*_SNAPSHOT, F.struct("decision", "reason").alias("found")).alias("x")).groupBy("hash").agg(F.collect_list("x").alias("found"))
    held = candidates.select("cand_id", hashed).join(known, "hash").select("cand_id", "found").distinct()
    return held.groupBy("cand_id").agg(F.flatten(F.collect_list("found")).alias("recorded"))


def with_decision(rows: DataFrame) -> DataFrame:
    """Rows with a `recorded` list to rows with `_decision`, as a left join over source, key and snapshot gives them."""
    own = F.filter("recorded", lambda x: (x["source_id"] == F.col("source_id")) & (x["candidate_key"] == F.col("candidate_key")) & (x["snapshot_hash"] == F.col("snapshot_hash")))
    return rows.select(*[c for c in rows.columns if c != "recorded"], F.explode_outer(F.transform(own, lambda x: x["found"])).alias("_decision"))


def overlay_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """A recorded decision on the exact snapshot replaces an otherwise addable proposal.

    Proposals that already carry their `recorded` decisions are not joined again.
    """
    if "recorded" in proposals.columns:
        joined = with_decision(proposals)
    else:
        joined = proposals.join(decisions.select(*_SNAPSHOT, F.struct("decision", "reason").alias("_decision")), _SNAPSHOT, "left")
    joined = joined.withColumn("decided", (F.col("action") == "WOULD_ADD") & F.col("_decision").isNotNull())
    decided = F.col("decided")
    rejected = F.col("_decision.decision") == "REJECTED"
    prefix = F.when(rejected, "Previously rejected exact source snapshot: ").otherwise("Needs correction before review: ")
    return joined.withColumns(
        {
            "action": F.when(decided & rejected, "REJECTED").when(decided, "LOW_CONFIDENCE").otherwise(F.col("action")),
            "reason": F.when(decided, F.concat(prefix, F.col("_decision.reason"))).otherwise(F.col("reason")),
        }
    ).drop("_decision")
