"""Keys and hashes that identify notices, snapshots and sources."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gazette import vocabulary as V
from gazette.functions.dates import parsed_day
from gazette.functions.text import clean, col, fold, let, present, rx, sha
from gazette.functions.urls import canonical_url

_TRIMMED = " \t\n\x0b\f\r      　﻿" + "".join(map(chr, range(0x2000, 0x200B)))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def composite(title: Column | str, department: Column | str, location: Column | str, day: Column) -> Column:
    """Folded title|department|location|day."""
    return F.concat_ws("|", fold(title), fold(department), fold(location), _or_empty(day))


def fingerprint(title: Column | str, department: Column | str, location: Column | str, day: Column, job_id: Column | str) -> Column:
    return sha(F.concat_ws("|", composite(title, department, location, day), fold(job_id)))


def notice_id(text: Column | str) -> Column:
    """The first advertisement number of a text, upper-cased; null for a stop word."""
    found = F.upper(clean(F.regexp_extract(clean(text), rx(V.NOTICE_ID), 1)))
    return let(found, lambda x: F.when((x != "") & ~x.isin(V.NOTICE_ID_STOP_WORDS), x))


def identity_parts() -> dict[str, Column]:
    """Normalised values the three keys below share; stage them as columns to compute each once."""
    return {
        "_job": fold("source_job_id"),
        "_title": fold("title"),
        "_apply": canonical_url("apply_link"),
        "_notice": canonical_url("notification_link"),
        "_source": canonical_url("source_url"),
        "_start": parsed_day("application_start_date"),
        "_end": parsed_day("last_date"),
    }


def notice_identity(parts: dict[str, Column] | None = None) -> Column:
    """Identity of one notice inside a source: id, else notice URL, else title and date."""
    p = parts or identity_parts()
    return (
        F.when(present("source_job_id"), F.concat(F.lit("id:"), p["_job"]))
        .when(present("notification_link"), F.concat(F.lit("notice:"), F.coalesce(p["_notice"], F.lit("null"))))
        .otherwise(F.concat(F.lit("job:"), p["_title"], F.lit(":"), clean("last_date")))
    )


def review_key(parts: dict[str, Column] | None = None) -> Column:
    """Stable review identity of a candidate within its source."""
    p = parts or identity_parts()
    by_title = F.concat(
        F.lit("detail-title-date:"), F.concat_ws("|", _or_empty(p["_source"]), p["_title"], _or_empty(p["_end"]))
    )
    identity = (
        F.when(p["_job"] != "", F.concat(F.lit("source-job:"), p["_job"]))
        .when(p["_notice"].isNotNull(), F.concat(F.lit("notification:"), p["_notice"]))
        .otherwise(by_title)
    )
    return sha(F.concat(F.lit("source:"), F.col("source_id").cast("string"), F.lit("|"), identity))


def snapshot_hash(parts: dict[str, Column] | None = None) -> Column:
    """Hash over every fact a reviewer sees; any change asks for a new review."""
    p = parts or identity_parts()
    values = [
        "content_hash", "title", "department", "qualification", "vacancy", "salary", "age_limit", "location",
        "application_fee", "selection_process", p["_start"], p["_end"], p["_apply"], p["_notice"], p["_source"],
        "source_job_id",
    ]
    trimmed = [F.trim(_or_empty(col(v)), F.lit(_TRIMMED)) for v in values]
    return sha(F.to_json(F.array(*trimmed)))


def significant_tokens(title: Column | str) -> Column:
    """Distinct title words longer than two characters that are not amendment words."""
    return F.array_distinct(
        F.filter(F.split(fold(title), " "), lambda w: (F.length(w) > 2) & ~w.isin(V.CORRIGENDUM_STOP_WORDS))
    )
