"""Column-set transforms over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gazette import vocabulary as V
from gazette.functions import dates, html, identity, text, urls


def normalize_text_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: text.fold(c) for c in columns})


def canonicalize_urls(df: DataFrame, columns: list[str], base: str | None = None) -> DataFrame:
    return df.withColumns({c: urls.canonical_url(c, base) for c in columns})


def with_content_hash(df: DataFrame, column: str = "raw_text") -> DataFrame:
    return df.withColumn("content_hash", text.content_hash(column))


def with_fingerprint(df: DataFrame, day: Column) -> DataFrame:
    """`source_hash` of listings or candidates; `day` is their deadline day."""
    hashed = identity.fingerprint("title", "department", "location", day, "source_job_id")
    return df.withColumn("source_hash", hashed)


def parse_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: dates.parse_date(c) for c in columns})


def extract_notice_id(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("notice_id", identity.notice_id(column))


def strip_html(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("text", html.strip_html(column))


def repair_mojibake(df: DataFrame, column: str, limit: int) -> DataFrame:
    return df.withColumn(column, text.repair(column, limit))


def cut_at_markers(df: DataFrame, column: str, patterns: list[str], minimum: int = 20) -> DataFrame:
    return df.withColumn(column, text.cut_at(F.col(column), [(p, True) for p in patterns], minimum))


def title_dates(df: DataFrame, column: str = "title") -> DataFrame:
    """Adds `title_start` and `title_end` read from the numeric dates of a title."""
    found = df.withColumn("_dates", dates.title_dates(column))
    return found.withColumns({"title_start": F.col("_dates.start"), "title_end": F.col("_dates.end")}).drop("_dates")


def notice_identity(df: DataFrame) -> DataFrame:
    """Adds `identity`, `candidate_key` and `snapshot_hash`."""
    parts = identity.identity_parts()
    staged = {name: F.col(name) for name in parts}
    return (
        df.withColumns(parts)
        .withColumns(
            {
                "identity": identity.notice_identity(staged),
                "candidate_key": identity.review_key(staged),
                "snapshot_hash": identity.snapshot_hash(staged),
            }
        )
        .drop(*parts)
    )


def https_upgrade(df: DataFrame, column: str) -> DataFrame:
    """Upgrade `column` against the row's `domain` and `start_url`."""
    return df.withColumn(column, urls.https_upgrade(column, "domain", "start_url"))


def transient_error(df: DataFrame, column: str = "error") -> DataFrame:
    return df.withColumn("transient", text.has(column, V.TRANSIENT_ERROR))


def pseudonymize(df: DataFrame, email: str, token: str) -> DataFrame:
    """Lower-case trimmed `email_normalized` and a hashed `token_hash`."""
    return df.withColumns(
        {"email_normalized": F.lower(F.trim(email)), "token_hash": text.sha(F.col(token))}
    )


def evidence_rule(value: Column, source_text: Column) -> Column:
    """Every longer word of the value occurs in the text."""
    words = F.filter(F.split(text.fold(value), " "), lambda w: F.length(w) > 1)
    return text.let(
        F.struct(words.alias("words"), text.fold(source_text).alias("body")),
        lambda x: (F.size(x["words"]) > 0) & F.forall(x["words"], lambda w: x["body"].contains(w)),
    )


def evidence_check(df: DataFrame, value: str, source_text: str, url: bool = False) -> DataFrame:
    """Blank a value the text does not support; URLs must occur literally."""
    cleaned = text.clean(value)
    if url:
        canonical = urls.canonical_url(cleaned)
        body = F.col(source_text)
        literal = body.contains(cleaned) | body.contains(canonical)
        return df.withColumn(value, F.when((cleaned != "") & canonical.isNotNull() & literal, canonical))
    return df.withColumn(value, F.when((cleaned != "") & evidence_rule(cleaned, F.col(source_text)), cleaned))


def fill_missing(df: DataFrame, extracted: DataFrame, key: str, columns: list[str], method: str = "AI") -> DataFrame:
    """Fill only empty fields from a table of supported values; mark the method when any value was supported."""
    other = extracted.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(other, key, "left")
    supported = F.lit(False)
    for c in columns:
        supported = supported | F.col(f"_{c}").isNotNull()
    filled = {c: F.coalesce(text.blank_to_null(c), F.col(f"_{c}"), F.col(c)) for c in columns}
    filled["extraction_method"] = F.when(supported, method).otherwise(F.col("extraction_method"))
    return joined.withColumns(filled).drop(*[f"_{c}" for c in columns])
