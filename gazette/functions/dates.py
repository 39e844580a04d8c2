"""Calendar expressions.  Parsed deadlines are the last millisecond of their day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from gazette import vocabulary as V
from gazette.functions.text import clean, col, kept, let

_CLOCK = r"(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d|24:00:00)(?:\.\d{1,3})?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)?"
_ISO = r"^(20\d{2})-(\d{1,2})-(\d{1,2})(?:T" + _CLOCK + r")?$"
_NUMERIC = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](20\d{2})$"
_NAMED = r"(?i)^(\d{1,2})(?:st|nd|rd|th)?[\s-]+([a-z]+)[\s,-]+(20\d{2})$"


def ts(now: datetime | str | Column) -> Column:
    """A parameter instant as TIMESTAMP_NTZ."""
    if isinstance(now, Column):
        return now
    return F.lit(str(now)).cast("timestamp_ntz")


def _month_number(name: Column) -> Column:
    full = F.array(*[F.lit(m) for m in V.MONTHS])
    short = F.array(*[F.lit(m[:3]) for m in V.MONTHS])
    lowered = F.lower(name)
    return F.greatest(F.array_position(full, lowered), F.array_position(short, lowered)).cast("int")


def _end_of_day(year: Column, month: Column, day: Column) -> Column:
    return F.try_make_timestamp_ntz(
        year.cast("int"), month.cast("int"), day.cast("int"), F.lit(23), F.lit(59), F.lit("59.999").cast("decimal(16,6)")
    )


@kept
def parse_date(c: Column | str) -> Column:
    """`2026-12-31`, `31/12/2026` or `31 Dec 2026` as the end of that day, else null."""

    def parse(s: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(s, pattern, i)
        return (
            F.when(s == "", F.lit(None).cast("timestamp_ntz"))
            .when(s.rlike(_ISO), _end_of_day(part(_ISO, 1), part(_ISO, 2), part(_ISO, 3)))
            .when(s.rlike(_NUMERIC), _end_of_day(part(_NUMERIC, 3), part(_NUMERIC, 2), part(_NUMERIC, 1)))
            .when(
                s.rlike(_NAMED),
                _end_of_day(part(_NAMED, 3), _month_number(part(_NAMED, 2)), part(_NAMED, 1)),
            )
        )

    return let(clean(c), parse)


def day(c: Column | str) -> Column:
    """`yyyy-MM-dd` of a timestamp column, null when unknown."""
    return F.date_format(col(c), "yyyy-MM-dd")


def parsed_day(c: Column | str) -> Column:
    return day(parse_date(c))


def exact_correction_date(c: Column) -> Column:
    """`yyyy-MM-dd` or `dd/MM/yyyy` in 1900-9999 as ISO text, null when invalid."""

    def check(s: Column) -> Column:
        iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s).when(
            s.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.regexp_replace(s, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")
        )
        return F.when((F.try_to_date(iso, "yyyy-MM-dd").isNotNull()) & (iso >= "1900-01-01"), iso)

    return let(c, check)


def title_dates(title: Column | str) -> Column:
    """struct(start, end): the last numeric date is the end, the one before it the start."""
    found = F.regexp_extract_all(col(title), F.lit(r"(?<!\w)(\d{1,2}[/.\-]\d{1,2}[/.\-]20\d{2})(?!\w)"), F.lit(1))
    return let(
        found,
        lambda a: F.struct(
            F.when(F.size(a) >= 2, F.try_element_at(a, F.lit(-2))).alias("start"),
            F.when(F.size(a) >= 1, F.try_element_at(a, F.lit(-1))).alias("end"),
        ),
    )


def is_past(deadline: Column | str, now: Column) -> Column:
    return F.coalesce(col(deadline) < now, F.lit(False))


def days_between(later: Column, earlier: Column) -> Column:
    """Exact distance in days as a double."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86_400_000_000.0)
