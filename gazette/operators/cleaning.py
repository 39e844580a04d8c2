"""Cleaning of the extracted notice fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gazette import vocabulary as V
from gazette.functions.text import blank_to_null, clean, col, cut_at, first_match, has, head, let, repair, rx


def _any_case(patterns: list[str]) -> list[tuple[str, bool]]:
    return [(p, True) for p in patterns]


def _kept(c: Column, condition: Column) -> Column:
    return F.when(condition, c)


def qualification(c: Column | str) -> Column:
    """From the first education term on, cut at the next section; needs education evidence."""
    cuts = _any_case(V.QUALIFICATION_CUTS) + [(V.NUMBERED_HEADING_CUT, False)]

    def from_education(s: Column) -> Column:
        at = first_match(s, V.EDUCATION)
        skip = (at > 0) & has(F.substring(s, F.lit(1), at), V.BEFORE_EDUCATION)
        return F.when(skip, F.substring(s, at + 1, F.length(s))).otherwise(s)

    def finish(s: Column) -> Column:
        return _kept(repair(s, V.FIELD_CAPS["qualification"]), has(head(s, 200), V.EDUCATION))

    return let(repair(c, 1_200), lambda s: let(cut_at(let(s, from_education), cuts), finish))


def vacancy(c: Column | str, raw_text: Column | str) -> Column:
    """A count or `various`/`multiple`; a lone 1 needs the text to say so."""

    def check(s: Column) -> Column:
        single = s.rlike("^0*1$")
        return _kept(s, has(s, V.VACANCY_VALUE) & (~single | has(raw_text, V.SINGLE_VACANCY)))

    return let(repair(c, 20), check)


def salary(c: Column | str) -> Column:
    cuts = _any_case(V.SALARY_CUTS)
    narrative = _any_case(V.NARRATIVE_CUTS) + [(V.BULLET_CUT, False)]

    def check(s: Column) -> Column:
        table = has(s, V.PAY_TABLE[0]) | has(s, V.PAY_TABLE[1])
        trimmed = cut_at(cut_at(s, cuts), narrative)
        return F.when(
            ~table, let(trimmed, lambda x: _kept(repair(x, V.FIELD_CAPS["salary"]), has(x, V.AMOUNT)))
        )

    return let(F.regexp_replace(repair(c, 800), r"(?i)^of\s+", ""), check)


def age_limit(c: Column | str) -> Column:
    def check(s: Column) -> Column:
        usable = ~has(s, V.OPEN_AGE_REFERENCE) & has(head(s, 260), V.AGE_EVIDENCE)
        return _kept(repair(F.regexp_replace(s, r"\s*[•]+\s*$", ""), V.FIELD_CAPS["age_limit"]), usable)

    return let(cut_at(repair(c, 800), _any_case(V.AGE_CUTS), 0), check)


def application_fee(c: Column | str) -> Column:
    return let(repair(c, V.FIELD_CAPS["application_fee"]), lambda s: _kept(s, has(s, V.FEE_EVIDENCE)))


def department(c: Column | str, title: Column | str) -> Column:
    """The stated department unless it is navigation text; else an organisation prefix of the title."""
    stated = let(
        repair(c, V.FIELD_CAPS["department"]),
        lambda s: _kept(s, ~(has(s, V.NAVIGATION[0]) & has(s, V.NAVIGATION[1]))),
    )
    prefix = let(
        F.regexp_extract(F.coalesce(repair(title, V.FIELD_CAPS["title"]), F.lit("")), V.TITLE_PREFIX, 1),
        lambda p: _kept(p, (F.length(p) >= 3) & ~has(p, V.TITLE_PREFIX_STOP)),
    )
    return F.coalesce(stated, prefix)


def location(c: Column | str, title: Column | str) -> Column:
    """The stated location, else the first known city of the title under its current name."""
    stated = let(repair(c, V.FIELD_CAPS["location"]), lambda s: _kept(s, ~has(s, V.NO_LOCATION)))
    cities = r"\b(" + "|".join(V.CITIES) + r")\b"
    city = let(
        blank_to_null(F.regexp_extract(clean(title), rx(cities), 1)),
        lambda x: F.when(F.lower(x) == "bangalore", V.CITY_RENAMES["bangalore"])
        .when(F.lower(x) == "mysore", V.CITY_RENAMES["mysore"])
        .otherwise(x),
    )
    return F.coalesce(stated, city)


def selection_process(c: Column | str) -> Column:
    cuts = _any_case(V.SELECTION_CUTS) + [(V.NUMBERED_HEADING_CUT, False)]

    def start(s: Column) -> Column:
        def choose(at: Column) -> Column:
            chosen, applying = at["selection"], at["application"]
            body = F.regexp_replace(
                F.substring(s, chosen + 1, F.length(s)),
                r"(?i)^selection\s*(?:process|procedure|method)?\s*[:\-]?\s*",
                "",
            )
            return F.when(
                ~((applying >= 0) & ((chosen < 0) | (applying < chosen))), F.when(chosen > 0, body).otherwise(s)
            )

        return let(
            F.struct(
                first_match(s, V.SELECTION_START).alias("selection"),
                first_match(s, V.APPLICATION_START).alias("application"),
            ),
            choose,
        )

    def finish(s: Column) -> Column:
        return _kept(repair(s, V.FIELD_CAPS["selection_process"]), has(head(s, 260), V.SELECTION_EVIDENCE))

    return let(repair(c, 900), lambda s: let(cut_at(let(s, start), cuts), finish))


def clean_notice_fields(df: DataFrame) -> DataFrame:
    """Every fact of a candidate cleaned and bounded; unsupported values become null."""
    caps = V.FIELD_CAPS
    return df.withColumns(
        {
            "title": F.coalesce(repair("title", caps["title"]), head(col("title"), caps["title"])),
            "department": department("department", "title"),
            "qualification": qualification("qualification"),
            "vacancy": vacancy("vacancy", "raw_text"),
            "salary": salary("salary"),
            "age_limit": age_limit("age_limit"),
            "location": location("location", "title"),
            "application_fee": application_fee("application_fee"),
            "selection_process": selection_process("selection_process"),
            "description": repair("description", caps["description"]),
            "how_to_apply": repair("how_to_apply", caps["how_to_apply"]),
        }
    )
