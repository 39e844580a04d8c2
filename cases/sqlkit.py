"""DuckDB expressions used by the oracles (RE2 regexes, list comprehension for local names)."""

from __future__ import annotations

from gazette import vocabulary as V

_SPACES = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_counter = [0]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def let(value: str, body) -> str:
    _counter[0] += 1
    name = f"v{_counter[0]}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({x}, ''), chr(0), ''), {q(_SPACES)}, ' ', 'g'))"


def fold(x: str) -> str:
    accents = "([àáâãäåçèéêëìíîïñòóôõöùúûüýÿ])"
    return (
        f"trim(regexp_replace(strip_accents(regexp_replace(lower(coalesce({x}, '')), '{accents}', '\\1 ', 'g')), "
        "'[^a-z0-9]+', ' ', 'g'))"
    )


def has(x: str, pattern: str, ignore_case: bool = True) -> str:
    return f"coalesce(regexp_matches({x}, {q(('(?i)' if ignore_case else '') + pattern)}), false)"


def sub(x: str, pattern: str, text: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(text)}, 'g')"


def canon(x: str, base: str | None = None) -> str:
    """Canonical URL for plain hosts without ports or credentials."""

    def query(u: str) -> str:
        raw = f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
        pairs = (
            f"list_filter(string_split({raw}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_|fbclid(=|$)|gclid(=|$)|mc_)'))"
        )
        sorted_pairs = f"list_sort(list_transform({pairs}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END))"
        return f"CASE WHEN len({sorted_pairs}) > 0 THEN '?' || replace(array_to_string({sorted_pairs}, '&'), ';', '%3B') ELSE '' END"

    def path(u: str) -> str:
        raw = f"regexp_extract({u}, '(?i)^https?://[^/?#]*([^?#]*)', 1)"
        chars = f"array_to_string(list_transform(string_split({raw}, ''), lambda c: CASE WHEN regexp_matches(c, '[^!-~]') THEN url_encode(c) ELSE c END), '')"
        return f"CASE WHEN regexp_matches({raw}, '^/*$') THEN '/' ELSE regexp_replace({chars}, '/+$', '') END"

    def build(u: str) -> str:
        host = f"regexp_replace(lower(regexp_extract({u}, '(?i)^https?://([^/?#]*)', 1)), '^www\\.', '')"
        scheme = f"lower(regexp_extract({u}, '(?i)^(https?)://', 1))"
        return f"CASE WHEN regexp_matches({u}, '(?i)^https?://[a-z0-9.-]+([/?#]|$)') THEN {scheme} || '://' || {host} || {path(u)} || {query(u)} END"

    def resolve(r: str) -> str:
        if base is None:
            return let(r, build)
        origin = f"regexp_extract({base}, '(?i)^(https?://[^/?#]*)', 1)"
        folder = f"regexp_extract({base}, '(?i)^(https?://[^/?#]*[^?#]*/)', 1)"
        return let(
            f"CASE WHEN regexp_matches({r}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {r} WHEN starts_with({r}, '/') THEN {origin} || {r} ELSE {folder} || {r} END",
            build,
        )

    return let(clean(x), lambda r: f"CASE WHEN {r} = '' OR starts_with({r}, '#') THEN NULL ELSE {resolve(r)} END")


def day(x: str) -> str:
    """Day of a date text as `yyyy-MM-dd`."""

    def parse(s: str) -> str:
        return (
            f"strftime(CASE WHEN regexp_matches({s}, '^20\\d\\d-\\d{{1,2}}-\\d{{1,2}}$') THEN try_strptime({s}, '%Y-%m-%d') "
            f"WHEN regexp_matches({s}, '^\\d{{1,2}}[/.-]\\d{{1,2}}[/.-]20\\d\\d$') THEN try_strptime(regexp_replace({s}, '[.-]', '/', 'g'), '%d/%m/%Y') "
            f"WHEN regexp_matches({s}, '(?i)^\\d{{1,2}}(st|nd|rd|th)?[ -]+[a-z]+[ ,-]+20\\d\\d$') THEN coalesce("
            f"try_strptime(regexp_replace(regexp_replace({s}, '(?i)^(\\d+)(st|nd|rd|th)', '\\1'), '[ ,-]+', ' ', 'g'), '%d %B %Y'), "
            f"try_strptime(regexp_replace(regexp_replace({s}, '(?i)^(\\d+)(st|nd|rd|th)', '\\1'), '[ ,-]+', ' ', 'g'), '%d %b %Y')) END, '%Y-%m-%d')"
        )

    return let(clean(x), parse)


def deadline(x: str) -> str:
    """End of the day of a date text."""
    return f"(CAST({day(x)} AS TIMESTAMP) + INTERVAL '23:59:59.999')"


def ts_day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def position(s: str, pattern: str, ignore_case: bool = True) -> str:
    """Characters before the first match, null when there is none."""
    flags = "(?is)" if ignore_case else "(?s)"
    return (
        f"CASE WHEN regexp_matches({s}, {q(flags + pattern)}) "
        f"THEN length(regexp_extract({s}, {q(flags + '^(.*?)(?:' + pattern + ')')}, 1)) END"
    )


def cut(x: str, patterns: list[tuple[str, bool]], minimum: int = 20) -> str:
    def body(s: str) -> str:
        stops = ", ".join(
            let(position(s, p, i), lambda n: f"CASE WHEN {n} >= {minimum} THEN {n} END") for p, i in patterns
        )
        return f"trim(left({s}, coalesce(list_min([{stops}]), length({s}))))"

    return let(x, body)


def last_index(s: str, needle: str) -> str:
    return (
        f"CASE WHEN contains({s}, {q(needle)}) THEN length({s}) - strpos(reverse({s}), {q(needle[::-1])}) - {len(needle) - 1} ELSE -1 END"
    )


def bounded(x: str, limit: int) -> str:
    def cut_prefix(p: str) -> str:
        sentence = f"greatest({last_index(p, '. ')}, {last_index(p, '; ')}, {last_index(p, ' • ')})"
        at = f"CASE WHEN {sentence} >= {int(limit * 0.55)} THEN {sentence} + 1 ELSE {last_index(p, ' ')} END"
        return let(at, lambda n: f"trim(left({p}, CASE WHEN {n} > 0 THEN {n} ELSE {limit} END))")

    return let(
        x, lambda s: f"CASE WHEN length({s}) <= {limit} THEN {s} ELSE {let(f'left({s}, {limit})', cut_prefix)} END"
    )


def repair(x: str, limit: int) -> str:
    fixed = clean(x)
    for broken, good in V.MOJIBAKE_REPAIRS:
        fixed = sub(fixed, broken, good.replace("$1", "\\1"))
    fixed = clean(fixed)
    fixed = f"regexp_replace({fixed}, '(?i)^(?:is|are)\\s+', '')"
    fixed = f"regexp_replace({fixed}, '^(?:\\(?\\d{{1,2}}[.)]\\s*)+', '')"
    fixed = f"trim(regexp_replace({fixed}, '^[\\s:;,./-]+', ''))"
    return let(
        fixed,
        lambda s: f"CASE WHEN {s} <> '' AND NOT regexp_matches({s}, {q(V.RESIDUAL_MOJIBAKE)}) THEN nullif({bounded(s, limit)}, '') END",
    )


def strip_html(x: str) -> str:
    def decode(s: str) -> str:
        for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
            s = sub(s, "(?i)" + entity, char)
        return s

    s = decode(f"coalesce({x}, '')")
    for tag in ("script", "style", "noscript"):
        s = sub(s, f"(?is)<{tag}.*?</{tag}>", " ")
    return clean(decode(sub(s, "(?s)<[^>]+>", " ")))


# --- cleaned candidates ---------------------------------------------------------------
def _i(patterns):
    return [(p, True) for p in patterns]


def kept(x: str, condition) -> str:
    return let(x, lambda s: f"CASE WHEN {condition(s)} THEN {s} END")


def qualification(x: str) -> str:
    def from_education(s: str) -> str:
        return let(
            position(s, V.EDUCATION),
            lambda n: f"CASE WHEN {n} > 0 AND {has(f'left({s}, {n})', V.BEFORE_EDUCATION)} THEN substr({s}, {n} + 1) ELSE {s} END",
        )

    cuts = _i(V.QUALIFICATION_CUTS) + [(V.NUMBERED_HEADING_CUT, False)]
    return let(
        cut(let(repair(x, 1200), from_education), cuts),
        lambda s: f"CASE WHEN {has(f'left({s}, 200)', V.EDUCATION)} THEN {repair(s, 420)} END",
    )


def vacancy(x: str, raw: str) -> str:
    return kept(
        repair(x, 20),
        lambda s: f"{has(s, V.VACANCY_VALUE)} AND (NOT regexp_matches({s}, '^0*1$') OR {has(raw, V.SINGLE_VACANCY)})",
    )


def salary(x: str) -> str:
    start = f"regexp_replace({repair(x, 800)}, '(?i)^of\\s+', '')"

    def check(s: str) -> str:
        trimmed = cut(cut(s, _i(V.SALARY_CUTS)), _i(V.NARRATIVE_CUTS) + [(V.BULLET_CUT, False)])
        out = let(trimmed, lambda t: f"CASE WHEN {has(t, V.AMOUNT)} THEN {repair(t, 220)} END")
        return f"CASE WHEN NOT {has(s, V.PAY_TABLE[0])} AND NOT {has(s, V.PAY_TABLE[1])} THEN {out} END"

    return let(start, check)


def age_limit(x: str) -> str:
    return let(
        cut(repair(x, 800), _i(V.AGE_CUTS), 0),
        lambda s: f"CASE WHEN NOT {has(s, V.OPEN_AGE_REFERENCE)} AND {has(f'left({s}, 260)', V.AGE_EVIDENCE)} "
        f"THEN {repair(sub(s, '[ ]*[•]+[ ]*$', ''), 240)} END",
    )


def department(x: str, title: str) -> str:
    stated = kept(repair(x, 180), lambda s: f"NOT ({has(s, V.NAVIGATION[0])} AND {has(s, V.NAVIGATION[1])})")
    prefix = f"regexp_extract(coalesce({repair(title, 240)}, ''), {q(V.TITLE_PREFIX)}, 1)"
    return f"coalesce({stated}, {kept(prefix, lambda p: f'length({p}) >= 3 AND NOT {has(p, V.TITLE_PREFIX_STOP)}')})"


def location(x: str, title: str) -> str:
    stated = kept(repair(x, 180), lambda s: f"NOT {has(s, V.NO_LOCATION)}")
    city = f"nullif(regexp_extract({clean(title)}, {q('(?i)' + chr(92) + 'b(' + '|'.join(V.CITIES) + ')' + chr(92) + 'b')}, 1), '')"
    renamed = let(
        city, lambda c: f"CASE lower({c}) WHEN 'bangalore' THEN 'Bengaluru' WHEN 'mysore' THEN 'Mysuru' ELSE {c} END"
    )
    return f"coalesce({stated}, {renamed})"


def selection_process(x: str) -> str:
    def start(s: str) -> str:
        a, b = position(s, V.APPLICATION_START), position(s, V.SELECTION_START)
        body = f"regexp_replace(substr({s}, {b} + 1), '(?i)^selection\\s*(?:process|procedure|method)?\\s*[:\\-]?\\s*', '')"
        body = body.replace(f"{b} + 1", f"({b}) + 1")
        return (
            f"CASE WHEN ({a}) IS NOT NULL AND (({b}) IS NULL OR ({a}) < ({b})) THEN NULL "
            f"WHEN ({b}) > 0 THEN {body} ELSE {s} END"
        )

    cuts = _i(V.SELECTION_CUTS) + [(V.NUMBERED_HEADING_CUT, False)]
    return let(
        cut(let(repair(x, 900), start), cuts),
        lambda s: f"CASE WHEN {has(f'left({s}, 260)', V.SELECTION_EVIDENCE)} THEN {repair(s, 360)} END",
    )


FACTS = [
    "title", "department", "qualification", "vacancy", "salary", "age_limit", "location", "application_fee",
    "selection_process", "description", "how_to_apply",
]

CLEANED = {
    "title": f"coalesce({repair('title', 240)}, left(title, 240))",
    "department": department("department", "title"),
    "qualification": qualification("qualification"),
    "vacancy": vacancy("vacancy", "raw_text"),
    "salary": salary("salary"),
    "age_limit": age_limit("age_limit"),
    "location": location("location", "title"),
    "application_fee": kept(repair("application_fee", 200), lambda s: has(s, V.FEE_EVIDENCE)),
    "selection_process": selection_process("selection_process"),
    "description": repair("description", 2000),
    "how_to_apply": repair("how_to_apply", 800),
}

# The candidates view with every field cleaned and its content hash.
CLEANED_CANDIDATES = (
    "SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in CLEANED.items()) + f"), sha256({clean('raw_text')}) AS content_hash FROM candidates"
)


def composite(title: str, dept: str, loc: str, d: str) -> str:
    return f"{fold(title)} || '|' || {fold(dept)} || '|' || {fold(loc)} || '|' || coalesce({d}, '')"


def fingerprint(title: str, dept: str, loc: str, d: str, job_id: str) -> str:
    return f"sha256({composite(title, dept, loc, d)} || '|' || {fold(job_id)})"
