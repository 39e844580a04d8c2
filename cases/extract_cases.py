"""Extraction from pages and notice documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cases import sqlkit as k
from cases.registry import Tables, query
from cases.views import NOW
from gazette.scale import in_order
from gazette import vocabulary as V
from gazette.functions.dates import ts
from gazette.operators import documents, extract, merge

P, N = ("pages_in",), ("notices",)
_A = "(?i)" + V.ANCHOR


def _links(table: str = "pages_in", extra: str = "") -> str:
    return f"""SELECT page_id{extra}, url, CAST(i - 1 AS INT) AS pos, hrefs[i] AS href_raw, inners[i] AS inner_html FROM
      (SELECT page_id{extra}, url, regexp_extract_all(html, {k.q(_A)}, 1) AS hrefs, regexp_extract_all(html, {k.q(_A)}, 2) AS inners FROM {table}), LATERAL (SELECT unnest(range(1, len(hrefs) + 1)) AS i)"""


_LINKS = f"links AS MATERIALIZED (SELECT *, {k.canon('href_raw', 'url')} AS href, {k.strip_html('inner_html')} AS label FROM ({_links(extra=', source_id')}))"


@query("extract_links", f"WITH {_LINKS} SELECT page_id, pos, href_raw, href, label FROM links", P)
def _(t: Tables):
    return extract.extract_links(t.pages_in.select("page_id", "url", "html")).drop("url")


@query(
    "extract_document_links",
    f"""WITH {_LINKS} SELECT page_id, href, arg_max(label, pos) AS label, min(pos) AS pos FROM links
    WHERE {k.has('href', V.PDF_LINK)} AND {k.has("label || ' ' || href", V.DOCUMENT_LINK_WORDS)} GROUP BY page_id, href""",
    P,
)
def _(t: Tables):
    return extract.extract_document_links(t.pages_in.select("page_id", "url", "html"))


@query("oversize_filter", "SELECT page_id, url FROM pages WHERE octet_length(encode(html)) <= 4000")
def _(t: Tables):
    return extract.oversize_filter(t.raw("pages"), 4_000).select("page_id", "url")


def clean_title_sql(x: str) -> str:
    text = f"regexp_replace({k.clean(x)}, '(?i)^[a-z-]+=[\"''][^\"'']*[\"'']>\\s*', '')"
    text = f"trim(regexp_replace(regexp_replace({text}, {k.q('(?is)' + V.TITLE_TAIL + '.*$')}, ''), {k.q('(?i)' + V.TITLE_ACTION)}, ''))"

    def unrepeat(t: str) -> str:
        again = f"strpos(substr({t}, length(left({t}, 32)) + 1), left({t}, 32))"
        return f"CASE WHEN length({t}) >= 16 AND {again} > 0 THEN left({t}, length(left({t}, 32)) + {again} - 1) ELSE {t} END"

    return f"left(trim(regexp_replace({k.let(text, unrepeat)}, '[â€¦…]+$', '')), 240)"


@query(
    "backfill_titles",
    f"""WITH {_LINKS}, c AS MATERIALIZED (SELECT page_id, pos, href, label, {clean_title_sql('label')} AS title FROM links),
    named AS (SELECT page_id, href, arg_max(title, pos) AS title FROM c WHERE href IS NOT NULL AND length(title) >= 10 AND NOT {k.has('title', V.GENERIC_TITLE)} AND {k.has('title', V.JOB_SIGNAL)} GROUP BY ALL)
    SELECT c.page_id, c.pos, c.href, c.label AS anchor_title, CASE WHEN {k.has('c.label', V.GENERIC_TITLE)} THEN coalesce(named.title, c.title) ELSE c.title END AS title
    FROM c LEFT JOIN named ON c.page_id = named.page_id AND c.href = named.href""",
    P,
)
def _(t: Tables):
    return extract.backfill_titles(t.pages_in)


@query("anchor_candidates")
def _(t: Tables):
    return extract.anchor_candidates(t.pages_in).drop("raw_text")


_JL = "regexp_extract_all(html, '(?is)<script[^>]+type=[\"'']application/ld\\+json[\"''][^>]*>(.*?)</script>', 1)"


@query(
    "extract_jsonld",
    f"""WITH s AS MATERIALIZED (SELECT page_id, source_id, url, unnest({_JL}) AS j FROM pages_in),
    g AS MATERIALIZED (SELECT page_id, source_id, url, unnest(CAST(json_extract(j, '$."@graph"') AS JSON[])) AS o FROM s WHERE json_valid(j))
    SELECT page_id, source_id, o->>'$.title' AS title, o->>'$.hiringOrganization.name' AS department, (o->>'$.baseSalary.currency') || ' ' || (o->>'$.baseSalary.value.minValue') || ' - ' || (o->>'$.baseSalary.value.maxValue') || ' ' || (o->>'$.baseSalary.value.unitText') AS salary,
      (o->>'$.jobLocation[0].address.addressLocality') || ', ' || (o->>'$.jobLocation[0].address.addressCountry') || '; ' || (o->>'$.jobLocation[1].address') AS location,
      {k.strip_html("o->>'$.description'")} AS description, o->>'$.validThrough' AS last_date, {k.canon("o->>'$.url'", 'url')} AS apply_link, {k.canon("o->>'$.hiringOrganization.sameAs'", 'url')} AS official_website,
      o->>'$.identifier.value' AS source_job_id, url AS notification_link
    FROM g WHERE o->>'$."@type"' LIKE '%JobPosting%'""",
    P,
)
def _(t: Tables):
    return extract.extract_jsonld(t.pages_in).select(
        "page_id", "source_id", "title", "department", "salary", "location", "description", "last_date", "apply_link",
        "official_website", "source_job_id", "notification_link",
    )


@query("ordered_union")
def _(t: Tables):
    both = merge.ordered_union(extract.extract_jsonld(t.pages_in), extract.anchor_candidates(t.pages_in))
    return both.select("page_id", "source_id", "pos", "title", "extraction_method")


def _page_records(t: Tables):
    both = merge.ordered_union(extract.extract_jsonld(t.pages_in), extract.anchor_candidates(t.pages_in))
    # Encounter order across the pages of a source.
    return in_order(both.withColumnRenamed("pos", "place"), ["page_id", "place"], "pos").drop("place")


@query("page_notices")
def _(t: Tables):
    notices = merge.merge_notices(_page_records(t))
    kept = extract.drop_result_only(extract.open_only(notices.withColumn("domain", F.lit("example.org")), "domain", ts(NOW)))
    return kept.select("source_id", "identity", "title", "last_date", "apply_link", "notification_link", "content_hash", "merged")


@query("collection_metrics")
def _(t: Tables):
    records = _page_records(t)
    notices = extract.drop_result_only(merge.merge_notices(records))
    return merge.collection_metrics(extract.extract_links(t.pages_in), records, notices)


# --- titles of the candidate table ----------------------------------------------------------
@query(
    "drop_result_only",
    f"SELECT cand_id, title FROM candidates WHERE NOT {k.has('title', V.RESULT_ONLY_TITLE)}",
    ("candidates",),
)
def _(t: Tables):
    return extract.drop_result_only(t.candidates).select("cand_id", "title")


@query(
    "is_recruitment_notice",
    f"""SELECT cand_id, title FROM candidates WHERE {k.has('title', V.NOTICE_POSITIVE)} AND NOT {k.has('title', V.RESULT_ONLY_TITLE)}
    AND NOT {k.has('title', V.NOTICE_NOISE)} AND NOT {k.has('title', V.NOTICE_AMENDMENT)}""",
    ("candidates",),
)
def _(t: Tables):
    return extract.is_recruitment_notice(t.candidates).select("cand_id", "title")


@query(
    "open_only",
    f"SELECT cand_id FROM candidates WHERE source_id % 2 = 0 OR coalesce({k.deadline('last_date')} > TIMESTAMP '{NOW}', false)",
    ("candidates",),
)
def _(t: Tables):
    rows = t.candidates.withColumn("domain", F.when(F.col("source_id") % 2 == 1, "www.sbi.co.in").otherwise("org.example.org"))
    return extract.open_only(rows, "domain", ts(NOW)).select("cand_id")


# --- labelled values ----------------------------------------------------------------------------
def _plausible(x: str, kind: str) -> str:
    def judge(v: str) -> str:
        ok = f"{v} <> '' AND length({v}) <= 180 AND NOT {k.has(v, V.LAYOUT_TEXT)}"
        if kind == "date":
            ok += f" AND {k.day(v)} IS NOT NULL"
        elif kind == "vacancy":
            ok += f" AND NOT regexp_matches({v}, '^\\d{{1,2}}[/.\\-]\\d{{1,2}}[/.\\-]20\\d{{2}}$') AND {k.has(v, V.PLAUSIBLE[kind])}"
        elif kind in V.PLAUSIBLE:
            ok += f" AND {k.has(v, V.PLAUSIBLE[kind])}"
        return f"CASE WHEN {ok} THEN {v} END"

    return k.let(k.clean(x), judge)


def _labeled(text: str, field: str) -> str:
    kind, label = V.LABELS[field]
    pattern = r"(?i)\b(?:" + label + r")\b\s*[:\-]?\s*(.{1,180}?)(?:\s{2,}|\b(?:" + V.NEXT_LABELS + r")\b|$)"
    return _plausible(f"regexp_extract({text}, {k.q(pattern)}, 1)", kind)


@query(
    "extract_labeled",
    f"SELECT page_id, {', '.join(f'{_labeled(chr(116), f)} AS {f}' for f in V.LABELS)} FROM (SELECT page_id, {k.strip_html('html')} AS t FROM pages_in)",
    P,
)
def _(t: Tables):
    from gazette.operators.normalize import strip_html

    rows = extract.extract_labeled(strip_html(t.pages_in, "html"), "text", list(V.LABELS))
    return rows.select("page_id", *V.LABELS)


# --- documents ------------------------------------------------------------------------------------
def _segment(field: str) -> str:
    labels, stops, limit = V.SEGMENTS[field]
    chars, evidence = V.SEGMENT_EVIDENCE[field]
    found = f"regexp_extract(tx, {k.q(f'(?is)(?:{labels}){chr(92)}s*[:{chr(92)}-]?{chr(92)}s*(.+?)(?:{chr(92)}s+(?:{stops}){chr(92)}b|$)')}, 1)"
    return k.let(k.repair(found, limit), lambda v: f"CASE WHEN {k.has(f'left({v}, {chars})', evidence)} THEN {v} END")


def _date_after(labels: str) -> str:
    pattern = rf"(?i)(?:{labels})[^\n]{{0,160}}?({V.DOCUMENT_DATE})"
    return f"nullif(regexp_replace(regexp_extract(tx, {k.q(pattern)}, 1), '(?i)^(\\d+)(st|nd|rd|th)\\b', '\\1'), '')"


_VACANCY = (
    "coalesce("
    + ", ".join(
        f"CASE WHEN regexp_extract(tx, {k.q('(?i)' + p)}, 1) <> '' AND NOT (length(regexp_extract(tx, {k.q('(?i)' + p)}, 1)) = 1 AND "
        f"regexp_matches(regexp_extract(tx, {k.q('(?is)' + p + '(.{0,4})')}, 2), '^\\s*\\.')) THEN regexp_extract(tx, {k.q('(?i)' + p)}, 1) END"
        for p in V.VACANCY_COUNTS
    )
    + ")"
)


@query(
    "extract_notice_facts",
    f"""WITH n AS MATERIALIZED (SELECT doc_id, regexp_replace({k.clean('text')}, '\\\\([.@/])', '\\1', 'g') AS tx FROM notices)
    SELECT doc_id, {', '.join(f'{_segment(f)} AS {f}' for f in V.SEGMENTS)}, {_VACANCY} AS vacancy,
    {k.repair(f"regexp_extract(left(tx, 2000), {k.q(V.ORGANISATION_HEADING)}, 1)", 180)} AS department,
    {_date_after(V.START_DATE_LABELS)} AS application_start_date, {_date_after(V.LAST_DATE_LABELS)} AS last_date,
    {k.canon("regexp_extract(tx, 'http://apply[^ ]*[0-9]', 0)")} AS apply_link FROM n""",
    N,
)
def _(t: Tables):
    columns = [*V.SEGMENTS, "vacancy", "department", "application_start_date", "last_date", "apply_link"]
    return documents.extract_notice_facts(t.notices).select("doc_id", *columns)


@query(
    "corrigendum_flag",
    f"""SELECT doc_id, CASE WHEN {k.has(k.clean('label'), V.DOCUMENT_AMENDMENT)} THEN true WHEN length({k.clean('label')}) >= 20 AND {k.has(k.clean('label'), V.RECRUITMENT_LABEL)} THEN false
    ELSE {k.has(f"{k.clean('lang')} || ' ' || {k.clean('left(text, 700)')}", V.DOCUMENT_AMENDMENT)} END AS is_corrigendum FROM notices""",
    N,
)
def _(t: Tables):
    return documents.corrigendum_flag(t.notices, title="lang").select("doc_id", "is_corrigendum")


@query(
    "pick_title",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN label WHEN doc_id % 4 = 2 OR doc_id % 4 IN (0, 3) THEN 'RECRUITMENT OF FIELD OFFICERS grade ' || CAST(doc_id % 9 AS VARCHAR) END AS title FROM notices""",
    N,
)
def _(t: Tables):
    return documents.pick_title(t.notices).select("doc_id", "title")


# --- hosts, robots, discovery ------------------------------------------------------------------------
_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '')"


@query(
    "same_domain",
    f"""SELECT page_id, {_HOST} AS host, {_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') AS inside FROM pages""",
)
def _(t: Tables):
    from gazette.functions.urls import host, official_url

    return t.raw("pages").select(
        "page_id", host("url").alias("host"), official_url("url", F.lit("www.Example.com")).alias("inside")
    )


# Six rules for every crawled host: a `*` group and, for half the hosts, a group naming the agent.
_RULES = """SELECT DISTINCT {host} AS host, grp, agent, seq, allow, path FROM pages, (VALUES (0, '*', 0, false, '/fr/'), (0, '*', 1, true, '/fr/8*1'), (0, '*', 2, false, '/d'),
  (1, 'noticebot', 3, false, '/en/'), (1, 'noticebot', 4, true, '/en/6'), (1, 'noticebot', 5, false, '/en/6')) r(grp, agent, seq, allow, path) WHERE grp = 0 OR length({host}) % 2 = 0"""


def _rules(t: Tables):
    from gazette.functions.urls import host

    hosts = t.raw("pages").select(host("url").alias("host")).distinct()
    rows = [(0, "*", 0, False, "/fr/"), (0, "*", 1, True, "/fr/8*1"), (0, "*", 2, False, "/d"),
            (1, "noticebot", 3, False, "/en/"), (1, "noticebot", 4, True, "/en/6"), (1, "noticebot", 5, False, "/en/6")]
    names = ("grp", "agent", "seq", "allow", "path")
    rules = F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]))
    return hosts.select("host", rules).where("grp = 0 OR length(host) % 2 = 0")


@query(
    "robots_filter",
    f"""WITH r AS MATERIALIZED ({_RULES.format(host=_HOST)}), g AS (SELECT host, max(grp) AS grp FROM r GROUP BY host),
    p AS MATERIALIZED (SELECT page_id, {_HOST} AS host, regexp_extract(url, '^https?://[^/]+([^#]*)', 1) AS path FROM pages),
    m AS (SELECT page_id, arg_max(allow, length(r.path) * 100 - seq) AS allowed FROM p JOIN g USING (host) JOIN r ON r.host = p.host AND r.grp = g.grp AND starts_with(p.path, split_part(r.path, '*', 1)) GROUP BY page_id)
    SELECT p.page_id, coalesce(m.allowed, true) AS allowed FROM p LEFT JOIN m ON p.page_id = m.page_id""",
)
def _(t: Tables):
    return extract.robots_filter(t.raw("pages").select("page_id", "url"), _rules(t)).select("page_id", "allowed")


@query(
    "discover_sources",
    f"""WITH {_LINKS}, d AS (SELECT l.*, s.name AS source_name, s.domain, s.type, s.category, s.start_url AS discovered_from_url FROM links l JOIN sources s ON l.source_id = s.id
      WHERE href IS NOT NULL AND {k.has("label || ' ' || href", V.DISCOVERY_TERMS)} AND NOT {k.has('href', r'[.]pdf($|[?])')} AND regexp_matches(href, '^https?://([^/]+\\.)?example\\.(com|net|org)/')),
    u AS (SELECT source_id, source_name, type, category, discovered_from_url, href, arg_max(label, page_id * 100000 + pos) AS label, min(page_id * 100000 + pos) AS first FROM d GROUP BY ALL)
    SELECT source_id, CASE WHEN left(label, 120) = '' THEN source_name || ' Careers' ELSE left(label, 120) END AS name, regexp_extract(href, '//([^/]+)', 1) AS domain, href AS start_url, type, category,
      CASE WHEN type IN ('GOVERNMENT', 'PSU') THEN 'GOVERNMENT_HTML' ELSE 'GENERIC_HTML' END AS parser_type, discovered_from_url
    FROM u QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY first) <= 20""",
    ("pages_in", "sources"),
)
def _(t: Tables):
    # The registered domains do not occur in crawled pages: every source owns the three page families.
    family = lambda d: t.sources.withColumn("domain", F.lit(d))
    return extract.discover_sources(t.pages_in, family("example.com").unionByName(family("example.net")).unionByName(family("example.org")))


@query(
    "dispatch",
    """SELECT id, CASE WHEN parser_type = 'PDF_NOTIFICATION' OR regexp_matches(start_url, '(?i)\\.pdf($|\\?)') THEN 'document' WHEN parser_type = 'GOVERNMENT_HTML' AND id = 8 THEN 'notice_api'
    WHEN parser_type = 'GOVERNMENT_HTML' THEN 'government_html' ELSE 'generic_html' END AS adapter FROM sources""",
    ("sources",),
)
def _(t: Tables):
    return extract.dispatch(t.sources, "org8.example.org").select("id", "adapter")


# --- notice API: one payload per page ------------------------------------------------------------------
def _payloads(t: Tables):
    text = F.expr(
        """'{"data":{"items":[{"id":"n-' || page_id || '","headline":"Recruitment of clerks ' || page_id || '","endDate":"2026-09-' || (10 + page_id % 20) || 'T00:00:00Z","attachment":{"fileName":"Notice_' || page_id || '.pdf"},"redirectUrl":"/candidate/' || page_id || '"},'
        || '{"id":"r-' || page_id || '","headline":"Final result of clerks ' || page_id || '","attachment":{"fileName":"res.pdf"}},{"note":{"deep":[{"subject":"Engagement of tutors ' || page_id || '","summary":' || to_json(named_struct('u', url)) || '}]}}]}}'"""
    )
    return t.raw("pages").select(F.col("page_id").alias("payload_id"), F.lit("https://www.api.example.org/x?page=1").alias("url"), text.alias("payload"))


@query(
    "ingest_notice_api",
    """SELECT page_id AS payload_id, title, last_date, source_job_id, notification_link, apply_link FROM (
      SELECT page_id, 'Recruitment of clerks ' || page_id AS title, CAST(10 + page_id % 20 AS VARCHAR) || '/09/2026' AS last_date, 'n-' || page_id AS source_job_id,
      'https://api.example.org/api/attachment/uploads/masterData/NoticeBoards/Notice_' || page_id || '.pdf' AS notification_link, 'https://api.example.org/candidate/' || page_id AS apply_link FROM pages)""",
)
def _(t: Tables):
    candidates, _ = extract.ingest_notice_api(_payloads(t), "https://api.example.org/board", "Commission", "api.example.org")
    return candidates.select("payload_id", "title", "last_date", "source_job_id", "notification_link", "apply_link")


@query(
    "notice_api_counts",
    "SELECT page_id AS payload_id, 3::BIGINT AS records_scanned, 4::BIGINT AS raw_links, 2::BIGINT AS recruitment_links FROM pages",
)
def _(t: Tables):
    return extract.ingest_notice_api(_payloads(t), "https://api.example.org/board", "Commission", "api.example.org")[1]
