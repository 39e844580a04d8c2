"""Normalisation, hashing, dates, field cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cases import sqlkit as k
from cases.registry import Tables, query
from gazette import vocabulary as V
from gazette.functions.dates import day
from gazette.operators import cleaning, normalize

C, D = ("candidates",), ("notices",)


@query("normalize_text_columns", f"SELECT doc_id, {k.fold('text')} AS text, {k.fold('source')} AS source FROM documents")
def _(t: Tables):
    return normalize.normalize_text_columns(t.raw("documents").select("doc_id", "text", "source"), ["text", "source"])


@query("canonicalize_urls", f"SELECT page_id, {k.canon('url')} AS url FROM pages")
def _(t: Tables):
    return normalize.canonicalize_urls(t.raw("pages").select("page_id", "url"), ["url"])


@query(
    "canonicalize_listing_urls",
    f"SELECT id, {k.canon('apply_link')} AS apply_link, {k.canon('notification_link')} AS notification_link, {k.canon('official_website')} AS official_website FROM listings",
    ("listings",),
)
def _(t: Tables):
    links = ["apply_link", "notification_link", "official_website"]
    return normalize.canonicalize_urls(t.listings.select("id", *links), links)


@query("content_hash", f"SELECT doc_id, sha256({k.clean('text')}) AS content_hash FROM documents")
def _(t: Tables):
    return normalize.with_content_hash(t.raw("documents").select("doc_id", "text"), "text").drop("text")


@query(
    "fingerprint",
    f"SELECT id, {k.fingerprint('title', 'department', 'location', k.ts_day('last_date'), 'source_job_id')} AS source_hash FROM listings",
    ("listings",),
)
def _(t: Tables):
    return normalize.with_fingerprint(t.listings, day("last_date")).select("id", "source_hash")


@query(
    "parse_dates",
    f"SELECT cand_id, {k.deadline('application_start_date')} AS application_start_date, {k.deadline('last_date')} AS last_date, {k.deadline('posted_date')} AS posted_date FROM candidates",
    C,
)
def _(t: Tables):
    dates = ["application_start_date", "last_date", "posted_date"]
    return normalize.parse_dates(t.candidates.select("cand_id", *dates), dates)


@query(
    "extract_notice_id",
    f"""SELECT doc_id, CASE WHEN m NOT IN ({', '.join(k.q(w) for w in V.NOTICE_ID_STOP_WORDS)}) AND m <> '' THEN m END AS notice_id
    FROM (SELECT doc_id, upper(trim(regexp_extract({k.clean('text')}, {k.q('(?i)' + V.NOTICE_ID)}, 1))) AS m FROM notices)""",
    D,
)
def _(t: Tables):
    return normalize.extract_notice_id(t.notices, "text").select("doc_id", "notice_id")


@query("strip_html", f"SELECT page_id, {k.strip_html('html')} AS text FROM pages")
def _(t: Tables):
    return normalize.strip_html(t.raw("pages"), "html").select("page_id", "text")


@query("repair_mojibake", f"SELECT doc_id, {k.repair('text', 2000)} AS text FROM documents")
def _(t: Tables):
    return normalize.repair_mojibake(t.raw("documents").select("doc_id", "text"), "text", 2000)


_MARKERS = [r"\s+the\b", r"\s+(?:und|que)\b", r"\bAge Limit\b"]


@query("cut_at_markers", f"SELECT doc_id, {k.cut('text', [(m, True) for m in _MARKERS], 120)} AS text FROM notices", D)
def _(t: Tables):
    return normalize.cut_at_markers(t.notices.select("doc_id", "text"), "text", _MARKERS, 120)


@query(
    "clean_notice_fields",
    f"SELECT cand_id, {', '.join(k.FACTS)} FROM ({k.CLEANED_CANDIDATES})",
    C,
)
def _(t: Tables):
    return cleaning.clean_notice_fields(t.candidates).select("cand_id", *k.FACTS)


_IDENTITY = f"""WITH c AS ({k.CLEANED_CANDIDATES})
SELECT cand_id,
  CASE WHEN source_job_id <> '' THEN 'id:' || {k.fold('source_job_id')} WHEN notification_link <> '' THEN 'notice:' || coalesce({k.canon('notification_link')}, 'null')
    ELSE 'job:' || {k.fold('title')} || ':' || {k.clean('last_date')} END AS identity,
  sha256('source:' || CAST(source_id AS VARCHAR) || '|' || CASE WHEN {k.fold('source_job_id')} <> '' THEN 'source-job:' || {k.fold('source_job_id')}
    WHEN {k.canon('notification_link')} IS NOT NULL THEN 'notification:' || {k.canon('notification_link')}
    ELSE 'detail-title-date:' || coalesce({k.canon('source_url')}, '') || '|' || {k.fold('title')} || '|' || coalesce({k.day('last_date')}, '') END) AS candidate_key,
  sha256('[' || array_to_string(list_transform([content_hash, title, department, qualification, vacancy, salary, age_limit, location, application_fee, selection_process,
    {k.day('application_start_date')}, {k.day('last_date')}, {k.canon('apply_link')}, {k.canon('notification_link')}, {k.canon('source_url')}, source_job_id],
    lambda x: CAST(to_json(trim(coalesce(x, ''))) AS VARCHAR)), ',') || ']') AS snapshot_hash
FROM c"""


@query("notice_identity", _IDENTITY, C)
def _(t: Tables):
    cleaned = normalize.with_content_hash(cleaning.clean_notice_fields(t.candidates))
    return normalize.notice_identity(cleaned).select("cand_id", "identity", "candidate_key", "snapshot_hash")


@query(
    "title_dates",
    r"""SELECT page_id, CASE WHEN len(d) >= 2 THEN d[-2] END AS title_start, CASE WHEN len(d) >= 1 THEN d[-1] END AS title_end
    FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h3>(.*?)</h3>', 1)[1] AS title, regexp_extract_all(regexp_extract(html, '(?s)<h3>(.*?)</h3>', 1), '\b(\d{1,2}[/.\-]\d{1,2}[/.\-]20\d{2})\b', 1) AS d FROM pages_in)""",
    ("pages_in",),
)
def _(t: Tables):
    pages = t.pages_in.select("page_id", F.regexp_extract("html", r"<h3>([\s\S]*?)</h3>", 1).alias("title"))
    return normalize.title_dates(pages).drop("title")


@query(
    "https_upgrade",
    f"""SELECT id, CASE WHEN source_url LIKE 'https:%' AND regexp_matches(u, '^http://([^/?]+\\.)?notices\\.example\\.org[/?]') THEN 'https' || substr(u, 5) ELSE u END AS notification_link
    FROM (SELECT id, source_url, {k.canon('notification_link')} AS u FROM listings)""",
    ("listings",),
)
def _(t: Tables):
    rows = t.listings.withColumns({"domain": F.lit("notices.example.org"), "start_url": F.col("source_url")})
    return normalize.https_upgrade(rows, "notification_link").select("id", "notification_link")


@query(
    "transient_error",
    """SELECT id, coalesce(error IN ('HTTP 503', 'Request timed out after 30s', 'socket hang up'), false) AS transient FROM run_items""",
    ("run_items",),
)
def _(t: Tables):
    return normalize.transient_error(t.run_items).select("id", "transient")


@query(
    "pseudonymize",
    "SELECT id, 'user' || CAST(id AS VARCHAR) || '@example.org' AS email_normalized, sha256(keyword_list) AS token_hash FROM preferences",
    ("preferences",),
)
def _(t: Tables):
    return normalize.pseudonymize(t.preferences, "email", "keyword_list").select("id", "email_normalized", "token_hash")


# A value is the label of a document; its text is the evidence.
_WORDS = f"list_filter(string_split({k.fold('label')}, ' '), lambda w: length(w) > 1)"


@query(
    "evidence_check",
    f"""SELECT doc_id, CASE WHEN label <> '' AND len(words) > 0 AND len(list_filter(words, lambda w: NOT contains(body, w))) = 0 THEN {k.clean('label')} END AS label
    FROM (SELECT doc_id, label, {_WORDS} AS words, {k.fold('text')} AS body FROM notices)""",
    D,
)
def _(t: Tables):
    return normalize.evidence_check(t.notices, "label", "text").select("doc_id", "label")


@query(
    "evidence_check_url",
    """SELECT doc_id, 'http://apply.example.org/form/' || CAST(doc_id AS VARCHAR) AS link FROM notices""",
    D,
)
def _(t: Tables):
    link = F.concat(F.lit(" http://www.apply.example.org/form/"), F.col("doc_id").cast("string"), F.lit("?utm_b=2 "))
    return normalize.evidence_check(t.notices.withColumn("link", link), "link", "text", url=True).select("doc_id", "link")


@query(
    "fill_missing",
    """SELECT c.cand_id, CASE WHEN coalesce(c.salary, '') <> '' THEN c.salary ELSE coalesce(l.salary, c.salary) END AS salary,
    CASE WHEN coalesce(c.location, '') <> '' THEN c.location ELSE coalesce(l.location, c.location) END AS location,
    CASE WHEN l.salary IS NOT NULL OR l.location IS NOT NULL THEN 'AI' ELSE c.extraction_method END AS extraction_method
    FROM candidates c LEFT JOIN (SELECT id, salary, location FROM listings WHERE category <> 'Private Jobs') l ON c.cand_id = l.id""",
    ("candidates", "listings"),
)
def _(t: Tables):
    extracted = t.listings.where("category <> 'Private Jobs'").select(F.col("id").alias("cand_id"), "salary", "location")
    out = normalize.fill_missing(t.candidates, extracted, "cand_id", ["salary", "location"])
    return out.select("cand_id", "salary", "location", "extraction_method")
