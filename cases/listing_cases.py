"""Listing search, facets, paging, projections and board counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cases.registry import Tables, query
from cases.views import NOW, SITE
from gazette import vocabulary as V
from gazette.operators import listing, stats

L = ("listings",)
_NOW = f"TIMESTAMP '{NOW}'"
_ACTIVE = f"status = 'PUBLISHED' AND NOT coalesce(last_date < {_NOW}, false) AND NOT coalesce(expires_at < {_NOW}, false)"
_LEGACY = (
    f"status = 'PUBLISHED' AND ((last_date IS NULL AND expires_at IS NULL) OR coalesce(last_date >= {_NOW}, false) "
    f"OR coalesce(expires_at >= {_NOW}, false))"
)
_SOON = f"(({{0}} >= {_NOW}) AND ({{0}} <= {_NOW} + INTERVAL 7 DAY))"
_CARD = ", ".join(V.CARD_COLUMNS)
_PUBLIC = ", ".join(V.PUBLIC_COLUMNS)


def _day_diff(c: str) -> str:
    return f"((epoch_us({c}) - epoch_us({_NOW})) / 86400000000.0)"


_TOOL = (
    f"CASE WHEN last_date IS NULL THEN 'Active' WHEN last_date < {_NOW} THEN 'Expired' "
    f"WHEN ceil({_day_diff('last_date')}) <= 7 THEN 'Closing Soon' WHEN status = 'DRAFT' THEN 'Draft' ELSE 'Active' END"
)


@query("scan_listings_public", f"SELECT {_PUBLIC} FROM listings WHERE {_ACTIVE}", L)
def _(t: Tables):
    return listing.scan_listings(t.listings, NOW)


@query("scan_listings_admin", "SELECT id, title, status, created_at, review_status FROM listings", L)
def _(t: Tables):
    return listing.scan_listings(t.listings, NOW, public=False).select("id", "title", "status", "created_at", "review_status")


@query("active", f"SELECT {_CARD} FROM listings WHERE {_ACTIVE}", L)
def _(t: Tables):
    return listing.project_public(listing.active(t.listings, NOW), "card")


@query("visible_legacy", f"SELECT id, last_date, expires_at FROM listings WHERE {_LEGACY}", L)
def _(t: Tables):
    return listing.visible_legacy(t.listings, NOW).select("id", "last_date", "expires_at")


@query(
    "search",
    f"""SELECT {_CARD} FROM listings WHERE {_ACTIVE} AND category = 'Government Jobs' AND location = 'ASIA'
    AND (title ILIKE '%engineer%' OR department ILIKE '%engineer%' OR qualification ILIKE '%engineer%' OR category ILIKE '%engineer%' OR location ILIKE '%engineer%')""",
    L,
)
def _(t: Tables):
    rows = listing.search(t.listings, NOW, query="  Engineer ", category="Government Jobs", location="ASIA")
    return listing.project_public(rows, "card")


@query(
    "search_text",
    f"""SELECT id FROM listings WHERE {_ACTIVE} AND (strpos(lower(title), '1-u') > 0 OR strpos(lower(department), '1-u') > 0
    OR strpos(lower(qualification), '1-u') > 0 OR strpos(lower(category), '1-u') > 0 OR coalesce(strpos(lower(location), '1-u') > 0, false))""",
    L,
)
def _(t: Tables):
    return listing.search(t.listings, NOW, query="1-U").select("id")


@query(
    "closing_soon",
    f"""SELECT id, last_date, expires_at FROM listings WHERE {_ACTIVE}
    AND (coalesce({_SOON.format('last_date')}, false) OR coalesce({_SOON.format('expires_at')}, false))""",
    L,
)
def _(t: Tables):
    return listing.closing_soon(t.listings, NOW).select("id", "last_date", "expires_at")


@query(
    "sector",
    f"""SELECT id, category FROM listings WHERE {_LEGACY} AND list_has_any(string_split(lower(category), ' '),
    ['government', 'banking', 'railway', 'university', 'hospital', 'psu'])""",
    L,
)
def _(t: Tables):
    return listing.sector(t.listings, NOW).select("id", "category")


@query("private_sector", f"SELECT id FROM listings WHERE {_LEGACY} AND lower(category) LIKE '%private%'", L)
def _(t: Tables):
    return listing.private_sector(t.listings, NOW).select("id")


@query("featured", f"SELECT id, created_at FROM listings WHERE featured AND {_ACTIVE}", L)
def _(t: Tables):
    return listing.featured(t.listings, NOW).select("id", "created_at")


_HOME = f"""WITH hits AS (SELECT * FROM listings WHERE {_ACTIVE} AND strpos(lower(concat_ws(' ', title, category, department, qualification, location)), '{{0}}') > 0)
SELECT id, title, featured FROM hits WHERE featured = (SELECT coalesce(max(featured), false) FROM hits)
ORDER BY created_at DESC, id DESC LIMIT 3"""


@query("home_cards", _HOME.format("clerks"), L)
def _(t: Tables):
    return listing.home_cards(t.listings, NOW, "Clerks").select("id", "title", "featured")


# Without any featured row the newest matches are shown.
@query(
    "home_cards_unfeatured",
    f"""SELECT id, title, featured FROM listings WHERE {_ACTIVE} AND NOT featured AND strpos(lower(concat_ws(' ', title, category, department, qualification, location)), 'private jobs nation_3') > 0
    ORDER BY created_at DESC, id DESC LIMIT 3""",
    L,
)
def _(t: Tables):
    plain = t.listings.where(~F.col("featured"))
    return listing.home_cards(plain, NOW, "private jobs nation_3").select("id", "title", "featured")


@query(
    "tool_search",
    f"""SELECT id, title, {_TOOL} AS tool_status FROM listings WHERE category = 'Private Jobs' AND {_TOOL} = 'Closing Soon'
    AND strpos(lower(concat_ws(' ', title, department, category, location)), 'america') > 0""",
    L,
)
def _(t: Tables):
    rows = listing.tool_search(t.listings, NOW, " America ", "Private Jobs", "Closing Soon")
    return listing.tool_status(rows, NOW).select("id", "title", "tool_status")


@query("tool_status", f"SELECT id, {_TOOL} AS tool_status FROM listings", L)
def _(t: Tables):
    return listing.tool_status(t.listings, NOW).select("id", "tool_status")


@query(
    "lookup",
    f"SELECT {_PUBLIC} FROM listings WHERE id = 49 AND {_ACTIVE}",
    L,
)
def _(t: Tables):
    return listing.project_public(listing.lookup(t.listings, 49, NOW))


@query(
    "deadline_status",
    f"""WITH d AS (SELECT id, date_diff('day', CAST({_NOW} AS DATE), CAST(last_date AS DATE)) AS diff FROM listings)
    SELECT id, CAST(diff + 1 AS INT) AS days_left,
      CASE WHEN diff < 0 THEN 'EXPIRED' WHEN diff + 1 <= 7 THEN 'CLOSING_SOON' WHEN diff IS NOT NULL THEN 'ACTIVE' END AS deadline_status,
      CASE WHEN diff < 0 THEN 'Expired' WHEN diff + 1 <= 7 THEN 'Closing Soon' WHEN diff IS NOT NULL THEN 'Active' END AS status_label,
      CASE WHEN diff >= 0 THEN CAST(diff + 1 AS VARCHAR) || ' days left' END AS days_label FROM d""",
    L,
)
def _(t: Tables):
    return listing.deadline_status(t.listings, NOW).select("id", "days_left", "deadline_status", "status_label", "days_label")


_FILTERED = f"{_ACTIVE} AND category = 'Railway Jobs'"


@query(
    "page",
    f"SELECT {_CARD} FROM listings WHERE {_FILTERED} ORDER BY featured DESC, created_at DESC, id DESC LIMIT 12 OFFSET 24",
    L,
)
def _(t: Tables):
    return listing.page(listing.search(t.listings, NOW, category="Railway Jobs"), 3)


@query(
    "page_info",
    f"""WITH n AS (SELECT count(*) AS total FROM listings WHERE {_FILTERED}), p AS (SELECT total, greatest(1, (total + 11) // 12) AS page_count FROM n)
    SELECT total, page_count, least(9999, page_count) AS page, (least(9999, page_count) - 1) * 12 + 1 AS first_result,
      least(least(9999, page_count) * 12, total) AS last_result FROM p""",
    L,
)
def _(t: Tables):
    return listing.page_info(listing.search(t.listings, NOW, category="Railway Jobs"), 9999)


@query(
    "facets",
    f"""SELECT DISTINCT 'category' AS facet, trim(category) AS value FROM listings WHERE {_ACTIVE} AND trim(category) <> ''
    UNION ALL SELECT DISTINCT 'location', trim(location) FROM listings WHERE {_ACTIVE} AND trim(location) <> ''""",
    L,
)
def _(t: Tables):
    return listing.facets(t.listings, NOW)


@query("distinct_values", "SELECT DISTINCT title FROM listings WHERE title <> ''", L)
def _(t: Tables):
    return listing.distinct_values(t.listings, "title")


_STATIC = ", ".join(
    f"('{SITE}{p}', {_NOW if f == 'daily' else 'NULL'}, '{f}', CAST({x} AS DOUBLE))" for p, f, x in V.STATIC_PAGES
)


@query(
    "sitemap",
    f"""SELECT * FROM (VALUES {_STATIC}) s(url, last_modified, change_frequency, priority)
    UNION ALL SELECT '{SITE}/jobs/' || CAST(id AS VARCHAR), updated_at, 'daily', CAST(0.8 AS DOUBLE) FROM listings WHERE {_ACTIVE}""",
    L,
)
def _(t: Tables):
    return listing.sitemap(t.listings, SITE, NOW).drop("seq")


_J = "CAST(to_json({0}) AS VARCHAR)"


def _when_json(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} ELSE '' END"


@query(
    "structured_data",
    f"""SELECT id, replace('{{"@context":"https://schema.org","@type":"JobPosting","title":' || {_J.format('title')} || ',"description":' || {_J.format('description')}
    || ',"datePosted":"' || strftime(coalesce(posted_date, published_at), '%Y-%m-%dT%H:%M:%S.000Z') || '"'
    || {_when_json('last_date IS NOT NULL', "',\"validThrough\":\"' || strftime(last_date, '%Y-%m-%dT%H:%M:%S.000Z') || '\"'")}
    || ',"hiringOrganization":{{"@type":"Organization","name":' || {_J.format('department')} || {_when_json('official_website IS NOT NULL', "',\"sameAs\":' || " + _J.format('official_website'))} || '}}'
    || ',"jobLocation":{{"@type":"Place","address":{{"@type":"PostalAddress","addressLocality":' || {_J.format('location')} || ',"addressCountry":"IN"}}}}'
    || {_when_json('source_job_id IS NOT NULL', "',\"identifier\":{\"@type\":\"PropertyValue\",\"name\":' || " + _J.format('department') + " || ',\"value\":' || " + _J.format('source_job_id') + " || '}'")}
    || ',"url":"{SITE}/jobs/' || CAST(id AS VARCHAR) || '"}}', '<', '\\u003c') AS json
    FROM listings WHERE description <> '' AND department <> '' AND location <> '' AND coalesce(posted_date, published_at) IS NOT NULL
    AND (apply_link IS NOT NULL OR notification_link IS NOT NULL OR official_website IS NOT NULL)""",
    L,
)
def _(t: Tables):
    return listing.structured_data(t.listings, SITE)


@query(
    "listing_metadata",
    f"""SELECT id, title, array_to_string(list_filter([title, department, qualification, location, category, '{V.METADATA_TAIL}'], lambda x: x <> ''), ' | ') AS description,
    '{SITE}/jobs/' || CAST(id AS VARCHAR) AS canonical FROM listings""",
    L,
)
def _(t: Tables):
    return listing.listing_metadata(t.listings, SITE)


# --- counters ----------------------------------------------------------------------
_STATS = f"""SELECT count(*) AS total, count(*) FILTER (lower(category) LIKE '%government%') AS government,
  count(*) FILTER (lower(category) LIKE '%private%') AS private, count(*) FILTER ({_ACTIVE}) AS active,
  count(*) FILTER (status = 'PUBLISHED' AND least(coalesce(last_date, expires_at), coalesce(expires_at, last_date)) >= {_NOW}
    AND least(coalesce(last_date, expires_at), coalesce(expires_at, last_date)) <= {_NOW} + INTERVAL 7 DAY) AS closing_soon,
  count(*) FILTER (status = 'EXPIRED' OR last_date < {_NOW} OR expires_at < {_NOW}) AS expired,
  count(*) FILTER (featured) AS featured FROM listings"""


@query("listing_stats", _STATS, L)
def _(t: Tables):
    return stats.listing_stats(t.listings, NOW)


@query("listing_stats_public", f"{_STATS} WHERE {_ACTIVE}", L)
def _(t: Tables):
    return stats.listing_stats(t.listings, NOW, public=True)


@query(
    "status_counts",
    """SELECT sum(CASE status WHEN 'PUBLISHED' THEN 1 ELSE 0 END)::BIGINT AS published, sum(CASE status WHEN 'DRAFT' THEN 1 ELSE 0 END)::BIGINT AS drafts,
    sum(featured::INT)::BIGINT AS featured FROM listings""",
    L,
)
def _(t: Tables):
    return stats.status_counts(t.listings)


@query(
    "distribution",
    f"""WITH s AS ({_STATS}) SELECT label, value, least(100, round(100.0 * value / total))::BIGINT AS percentage FROM (
      SELECT 'Government Jobs' AS label, government AS value, total FROM s UNION ALL SELECT 'Private Jobs', private, total FROM s
      UNION ALL SELECT 'Featured Jobs', featured, total FROM s)""",
    L,
)
def _(t: Tables):
    labels = {"government": "Government Jobs", "private": "Private Jobs", "featured": "Featured Jobs"}
    return stats.distribution(stats.listing_stats(t.listings, NOW), labels)


@query(
    "tool_counts",
    f"""SELECT count(*) AS total, count(*) FILTER (category ILIKE '%government%') AS government, count(*) FILTER (category ILIKE '%private%') AS private,
    count(*) FILTER ({_TOOL} = 'Closing Soon') AS closing_soon, count(*) FILTER ({_TOOL} = 'Expired') AS expired FROM listings""",
    L,
)
def _(t: Tables):
    return stats.tool_counts(t.listings, NOW)


@query(
    "home_counts",
    f"""SELECT count(*) AS total, count(*) FILTER (category ILIKE '%government%') AS government, count(*) FILTER (category ILIKE '%private%') AS private,
    count(*) FILTER (last_date >= {_NOW} AND last_date <= {_NOW} + INTERVAL 7 DAY) AS closing_soon FROM listings WHERE {_ACTIVE}""",
    L,
)
def _(t: Tables):
    return stats.home_counts(t.listings, NOW)
