"""Validation, registry, run ledger, alerts and snapshot changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cases import sqlkit as k
from cases.listing_cases import _ACTIVE
from cases.plan_cases import PLAN_CTES, plan
from cases.registry import Tables, query
from cases.views import EVENTS_NOW, NOW
from gazette import vocabulary as V
from gazette.operators import alerts, registry, runs, snapshot, stats, validate

L, S, R, A = ("listings",), ("sources",), ("run_items",), ("preferences",)
_NOW = f"TIMESTAMP '{NOW}'"

# --- validation ----------------------------------------------------------------------
# Write requests made from the listings: long texts, broken dates and links by rule.
_REQUEST = """SELECT id, CASE WHEN id % 21 = 0 THEN ' ' ELSE ' ' || title END AS title, category, department, CASE WHEN id % 22 = 0 THEN repeat(qualification, 500) ELSE qualification END AS qualification,
  CASE WHEN id % 23 = 0 THEN '2026-02-31' WHEN id % 2 = 0 THEN substr(CAST(CAST(last_date AS DATE) AS STRING), 1, 10) ELSE substr(CAST(CAST(last_date AS DATE) AS STRING), 9, 2) || '.' || substr(CAST(CAST(last_date AS DATE) AS STRING), 6, 2) || '.' || substr(CAST(CAST(last_date AS DATE) AS STRING), 1, 4) END AS last_date,
  CASE WHEN id % 26 = 0 THEN '2031-01-01' ELSE substr(CAST(CAST(application_start_date AS DATE) AS STRING), 1, 10) END AS application_start_date,
  CASE WHEN id % 29 = 0 THEN 'https://user:pw@example.org/' ELSE apply_link END AS apply_link, notification_link, CASE WHEN id % 31 = 0 THEN 'ftp://x' ELSE official_website END AS official_website,
  CASE WHEN id % 37 = 0 THEN 'OTHER' ELSE status END AS status, featured FROM {0}"""


def _requests(t: Tables):
    t.listings.createOrReplaceTempView("bind_request_listings")
    return t.spark.sql(_REQUEST.format("bind_request_listings"))


_VALIDATED = f"""r AS MATERIALIZED ({_REQUEST.format('listings')}), v AS MATERIALIZED (SELECT * REPLACE (trim(title) AS title, {k.deadline('last_date')} AS last_date, {k.deadline('application_start_date')} AS application_start_date,
    CASE WHEN status IN ('DRAFT', 'PUBLISHED', 'EXPIRED', 'ARCHIVED') THEN status ELSE 'DRAFT' END AS status), last_date AS raw_last FROM r),
  valid AS MATERIALIZED (SELECT *, CASE WHEN title = '' OR title IS NULL THEN 'A title and category are required and must be reasonably sized.' WHEN length(qualification) > 4000 THEN 'qualification is too long.'
    WHEN raw_last <> '' AND last_date IS NULL THEN 'Last date is invalid.' WHEN application_start_date > last_date THEN 'Application start date must not be after the last date.'
    WHEN contains(apply_link, '@') THEN 'Apply link must be a valid http/https URL.' WHEN starts_with(official_website, 'ftp') THEN 'Official website must be a valid http/https URL.'
    WHEN status = 'PUBLISHED' AND last_date < {_NOW} THEN 'A past-deadline job cannot be published. Mark it expired or archived.' END AS error FROM v)"""


@query(
    "validate_listings",
    f"WITH {_VALIDATED} SELECT id, error, title, status, last_date, application_start_date, apply_link FROM valid",
    L,
)
def _(t: Tables):
    return validate.validate_listings(_requests(t), NOW).select(
        "id", "error", "title", "status", "last_date", "application_start_date", "apply_link"
    )


_VALID_SOURCES = f"""vs AS MATERIALIZED (SELECT * REPLACE ({k.canon('start_url')} AS start_url, coalesce(trusted AND review_status = 'APPROVED', false) AS trusted, trusted AND auto_publish AND review_status = 'APPROVED' AS auto_publish,
    regexp_extract({k.canon('start_url')}, '//([^/]+)', 1) AS domain), CASE WHEN length(name) < 2 THEN 'name must have 2 to 160 characters.' WHEN start_url = 'nowhere' THEN 'start_url must be a valid http/https URL.'
    WHEN type = 'CLUB' THEN 'type is not supported.' END AS error FROM sources)"""


@query(
    "validate_sources",
    f"WITH {_VALID_SOURCES} SELECT id, error, coalesce(start_url, 'nowhere') AS start_url, nullif(domain, '') AS domain, trusted, auto_publish, enabled FROM vs",
    S,
)
def _(t: Tables):
    return validate.validate_sources(t.sources).select("id", "error", "start_url", "domain", "trusted", "auto_publish", "enabled")


def _split(c: str):
    return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\\|"))


def preferences(t: Tables):
    p = t.preferences
    return p.withColumns(
        {"keywords": _split("keyword_list"), "categories": _split("category_list"), "locations": _split("location_list")}
    )


@query(
    "validate_subscriptions",
    """SELECT id, CASE WHEN id % 13 = 0 THEN 'email is invalid.' WHEN id % 17 = 0 THEN 'keywords are invalid.' WHEN id % 19 = 0 THEN 'qualification is too long.' END AS error,
    CASE WHEN id % 13 = 0 THEN replace(trim(email), '@', ' at ') ELSE trim(email) END AS email FROM preferences""",
    A,
)
def _(t: Tables):
    rows = preferences(t).withColumns(
        {
            "email": F.when(F.col("id") % 13 == 0, F.replace("email", F.lit("@"), F.lit(" at "))).otherwise(F.col("email")),
            "keywords": F.when(F.col("id") % 17 == 0, F.array(F.lit("ok"), F.lit("  "))).otherwise(F.col("keywords")),
            "qualification": F.when(F.col("id") % 19 == 0, F.repeat(F.lit("x"), F.lit(151))).otherwise(F.col("qualification")),
        }
    )
    return validate.validate_subscriptions(rows).select("id", "error", "email")


# --- registry ---------------------------------------------------------------------------
_S = ["id", "name", "enabled", "trusted"]


@query("select_sources", "SELECT id, name, enabled, trusted FROM sources WHERE enabled ORDER BY trusted DESC, name, id LIMIT 10", S)
def _(t: Tables):
    return registry.select_sources(t.sources, 10).select(*_S)


@query("registry_order", "SELECT id, name, enabled, trusted FROM sources ORDER BY enabled DESC, name", S)
def _(t: Tables):
    return registry.registry_order(t.sources).select(*_S)


@query(
    "unsafe_sources",
    "SELECT id FROM sources WHERE auto_publish OR (trusted AND review_status <> 'APPROVED') OR (enabled AND (NOT trusted OR review_status <> 'APPROVED'))",
    S,
)
def _(t: Tables):
    return registry.unsafe_sources(t.sources).select("id")


@query(
    "registry_counts",
    "SELECT count(*) AS total, count(*) FILTER (enabled) AS enabled, count(*) FILTER (review_status = 'PENDING') AS pending FROM sources",
    S,
)
def _(t: Tables):
    return stats.registry_counts(t.sources)


# Discovered sources: career pages of listing sites, some already registered.
_FOUND = "SELECT source_id, 'Careers ' || title AS name, CASE WHEN id % 3 = 0 THEN 'http://org' || CAST(id % 40 AS STRING) || '.example.org/jobs' ELSE 'https://site' || CAST(id % 300 AS STRING) || '.example.org/careers' END AS start_url FROM {0} WHERE source_id IS NOT NULL"


@query(
    "new_sources",
    f"""WITH d AS ({_FOUND.format('listings')}), u AS (SELECT start_url, arg_min(name, (lpad(CAST(source_id AS VARCHAR), 9, '0'), name)) AS name, min(source_id) AS source_id FROM d GROUP BY start_url)
    SELECT source_id, name, start_url, 'PENDING' AS review_status, false AS enabled FROM u WHERE start_url NOT IN (SELECT start_url FROM sources)""",
    ("listings", "sources"),
)
def _(t: Tables):
    t.listings.createOrReplaceTempView("bind_found_listings")
    found = t.spark.sql(_FOUND.format("bind_found_listings"))
    return registry.new_sources(found, t.sources).select("source_id", "name", "start_url", "review_status", "enabled")


@query("guard_delete_sources", "SELECT id, name FROM sources WHERE id NOT IN (SELECT source_id FROM listings WHERE source_id IS NOT NULL)", ("listings", "sources"))
def _(t: Tables):
    return registry.guard_delete_sources(t.sources, t.listings).select("id", "name")


_EDITS = """e AS (SELECT id, name || ' (edited)' AS name, CASE WHEN id % 4 = 1 THEN 'http://org' || CAST(id + 1 AS VARCHAR) || '.example.org/jobs' ELSE 'https://edited' || CAST(id AS VARCHAR) || '.example.org/' END AS start_url,
  CASE WHEN length(name) < 2 THEN 'short name' END AS error FROM sources WHERE id % 3 = 0),
  p AS (SELECT s.id, s.name AS old_name, e.name, e.id IS NOT NULL AND e.error IS NULL AS asked, CASE WHEN e.error IS NULL THEN coalesce(e.start_url, s.start_url) ELSE s.start_url END AS url FROM sources s LEFT JOIN e ON s.id = e.id),
  o AS (SELECT *, count(*) OVER (PARTITION BY url) AS owners FROM p)"""


def _source_edits(t: Tables):
    url = F.when(F.col("id") % 4 == 1, F.concat(F.lit("http://org"), (F.col("id") + 1).cast("string"), F.lit(".example.org/jobs"))).otherwise(
        F.concat(F.lit("https://edited"), F.col("id").cast("string"), F.lit(".example.org/"))
    )
    return t.sources.where("id % 3 = 0").select(
        "id", F.concat("name", F.lit(" (edited)")).alias("name"), url.alias("start_url"),
        F.when(F.length("name") < 2, "short name").alias("error"),
    )


@query("edit_sources", f"WITH {_EDITS} SELECT s.id, CASE WHEN asked AND owners = 1 THEN o.name ELSE s.name END AS name, CASE WHEN asked AND owners = 1 THEN url ELSE s.start_url END AS start_url FROM sources s JOIN o ON s.id = o.id", S)
def _(t: Tables):
    return registry.edit_sources(t.sources, _source_edits(t))[0].select("id", "name", "start_url")


@query("edit_sources_rejected", f"WITH {_EDITS} SELECT e.id, coalesce(error, 'A source with this start URL already exists.') AS error FROM e JOIN o ON e.id = o.id WHERE error IS NOT NULL OR owners > 1", S)
def _(t: Tables):
    return registry.edit_sources(t.sources, _source_edits(t))[1]


# --- run ledger ------------------------------------------------------------------------------
_RUNS = "runs AS (SELECT run_id, min(created_at) AS started_at, CASE WHEN bool_or(action = 'ERROR') THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM run_items GROUP BY run_id)"


def _runs(t: Tables):
    return runs.run_summary(t.run_items).select("run_id", "started_at", "status")


@query(
    "run_summary",
    """WITH s AS (SELECT run_id, source_id, bool_or(action = 'ERROR' AND candidate_title IS NULL) AS e FROM run_items GROUP BY ALL),
    m AS (SELECT run_id, max(details) AS d FROM run_items WHERE details->>'$.kind' = 'metrics' GROUP BY run_id)
    SELECT r.run_id, (SELECT count(*) FROM s WHERE s.run_id = r.run_id) AS sources_checked, (SELECT count(*) FROM s WHERE s.run_id = r.run_id AND NOT e) AS sources_succeeded,
      (SELECT count(*) FROM s WHERE s.run_id = r.run_id AND e) AS sources_failed, coalesce(CAST(any_value(d->>'$.processed') AS BIGINT), count(*) FILTER (action <> 'ERROR')) AS processed, count(*) FILTER (action = 'WOULD_ADD') AS would_add, count(*) FILTER (action = 'ADDED') AS added,
      count(*) FILTER (action = 'UPDATED') AS updated, count(*) FILTER (action = 'DUPLICATE') AS duplicates, coalesce(CAST(any_value(d->>'$.expired') AS BIGINT), count(*) FILTER (action = 'EXPIRED')) AS expired, coalesce(CAST(any_value(d->>'$.skipped') AS BIGINT), count(*) FILTER (action = 'SKIPPED')) AS skipped,
      count(*) FILTER (action = 'ERROR') AS errors, min(created_at) AS started_at, max(created_at) AS completed_at, coalesce(CAST(any_value(d->>'$.candidates') AS BIGINT), 0) AS candidates, coalesce(CAST(any_value(d->>'$.rawLinks') AS BIGINT), 0) AS raw_links, coalesce(CAST(any_value(d->>'$.recruitmentLinks') AS BIGINT), 0) AS recruitment_links, coalesce(CAST(any_value(d->>'$.uniqueNotices') AS BIGINT), 0) AS unique_notices,
      coalesce(CAST(any_value(d->>'$.parsedJobs') AS BIGINT), 0) AS parsed_jobs, coalesce(CAST(any_value(d->>'$.rejected') AS BIGINT), 0) AS rejected, coalesce(CAST(any_value(d->>'$.lowConfidence') AS BIGINT), 0) AS low_confidence, coalesce(CAST(any_value(d->>'$.draftsCreated') AS BIGINT), 0) AS drafts_created, CASE WHEN count(*) FILTER (action = 'ERROR') > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status
    FROM run_items r LEFT JOIN m ON m.run_id = r.run_id GROUP BY r.run_id""",
    R,
)
def _(t: Tables):
    return runs.run_summary(t.run_items)


@query("latest_run", f"WITH {_RUNS} SELECT run_id, started_at, status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1", R)
def _(t: Tables):
    return runs.latest_run(_runs(t))


_RECENT = f"{_RUNS}, newest AS (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 5), numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at, id) AS item_number FROM run_items)"


@query("recent_runs", f"WITH {_RECENT} SELECT n.run_id, n.started_at, i.id, i.item_number::INT AS item_number FROM newest n LEFT JOIN numbered i ON i.run_id = n.run_id AND item_number <= 20", R)
def _(t: Tables):
    return runs.recent_runs(_runs(t), t.run_items, 5, 20).select("run_id", "started_at", "id", "item_number")


@query("runs_with_items", f"WITH {_RECENT} SELECT n.run_id, count(i.id) AS items, string_agg(CAST(i.id AS VARCHAR), ',' ORDER BY item_number) AS ids FROM newest n LEFT JOIN numbered i ON i.run_id = n.run_id AND item_number <= 20 GROUP BY n.run_id", R)
def _(t: Tables):
    rows = runs.runs_with_items(_runs(t), t.run_items, 5, 20)
    ids = F.array_join(F.transform("items", lambda i: i["id"].cast("string")), ",")
    return rows.select("run_id", F.size("items").cast("bigint").alias("items"), ids.alias("ids"))


@query(
    "source_health",
    """SELECT e.source_id, max(created_at) AS last_checked_at, any_value(ok) AS last_success_at, count(*) FILTER (action = 'ERROR' AND candidate_title IS NULL AND (ok IS NULL OR created_at > ok)) AS consecutive_failures
    FROM run_items e JOIN (SELECT source_id, max(created_at) FILTER (action <> 'ERROR' OR candidate_title IS NOT NULL) AS ok FROM run_items GROUP BY source_id) o ON e.source_id = o.source_id GROUP BY e.source_id""",
    R,
)
def _(t: Tables):
    return runs.source_health(t.run_items)


@query(
    "readiness",
    f"""WITH {_RUNS}, last AS (SELECT * FROM runs ORDER BY started_at DESC LIMIT 1), c AS (
      SELECT 'source-safety' AS key, (SELECT count(*) FROM sources WHERE auto_publish OR (trusted AND review_status <> 'APPROVED') OR (enabled AND (NOT trusted OR review_status <> 'APPROVED'))) AS n, 'BLOCKER' AS severity
      UNION ALL SELECT 'content', (SELECT count(*) FROM listings WHERE {_ACTIVE.replace(_NOW, f"TIMESTAMP '{EVENTS_NOW}'")}), 'BLOCKER' UNION ALL SELECT 'enabled-sources', (SELECT count(*) FROM sources WHERE enabled AND trusted AND review_status = 'APPROVED'), 'WARNING'),
    k AS (SELECT key, CASE key WHEN 'source-safety' THEN n = 0 ELSE n > 0 END AS passed, severity, CAST(n AS VARCHAR) AS measured FROM c
      UNION ALL SELECT 'recent-run', status = 'COMPLETED' AND started_at BETWEEN TIMESTAMP '{EVENTS_NOW}' - INTERVAL 48 HOUR AND TIMESTAMP '{EVENTS_NOW}', 'WARNING', run_id FROM last)
    SELECT *, (SELECT bool_and(passed OR severity = 'WARNING') FROM k) AS ready FROM k""",
    ("sources", "listings", "run_items"),
)
def _(t: Tables):
    return stats.readiness(t.sources, t.listings, _runs(t), EVENTS_NOW)


# --- alerts -----------------------------------------------------------------------------------
_TERMS = "list_transform(string_split({0}, '|'), lambda x: lower(x))"


def _any(list_column: str, text: str) -> str:
    return f"({list_column} = '' OR len(list_filter({_TERMS.format(list_column)}, lambda w: contains({text}, w))) > 0)"


_MATCHES = f"""p AS MATERIALIZED (SELECT * FROM preferences WHERE active), l AS MATERIALIZED (SELECT id, lower(category) AS c, lower(coalesce(location, '')) AS loc, lower(qualification) AS q,
    lower(title || ' ' || department || ' ' || qualification || ' ' || coalesce(location, '') || ' ' || category) AS hay FROM listings WHERE {_ACTIVE}),
  m AS MATERIALIZED (SELECT p.id AS pref_id, l.id AS listing_id FROM p JOIN l ON {_any('p.keyword_list', 'l.hay')} AND {_any('p.category_list', 'l.c')} AND {_any('p.location_list', 'l.loc')}
    AND (coalesce(p.qualification, '') = '' OR contains(l.q, lower(p.qualification))))"""
LA = ("listings", "preferences")


@query("match_alerts", f"WITH {_MATCHES} SELECT pref_id, listing_id FROM m", LA)
def _(t: Tables):
    return alerts.match_alerts(t.spread("listings"), preferences(t), NOW)


@query(
    "alert_digest",
    f"WITH {_MATCHES}, n AS (SELECT pref_id, count(*) AS matches FROM m GROUP BY pref_id) SELECT p.id AS pref_id, coalesce(n.matches, 0) AS matches, m.listing_id FROM preferences p LEFT JOIN n ON n.pref_id = p.id LEFT JOIN m ON m.pref_id = p.id",
    LA,
)
def _(t: Tables):
    prefs = preferences(t)
    return alerts.alert_digest(alerts.match_alerts(t.spread("listings"), prefs, NOW), prefs)


@query("newest_subscriptions", "SELECT id, active, created_at FROM preferences ORDER BY created_at DESC, id DESC LIMIT 500", A)
def _(t: Tables):
    return alerts.newest_subscriptions(preferences(t)).select("id", "active", "created_at")


# Events address the subscriptions: half the tokens of verify/unsubscribe are right.
_EVENTS = """SELECT event_id AS seq, ts AS happened, user_id AS id, CASE event_type WHEN 'signup' THEN 'subscribe' WHEN 'click' THEN 'verify' WHEN 'purchase' THEN 'unsubscribe' WHEN 'error' THEN 'set_active' END AS kind,
  ' USER' || CAST(user_id AS STRING) || '@example.org' AS email, CASE WHEN event_id % 2 = 0 THEN 'tok' || CAST(user_id AS STRING) ELSE 'wrong' END AS token, 'tok' || CAST(user_id AS STRING) AS issued, event_id % 3 = 0 AS active, 'q' || CAST(event_id AS STRING) AS qualification
  FROM {0} WHERE event_type <> 'view'"""


@query(
    "apply_subscription_events",
    f"""WITH e AS MATERIALIZED (SELECT *, lower(trim(email)) AS mail FROM ({_EVENTS.format('events')})), s AS MATERIALIZED (SELECT *, lower(trim(email)) AS mail, 'tok' || CAST(id AS VARCHAR) AS tok FROM preferences),
    a AS MATERIALIZED (SELECT e.seq, e.happened, e.kind, CASE WHEN e.kind = 'set_active' THEN s.mail ELSE e.mail END AS mail, e.token, e.active, e.qualification FROM e LEFT JOIN s ON e.kind = 'set_active' AND s.id = e.id),
    sub AS MATERIALIZED (SELECT mail, max(seq) AS sub_seq, arg_max(qualification, seq) AS qualification, min(happened) AS first_at FROM a WHERE kind = 'subscribe' GROUP BY mail),
    b AS MATERIALIZED (SELECT coalesce(s.mail, sub.mail) AS mail, s.id, CASE WHEN sub.mail IS NOT NULL THEN sub.qualification ELSE s.qualification END AS qualification, sub.mail IS NOT NULL AS resub, coalesce(sub_seq, -1) AS sub_seq, s.active, s.verified_at, coalesce(s.created_at, first_at) AS created_at FROM s FULL JOIN sub ON s.mail = sub.mail),
    x AS MATERIALIZED (SELECT b.mail, arg_min(happened, seq) FILTER (kind = 'verify' AND token <> 'wrong') AS verified, arg_max(kind = 'set_active' AND a.active, seq) FILTER (kind = 'set_active' OR (kind = 'unsubscribe' AND token <> 'wrong')) AS flag FROM b JOIN a ON a.mail = b.mail AND a.seq > b.sub_seq GROUP BY b.mail)
    SELECT b.id, b.mail AS email_normalized, b.qualification, coalesce(x.flag, CASE WHEN resub THEN true ELSE b.active END) AS active, coalesce(CASE WHEN NOT resub THEN b.verified_at END, x.verified) AS verified_at, b.created_at FROM b LEFT JOIN x ON b.mail = x.mail""",
    A,
)
def _(t: Tables):
    t.raw("events").createOrReplaceTempView("bind_sub_events")
    events = t.spark.sql(_EVENTS.format("bind_sub_events")).withColumnRenamed("happened", "at").withColumns(
        {
            "keywords": F.array(F.lit("k")), "categories": F.array(F.lit("c")), "locations": F.array(F.lit("l")),
            "verification_token": F.col("issued"), "unsubscribe_token": F.col("issued"),
        }
    )
    token = F.sha2(F.concat(F.lit("tok"), F.col("id").cast("string")), 256)
    subs = preferences(t).withColumns({"verification_token": token, "unsubscribe_token": token})
    return alerts.apply_subscription_events(subs, events).select("id", "email_normalized", "qualification", "active", "verified_at", "created_at")


# --- snapshot ---------------------------------------------------------------------------------------
_DUE = f"status = 'PUBLISHED' AND (coalesce(last_date < {_NOW}, false) OR coalesce(expires_at < {_NOW}, false))"


@query("expire", f"SELECT id, CASE WHEN {_DUE} THEN 'EXPIRED' ELSE status END AS status, CASE WHEN {_DUE} THEN {_NOW} END AS expired_at, featured AND NOT ({_DUE}) AS featured, CASE WHEN {_DUE} THEN {_NOW} ELSE updated_at END AS updated_at FROM listings", L)
def _(t: Tables):
    return snapshot.expire(t.listings, NOW).select("id", "status", "expired_at", "featured", "updated_at")


@query("expiry_items", f"SELECT 'r1' AS run_id, source_id, left(source_name, 200) AS source_name, left(title, 300) AS candidate_title, 'EXPIRED' AS action, id AS job_id, 'Application deadline passed' AS reason FROM listings WHERE {_DUE}", L)
def _(t: Tables):
    return snapshot.expiry_items(t.listings, NOW, "r1")


@query("audit_rows", "SELECT doc_id, nullif(left(text, 2000), '') AS reason, nullif(left(text, 4000), '') AS error, nullif(left(text, 300), '') AS candidate_title, nullif(left(source, 200), '') AS source_name FROM documents")
def _(t: Tables):
    d = t.raw("documents")
    return snapshot.audit_rows(d.select("doc_id", F.col("text").alias("reason"), F.col("text").alias("error"), F.col("text").alias("candidate_title"), F.col("source").alias("source_name")))


@query(
    "recover_stale_runs",
    f"""WITH r AS (SELECT id, created_at AS started_at, CASE WHEN action = 'ERROR' THEN 'RUNNING' ELSE 'COMPLETED' END AS status FROM run_items)
    SELECT id, CASE WHEN stale THEN 'FAILED' ELSE status END AS status, CASE WHEN stale THEN TIMESTAMP '{EVENTS_NOW}' END AS completed_at,
      CASE WHEN stale THEN least(2147483647, greatest(0, (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(started_at)) // 1000))::BIGINT END AS duration_ms, CASE WHEN stale THEN {k.q(V.STALE_RUN_MESSAGE)} END AS error_message
    FROM (SELECT *, status = 'RUNNING' AND started_at < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 30 MINUTE AS stale FROM r)""",
    R,
)
def _(t: Tables):
    r = t.run_items.select(
        "id", F.col("created_at").alias("started_at"), F.when(F.col("action") == "ERROR", "RUNNING").otherwise("COMPLETED").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(None).cast("bigint").alias("duration_ms"), F.lit(None).cast("string").alias("error_message"),
    )
    return snapshot.recover_stale_runs(r, EVENTS_NOW).drop("started_at")


@query("delete_listings", "SELECT id, title FROM listings WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)", L)
def _(t: Tables):
    ids = t.raw("orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("id"))
    return snapshot.delete_listings(t.listings, ids).select("id", "title")


@query("orphan_nulling", "SELECT e.id, CASE WHEN o.o_orderkey IS NOT NULL THEN e.id END AS job_id FROM run_items e LEFT JOIN orders o ON o.o_orderkey = e.id AND o.o_totalprice <= 100000", R)
def _(t: Tables):
    kept = t.listings.join(t.raw("orders").where("o_totalprice <= 100000"), F.col("id") == F.col("o_orderkey"), "left_semi")
    return snapshot.orphan_nulling(t.run_items.withColumn("job_id", F.col("id")), kept).select("id", "job_id")


@query("backfill_snapshot", "SELECT id, created_at AS first_seen_at, updated_at AS last_seen_at, last_date AS expires_at, CASE WHEN status = 'PUBLISHED' THEN created_at END AS published_at FROM listings", L)
def _(t: Tables):
    return snapshot.backfill(t.listings).select("id", "first_seen_at", "last_seen_at", "expires_at", "published_at")


@query(
    "manual_edit",
    f"""WITH {_VALIDATED}, e AS (SELECT * FROM valid WHERE error IS NULL AND status <> 'ARCHIVED')
    SELECT l.id, coalesce(e.title, l.title) AS title, coalesce(e.status, l.status) AS status, CASE WHEN e.id IS NULL THEN l.last_date ELSE e.last_date END AS last_date, CASE WHEN e.id IS NULL THEN l.expires_at ELSE e.last_date END AS expires_at,
      CASE WHEN e.status = 'EXPIRED' THEN {_NOW} END AS expired_at, CASE WHEN e.status = 'PUBLISHED' AND l.published_at IS NULL THEN {_NOW} ELSE l.published_at END AS published_at, CASE WHEN e.id IS NULL THEN l.review_status ELSE 'MANUAL_VERIFIED' END AS review_status, CASE WHEN e.id IS NULL THEN l.updated_at ELSE {_NOW} END AS updated_at
    FROM listings l LEFT JOIN e ON l.id = e.id""",
    L,
)
def _(t: Tables):
    edits = validate.validate_listings(_requests(t), NOW).where("error IS NULL AND status <> 'ARCHIVED'").drop("error")
    return snapshot.manual_edit(t.listings, edits, NOW).select("id", "title", "status", "last_date", "expires_at", "expired_at", "published_at", "review_status", "updated_at")


# A backup file: every record's id is halved (collisions, later records win), every fifth record is new.
def _backup(t: Tables):
    rows = _requests(t).withColumn("seq", F.col("id"))
    return validate.validate_listings(rows, NOW).withColumn("id", F.when(F.col("seq") % 5 != 0, F.floor(F.col("seq") / 2) + 7000))


@query(
    "import_backup",
    f"""WITH {_VALIDATED}, i AS MATERIALIZED (SELECT *, CASE WHEN id % 5 <> 0 THEN id // 2 + 7000 END AS new_id FROM valid WHERE error IS NULL),
    u AS MATERIALIZED (SELECT new_id AS id, arg_max(title, id) AS title, arg_max(status, id) AS status, max_by(struct_pack(v := last_date), id).v AS last_date, arg_min(status, id) AS first_status FROM i WHERE new_id > 0 GROUP BY new_id),
    top AS (SELECT greatest((SELECT max(id) FROM listings), (SELECT max(id) FROM u)) AS t)
    SELECT coalesce(l.id, u.id) AS id, coalesce(u.title, l.title) AS title, coalesce(u.status, l.status) AS status, CASE WHEN u.id IS NULL THEN l.expires_at ELSE u.last_date END AS expires_at,
      CASE WHEN l.id IS NOT NULL THEN l.published_at WHEN first_status = 'PUBLISHED' THEN {_NOW} END AS published_at, CASE WHEN u.id IS NULL THEN l.review_status ELSE 'MANUAL_VERIFIED' END AS review_status, CASE WHEN u.id IS NULL THEN l.updated_at ELSE {_NOW} END AS updated_at FROM listings l FULL JOIN u ON l.id = u.id
    UNION ALL SELECT (SELECT t FROM top) + row_number() OVER (ORDER BY id), title, status, last_date, CASE WHEN status = 'PUBLISHED' THEN {_NOW} END, 'MANUAL_VERIFIED', {_NOW} FROM i WHERE new_id IS NULL""",
    L,
)
def _(t: Tables):
    return snapshot.import_backup(t.listings, _backup(t), NOW)[0].select("id", "title", "status", "expires_at", "published_at", "review_status", "updated_at")


@query("import_counts", f"WITH {_VALIDATED} SELECT count(*) FILTER (error IS NULL) AS imported, count(*) FILTER (error IS NOT NULL) AS skipped FROM valid", L)
def _(t: Tables):
    return snapshot.import_backup(t.listings, _backup(t), NOW)[1]


@query(
    "advance_source_hash",
    """SELECT id, CASE WHEN id % 3 = 0 THEN last_content_hash WHEN coalesce((SELECT bool_and(action <> 'ERROR') FROM run_items r WHERE r.source_id = sources.id), true) THEN 'new' || CAST(id AS VARCHAR) ELSE last_content_hash END AS last_content_hash FROM sources""",
    ("sources", "run_items"),
)
def _(t: Tables):
    collected = t.sources.where("id % 3 <> 0").select(F.col("id").alias("source_id"), F.concat(F.lit("new"), F.col("id").cast("string")).alias("content_hash"))
    handled = t.run_items.select("source_id", (F.col("action") != "ERROR").alias("ok"))
    return snapshot.advance_source_hash(t.sources, collected, handled).select("id", "last_content_hash")


# --- write run -------------------------------------------------------------------------------------
CLS = ("candidates", "listings", "sources")


def _upsert_sql() -> str:
    upd = "SELECT * FROM final WHERE action = 'WOULD_UPDATE'"

    def last(e: str, given: str) -> str:
        return f"max_by(struct_pack(v := {e}), pos) FILTER ({given})"

    fields = ["title", "qualification", "salary", "location", "source_job_id"]
    value = {f: f for f in fields} | {"source_job_id": k.clean("source_job_id")}
    folded = ", ".join(f"{last(value[f], f'{f} <> {chr(39)}{chr(39)}')} AS u_{f}" for f in fields)
    return f"""WITH {PLAN_CTES}, f AS MATERIALIZED (SELECT listing_id, {folded}, {last('dl', "last_date <> ''")} AS u_dl, {last('a', "apply_link <> ''")} AS u_a, max(pos) AS p,
      max_by(source_id, pos) AS from_id, bool_or(coalesce(dl > {_NOW}, false)) AS revive, max_by(score, pos) AS score FROM ({upd}) GROUP BY listing_id),
    touched AS (SELECT DISTINCT listing_id FROM final WHERE action IN ('WOULD_UPDATE', 'DUPLICATE'))
    SELECT l.id, {', '.join(f'CASE WHEN u_{x} IS NOT NULL THEN (u_{x}).v ELSE l.{x} END AS {x}' for x in fields)}, CASE WHEN u_dl IS NOT NULL THEN (u_dl).v ELSE l.last_date END AS last_date,
      CASE WHEN u_dl IS NOT NULL THEN (u_dl).v ELSE l.expires_at END AS expires_at, CASE WHEN u_a IS NOT NULL THEN (u_a).v ELSE l.apply_link END AS apply_link,
      CASE WHEN f.listing_id IS NOT NULL AND l.status = 'PUBLISHED' THEN 'DRAFT' WHEN l.status = 'EXPIRED' AND f.revive THEN 'DRAFT' ELSE l.status END AS status,
      l.featured AND NOT (f.listing_id IS NOT NULL AND l.status = 'PUBLISHED') AS featured, CASE WHEN f.listing_id IS NOT NULL THEN 'REVIEW_REQUIRED' ELSE l.review_status END AS review_status,
      CASE WHEN f.listing_id IS NOT NULL AND l.source_id IS NULL THEN f.from_id ELSE l.source_id END AS source_id, CASE WHEN t.listing_id IS NOT NULL THEN {_NOW} END AS last_seen_at, CASE WHEN t.listing_id IS NOT NULL THEN 7::BIGINT END AS automation_run_id,
      f.score / 100.0::DOUBLE AS automation_confidence
    FROM listings l LEFT JOIN f ON f.listing_id = l.id LEFT JOIN touched t ON t.listing_id = l.id"""


@query("upsert", _upsert_sql(), CLS)
def _(t: Tables):
    out = snapshot.upsert(t.spread("listings"), plan(t), NOW, 7)
    return out.select(
        "id", "title", "qualification", "salary", "location", "source_job_id", "last_date", "expires_at", "apply_link", "status", "featured",
        "review_status", "source_id", "last_seen_at", "automation_run_id", F.col("automation_confidence").cast("double").alias("automation_confidence"),
    )


@query(
    "touch_duplicates",
    f"WITH {PLAN_CTES} SELECT l.id, CASE WHEN l.id IN (SELECT listing_id FROM final WHERE action = 'DUPLICATE') THEN {_NOW} END AS last_seen_at, CASE WHEN l.id IN (SELECT listing_id FROM final WHERE action = 'DUPLICATE') THEN {_NOW} ELSE l.updated_at END AS updated_at FROM listings l",
    CLS,
)
def _(t: Tables):
    return snapshot.touch_duplicates(t.spread("listings"), plan(t), NOW, 7).select("id", "last_seen_at", "updated_at")


@query(
    "insert_new",
    f"""WITH {PLAN_CTES} SELECT (SELECT max(id) FROM listings) + row_number() OVER (ORDER BY pos) AS id, f.cand_id, trim(f.title) AS title, f.department, f.salary, f.dl AS last_date, f.dl AS expires_at, {k.deadline('f.posted_date')} AS posted_date, f.a AS apply_link, f.n AS notification_link,
      'DRAFT' AS status, s.category, s.name AS source_name, nullif({k.clean('f.source_job_id')}, '') AS source_job_id, {k.fingerprint('f.title', 'f.department', 'f.location', k.day('f.last_date'), 'f.source_job_id')} AS source_hash
    FROM final f JOIN sources s ON s.id = f.source_id WHERE action = 'WOULD_ADD'""",
    CLS,
)
def _(t: Tables):
    out = snapshot.insert_new(plan(t).where("action = 'WOULD_ADD'"), t.spread("listings"), NOW, 7)
    return out.select("id", "cand_id", "title", "department", "salary", "last_date", "expires_at", "posted_date", "apply_link", "notification_link", "status", "category", "source_name", "source_job_id", "source_hash")
