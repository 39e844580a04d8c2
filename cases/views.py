"""Bindings of the board's tables onto the driver tables.

Each view is one SQL text that runs unchanged in both engines; `{orders}` etc.
are the driver tables.  Spark reads it through `view()`, the oracles through
`with_views()`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from cases import sqlkit as k
from gazette.functions.dates import day
from gazette.functions.identity import fingerprint

NOW = "2026-07-01 12:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"
SITE = "https://board.example.org"

_DAY = "CAST(CAST({0} AS DATE) AS STRING)"


def _iso(x: str) -> str:
    return _DAY.format(x)


def _dmy(x: str) -> str:
    d = _iso(x)
    return f"substr({d}, 9, 2) || '/' || substr({d}, 6, 2) || '/' || substr({d}, 1, 4)"


def _named(x: str) -> str:
    d = _iso(x)
    months = ["Jan", "Feb", "March", "April", "May", "June", "July", "Aug", "September", "October", "Nov", "Dec"]
    names = " ".join(f"WHEN '{i + 1:02d}' THEN '{m}'" for i, m in enumerate(months))
    return f"substr({d}, 9, 2) || ' ' || CASE substr({d}, 6, 2) {names} END || ' ' || substr({d}, 1, 4)"


_KEY = "CAST(o_orderkey AS STRING)"
_SHIFT = "INTERVAL '9862' DAY"          # 1995-2001 order dates become 2022-2028
_PLUS30 = "INTERVAL '9892' DAY"
_PLUS10 = "INTERVAL '9872' DAY"
_MINUS20 = "INTERVAL '9842' DAY"

_TITLE = """CASE o_orderkey % 6 WHEN 0 THEN 'Recruitment of Junior Engineers at ' WHEN 1 THEN 'Engagement of Assistant Officers by '
  WHEN 2 THEN 'Applications invited for Clerks: ' WHEN 3 THEN 'Apprentices wanted, ' WHEN 4 THEN 'Appointment of Research Associate - '
  ELSE 'Walk-in interview for Trainees ' END || c_name"""

VIEWS: dict[str, str] = {}

VIEWS["listings"] = f"""
SELECT o_orderkey AS id,
  {_TITLE} AS title,
  n_name AS department,
  o_orderpriority AS qualification,
  CAST(o_orderkey % 40 AS STRING) AS vacancy,
  'Rs. ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS salary,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Maximum ' || CAST(20 + o_orderkey % 30 AS STRING) || ' years' END AS age_limit,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE r_name END AS location,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Rs. ' || CAST(o_orderkey % 500 AS STRING) || '/-' END AS application_fee,
  'Written examination' AS selection_process,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE c_name || ' <b>' || c_mktsegment || '</b> & more' END AS description,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Apply online' END AS how_to_apply,
  CAST(NULL AS STRING) AS important_dates,
  o_orderdate + {_SHIFT} AS application_start_date,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + {_PLUS30} END AS last_date,
  CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate + {_PLUS10} WHEN o_orderkey % 5 = 0 THEN NULL
    WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + {_PLUS30} END AS expires_at,
  CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderdate + {_MINUS20} END AS posted_date,
  CASE WHEN o_orderstatus = 'O' THEN o_orderdate + {_SHIFT} END AS published_at,
  CAST(NULL AS TIMESTAMP) AS expired_at,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://www.jobs' || CAST(o_custkey AS STRING) || '.example.org/apply/' || {_KEY} || '/?utm_source=x&id=' || {_KEY}
    ELSE 'https://jobs' || CAST(o_custkey AS STRING) || '.example.org/apply/' || {_KEY} || '?id=' || {_KEY} END AS apply_link,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'http://www.notices.example.org/n/' || {_KEY} || '.pdf/#p1'
    ELSE 'http://notices.example.org/n/' || {_KEY} || '.pdf' END AS notification_link,
  CASE WHEN o_orderkey % 3 = 1 THEN 'https://org' || CAST(n_nationkey AS STRING) || '.example.org' END AS official_website,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'Government Jobs' WHEN 'BUILDING' THEN 'Railway Jobs' WHEN 'AUTOMOBILE' THEN 'Private Jobs'
    WHEN 'FURNITURE' THEN 'Banking Jobs' ELSE 'HOUSEHOLD' END AS category,
  CASE WHEN o_orderstatus = 'O' THEN 'PUBLISHED' WHEN o_orderstatus = 'P' THEN 'DRAFT'
    WHEN o_orderkey % 2 = 0 THEN 'EXPIRED' ELSE 'ARCHIVED' END AS status,
  o_orderkey % 10 = 0 AS featured,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey % 25 END AS source_id,
  'Source ' || CAST(o_custkey % 25 AS STRING) AS source_name,
  'https://org' || CAST(o_custkey % 25 AS STRING) || '.example.org/jobs' AS source_url,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'ORD-' || {_KEY} END AS source_job_id,
  CASE WHEN o_orderkey % 19 = 0 THEN 'REJECTED' WHEN o_orderkey % 2 = 0 THEN 'REVIEW_REQUIRED' ELSE 'MANUAL_VERIFIED' END AS review_status,
  CAST(NULL AS STRING) AS source_hash,
  CAST(NULL AS BIGINT) AS automation_run_id,
  o_orderdate + {_SHIFT} AS created_at,
  o_orderdate + {_SHIFT} + CAST(o_orderkey % 50 AS INT) * INTERVAL '1' DAY AS updated_at
FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey
  JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
"""

# One candidate per order.  `o_orderkey % 8` picks how it relates to the listing:
# 0 same id, 1 amendment, 2 apply link, 3 notice link, 4 same facts, 5 same facts
# with noise, 6 unseen ids shared by neighbours, 7 unseen links and broken text.
VIEWS["candidates"] = f"""
SELECT o_orderkey AS cand_id,
  o_orderkey AS pos,
  o_custkey % 25 AS source_id,
  CASE o_orderkey % 8 WHEN 1 THEN 'Corrigendum: ' || t.title || ' last date extension'
    WHEN 5 THEN '  ' || upper(t.title) || ' !' WHEN 6 THEN 'Vacancies for Scientists ' || CAST(o_orderkey % 100 AS STRING)
    WHEN 7 THEN CASE o_orderkey % 5 WHEN 0 THEN 'Final result of Engineers' WHEN 1 THEN 'Recruitment' WHEN 2 THEN 'Holiday list'
      ELSE 'Posts of Managers â€¦' || {_KEY} END ELSE t.title END AS title,
  n_name AS department,
  CASE o_orderkey % 4 WHEN 0 THEN 'Experience and date. Degree in ' || c_mktsegment || ' How to apply online' WHEN 1 THEN o_orderpriority
    WHEN 2 THEN 'is Graduate with ' || c_name || ' 12/10/2026 and more' END AS qualification,
  CASE WHEN o_orderkey % 40 = 1 THEN '1' WHEN o_orderkey % 6 = 5 THEN 'many' ELSE CAST(o_orderkey % 40 AS STRING) END AS vacancy,
  CASE WHEN o_orderkey % 3 = 0 THEN 'of Rs. ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' age limit 30'
    WHEN o_orderkey % 3 = 1 THEN 'as per norms' END AS salary,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'Below 25 Years. c. Selected students will be told'
    ELSE 'Maximum ' || CAST(20 + o_orderkey % 30 AS STRING) || ' years' END AS age_limit,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN 'N/A' ELSE r_name END AS location,
  CASE WHEN o_orderkey % 3 = 0 THEN 'free of cost' ELSE 'Rs. ' || CAST(o_orderkey % 500 AS STRING) || '/-' END AS application_fee,
  CASE o_orderkey % 3 WHEN 0 THEN 'Selection Process: Written examination. How to apply by post' WHEN 1 THEN 'How to apply first' ELSE 'merit 2 . Next' END AS selection_process,
  '1) ' || c_name || '; ' || c_mktsegment AS description,
  CASE WHEN o_orderkey % 2 = 0 THEN ': Apply online' END AS how_to_apply,
  CASE WHEN o_orderkey % 3 = 0 THEN {_iso(f'o_orderdate + {_SHIFT}')} END AS application_start_date,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CASE o_orderkey % 3 WHEN 0 THEN {_iso(f'o_orderdate + {_PLUS30}')}
    WHEN 1 THEN {_dmy(f'o_orderdate + {_PLUS30}')} ELSE {_named(f'o_orderdate + {_PLUS30}')} END END AS last_date,
  {_dmy(f'o_orderdate + {_MINUS20}')} AS posted_date,
  CAST(NULL AS STRING) AS updated_date,
  CASE WHEN o_orderkey % 8 IN (0, 2) AND o_orderkey % 5 <> 0 THEN 'https://www.jobs' || CAST(o_custkey AS STRING) || '.example.org/apply/' || {_KEY} || '/?id=' || {_KEY} || '&gclid=9'
    WHEN o_orderkey % 8 = 7 THEN 'https://new.example.org/apply/' || CAST(o_custkey AS STRING) || '/' END AS apply_link,
  CASE WHEN o_orderkey % 8 IN (0, 3) AND o_orderkey % 4 <> 0 THEN 'http://www.notices.example.org/n/' || {_KEY} || '.pdf#top'
    WHEN o_orderkey % 8 = 6 THEN 'https://new.example.org/n/' || {_KEY} || '?b=2&a=1' END AS notification_link,
  CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.org' || CAST(n_nationkey AS STRING) || '.example.org/' END AS official_website,
  CASE WHEN o_orderkey % 8 IN (0, 4) AND o_orderkey % 3 <> 0 THEN ' ord-' || {_KEY} WHEN o_orderkey % 8 = 6 THEN 'NEW/' || CAST(o_orderkey - o_orderkey % 24 AS STRING) END AS source_job_id,
  CASE WHEN o_orderkey % 9 = 0 THEN 'https://elsewhere.example.net/jobs' ELSE 'https://www.org' || CAST(o_custkey % 25 AS STRING) || '.example.org/jobs' END AS source_url,
  CASE WHEN o_orderkey % 23 = 0 THEN 'short' ELSE t.title || ' official text of the notice. Total vacancies: 1. ' || repeat(c_name || ' ', CAST(1 + o_orderkey % 40 AS INT)) END AS raw_text,
  o_orderkey % 8 = 1 AS is_corrigendum,
  CASE WHEN o_orderkey % 6 = 0 THEN 'PDF' ELSE 'HTML' END AS extraction_method
FROM (SELECT o.*, c.*, {_TITLE} AS title FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey) t
  JOIN {{nation}} n ON t.c_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
"""

VIEWS["sources"] = """
SELECT s_suppkey AS id,
  CASE WHEN s_suppkey % 31 = 30 THEN 'x' ELSE s_name END AS name,
  'org' || CAST(s_suppkey AS STRING) || '.example.org' AS domain,
  CASE WHEN s_suppkey % 29 = 28 THEN 'nowhere' WHEN s_suppkey % 4 = 0 THEN 'https://www.org' || CAST(s_suppkey AS STRING) || '.example.org/jobs/?utm_x=1'
    WHEN s_suppkey % 12 = 5 THEN 'https://org' || CAST(s_suppkey AS STRING) || '.example.org/list.pdf'
    ELSE 'http://org' || CAST(s_suppkey AS STRING) || '.example.org/jobs' END AS start_url,
  CASE s_suppkey % 6 WHEN 0 THEN 'GOVERNMENT' WHEN 1 THEN 'PSU' WHEN 2 THEN 'BANKING' WHEN 3 THEN 'UNIVERSITY' WHEN 4 THEN 'PRIVATE_COMPANY' ELSE 'CLUB' END AS type,
  n_name AS category,
  CASE s_suppkey % 4 WHEN 0 THEN 'GOVERNMENT_HTML' WHEN 3 THEN 'PDF_NOTIFICATION' ELSE 'GENERIC_HTML' END AS parser_type,
  s_acctbal > 0 AS enabled, s_suppkey % 2 = 0 AS trusted, s_suppkey % 10 = 0 AS auto_publish,
  CASE s_suppkey % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'PENDING' ELSE 'REJECTED' END AS review_status,
  CASE WHEN s_suppkey % 2 = 1 THEN md5(CAST(s_suppkey AS STRING)) END AS last_content_hash
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
"""

VIEWS["preferences"] = """
SELECT c_custkey AS id, ' User' || CAST(c_custkey AS STRING) || '@Example.ORG ' AS email,
  CASE c_custkey % 4 WHEN 0 THEN 'engineers|' || lower(c_name) WHEN 1 THEN 'Customer#00000' || CAST(c_custkey % 1000 AS STRING) WHEN 2 THEN lower(n_name) || '|Trainees' ELSE '' END AS keyword_list,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'government|bank' ELSE c_mktsegment || '|rail' END AS category_list,
  CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 > 0 THEN '' ELSE r_name || '|asi' END AS location_list,
  CASE c_custkey % 6 WHEN 0 THEN 'urgent' WHEN 1 THEN '' WHEN 2 THEN 'low' END AS qualification,
  c_acctbal > 0 AS active,
  CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2026-01-01 00:00:00' END AS verified_at,
  TIMESTAMP '2026-01-01 00:00:00' + CAST(c_custkey % 97 AS INT) * INTERVAL '1' HOUR AS created_at
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

VIEWS["run_items"] = """
SELECT event_id AS id, ts AS created_at, user_id AS source_id, 'Source ' || CAST(user_id AS STRING) AS source_name,
  CAST(CAST(ts AS DATE) AS STRING) AS run_id,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'WOULD_ADD' ELSE 'ADDED' END
    WHEN 'purchase' THEN 'UPDATED' WHEN 'click' THEN 'SKIPPED' ELSE 'DUPLICATE' END AS action,
  CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'HTTP 503' WHEN 1 THEN 'HTTP 403' WHEN 2 THEN 'Request timed out after 30s' WHEN 3 THEN 'socket hang up' ELSE 'bad page' END END AS error,
  CASE WHEN event_type <> 'error' OR event_id % 2 = 1 THEN 'Notice ' || CAST(event_id AS STRING) END AS candidate_title,
  'reason ' || props AS reason,
  CASE WHEN event_type = 'click' AND event_id % 64 = 3 THEN '{"kind":"metrics","processed":' || CAST(event_id AS STRING) || ',"skipped":' || CAST(event_id % 97 AS STRING) || ',"expired":' || CAST(event_id % 7 AS STRING)
    || ',"candidates":' || CAST(event_id % 1000 AS STRING) || ',"rawLinks":12,"recruitmentLinks":' || CAST(event_id % 5 AS STRING) || ',"uniqueNotices":4,"parsedJobs":3,"rejected":2,"lowConfidence":1,"draftsCreated":' || CAST(event_id % 3 AS STRING) || '}'
  WHEN event_type = 'click' THEN CASE event_id % 4
    WHEN 0 THEN '{"kind":"manual-review-decision","candidateKey":"k' || CAST(event_id % 7 AS STRING) || '","snapshotHash":"s' || CAST(user_id % 3 AS STRING) || '","decision":"' || CASE event_id % 3 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'NEEDS_CORRECTION' ELSE 'MAYBE' END || '","reason":"r' || CAST(event_id AS STRING) || '"}'
    WHEN 1 THEN '{"kind":"manual-review-correction","candidateKey":"k' || CAST(event_id % 5 AS STRING) || '","snapshotHash":"s' || CAST(user_id % 2 AS STRING) || '","corrections":{"vacancy":" ' || CAST(event_id AS STRING) || ' ","' || CASE event_id % 3 WHEN 0 THEN 'salary' WHEN 1 THEN 'title' ELSE 'location' END || '":"Rs. 5"}}'
    ELSE props END ELSE props END AS details,
  value
FROM {events}
"""

# Page text with a recruitment card, links and structured data placed in its article.
VIEWS["pages_in"] = r"""
SELECT page_id, page_id % 50 AS source_id, url,
  replace(html, '<article>', '<article><div><h3>Recruitment of Engineers batch ' || CAST(page_id % 90 AS STRING) || CASE WHEN page_id % 5 = 0 THEN ' (Apply from 01.08.2026 to 31.12.2026)' ELSE '' END || '</h3><p>ADVERTISEMENT NO: ENG/' || CAST(page_id % 90 AS STRING)
  || '/2026</p> <span>Location: Delhi  Age limit: 28 years  Last date: 30/09/2026  Vacancies: ' || CAST(page_id % 30 AS STRING) || '  Salary: Rs. 500 per month</span> <a href="/docs/notice-' || CAST(page_id AS STRING) || '.pdf?utm_source=a&amp;v=2">Download Advertisement</a> <a class="b" href=''/docs/notice-'
  || CAST(page_id AS STRING) || '.pdf?v=2''>Notification <b>' || CAST(page_id AS STRING) || '</b></a> <a href="/careers/' || CAST(page_id % 10 AS STRING) || '">Careers and jobs</a> <a href="/vacancy/' || CAST(page_id AS STRING) || '/">Assistant Managers vacancy at desk ' || CAST(page_id AS STRING)
  || '</a> <a href="/vacancy/' || CAST(page_id AS STRING) || '">View More</a> <a href="https://apply.example.org/eng-' || CAST(page_id AS STRING) || '">Apply Online</a> <a href="/result.pdf">Final Result</a> </div>'
  || '<script type="application/ld+json">' || CASE WHEN page_id % 7 = 3 THEN '{"broken": ' ELSE '{"@context":"https://schema.org","@graph":[{"@type":["Thing","JobPosting"],"title":"Trainee posts ' || CAST(page_id AS STRING) || '","hiringOrganization":{"name":"Board ' || CAST(page_id % 9 AS STRING) || '","sameAs":"/about"},"jobLocation":[{"address":{"addressLocality":"Pune","addressCountry":"IN"}},{"address":"Delhi"}],"baseSalary":{"currency":"INR","value":{"minValue":100,"maxValue":200,"unitText":"MONTH"}},"validThrough":"2026-12-0' || CAST(1 + page_id % 9 AS STRING) || '","identifier":{"value":"JL-' || CAST(page_id AS STRING) || '"},"url":"/job/' || CAST(page_id AS STRING) || '","description":"<p>Text &amp;amp; more</p>"},{"@type":"Organization","name":"none"}]}' END || '</script>') AS html
FROM {pages}
"""

# Long notice text around every document.
VIEWS["notices"] = """
SELECT doc_id, source, lang,
  CASE doc_id % 4 WHEN 0 THEN 'walk in interview' WHEN 1 THEN 'Corrigendum ' || CAST(doc_id AS STRING) WHEN 2 THEN 'Recruitment of officers, batch ' || CAST(doc_id AS STRING) ELSE '' END AS label,
  'NATIONAL SURVEY ORGANISATION Advt No. NSO/' || CAST(doc_id AS STRING) || '/2026 RECRUITMENT OF FIELD OFFICERS grade ' || CAST(doc_id % 9 AS STRING) || ' Essential Qualifications Degree in Law with ' || CAST(doc_id % 60 AS STRING)
  || ' percent General Conditions Tenure two years. ' || CASE WHEN doc_id % 6 = 1 THEN 'Extension of the last date applies. ' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'No. of Posts ' || CAST(10 + doc_id % 80 AS STRING) || ' ' ELSE 'Number of vacancies: ' || CAST(doc_id % 9 AS STRING) || '. Clerk ' END
  || text || ' Age Limit Maximum ' || CAST(20 + doc_id % 20 AS STRING) || ' years as on closing. Pay Scale Rs. ' || CAST(doc_id * 3 AS STRING) || ' per month Application Fee nil How to apply Candidates submit the form at http://apply.example.org/form/' || CAST(doc_id AS STRING)
  || '?utm_a=1. Selection procedure Screening and interview. Last date ' || CAST(1 + doc_id % 28 AS STRING) || CASE doc_id % 3 WHEN 0 THEN 'th Sep 2026' WHEN 1 THEN '/09/2026' ELSE '-10-2026' END || ' Place of posting Delhi office' AS text
FROM {documents}
"""

_TABLES = re.compile(r"\{(region|nation|customer|supplier|part|orders|lineitem|events|documents|pages)\}")


def tables_of(sql: str) -> list[str]:
    return sorted(set(_TABLES.findall(sql)))


# A test table is one small file, hence one task; text-heavy views spread it over the cores. Their rows grow
# wide, and what a task sorts of them must not grow with the table: a task gets so many rows on average.
ROWS_PER_TASK = 50_000
_SPREAD = {"candidates": ("orders",), "notices": ("documents",), "pages_in": ("pages",)}


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    sql = VIEWS[name]
    text = _TABLES.sub(lambda m: f"bind_{m.group(1)}", sql)
    for table in tables_of(sql):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        cores = spark.sparkContext.defaultParallelism
        if table in _SPREAD.get(name, ()) or (spread and table == "orders"):
            tasks = max(cores, -(-df.count() // ROWS_PER_TASK))
            if len(df.inputFiles()) < tasks:
                df = df.repartition(tasks)
        df.createOrReplaceTempView(f"bind_{table}")
    df = spark.sql(text)
    if name == "listings":
        # Every third listing was stored with its fingerprint; hashing differs between the engines' SQL.
        df = df.withColumn("source_hash", F.when(F.col("id") % 3 == 0, fingerprint("title", "department", "location", day("last_date"), "source_job_id")))
    return df.select(*[df[c].cast("timestamp_ntz") if t == "timestamp" else df[c] for c, t in df.dtypes])


def view_sql(name: str) -> str:
    sql = _TABLES.sub(lambda m: m.group(1), VIEWS[name])
    if name == "listings":
        stored = k.fingerprint("title", "department", "location", k.ts_day("last_date"), "source_job_id")
        sql = f"SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN {stored} END AS source_hash) FROM ({sql})"
    return sql


def with_views(sql: str, *names: str) -> str:
    """`sql` preceded by CTEs for the named views (materialised once)."""
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({view_sql(n)})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        recursive = body[5:].lstrip().upper().startswith("RECURSIVE")
        rest = body[5:].lstrip()[len("RECURSIVE"):] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"
