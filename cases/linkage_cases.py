"""Record linkage of candidates and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cases import sqlkit as k
from cases.registry import Tables, query
from gazette import vocabulary as V
from gazette.operators import linkage

CL = ("candidates", "listings")


def keys_sql(table: str, row: str, d: str, stored: bool = False) -> str:
    hashed = "nullif(source_hash, '')" if stored else k.fingerprint("title", "department", "location", d, "source_job_id")
    return f"""SELECT {row} AS id, 1 AS kind, CAST(source_id AS VARCHAR) || '|' || {k.fold('source_job_id')} AS key FROM {table} WHERE source_id IS NOT NULL AND source_job_id <> ''
      UNION ALL SELECT {row}, 3, {k.canon('apply_link')} FROM {table} UNION ALL SELECT {row}, 4, {k.canon('notification_link')} FROM {table}
      UNION ALL SELECT {row}, 5, {hashed} FROM {table}
      UNION ALL SELECT {row}, 6, {k.composite('title', 'department', 'location', d)} FROM {table}"""


_TOKENS = (
    f"list_sort(list_distinct(list_filter(string_split({k.fold('title')}, ' '), lambda w: length(w) > 2 AND w NOT IN ("
    + ", ".join(k.q(w) for w in V.CORRIGENDUM_STOP_WORDS) + "))))"
)


def match_ctes(cand: str, listing: str) -> str:
    """CTEs ending in `matches(cand_id, listing_id, kind)`."""
    return f"""lk AS MATERIALIZED (SELECT kind, key, max(id) AS id FROM ({keys_sql(listing, 'id', k.ts_day('last_date'), stored=True)}) WHERE key IS NOT NULL GROUP BY ALL),
  ck AS MATERIALIZED (SELECT id AS cand_id, kind, key FROM ({keys_sql(cand, 'cand_id', k.day('last_date'))}) WHERE key IS NOT NULL),
  ct AS MATERIALIZED (SELECT cand_id, source_id, {_TOKENS} AS w FROM {cand} WHERE is_corrigendum),
  lt AS MATERIALIZED (SELECT id, source_id, {_TOKENS} AS w FROM {listing} WHERE source_id IS NOT NULL),
  amended AS MATERIALIZED (SELECT cand_id, min(id) AS id FROM ct JOIN lt ON ct.source_id = lt.source_id
    WHERE len(ct.w) >= 2 AND len(lt.w) >= 2 AND len(list_intersect(ct.w, lt.w)) / least(len(ct.w), len(lt.w))::DOUBLE >= 0.6 GROUP BY cand_id),
  hits AS MATERIALIZED (SELECT cand_id, ck.kind, lk.id FROM ck JOIN lk ON ck.kind = lk.kind AND ck.key = lk.key UNION ALL SELECT cand_id, 2, id FROM amended),
  matches AS MATERIALIZED (SELECT cand_id, arg_min(id, kind) AS listing_id, min(kind) AS kind FROM hits GROUP BY cand_id)"""


KIND_NAME = "CASE kind " + " ".join(f"WHEN {i} THEN {k.q(n)}" for i, n in enumerate(V.MATCH_KINDS, 1)) + " END"
_MATCH = f"WITH {match_ctes('candidates', 'listings')} "


@query(
    "match_candidates",
    f"{_MATCH} SELECT c.cand_id, m.listing_id, {KIND_NAME} AS matched_by FROM candidates c LEFT JOIN matches m ON c.cand_id = m.cand_id",
    CL,
)
def _(t: Tables):
    return linkage.match_candidates(t.candidates, t.spread("listings"))


for _name, _kind in {
    "match_source_id": linkage.BY_ID,
    "match_amendment_title": linkage.BY_AMENDMENT,
    "match_apply_url": linkage.BY_APPLY,
    "match_notice_url": linkage.BY_NOTICE,
    "match_fingerprint": linkage.BY_HASH,
    "match_composite": linkage.BY_FACTS,
}.items():
    query(_name, f"{_MATCH} SELECT cand_id, id AS listing_id FROM hits WHERE kind = {_kind}", CL)(
        lambda t, kind=_kind: linkage.match_by(t.candidates, t.spread("listings"), kind)
    )


@query(
    "prefilter",
    f"""WITH l AS MATERIALIZED (SELECT *, {k.canon('apply_link')} AS ca, {k.canon('notification_link')} AS cn,
      nullif(source_hash, '') AS fp FROM listings),
    c AS MATERIALIZED (SELECT *, {k.canon('apply_link')} AS ca, {k.canon('notification_link')} AS cn, {k.clean('source_job_id')} AS job,
      {k.fingerprint('title', 'department', 'location', k.day('last_date'), 'source_job_id')} AS fp FROM candidates)
    SELECT id, title FROM l WHERE EXISTS (FROM c WHERE c.job <> '' AND c.source_id = l.source_id AND c.job = l.source_job_id)
      OR EXISTS (FROM c WHERE c.is_corrigendum AND c.source_id = l.source_id) OR EXISTS (FROM c WHERE c.ca = l.ca) OR EXISTS (FROM c WHERE c.ca = l.apply_link)
      OR EXISTS (FROM c WHERE c.cn = l.cn) OR EXISTS (FROM c WHERE c.cn = l.notification_link) OR EXISTS (FROM c WHERE c.fp = l.fp) OR EXISTS (FROM c WHERE trim(c.title) = l.title)""",
    CL,
)
def _(t: Tables):
    return linkage.prefilter(t.spread("listings"), t.candidates).select("id", "title")


@query(
    "last_wins_index",
    f"SELECT kind, key, max(id) AS id FROM ({keys_sql('listings', 'id', k.ts_day('last_date'), stored=True)}) WHERE key IS NOT NULL GROUP BY ALL",
    ("listings",),
)
def _(t: Tables):
    return linkage.last_wins_index(linkage.listing_keys(t.spread("listings")), ["kind", "key"])


def changes_sql(new: str = "c", old: str = "l") -> str:
    parts = []
    for f in V.COMPARABLE_FIELDS:
        n, o = f"{new}.{f}", f"{old}.{f}"
        if f in ("last_date", "application_start_date"):
            differs = f"{k.day(n)} IS DISTINCT FROM {k.ts_day(o)}"
        elif f.endswith("_link") or f == "official_website":
            differs = f"{k.canon(n)} IS DISTINCT FROM {k.canon(o)}"
        else:
            differs = f"{k.fold(n)} <> {k.fold(o)}"
        parts.append(f"CASE WHEN {n} <> '' AND {differs} THEN '{f}' END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ', ')"


@query(
    "changed_fields",
    f"{_MATCH} SELECT c.cand_id, l.id AS listing_id, {changes_sql()} AS changes FROM candidates c JOIN matches m ON c.cand_id = m.cand_id JOIN listings l ON l.id = m.listing_id",
    CL,
)
def _(t: Tables):
    out = linkage.with_changes(t.candidates, linkage.match_candidates(t.candidates, t.spread("listings")), t.spread("listings"))
    return out.select("cand_id", "listing_id", F.array_join("changes", ", ").alias("changes"))


# The ordered walk is too slow in SQL on the whole table; tests compare it with brute force.
# Round by round: rows first on all their keys stay, rows that share a key with one go.
_WALK = f"""WITH RECURSIVE ck AS MATERIALIZED (SELECT DISTINCT x.id AS cand_id, c.pos, x.kind, x.key FROM ({keys_sql('candidates', 'cand_id', k.day('last_date'))}) x JOIN candidates c ON c.cand_id = x.id WHERE x.key IS NOT NULL),
  walk AS (SELECT cand_id, pos, kind, key, 'open' AS state FROM ck
    UNION ALL SELECT cand_id, pos, kind, key, CASE WHEN keep THEN 'kept' WHEN gone THEN 'gone' ELSE 'open' END FROM (SELECT *, bool_or(taken) OVER (PARTITION BY cand_id) AS gone FROM (SELECT *, bool_or(keep) OVER (PARTITION BY kind, key) AS taken
      FROM (SELECT *, bool_and(pos = first) OVER (PARTITION BY cand_id) AS keep FROM (SELECT *, min(pos) OVER (PARTITION BY kind, key) AS first FROM walk WHERE state = 'open'))))),
  kept AS MATERIALIZED (SELECT cand_id, pos, kind, key FROM walk WHERE state = 'kept'),
  hits AS MATERIALIZED (SELECT ck.cand_id, ck.kind, kept.cand_id AS other FROM ck JOIN kept ON kept.kind = ck.kind AND kept.key = ck.key AND kept.pos < ck.pos WHERE ck.cand_id NOT IN (SELECT cand_id FROM kept)),
  best AS (SELECT cand_id, min(struct_pack(kind := kind, other := other)) AS hit FROM hits GROUP BY cand_id)"""


@query(
    "dedupe_batch",
    f"{_WALK} SELECT c.cand_id, b.hit IS NULL AS keep, b.hit.other AS duplicate_of, {KIND_NAME.replace('CASE kind', 'CASE b.hit.kind')} AS matched_by FROM candidates c LEFT JOIN best b ON b.cand_id = c.cand_id",
    ("candidates",),
)
def _(t: Tables):
    return linkage.dedupe_batch(t.candidates)
