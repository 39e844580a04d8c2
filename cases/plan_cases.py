"""Scoring, quality gate, proposals and the review ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from cases import sqlkit as k
from cases.linkage_cases import KIND_NAME, changes_sql, match_ctes
from cases.registry import Tables, query
from cases.text_cases import _IDENTITY
from cases.views import EVENTS_NOW, NOW
from gazette import vocabulary as V
from gazette.operators import cleaning, normalize, review, scoring
from gazette.plans import proposals

_NOW = f"TIMESTAMP '{NOW}'"
CS = ("candidates", "sources")
R = ("run_items",)


def scored_sql(table: str = "cleaned") -> str:
    facts = " + ".join(f"CASE WHEN coalesce({k.clean(c)}, '') <> '' THEN {int(float(w) * 100)} ELSE 0 END" for c, w in V.FACT_SCORES)
    host = f"regexp_replace(lower(regexp_extract(c.source_url, '^https?://([^/?#]+)', 1)), '^www\\.', '')"
    return f"""SELECT *, least(100, 10 + CASE WHEN official THEN 18 ELSE 0 END + {facts} + CASE WHEN source_job_id <> '' THEN 9 ELSE 0 END + CASE WHEN long_text THEN 5 ELSE 0 END
      + CASE WHEN a IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN n IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN coalesce(dl > {_NOW}, false) THEN 16 ELSE 0 END) AS score
    FROM (SELECT c.*, s.trusted, s.auto_publish, s.review_status, s.trusted AND ({host} = s.domain OR ends_with({host}, '.' || s.domain)) AS official,
      {k.deadline('c.last_date')} AS dl, {k.canon('c.apply_link')} AS a, {k.canon('c.notification_link')} AS n, length({k.clean('c.raw_text')}) >= 500 AS long_text
      FROM {table} c JOIN sources s ON c.source_id = s.id)"""


_REASONS = f"""array_to_string(list_filter([CASE WHEN official THEN 'trusted official source' WHEN NOT trusted THEN 'untrusted source requires review' END,
  CASE WHEN long_text THEN 'substantial official source text found' END,
  CASE WHEN dl > {_NOW} THEN 'future application deadline found' WHEN dl IS NOT NULL THEN 'deadline has passed' ELSE 'application deadline not reliably found' END,
  CASE WHEN NOT eligible THEN 'saved as draft unless manually verified' END], lambda x: x IS NOT NULL), '; ')"""
_ELIGIBLE = f"trusted AND auto_publish AND review_status = 'APPROVED' AND score >= 50 AND coalesce(dl > {_NOW}, false) AND (a IS NOT NULL OR n IS NOT NULL)"
_SCORE_CTES = f"cleaned AS MATERIALIZED ({k.CLEANED_CANDIDATES}), scored0 AS MATERIALIZED ({scored_sql()}), scored AS MATERIALIZED (SELECT *, {_ELIGIBLE} AS eligible FROM scored0)"


def _cleaned(t: Tables):
    return normalize.with_content_hash(cleaning.clean_notice_fields(t.candidates))


@query(
    "score_confidence",
    f"WITH {_SCORE_CTES} SELECT cand_id, score / 100.0::DOUBLE AS confidence, score >= 50 AS high_confidence, eligible, {_REASONS} AS reasons FROM scored",
    CS,
)
def _(t: Tables):
    scored = scoring.score_confidence(scoring.with_source(_cleaned(t), t.sources), NOW, "0.50", auto_publish=True)
    return scored.select(
        "cand_id", F.col("confidence").cast("double").alias("confidence"), "high_confidence", "eligible",
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query("publish_eligibility", f"WITH {_SCORE_CTES} SELECT cand_id FROM scored WHERE eligible", CS)
def _(t: Tables):
    scored = scoring.score_confidence(scoring.with_source(_cleaned(t), t.sources), NOW, "0.50", auto_publish=True)
    return scored.where("eligible").select("cand_id")


_FIELDS = ["title", "department", "qualification", "vacancy", "salary", "age_limit", "location", "application_fee", "selection_process"]
_QUALITY = f"""CASE WHEN NOT {k.has('trim(title)', V.RECOGNIZABLE_TITLE)} OR {k.has('trim(title)', V.BARE_TITLE)} THEN 'title'
  WHEN {' OR '.join(k.has(f, V.UNREADABLE) for f in _FIELDS)} THEN 'layout' WHEN dl < {_NOW} THEN 'expired'
  WHEN {k.has('title', V.QUALITY_RESULT_TITLE)} THEN 'result' WHEN coalesce(source_job_id, '') = '' AND n IS NULL AND a IS NULL THEN 'url'
  WHEN length(coalesce(raw_text, '')) < 40 THEN 'text' WHEN score < 60 THEN 'low' ELSE 'pass' END"""
_ACTION = "CASE q WHEN 'expired' THEN 'EXPIRED' WHEN 'result' THEN 'REJECTED' WHEN 'pass' THEN 'WOULD_ADD' ELSE 'LOW_CONFIDENCE' END"
_REASON = (
    "CASE q " + " ".join(f"WHEN '{n}' THEN {k.q(t)}" for n, t in V.QUALITY_REASONS.items())
    + " ELSE 'Confidence ' || CAST(score AS VARCHAR) || '% is below the 60% draft threshold.' END"
)


@query(
    "classify_quality",
    f"WITH {_SCORE_CTES} SELECT cand_id, {_ACTION} AS action, {_REASON} AS reason FROM (SELECT *, {_QUALITY} AS q FROM scored)",
    CS,
)
def _(t: Tables):
    scored = scoring.score_confidence(scoring.with_source(_cleaned(t), t.sources), NOW)
    return scoring.classify_quality(scored, NOW).select("cand_id", "action", "reason")


# Every third candidate key carries a recorded decision.
_DECISIONS = f"""SELECT source_id, candidate_key, snapshot_hash, CASE WHEN any_value(pos) % 2 = 0 THEN 'REJECTED' ELSE 'NEEDS_CORRECTION' END AS decision,
  'checked ' || CAST(source_id AS VARCHAR) AS reason FROM keyed WHERE pos % 3 = 0 GROUP BY ALL"""


def _decisions(prepared):
    return prepared.where(F.col("pos") % 3 == 0).groupBy("source_id", "candidate_key", "snapshot_hash").agg(
        F.when(F.min("pos") % 2 == 0, "REJECTED").otherwise("NEEDS_CORRECTION").alias("decision"),
        F.concat(F.lit("checked "), F.col("source_id").cast("string")).alias("reason"),
    )


_KEYED = f"""keyed AS MATERIALIZED (SELECT cand_id, source_id, pos {_IDENTITY.split('SELECT cand_id', 1)[1].rsplit('FROM c', 1)[0]} FROM cleaned),
  decisions AS MATERIALIZED ({_DECISIONS.replace('any_value(pos)', 'min(pos)')})"""
#: The cleaned candidates with their keys, and the recorded decisions.
KEYED_CTES = f"cleaned AS MATERIALIZED ({k.CLEANED_CANDIDATES}), {_KEYED}"
_PLAN_CTES = f"""{_SCORE_CTES}, {_KEYED},
  {match_ctes('cleaned', 'listings')},
  judged AS MATERIALIZED (SELECT s.*, m.listing_id, {KIND_NAME.replace('kind', 'm.kind', 1)} AS matched_by, {_QUALITY} AS q0, ky.candidate_key, ky.snapshot_hash, d.decision, d.reason AS decision_reason
    FROM scored s LEFT JOIN matches m ON s.cand_id = m.cand_id JOIN keyed ky ON ky.cand_id = s.cand_id
    LEFT JOIN decisions d ON d.source_id = ky.source_id AND d.candidate_key = ky.candidate_key AND d.snapshot_hash = ky.snapshot_hash),
  planned AS MATERIALIZED (SELECT j.*, CASE WHEN j.listing_id IS NOT NULL THEN {changes_sql('j', 'l')} END AS changes,
    CASE WHEN is_corrigendum AND listing_id IS NULL THEN 'amendment' ELSE q0 END AS q FROM judged j LEFT JOIN listings l ON l.id = j.listing_id),
  final AS MATERIALIZED (SELECT *, CASE WHEN q = 'amendment' THEN 'REJECTED' WHEN q <> 'pass' THEN {_ACTION} WHEN decision = 'REJECTED' THEN 'REJECTED' WHEN decision IS NOT NULL THEN 'LOW_CONFIDENCE'
      WHEN listing_id IS NULL THEN 'WOULD_ADD' WHEN changes = '' THEN 'DUPLICATE' ELSE 'WOULD_UPDATE' END AS action,
    CASE WHEN q <> 'pass' THEN {_REASON} WHEN decision = 'REJECTED' THEN 'Previously rejected exact source snapshot: ' || decision_reason WHEN decision IS NOT NULL THEN 'Needs correction before review: ' || decision_reason
      WHEN listing_id IS NULL THEN {_REASONS} WHEN changes = '' THEN 'Matched a persistent Job by ' || matched_by || '; no supported field changed.' ELSE 'Would update persistent Job: ' || changes END AS reason FROM planned)"""
PLAN_CTES = _PLAN_CTES.replace(_ELIGIBLE, "false")
QUALITY = _QUALITY
CLS = ("candidates", "listings", "sources")


def plan(t: Tables):
    prepared = proposals.prepare_candidates(t.candidates)
    return proposals.propose(prepared, t.spread("listings"), t.sources, _decisions(prepared), NOW)


@query(
    "plan_actions",
    f"WITH {PLAN_CTES} SELECT cand_id, action, reason, listing_id, matched_by, candidate_key, snapshot_hash, score / 100.0::DOUBLE AS confidence FROM final",
    CLS,
)
def _(t: Tables):
    return plan(t).select(
        "cand_id", "action", "reason", "listing_id", "matched_by", "candidate_key", "snapshot_hash",
        F.col("confidence").cast("double").alias("confidence"),
    )


@query("action_counts", f"WITH {PLAN_CTES} SELECT action, count(*) AS n FROM final GROUP BY action", CLS)
def _(t: Tables):
    return scoring.action_counts(plan(t))


@query(
    "preview_top",
    f"WITH {PLAN_CTES} SELECT cand_id, action FROM final ORDER BY pos LIMIT 20",
    CLS,
)
def _(t: Tables):
    return proposals.preview(plan(t)).select("cand_id", "action")


@query(
    "source_outcome",
    f"""WITH {PLAN_CTES}, f AS (SELECT DISTINCT source_id FROM run_items WHERE action = 'ERROR' AND error = 'bad page' AND source_id % 10 = 3)
    SELECT s.id AS source_id, count(p.cand_id) AS proposals, CASE WHEN s.id IN (FROM f) THEN 'BLOCKED_OR_FAILED' WHEN bool_or(p.action IN ('WOULD_ADD', 'WOULD_UPDATE', 'DUPLICATE')) THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS outcome
    FROM sources s LEFT JOIN final p ON p.source_id = s.id GROUP BY s.id""",
    CLS + ("run_items",),
)
def _(t: Tables):
    failed = t.run_items.where("action = 'ERROR' AND error = 'bad page' AND source_id % 10 = 3").select("source_id")
    return scoring.source_outcome(plan(t), t.sources, failed)


@query(
    "draft_eligibility",
    f"""WITH {PLAN_CTES} SELECT cand_id, action = 'WOULD_ADD' AND source_id > 0 AS allowed, CASE WHEN action <> 'WOULD_ADD' THEN 'Only WOULD_ADD notices can become new drafts; this item is ' || action || '.'
    WHEN source_id > 0 THEN 'Eligible for an explicit admin-approved DRAFT only.' ELSE 'The review identity is incomplete or invalid.' END AS eligibility FROM final""",
    CLS,
)
def _(t: Tables):
    return scoring.draft_eligibility(plan(t), True).select("cand_id", "allowed", "eligibility")


@query(
    "overlay_decisions",
    f"""WITH {PLAN_CTES} SELECT cand_id, CASE WHEN q0 = 'pass' AND decision IS NOT NULL THEN CASE decision WHEN 'REJECTED' THEN 'REJECTED' ELSE 'LOW_CONFIDENCE' END ELSE {_ACTION.replace('q ', 'q0 ', 1)} END AS action,
    q0 = 'pass' AND decision IS NOT NULL AS decided FROM judged""",
    CLS,
)
def _(t: Tables):
    keyed = proposals.prepare_candidates(t.candidates)
    judged = scoring.classify_quality(scoring.score_confidence(scoring.with_source(keyed, t.sources), NOW), NOW)
    return review.overlay_decisions(judged, _decisions(keyed)).select("cand_id", "action", "decided")


@query(
    "unchanged_sources",
    "SELECT id AS source_id FROM sources WHERE id % 4 IN (1, 3) AND id % 5 <> 0",
    ("sources",),
)
def _(t: Tables):
    collected = t.sources.select(
        F.col("id").alias("source_id"),
        F.when(F.col("id") % 5 == 0, F.lit("changed")).otherwise(F.md5(F.col("id").cast("string"))).alias("content_hash"),
    )
    return proposals.unchanged_sources(collected, t.sources)


@query(
    "bounded_per_source",
    "SELECT cand_id, source_id FROM candidates QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY pos) <= 100",
    ("candidates",),
)
def _(t: Tables):
    return proposals.bounded_per_source(t.candidates, 100).select("cand_id", "source_id")


# --- ledger -----------------------------------------------------------------------------------
@query(
    "latest_decisions",
    """WITH recent AS (SELECT * FROM run_items WHERE action = 'SKIPPED' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, id DESC) <= 10),
    d AS (SELECT source_id, id, created_at, details->>'$.kind' AS kind, details->>'$.candidateKey' AS candidate_key, details->>'$.snapshotHash' AS snapshot_hash, details->>'$.decision' AS decision, details->>'$.reason' AS reason FROM recent)
    SELECT source_id, candidate_key, snapshot_hash, decision, reason, created_at FROM d WHERE kind = 'manual-review-decision' AND decision IN ('REJECTED', 'NEEDS_CORRECTION')
    QUALIFY row_number() OVER (PARTITION BY source_id, candidate_key, snapshot_hash ORDER BY created_at DESC, id DESC) = 1""",
    R,
)
def _(t: Tables):
    return review.latest_decisions(t.run_items, 10)


@query(
    "latest_corrections",
    """WITH recent AS (SELECT *, details->>'$.candidateKey' AS candidate_key, details->>'$.snapshotHash' AS snapshot_hash FROM run_items WHERE action = 'SKIPPED' AND details->>'$.kind' = 'manual-review-correction'
      QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, id DESC) <= 5),
    d AS (SELECT * FROM recent QUALIFY row_number() OVER (PARTITION BY source_id, candidate_key, snapshot_hash ORDER BY created_at DESC, id DESC) = 1)
    SELECT source_id, candidate_key, snapshot_hash, trim(details->>'$.corrections.vacancy') AS vacancy, details->>'$.corrections.salary' AS salary, details->>'$.corrections.location' AS location FROM d
    WHERE details->>'$.corrections.title' IS NULL""",
    R,
)
def _(t: Tables):
    rows = review.latest_corrections(t.run_items, 5)
    value = lambda c: F.try_element_at("corrections", F.lit(c)).alias(c)
    return rows.select("source_id", "candidate_key", "snapshot_hash", value("vacancy"), value("salary"), value("location"))


# Corrections derived from the listings: dates, links and text of each order.
def _submitted():
    return F.create_map(
        F.lit("last_date"),
        F.when(F.col("id") % 4 == 0, "31/02/2026").otherwise(F.date_format("last_date", "dd/MM/yyyy")),
        F.when(F.col("id") % 7 == 3, "title").otherwise("salary"),
        F.concat(F.lit("  "), "salary"),
        F.lit("apply_link"),
        F.when(F.col("id") % 9 == 1, "javascript:x").otherwise(F.col("apply_link")),
    )


@query(
    "validate_corrections",
    """SELECT id, correction_error, CASE WHEN correction_error IS NULL THEN strftime(last_date, '%Y-%m-%d') END AS last_date, CASE WHEN correction_error IS NULL THEN trim(salary) END AS salary,
      CASE WHEN correction_error IS NULL THEN regexp_replace(regexp_replace(apply_link, 'utm_source=x&', ''), '/\\?', '?') END AS apply_link
    FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 'last_date: invalid calendar date.' WHEN id % 7 = 3 THEN 'Unsupported correction field: title'
      WHEN id % 9 = 1 THEN 'apply_link: enter an HTTP or HTTPS URL without credentials.' END AS correction_error FROM listings)""",
    ("listings",),
)
def _(t: Tables):
    checked = review.validate_corrections(t.listings.select("id", _submitted().alias("corrections")))
    value = lambda c: F.try_element_at("corrections", F.lit(c)).alias(c)
    return checked.select("id", "correction_error", value("last_date"), value("salary"), value("apply_link"))


@query(
    "overlay_corrections",
    f"""WITH cleaned AS MATERIALIZED ({k.CLEANED_CANDIDATES}),
    patched AS MATERIALIZED (SELECT * REPLACE (CASE WHEN cand_id % 3 = 0 THEN NULL ELSE salary END AS salary, CASE WHEN cand_id % 3 = 0 THEN '2024-02-01' ELSE last_date END AS last_date) FROM cleaned),
    again AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in k.CLEANED.items())}) FROM patched)
    SELECT cand_id, cand_id % 3 = 0 AS corrected, title, salary, qualification, last_date,
      CASE WHEN cand_id % 3 = 0 AND {k.day('application_start_date')} > '2024-02-01' THEN 'Application start date must not be after the last date.' END AS correction_error FROM again""",
    ("candidates",),
)
def _(t: Tables):
    # Twice-cleaned rows carry their own keys; every third row has a saved patch.
    keyed = _cleaned(t).withColumns(
        {"candidate_key": F.col("cand_id").cast("string"), "snapshot_hash": F.lit("current")}
    )
    patch = keyed.where("cand_id % 3 = 0").select(
        "candidate_key", "snapshot_hash",
        F.create_map(F.lit("salary"), F.lit(None).cast("string"), F.lit("last_date"), F.lit("2024-02-01")).alias("corrections"),
    )
    stale = patch.withColumn("snapshot_hash", F.lit("older"))
    out = review.overlay_corrections(keyed, patch.unionByName(stale))
    return out.select("cand_id", "corrected", "title", "salary", "qualification", "last_date", "correction_error")
