"""Candidates to proposed actions: cleaning, scoring, matching, gating, change detection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from gazette import vocabulary as V
from gazette.operators import linkage, normalize, review, scoring, snapshot
from gazette.operators.cleaning import clean_notice_fields
from gazette.scale import once, written


def unchanged_sources(collected: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id) whose collected content hash equals the stored one."""
    stored = sources.select(F.col("id").alias("source_id"), F.col("last_content_hash").alias("content_hash"))
    return collected.join(stored, ["source_id", "content_hash"]).select("source_id").distinct()


def prepare_candidates(candidates: DataFrame) -> DataFrame:
    """Cleaned candidates with content hash, identity, review key and snapshot hash.

    Written once: matching, scoring and the review overlays all read the result.
    """
    cleaned = normalize.with_content_hash(clean_notice_fields(candidates))
    return written(normalize.notice_identity(cleaned), "candidates")


def _named_sources(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources that stored candidates name.

    Where they are few, the join sends them to the candidates; a whole registry would deal out the wide rows by their few, hot sources.
    """
    named = candidates.select(F.col("source_id").alias("id")).distinct()
    return written(sources.join(named, "id", "left_semi"), "named-sources")


def propose(
    prepared: DataFrame,
    listings: DataFrame,
    sources: DataFrame,
    decisions: DataFrame,
    now: datetime | str,
    minimum: str = V.MIN_DRAFT_CONFIDENCE,
    threshold: str = V.HIGH_CONFIDENCE,
    auto_publish: bool = False,
    matches: DataFrame | None = None,
) -> DataFrame:
    """Every prepared candidate with `action`, `reason`, match and changes.

    With `matches` (of `match_candidates`) `listings` need only hold the matched ones.
    Actions: WOULD_ADD, WOULD_UPDATE, DUPLICATE, REJECTED, EXPIRED, LOW_CONFIDENCE.
    """
    scored = scoring.score_confidence(scoring.with_source(prepared, _named_sources(prepared, sources)), now, threshold, auto_publish)
    judged = scoring.classify_quality(scored, now, minimum)
    if matches is None:
        matches = written(linkage.match_candidates(prepared, listings), "matches")
    matched = judged.join(_matched_facts(prepared, matches, listings, decisions), "cand_id")
    orphan = F.col("is_corrigendum") & F.col("listing_id").isNull()
    gated = matched.withColumns(
        {
            "action": F.when(orphan, "REJECTED").otherwise(F.col("action")),
            "reason": F.when(orphan, V.QUALITY_REASONS["amendment"]).otherwise(F.col("reason")),
        }
    )
    decided = review.overlay_decisions(gated, decisions)
    return _compared(decided)


def _old_facts(listings: DataFrame) -> DataFrame:
    return listings.select(F.col("id").alias("listing_id"), F.struct(*V.COMPARABLE_FIELDS).alias("old"))


def _matched_facts(prepared: DataFrame, matches: DataFrame, listings: DataFrame, decisions: DataFrame) -> DataFrame:
    """(cand_id, listing_id, matched_by, old, recorded): all that a candidate meets, so that its wide row is moved once.

    Unmatched candidates stay out of the join with the listings, where they would all share one null key.
    """
    old = _old_facts(listings)
    found = matches.where(F.col("listing_id").isNotNull()).join(old, "listing_id", "left").select("cand_id", "listing_id", "matched_by", "old")
    alone = matches.where(F.col("listing_id").isNull()).select("cand_id", "listing_id", "matched_by", F.lit(None).cast(old.schema["old"].dataType).alias("old"))
    return found.unionAll(alone).join(review.recorded(prepared, decisions), "cand_id", "left")


def _compared(decided: DataFrame) -> DataFrame:
    """Adds `changes` against the `old` facts; passing candidates that match a listing become updates or duplicates of it."""
    # A filter on the action must not compare the fields a second time.
    compared = once(decided, changes=F.when(F.col("listing_id").isNotNull(), linkage.changed_fields()))
    passing = F.col("action") == "WOULD_ADD"
    found, same = F.col("listing_id").isNotNull(), F.size("changes") == 0
    reason = (
        F.when(
            passing & found & same,
            F.concat(F.lit("Matched a persistent Job by "), "matched_by", F.lit("; no supported field changed.")),
        )
        .when(passing & found, F.concat(F.lit("Would update persistent Job: "), F.array_join("changes", ", ")))
        .when(passing, F.array_join("reasons", "; "))
        .otherwise(F.col("reason"))
    )
    action = (
        F.when(passing & found & same, "DUPLICATE").when(passing & found, "WOULD_UPDATE").otherwise(F.col("action"))
    )
    return compared.withColumns({"action": action, "reason": reason}).drop("old")


def settle_batch(planned: DataFrame, added: DataFrame, decisions: DataFrame, now: datetime | str, minimum: str = V.MIN_DRAFT_CONFIDENCE) -> DataFrame:
    """The proposals that are not in `added`, the new listings of the batch with their `cand_id`, matched with these too.

    A row matches a new listing that comes before it in the batch, amendments by
    their title as well, and keeps its held listing unless the new one answers to
    a stronger key.  Quality and decisions hold as for any matched row.
    """
    # Only these can change: quality or a decision turned the others away whatever they match.
    orphan = F.col("is_corrigendum") & F.col("listing_id").isNull()
    rows = planned.join(added.select("cand_id"), "cand_id", "left_anti")
    open_rows = rows.where(orphan | F.col("action").isin("WOULD_ADD", "WOULD_UPDATE", "DUPLICATE"))
    found = linkage.match_earlier(open_rows, planned, added).withColumnsRenamed({"listing_id": "_new", "matched_by": "_by"})
    strength = lambda c: F.coalesce(F.nullif(F.array_position(F.lit(V.MATCH_KINDS), F.col(c)), F.lit(0)), F.lit(99))
    joined = written(rows.join(found, "cand_id", "left").withColumn("_moves", strength("_by") < strength("matched_by")), "batch-matches")
    moved = joined.where("_moves").withColumns({"listing_id": F.col("_new"), "matched_by": F.col("_by")})
    judged = scoring.classify_quality(moved.drop("_new", "_by", "_moves", "decided", "changes"), now, minimum)
    again = _compared(review.overlay_decisions(judged, decisions).join(_old_facts(added), "listing_id", "left"))
    return joined.where(~F.col("_moves")).drop("_new", "_by", "_moves").unionByName(again)


def plan_actions(
    candidates: DataFrame,
    listings: DataFrame,
    sources: DataFrame,
    decisions: DataFrame,
    now: datetime | str,
    collected: DataFrame | None = None,
    **settings,
) -> DataFrame:
    """Raw candidates to proposals; sources whose content did not change are skipped first."""
    if collected is not None:
        candidates = candidates.join(unchanged_sources(collected, sources), "source_id", "left_anti")
    return propose(prepare_candidates(candidates), listings, sources, decisions, now, **settings)


def preview(proposals: DataFrame, n: int = 20, order: str = "pos") -> DataFrame:
    """The first `n` proposals of a run."""
    return proposals.orderBy(order).limit(n)


def bounded_per_source(candidates: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The first `n` candidates of each source (a page or source quota)."""
    rank = F.row_number().over(W.partitionBy("source_id").orderBy(order))
    return candidates.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def create_drafts(
    requests: DataFrame,
    prepared: DataFrame,
    listings: DataFrame,
    sources: DataFrame,
    decisions: DataFrame,
    now: datetime | str,
    enabled: bool = True,
    minimum: str = V.MIN_DRAFT_CONFIDENCE,
) -> DataFrame:
    """Outcome of every draft request: (source_id, candidate_key, snapshot_hash, corrections).

    The snapshot must be current, not rejected, eligible and unmatched; both the
    original and the corrected facts are matched, so a repeated request reports
    the draft it already made.
    """
    identity = ["source_id", "candidate_key"]
    # One row per review item: the first exact snapshot, else the first stale one.
    asked = requests.withColumnRenamed("snapshot_hash", "asked_hash")
    pairs = prepared.join(asked, identity)
    rank = F.struct(F.col("snapshot_hash") != F.col("asked_hash"), F.col("pos"))
    columns = [c for c in pairs.columns if c not in (*identity, "asked_hash")]
    current = (
        pairs.groupBy(*identity, "asked_hash")
        .agg(F.min_by(F.struct(*columns), rank).alias("row"))
        .select(*identity, "asked_hash", "row.*")
    )
    current = written(current, "draft-requests")
    stale = current.where(F.col("snapshot_hash") != F.col("asked_hash"))
    live = current.where(F.col("snapshot_hash") == F.col("asked_hash")).drop("asked_hash")
    facts = F.struct(*linkage.MATCHED_ON)
    patch = live.where(F.size("corrections") > 0).select(
        "candidate_key", "snapshot_hash", "corrections"
    ).dropDuplicates(["candidate_key", "snapshot_hash"])
    again = review.overlay_corrections(live.drop("corrections").withColumn("_facts", facts), patch)
    corrected = written(again.withColumn("_moved", ~facts.eqNullSafe(F.col("_facts"))).drop("_facts"), "draft-corrected")
    judged = scoring.classify_quality(
        scoring.score_confidence(scoring.with_source(corrected.drop("_moved"), _named_sources(corrected, sources)), now), now, minimum
    )
    # Both states of a row meet the listings in one pass; a corrected one that is matched on the same facts finds the same.
    state = lambda rows, n: rows.select(F.struct(F.lit(n).alias("state"), "cand_id").alias("cand_id"), *linkage.MATCHED_ON)
    hits = linkage.match_candidates(state(live, 0).unionAll(state(corrected.where("_moved"), 1)), listings)
    hit = F.min(F.when(F.col("listing_id").isNotNull(), F.struct("cand_id.state", "listing_id", "matched_by"))).alias("hit")
    matches = written(hits.groupBy("cand_id.cand_id").agg(hit).select("cand_id", "hit.listing_id", "hit.matched_by"), "draft-matches")
    matched = judged.join(_matched_facts(corrected, matches, listings, decisions), "cand_id")
    full = (
        review.with_decision(scoring.draft_eligibility(matched, enabled))
        .withColumns({"decision": F.col("_decision.decision"), "changes": F.when(F.col("listing_id").isNotNull(), linkage.changed_fields())})
        .drop("_decision")
    )
    blocked = (F.col("decision") == "REJECTED") | ((F.col("decision") == "NEEDS_CORRECTION") & ~F.col("corrected"))
    orphan = F.col("is_corrigendum") & F.col("listing_id").isNull()
    outcome = (
        F.when(F.col("correction_error").isNotNull(), "INVALID_CORRECTION")
        .when(F.coalesce(blocked, F.lit(False)), "REVIEW_REQUIRED")
        .when(orphan | ~F.col("allowed"), "NOT_ELIGIBLE")
        .when(F.col("listing_id").isNotNull() & (F.size("changes") > 0), "WOULD_UPDATE")
        .when(F.col("listing_id").isNotNull(), "DUPLICATE")
        .otherwise("DRAFT_CREATED")
    )
    done = full.withColumn("outcome", outcome).drop("old")
    return done.unionByName(
        stale.drop("asked_hash", "corrections").withColumn("outcome", F.lit("STALE")), allowMissingColumns=True
    )


def draft_rows(outcomes: DataFrame, listings: DataFrame, now: datetime | str, run_id: int) -> DataFrame:
    """The listing rows of the requests that `create_drafts` granted, with their `cand_id`.

    They are drafts verified by hand and never published, numbered on from the
    largest held id in the order of the candidates.
    """
    granted = outcomes.where(F.col("outcome") == "DRAFT_CREATED").withColumn("eligible", F.lit(False))
    rows = snapshot.insert_new(granted, listings, now, run_id)
    return rows.withColumns({"status": F.lit("DRAFT"), "review_status": F.lit("MANUAL_VERIFIED")})


def draft_items(outcomes: DataFrame, rows: DataFrame, run_id: str) -> DataFrame:
    """One log row per decided request: ADDED for a new draft, SKIPPED for a pending update, DUPLICATE for a known notice."""
    made = rows.select("cand_id", F.col("id").alias("draft_id"))
    action = (
        F.when(F.col("outcome") == "DRAFT_CREATED", "ADDED").when(F.col("outcome") == "WOULD_UPDATE", "SKIPPED")
        .when(F.col("outcome") == "DUPLICATE", "DUPLICATE")
    )
    logged = outcomes.withColumn("action", action).where(F.col("action").isNotNull()).join(made, "cand_id", "left")
    return logged.select(
        F.lit(run_id).alias("run_id"), "source_id", F.col("source.name").alias("source_name"), F.col("title").alias("candidate_title"), "action",
        F.coalesce("draft_id", "listing_id").alias("job_id"), F.col("outcome").alias("kind"),
    )
