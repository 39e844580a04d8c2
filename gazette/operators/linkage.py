"""Record linkage: candidates against the listings already held, and against each other.

Exact keys of all kinds travel in one long table `(kind, key, id)`; each key
keeps one listing (the last in read order), so joining candidates to it never
multiplies rows and a hot key only skews the candidate side, which AQE splits.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gazette import vocabulary as V
from gazette.functions.dates import day, parsed_day
from gazette.functions.identity import composite, fingerprint, significant_tokens
from gazette.functions.text import blank_to_null, clean, clean_or_null, fold, present
from gazette.functions.urls import canonical_url
from gazette.operators.graph import connected
from gazette.scale import written

# Position in the cascade; 2 is the amendment title overlap.
BY_ID, BY_AMENDMENT, BY_APPLY, BY_NOTICE, BY_HASH, BY_FACTS = 1, 2, 3, 4, 5, 6
_UNMATCHED = 99
#: The facts of a candidate that any of the keys is made of.
MATCHED_ON = ["source_id", "source_job_id", "title", "department", "location", "last_date", "apply_link", "notification_link", "is_corrigendum"]
FIRST_POSTINGS = 64


def _keys(df: DataFrame, row_id: str, deadline_day: Column, stored: bool, only: int | None = None) -> DataFrame:
    """(kind, key, id) of every usable key of every row, or of one kind; null and empty keys are left out."""
    apply_url, notice_url = canonical_url("apply_link"), canonical_url("notification_link")
    if stored and "canonical_apply_url" in df.columns:
        apply_url = F.coalesce(blank_to_null("canonical_apply_url"), apply_url)
        notice_url = F.coalesce(blank_to_null("canonical_notice_url"), notice_url)
    facts = df.select(
        F.col(row_id).alias("id"),
        F.when(
            F.col("source_id").isNotNull() & present("source_job_id"),
            F.concat_ws("|", F.col("source_id").cast("string"), fold("source_job_id")),
        ).alias("by_id"),
        apply_url.alias("by_apply"),
        notice_url.alias("by_notice"),
        composite("title", "department", "location", deadline_day).alias("by_facts"),
        fold("source_job_id").alias("job"),
        (blank_to_null("source_hash") if "source_hash" in df.columns else F.lit(None).cast("string")).alias("hash"),
    )
    # Held rows answer to the hash they were stored with, and to none if they have none.
    hashed = F.col("hash") if stored else F.sha2(F.concat_ws("|", "by_facts", "job"), 256)
    kinds = [(BY_ID, F.col("by_id")), (BY_APPLY, F.col("by_apply")), (BY_NOTICE, F.col("by_notice")),
             (BY_HASH, hashed), (BY_FACTS, F.col("by_facts"))]
    # Columns of kinds that nobody asked for are never computed.
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds if only in (None, k)])
    return facts.select("id", F.inline(rows)).where(F.col("key").isNotNull())


def listing_keys(listings: DataFrame, only: int | None = None) -> DataFrame:
    return _keys(listings, "id", day("last_date"), stored=True, only=only)


def candidate_keys(candidates: DataFrame, only: int | None = None) -> DataFrame:
    return _keys(candidates, "cand_id", parsed_day("last_date"), stored=False, only=only).withColumnRenamed("id", "cand_id")


def last_wins_index(df: DataFrame, key: list[str], order: str = "id") -> DataFrame:
    """The last row id per key."""
    return df.groupBy(*key).agg(F.max(order).alias(order))


# --- amendment titles -----------------------------------------------------------------
def title_words(df: DataFrame, row_id: str = "id") -> DataFrame:
    """(source_id, tokens, id): the significant title words of every row that has a source and two of them."""
    rows = df.where(F.col("source_id").isNotNull())
    words = rows.select("source_id", F.array_sort(significant_tokens("title")).alias("tokens"), F.col(row_id).alias("id"))
    return words.where(F.size("tokens") >= 2)


def _collapsed(words: DataFrame) -> DataFrame:
    """Distinct (source, title words) with the smallest id carrying them."""
    return words.groupBy("source_id", "tokens").agg(F.min("id").alias("id"))


def _postings(sets: DataFrame, rarity: DataFrame) -> DataFrame:
    """Prefix-filter postings of each token set.

    Two sets of smaller size m that share at least t = ceil(0.6 m) words share
    one of the first |set| - t + 1 words of either, words ordered by rarity.
    Postings are therefore keyed by (source, m, word).
    """
    size = F.size("tokens")
    required = F.ceil(F.col("m") * V.CORRIGENDUM_OVERLAP_PERCENT / 100)
    ranked = (
        sets.select("source_id", "tokens", "id", F.explode("tokens").alias("word"))
        .join(rarity, ["source_id", "word"], "left")
        .groupBy("source_id", "tokens", "id")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("ranked"))
    )
    return (
        ranked.select("*", F.explode(F.sequence(F.lit(2), size)).alias("m"))
        .select("source_id", "tokens", "id", "m", F.slice("ranked", F.lit(1), (size - required + 1).cast("int")).alias("prefix"))
        .select("source_id", "tokens", "id", "m", F.explode("prefix.word").alias("word"))
    )


def amendment_matches(candidates: DataFrame, titles: DataFrame) -> DataFrame:
    """(cand_id, listing_id): the first listing of the source whose title words overlap enough.

    `titles` are the `title_words` of the listings, of other sources as well.
    Copies of a title are collapsed before the join.  Each posting list is read
    up to its first `FIRST_POSTINGS` ids; only candidates that could still find
    an earlier listing beyond that go on to the rest of the lists.
    """
    amendments = candidates.where(F.col("is_corrigendum"))
    sources = amendments.select("source_id").distinct()
    left = _collapsed(title_words(amendments, "cand_id"))
    # Compact intermediates that several branches read are computed once.
    right = written(_collapsed(titles.join(sources, "source_id", "left_semi")), "title-words")
    words = right.select("source_id", F.explode("tokens").alias("word"))
    rarity = words.groupBy("source_id", "word").agg(F.count(F.lit(1)).alias("n"))
    key = ["source_id", "m", "word"]
    wanted = written(_postings(left, rarity).select(*key, F.col("tokens").alias("a")), "title-wanted")
    held = written(
        _postings(right, rarity).select(*key, F.col("tokens").alias("b"), F.col("id").alias("listing_id")), "title-held"
    )

    first = held.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy("listing_id"))).where(
        F.col("rn") <= FIRST_POSTINGS
    )
    truncated = first.groupBy(*key).agg(F.max("rn").alias("n"), F.max("listing_id").alias("seen")).where(
        F.col("n") == FIRST_POSTINGS
    )
    smaller = F.least(F.size("a"), F.size("b"))
    overlaps = (F.col("m") == smaller) & (
        F.size(F.array_intersect("a", "b")) * 100 >= smaller * V.CORRIGENDUM_OVERLAP_PERCENT
    )

    def found(pairs: DataFrame) -> DataFrame:
        return pairs.where(overlaps).groupBy("source_id", "a").agg(F.min("listing_id").alias("listing_id"))

    early = found(wanted.join(first.drop("rn"), key))
    horizon = wanted.join(truncated, key).groupBy("source_id", "a").agg(F.min("seen").alias("seen"))
    state = horizon.join(early, ["source_id", "a"], "left")
    undecided = state.where(F.col("listing_id").isNull() | (F.col("listing_id") > F.col("seen"))).select("source_id", "a")
    rest = held.join(truncated, key).where(F.col("listing_id") > F.col("seen")).select(*held.columns)
    late = found(wanted.join(undecided, ["source_id", "a"], "left_semi").join(rest, key))
    best = early.unionByName(late).groupBy("source_id", "a").agg(F.min("listing_id").alias("listing_id"))
    return (
        amendments.select("cand_id", "source_id", F.array_sort(significant_tokens("title")).alias("a"))
        .join(best, ["source_id", "a"])
        .select("cand_id", "listing_id")
    )


# --- the cascade --------------------------------------------------------------------------
def _first_hit(hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per candidate: its hit of the highest priority, or nulls."""
    nothing = candidates.select("cand_id", F.lit(_UNMATCHED).alias("kind"), F.lit(None).cast("bigint").alias("listing_id"))
    names = F.create_map(*[F.lit(x) for i, n in enumerate(V.MATCH_KINDS, 1) for x in (i, n)])
    return (
        hits.select("cand_id", "kind", F.col("listing_id").cast("bigint").alias("listing_id"))
        .unionByName(nothing)
        .groupBy("cand_id")
        .agg(F.min(F.struct("kind", "listing_id")).alias("hit"))
        .select("cand_id", "hit.listing_id", F.try_element_at(names, F.col("hit.kind")).alias("matched_by"))
    )


def match_candidates(candidates: DataFrame, listings: DataFrame) -> DataFrame:
    """(cand_id, listing_id, matched_by) for every candidate; unmatched rows carry nulls."""
    return match_with(candidates, candidate_keys(candidates), listing_keys(listings), title_words(listings))


def match_with(candidates: DataFrame, wanted: DataFrame, keys: DataFrame, titles: DataFrame) -> DataFrame:
    """`match_candidates` over the keys of the candidates, and the keys and title words of the listings."""
    index = last_wins_index(keys, ["kind", "key"]).withColumnRenamed("id", "listing_id")
    exact = wanted.join(index, ["kind", "key"]).select("cand_id", "kind", "listing_id")
    overlap = amendment_matches(candidates, titles).withColumn("kind", F.lit(BY_AMENDMENT))
    return _first_hit(exact.unionByName(overlap), candidates)


def match_by(candidates: DataFrame, listings: DataFrame, kind: int) -> DataFrame:
    """Matches of a single key kind."""
    if kind == BY_AMENDMENT:
        return amendment_matches(candidates, title_words(listings))
    index = last_wins_index(listing_keys(listings, kind), ["key"])
    keys = candidate_keys(candidates, kind)
    return keys.join(index, "key").select("cand_id", F.col("id").alias("listing_id"))


def prefilter(listings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Listings that could match any candidate: a semi join on one long key table."""
    raw_or_canonical = lambda link: F.array_distinct(F.array(canonical_url(link), blank_to_null(link)))
    tag = lambda kind, c: F.when(c.isNotNull(), F.concat(F.lit(kind), c))
    same_id = F.when(
        F.col("source_id").isNotNull(), F.concat_ws("|", F.col("source_id").cast("string"), clean_or_null("source_job_id"))
    )
    source = F.col("source_id").cast("string")
    known = listings.select(
        "id",
        F.explode(
            F.array_compact(
                F.concat(
                    F.array(
                        F.when(present("source_job_id"), tag("i", same_id)),
                        tag("c", source),
                        tag("h", blank_to_null("source_hash")),
                        tag("t", F.col("title")),
                    ),
                    F.transform(raw_or_canonical("apply_link"), lambda u: tag("a", u)),
                    F.transform(raw_or_canonical("notification_link"), lambda u: tag("n", u)),
                )
            )
        ).alias("key"),
    )
    wanted = candidates.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(present("source_job_id"), tag("i", same_id)),
                    F.when(F.col("is_corrigendum"), tag("c", source)),
                    tag("h", fingerprint("title", "department", "location", parsed_day("last_date"), "source_job_id")),
                    tag("t", F.trim("title")),
                    tag("a", canonical_url("apply_link")),
                    tag("n", canonical_url("notification_link")),
                )
            )
        ).alias("key")
    ).distinct()
    hits = known.join(wanted, "key", "left_semi").select("id").distinct()
    return listings.join(hits, "id", "left_semi")


# --- change detection ------------------------------------------------------------------------
def changed_fields() -> Column:
    """Names of the fields where a candidate value is present and differs from `old.<field>`."""

    def changed(field: str) -> Column:
        new, old = field, f"old.{field}"
        if field in ("last_date", "application_start_date"):
            differs = ~parsed_day(new).eqNullSafe(day(old))
        elif field.endswith("_link") or field == "official_website":
            differs = ~canonical_url(new).eqNullSafe(canonical_url(old))
        else:
            differs = fold(new) != fold(old)
        if field not in ("last_date", "application_start_date"):
            # Equal texts fold to equal texts; most fields of a known notice are.
            differs = ~F.col(new).eqNullSafe(F.col(old)) & differs
        return F.when(present(new) & differs, F.lit(field))

    return F.array_compact(F.array(*[changed(f) for f in V.COMPARABLE_FIELDS]))


def with_changes(candidates: DataFrame, matches: DataFrame, listings: DataFrame) -> DataFrame:
    """Matched candidates with `listing_id`, `matched_by` and their `changes`."""
    old = listings.select(F.col("id").alias("listing_id"), F.struct(*V.COMPARABLE_FIELDS).alias("old"))
    return (
        candidates.join(matches.where(F.col("listing_id").isNotNull()), "cand_id")
        .join(old, "listing_id")
        .withColumn("changes", changed_fields())
        .drop("old")
    )


# --- duplicates inside one batch ----------------------------------------------------------------
#: Keys of a connected group of rows that one task walks in batch order; larger groups are settled by rounds.
GROUP_KEYS = 200_000


def _walked(group: pa.Table) -> pa.Table:
    """The rows of one connected group that a walk in batch order keeps."""
    group = group.sort_by("pos")
    rows: dict[int, list[int]] = {}
    for row, key in zip(group.column("cand_id").to_pylist(), group.column("node").to_pylist(), strict=True):
        rows.setdefault(row, []).append(key)
    taken: set[int] = set()
    kept = []
    for row, keys in rows.items():
        if taken.isdisjoint(keys):
            kept.append(row)
            taken.update(keys)
    return pa.table({"cand_id": pa.array(kept, pa.int64())})


def batch_keepers(candidates: DataFrame, order: str = "pos", group_keys: int = GROUP_KEYS) -> DataFrame:
    """(cand_id) of the rows a sequential run would insert.

    A row is a duplicate when it shares any key with an earlier *kept* row.
    Rows that share keys, directly or over others, form groups: a group of one
    row is kept, one of at most `group_keys` keys is walked in batch order by one
    task, whatever its chains, and only larger ones are settled by rounds.
    """
    ranks = candidates.select(F.col("cand_id").cast("bigint").alias("cand_id"), F.col(order).cast("bigint").alias("pos"))
    keys = candidate_keys(candidates).select(F.col("cand_id").cast("bigint").alias("cand_id"), "kind", "key").distinct()
    shared = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("cand_id").alias("first")).where("n > 1")
    # Only keys of several rows tie anything; such a key is known by its first row, so rows of it meet that one.
    tied = written(keys.join(shared, ["kind", "key"]).join(ranks, "cand_id").withColumn("node", F.xxhash64("kind", "key")), "batch-keys")
    groups = connected(tied.select(F.col("cand_id").alias("a"), F.col("first").alias("b")))
    grouped = written(tied.join(groups.withColumnsRenamed({"node": "cand_id"}), "cand_id").drop("n", "first"), "batch-groups")
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    alone = keys.select("cand_id").distinct().join(grouped.select("cand_id").distinct(), "cand_id", "left_anti")
    small = grouped.join(sizes.where(F.col("n") <= group_keys).select("root"), "root", "left_semi")
    kept = alone.unionAll(written(small.select("root", "cand_id", "pos", "node").groupBy("root").applyInArrow(_walked, "cand_id bigint"), "batch-keepers"))
    large = grouped.join(sizes.where(F.col("n") > group_keys).select("root"), "root", "left_semi")
    return kept if large.isEmpty() else kept.unionAll(_kept_by_rounds(large))


def _kept_by_rounds(keys: DataFrame) -> DataFrame:
    """The kept rows of (cand_id, pos, kind, key).

    Each round keeps the rows that come first on all their keys among the rows
    still in play, drops the rows sharing a key with them, and repeats on the
    shrinking rest.  Keys are combined by `min`, so a hot key costs one row per
    map task.
    """
    open_rows = written(keys.select("cand_id", "pos", "kind", "key"), "batch-keys")
    kept = None
    while True:
        first = open_rows.groupBy("kind", "key").agg(F.min("pos").alias("first"))
        keepers = (
            open_rows.join(first, ["kind", "key"])
            .groupBy("cand_id")
            .agg(F.bool_and(F.col("pos") == F.col("first")).alias("keep"))
            .where("keep")
            .select("cand_id")
        )
        keepers = written(keepers, "batch-keepers")
        kept = keepers if kept is None else kept.unionByName(keepers)
        taken = open_rows.join(keepers, "cand_id", "left_semi").select("kind", "key").distinct()
        gone = open_rows.join(taken, ["kind", "key"], "left_semi").select("cand_id").distinct()
        open_rows = written(open_rows.join(gone, "cand_id", "left_anti"), "batch-keys")
        if open_rows.isEmpty():
            return kept


def dedupe_batch(candidates: DataFrame, order: str = "pos") -> DataFrame:
    """(cand_id, keep, duplicate_of, matched_by) of the insertable rows of one batch."""
    kept = batch_keepers(candidates, order)
    ranks = candidates.select("cand_id", F.col(order).alias("pos"))
    held = (
        candidate_keys(candidates.join(kept, "cand_id", "left_semi"))
        .withColumnRenamed("cand_id", "listing_id")
    )
    hits = (
        candidate_keys(candidates.join(kept, "cand_id", "left_anti"))
        .join(held, ["kind", "key"])
        .join(ranks, "cand_id")
        .join(ranks.withColumnsRenamed({"cand_id": "listing_id", "pos": "held_pos"}), "listing_id")
        .where(F.col("held_pos") < F.col("pos"))
        .select("cand_id", "kind", "listing_id")
    )
    return _first_hit(hits, candidates).select(
        "cand_id", F.col("listing_id").isNull().alias("keep"), F.col("listing_id").alias("duplicate_of"), "matched_by"
    )


def match_earlier(candidates: DataFrame, batch: DataFrame, added: DataFrame, order: str = "pos") -> DataFrame:
    """(cand_id, listing_id, matched_by) of the candidates that match a new listing of their batch from before them.

    `added` holds the new listings (ids in batch order) with the `cand_id` of the
    row of `batch` each was made from; no two share a key.
    """
    made = added.select(F.col("cand_id").alias("from"), F.col("id").alias("listing_id"))
    ranks = batch.select("cand_id", F.col(order).alias("pos"))
    keys = candidate_keys(batch.join(added.select("cand_id"), "cand_id", "left_semi")).withColumnRenamed("cand_id", "from")
    exact = candidate_keys(candidates).join(keys.join(made, "from"), ["kind", "key"]).select("cand_id", "kind", "listing_id")
    # The first overlapping title is the earliest: if it comes too late, so do the others.
    overlap = amendment_matches(candidates, title_words(added)).withColumn("kind", F.lit(BY_AMENDMENT)).select("cand_id", "kind", "listing_id")
    places = made.join(ranks.withColumnsRenamed({"cand_id": "from", "pos": "held_pos"}), "from").drop("from")
    hits = exact.unionByName(overlap).join(ranks, "cand_id").join(places, "listing_id").where(F.col("held_pos") < F.col("pos"))
    return _first_hit(hits, candidates).where(F.col("listing_id").isNotNull())
