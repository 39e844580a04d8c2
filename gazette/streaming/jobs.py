"""Incremental forms of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gazette.operators import alerts, extract, linkage, merge, snapshot
from gazette.plans import proposals
from gazette.plans.collect import collect
from gazette.plans.write_run import write_run
from gazette.scale import exists, in_order, job_folder, written
from gazette.sources.store import Store


def ingest_pages(pages: DataFrame, listings: DataFrame, sources: DataFrame, decisions: DataFrame, now: datetime | str, run_id: int) -> DataFrame:
    """The next listing snapshot after one batch of crawled (page_id, source_id, url, html) pages.

    Rows of the batch that match a listing made from an earlier row of it, amendments
    included, are folded into that listing.
    """
    records = merge.with_candidate_columns(
        merge.ordered_union(extract.extract_jsonld(pages), extract.anchor_candidates(pages))
    )
    ordered = in_order(records.withColumnRenamed("pos", "place"), ["page_id", "place"], "pos").drop("place")
    notices = extract.drop_result_only(merge.merge_notices(ordered)).withColumn("cand_id", F.col("pos"))
    planned = written(
        proposals.plan_actions(notices.drop("identity", "content_hash", "merged"), listings, sources, decisions, now), "proposals"
    )
    fresh = planned.where(F.col("action") == "WOULD_ADD")
    keep = linkage.dedupe_batch(fresh).where("keep").select("cand_id")
    added = written(snapshot.insert_new(fresh.join(keep, "cand_id", "left_semi"), listings, now, run_id), "added")
    settled = proposals.settle_batch(planned, added, decisions, now)
    held = snapshot.with_automation_columns(listings).unionByName(added.drop("cand_id"), allowMissingColumns=True)
    return snapshot.upsert(held, settled, now, run_id)


def stream_ingest(
    pages: DataFrame,
    load: Callable[[], DataFrame],
    store: Callable[[DataFrame, int], None],
    sources: DataFrame,
    decisions: DataFrame,
    clock: Callable[[], datetime | str],
    checkpoint: str,
) -> DataStreamWriter:
    """Page stream to listing snapshots: `load` reads the current one, `store(df, batch)` writes the next.

    `store` must overwrite the same batch number, so a replayed batch is harmless.
    """

    def batch(df: DataFrame, number: int) -> None:
        with job_folder(df.sparkSession):
            store(ingest_pages(written(df, "pages"), load(), sources, decisions, clock(), number), number)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_runs(
    pages: DataFrame, path: str, documents: Callable[[], DataFrame], payloads: Callable[[], DataFrame], decisions: Callable[[], DataFrame],
    clock: Callable[[], datetime | str], checkpoint: str, first_run: int = 2, **settings,
) -> DataStreamWriter:
    """Page stream to versions of a store: every micro-batch is one write run over the sources it has pages of.

    A batch writes the parts it touched, the log of the run and one commit file;
    batch n is run `first_run` + n, so a replay of a batch changes nothing. The
    texts of documents and the payloads known by then complete its notices.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        with job_folder(spark):
            store, now = Store(spark, path), clock()
            if first_run + number <= store.run:
                return
            candidates, collected = collect(store.read("sources"), written(df, "pages"), documents(), payloads(), now)
            # A source without a page in this batch was not checked, it did not fail.
            seen = written(collected.where(F.col("error").isNull()), "collected")
            write_run(store, candidates.drop("adapter"), seen, decisions(), now, first_run + number, **settings)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_alerts(listings: DataFrame, preferences: Callable[[], DataFrame], sent_path: str, checkpoint: str) -> DataStreamWriter:
    """New listings to (pref_id, listing_id) deliveries, each pair once.

    Only verified subscriptions are served.  What was sent lies by the day of the
    listing and by batch: a batch reads the days of its own listings only, and
    writes its pairs over what the same batch wrote before, so a replay sends
    nothing twice and old days are never read.
    """

    def batch(df: DataFrame, number: int) -> None:
        with job_folder(df.sparkSession):
            send(df, number)

    def send(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        prefs = preferences().where(F.col("verified_at").isNotNull())
        fresh = written(df, "new-listings")
        day = F.coalesce(F.to_date("created_at"), F.lit("1970-01-01").cast("date")).alias("day")
        dated = fresh.groupBy(F.col("id").alias("listing_id")).agg(F.min(day).alias("day"))
        pairs = alerts.match_alerts(fresh.dropDuplicates(["id"]), prefs).join(dated, "listing_id")
        days = [r.day for r in dated.select("day").distinct().collect()]
        held = [f"{sent_path.rstrip('/')}/day={d}" for d in days]
        held = [f for f in held if exists(spark, f)]
        if held:
            schema = "pref_id {}, listing_id {}, day date, batch bigint".format(*[pairs.schema[c].dataType.simpleString() for c in ("pref_id", "listing_id")])
            sent = spark.read.schema(schema).option("basePath", sent_path).parquet(*held).where(F.col("batch") != number)
            pairs = pairs.join(sent, ["day", "pref_id", "listing_id"], "left_anti")
        numbered = pairs.select("pref_id", "listing_id", "day", F.lit(number).cast("bigint").alias("batch"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(sent_path)

    return listings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_quota(events: DataFrame, key: str, limit: int, window_seconds: int, at: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Quota decision per event of a stream; the state of a key is its open window and count."""
    window_ms = window_seconds * 1_000
    kind = events.schema[key].dataType.simpleString()

    def decide(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        expiry, count = state.get if state.exists else (0, 0)
        out = []
        for event_id, ms in zip(rows["event_id"], rows["ms"]):
            if count == 0 or expiry <= ms:
                expiry, count = int(ms) + window_ms, 1
            else:
                count = min(count + 1, limit + 1)
            allowed = count <= limit
            wait = 0 if allowed else max(1, -(-(expiry - int(ms)) // 1_000))
            out.append((event_id, group[0], count, allowed, limit - count if allowed else 0, wait))
        state.update((expiry, count))
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "key", "count", "allowed", "remaining", "retry_after_seconds"])

    timed = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", lateness)
    prepared = timed.select("event_id", F.col(key).alias("key"), "at", F.unix_millis("at").alias("ms"))
    return prepared.groupBy("key").applyInPandasWithState(
        decide,
        f"event_id bigint, key {kind}, count bigint, allowed boolean, remaining bigint, retry_after_seconds bigint",
        "expiry bigint, count bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def stream_run_counters(run_items: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Items per day, source and action; late items count until the watermark passes their day."""
    return (
        run_items.withColumn("at", F.col("created_at").cast("timestamp"))
        .withWatermark("at", lateness)
        .groupBy(F.window("at", "1 day").alias("day"), "source_id", "action")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("day.start").alias("day"), "source_id", "action", "n")
    )
