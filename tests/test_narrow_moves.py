"""Wide rows are moved and made no more often than the job needs."""

from __future__ import annotations

import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from gazette.functions.text import fold
from gazette.operators import linkage, review, snapshot
from gazette.plans import proposals, write_run as w
from gazette.sources.store import Store

NOW = "2026-07-01 12:00:00"
DECISION = "source_id bigint, candidate_key string, snapshot_hash string, decision string, reason string"


def spied(monkeypatch, module) -> dict:
    seen, plain = {}, module.written

    def keep(df, name):
        out = plain(df, name)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(module, "written", keep)
    return seen


def test_drafts_meet_the_listings_once(spark, candidates, listings, sources, monkeypatch):
    asked, plain = [], linkage.match_candidates
    monkeypatch.setattr(linkage, "match_candidates", lambda c, held: asked.append(c.count()) or plain(c, held))
    facts = {"last_date": "15/10/2026", "department": "D", "qualification": "Degree", "vacancy": "5", "location": "Delhi"}
    prepared = proposals.prepare_candidates(candidates(
        {"title": "Recruitment of Weavers", "source_job_id": "WV/1", **facts}, {"title": "Recruitment of Dyers", **facts, "notification_link": "https://example.gov.in/d.pdf"},
    ))
    fixed = F.when(F.col("pos") == 1, F.create_map(F.lit("last_date"), F.lit("2026-11-20"))).otherwise(F.create_map().cast("map<string,string>"))
    requests = prepared.select("source_id", "candidate_key", "snapshot_hash", fixed.alias("corrections"))
    held = listings({"id": 8, "title": "Recruitment of Dyers", "department": "D", "location": "Delhi", "last_date": datetime(2026, 11, 20), "source_id": 1},
                    {"id": 9, "title": "Recruitment of Weavers", "source_id": 1, "source_job_id": "wv/1"})
    out = proposals.create_drafts(requests, prepared, held, sources({}), spark.createDataFrame([], DECISION), NOW)
    got = {r["cand_id"]: (r["listing_id"], r["matched_by"]) for r in out.collect()}
    # The second is found by its corrected date only; the first is asked for once, its facts are as they were.
    assert got == {0: (9, "source job ID"), 1: (8, got[1][1])} and got[1][1] is not None
    assert asked == [3]


def test_sources_nobody_names_are_not_joined(spark, candidates, listings, sources, monkeypatch):
    seen = spied(monkeypatch, proposals)
    prepared = proposals.prepare_candidates(candidates({"title": "Recruitment of Potters"}, {"title": "Recruitment of Masons", "source_id": 3}))
    plan = proposals.propose(prepared, listings(), sources({}, {"id": 2}, {"id": 3}), spark.createDataFrame([], DECISION), NOW)
    assert sorted(r["source_id"] for r in plan.collect()) == [1, 3]
    assert sorted(r["id"] for r in seen["named-sources"][0].collect()) == [1, 3]


def test_recorded_decisions_are_those_of_the_join(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", "x", "WOULD_ADD", "r"), (1, 1, "b", "x", "WOULD_ADD", "r"), (2, 1, "a", "x", "EXPIRED", "r"), (3, None, "a", "x", "WOULD_ADD", "r"), (4, 2, "a", "x", "WOULD_ADD", "r")],
        "cand_id bigint, source_id bigint, candidate_key string, snapshot_hash string, action string, reason string")
    ruled = spark.createDataFrame([(1, "a", "x", "REJECTED", "one"), (1, "a", "x", "REJECTED", "one"), (1, "b", "x", "NEEDS_CORRECTION", "two"), (None, "a", "x", "REJECTED", "none")], DECISION)
    lists = review.recorded(rows, ruled)
    assert lists.columns == ["cand_id", "recorded"]
    plain, narrow = review.overlay_decisions(rows, ruled), review.overlay_decisions(rows.join(lists, "cand_id", "left"), ruled)
    columns = sorted(plain.columns)
    assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, narrow.select(columns).collect()))


def test_new_listings_are_made_before_they_are_numbered(spark, monkeypatch):
    seen, places = spied(monkeypatch, snapshot), []
    monkeypatch.setattr(snapshot, "number_rows", lambda df, keys, order, plain=snapshot.number_rows: places.append(df.columns) or plain(df, keys, order))
    text = ["title", "source_job_id", "source_url", "content_hash", "raw_text", "application_start_date", "last_date", "posted_date", "apply_link", "notification_link", "official_website", *snapshot.V.TEXT_FACTS]
    rows = spark.range(3).select(
        F.col("id").alias("cand_id"), (F.lit(9) - F.col("id")).alias("pos"), F.lit(1).cast("bigint").alias("source_id"), F.lit(False).alias("eligible"), F.lit("0.70").cast("decimal(3,2)").alias("confidence"),
        F.struct(F.lit("s").alias("name"), F.lit("c").alias("category"), F.lit("https://e.example").alias("start_url")).alias("source"), *[F.lit("word").alias(c) for c in dict.fromkeys(text)])
    out = snapshot.insert_new(rows, spark.range(5), NOW, 1)
    assert {r["cand_id"]: r["id"] for r in out.collect()} == {2: 5, 1: 6, 0: 7}
    assert len(seen["unnumbered"]) == 1 and "raw_text" not in places[0]


def test_only_changed_listings_are_indexed_again(spark, listings, sources, monkeypatch):
    rows = [{"id": i, "title": f"Engagement of guides group {i}", "source_id": 1, "source_job_id": f"MU-{i}", "apply_link": f"https://m.example/{i}", "created_at": datetime(2044, 1, 1)} for i in range(12)]
    store = Store(spark, tempfile.mkdtemp(prefix="gazette-test-"))
    w.open_store(store, listings(*rows, rows[3]), sources({}), 10, 4)
    seen = spied(monkeypatch, w)
    moved = F.when(F.col("id") == 5, F.lit("https://new.example/5")).otherwise(F.col("apply_link"))
    w.change_listings(store, 2, spark.range(12).select("id"), lambda x: x.withColumn("apply_link", moved).withColumn("featured", F.lit(True)).where("id <> 7"), 10, 4)
    assert {r["id"] for x in seen["index-before"] for r in x.collect()} == {5, 7} and {r["id"] for x in seen["index-after"] for r in x.collect()} == {5}
    held, keys = store.read("listings"), store.read("match_keys").select("kind", "key", "id")
    made = linkage.listing_keys(held).select("kind", "key", "id")
    assert not keys.exceptAll(made).collect() and not made.exceptAll(keys).collect()


def test_an_expression_over_a_name_is_built_once(spark):
    assert fold("title") is fold("title") and fold("title") is not fold("department")
