"""Linkage, quotas, snapshots, files and streams; order-dependent jobs against brute force."""

from __future__ import annotations

import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.functions import identity
from gazette.operators import linkage, merge, quota, snapshot
from gazette.plans import proposals
from gazette.sources import files
from gazette.streaming import jobs

NOW = "2026-09-01 00:00:00"


def test_match_priority_and_amendments(spark, candidates, listings):
    held = listings(
        {"id": 7, "title": "Lighthouse Crew Recruitment", "department": "Coast Board", "location": "Delhi", "last_date": datetime(2026, 12, 31), "source_id": 3, "source_job_id": "LH-31", "notification_link": "https://coast.example.in/crew.pdf"},
        {"id": 9, "title": "Senior Glacier Surveyor Posts", "source_id": 4, "location": "Patna"},
    )
    rows = candidates(
        {"title": "Changed title", "source_job_id": "lh-31", "source_id": 3},
        {"title": "Other", "notification_link": "https://www.coast.example.in/crew.pdf?utm_medium=m", "source_id": 3},
        {"title": "Corrigendum: Senior Glacier Surveyor Posts last date extension", "is_corrigendum": True, "source_id": 4},
        {"title": "Nothing", "source_id": 4},
    )
    got = {r["cand_id"]: (r["listing_id"], r["matched_by"]) for r in linkage.match_candidates(rows, held).collect()}
    assert got == {0: (7, "source job ID"), 1: (7, "notification URL"), 2: (9, "corrigendum title/source"), 3: (None, None)}


def test_changed_fields_name_true_changes(spark, candidates, listings):
    held = listings({"id": 44, "title": "Recruitment of Crane Drivers", "last_date": datetime(2026, 10, 10), "source_id": 3, "source_job_id": "CD/6", "notification_link": "https://coast.example.in/cranes.pdf"})
    rows = candidates({"title": "recruitment of crane drivers!", "source_job_id": "CD/6", "source_id": 3, "last_date": "15/10/2026", "notification_link": "https://www.coast.example.in/cranes.pdf#p"})
    row = linkage.with_changes(rows, linkage.match_candidates(rows, held), held).first()
    assert row["changes"] == ["last_date"]


def test_amendment_overlap_reads_past_the_first_postings(spark, candidates, listings, monkeypatch):
    monkeypatch.setattr(linkage, "FIRST_POSTINGS", 2)
    rng = random.Random(5)
    words = [f"word{i}" for i in range(9)]
    titles = [" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(80)]
    held = listings(*[{"id": i, "title": t, "source_id": i % 2} for i, t in enumerate(titles)])
    asked = [" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(60)]
    rows = candidates(*[{"title": t, "is_corrigendum": True, "source_id": i % 2} for i, t in enumerate(asked)])

    def expected(i):
        a = set(asked[i].split())
        for j, t in enumerate(titles):
            b = set(t.split())
            if j % 2 == i % 2 and len(a) >= 2 and len(b) >= 2 and len(a & b) / min(len(a), len(b)) >= 0.6:
                return j
        return None

    got = {r["cand_id"]: r["listing_id"] for r in linkage.amendment_matches(rows, linkage.title_words(held)).collect()}
    assert got == {i: expected(i) for i in range(60) if expected(i) is not None}


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_dedupe_equals_the_ordered_walk(spark, candidates, seed):
    rng = random.Random(seed)
    specs = [{"title": f"t{rng.randint(0, 40)}", "apply_link": f"https://a.in/{rng.randint(0, 12)}" if rng.random() < 0.6 else None,
              "notification_link": f"https://n.in/{rng.randint(0, 12)}" if rng.random() < 0.6 else None, "source_job_id": f"j{rng.randint(0, 15)}" if rng.random() < 0.5 else None} for _ in range(70)]
    keys = lambda s: {("t", s["title"], s["source_job_id"]), ("c", s["title"])} | {(k, s[k]) for k in ("apply_link", "notification_link", "source_job_id") if s[k]}
    held, kept = set(), set()
    for i, s in enumerate(specs):
        if not keys(s) & held:
            kept.add(i)
            held |= keys(s)
    got = linkage.dedupe_batch(candidates(*specs)).collect()
    assert {r["cand_id"] for r in got if r["keep"]} == kept
    assert all(r["duplicate_of"] in kept and r["duplicate_of"] < r["cand_id"] for r in got if not r["keep"])


def test_merge_prefers_first_facts_and_documents(spark, candidates):
    rows = candidates(
        {"title": "Glacier Station invites applications for Field Glaciologist", "source_job_id": "GST/2", "notification_link": "https://g.in/ice", "raw_text": "page"},
        {"title": "ADVERTISEMENT FOR THE POST OF FIELD GLACIOLOGIST", "source_job_id": "gst/2", "qualification": "BE", "notification_link": "https://g.in/ice.pdf", "raw_text": "document text " * 9, "is_corrigendum": True},
    )
    row = merge.merge_notices(rows).collect()
    assert len(row) == 1 and row[0]["notification_link"] == "https://g.in/ice.pdf" and row[0]["qualification"] == "BE"
    assert row[0]["raw_text"].startswith("document") and row[0]["is_corrigendum"] and row[0]["merged"] == 2


def test_sources_of_any_length_hash_by_one_rule(spark):
    c = spark.range(2500).select(F.lit(1).alias("source_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("content_hash"))
    p = spark.createDataFrame([(1, "p"), (2, "q")], "source_id int, content_hash string")
    import hashlib

    h = lambda parts: hashlib.sha256("|".join(parts).encode()).hexdigest()
    got = {r["source_id"]: r["content_hash"] for r in merge.source_content_hash(c, p).collect()}
    assert got == {1: h(["p", *map(str, range(2500))]), 2: h(["q"])}


def _events(spark, seed, n=400):
    rng, at, rows = random.Random(seed), datetime(2026, 1, 1), []
    for i in range(n):
        at += timedelta(milliseconds=rng.choice([0, 1, 50, 900, 4_000]))
        rows.append((i, at, 0 if rng.random() < 0.7 else rng.randint(1, 4)))
    return rows, spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint")


def test_fixed_window_quota_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quota, "CHUNK_WINDOWS", 2)
    rows, df = _events(spark, 3)
    state, want = {}, {}
    for i, at, user in rows:
        start, count = state.get(user, (None, 0))
        if start is None or at >= start + timedelta(seconds=7):
            start, count = at, 1
        else:
            count = min(count + 1, 4)
        state[user] = (start, count)
        left = start + timedelta(seconds=7) - at
        want[i] = (count, count <= 3, 3 - count if count <= 3 else 0, 0 if count <= 3 else max(1, -(-left // timedelta(seconds=1))))
    got = {r["event_id"]: (r["count"], r["allowed"], r["remaining"], r["retry_after_seconds"]) for r in quota.fixed_window_quota(df, "user_id", 3, 7).collect()}
    assert got == want


def test_sliding_quota_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quota, "CHUNK_WINDOWS", 1)
    rows, df = _events(spark, 4)
    taken, want = {}, {}
    for i, at, user in rows:
        alive = [a for a in taken.get(user, []) if at - a < timedelta(seconds=9)]
        want[i] = len(alive) < 4
        taken[user] = alive + [at] * want[i]
    got = {r["event_id"]: r["accepted"] for r in quota.sliding_quota(df, "user_id", 4, 9).collect()}
    assert got == want


def _proposals(candidates, listings, sources, spark):
    held = listings({"id": 1, "title": "Recruitment of Engineers", "source_id": 1, "source_job_id": "ENG/1", "last_date": datetime(2026, 10, 10)})
    none = spark.createDataFrame([], "source_id bigint, candidate_key string, snapshot_hash string, decision string, reason string")
    rows = candidates(
        {"title": "Recruitment of Engineers", "source_job_id": "ENG/1", "salary": "Rs. 100", "last_date": "15/10/2026", "department": "D", "qualification": "Degree", "vacancy": "5", "location": "Delhi", "notification_link": "https://example.gov.in/e.pdf"},
        {"title": "Recruitment of Clerks", "source_job_id": "CL/1", "last_date": "15/10/2026", "department": "D", "qualification": "Degree", "vacancy": "5", "location": "Delhi", "notification_link": "https://example.gov.in/c.pdf"},
        {"title": "Corrigendum: Posts of Tutors", "is_corrigendum": True},
    )
    return held, none, rows


def test_plan_and_upsert_are_idempotent(spark, candidates, listings, sources):
    held, none, rows = _proposals(candidates, listings, sources, spark)
    plan = proposals.plan_actions(rows, held, sources({}), none, NOW)
    got = {r["cand_id"]: r["action"] for r in plan.collect()}
    assert got == {0: "WOULD_UPDATE", 1: "WOULD_ADD", 2: "REJECTED"}
    once = snapshot.upsert(held, plan, NOW, 5)
    row = once.first()
    assert (row["salary"], row["status"], row["featured"], row["review_status"]) == ("Rs. 100", "DRAFT", False, "REVIEW_REQUIRED")
    assert snapshot.upsert(once, plan, NOW, 5).collect() == once.collect()
    added = snapshot.insert_new(plan.where("action = 'WOULD_ADD'"), held, NOW, 5).first()
    assert (added["id"], added["status"], str(added["last_date"])) == (2, "DRAFT", "2026-10-15 23:59:59.999000")


def test_drafts(spark, candidates, listings, sources):
    held, none, rows = _proposals(candidates, listings, sources, spark)
    prepared = proposals.prepare_candidates(rows)
    keys = prepared.select("source_id", "candidate_key", "snapshot_hash", F.create_map().cast("map<string,string>").alias("corrections"))
    outcomes = lambda asked, board, ruled=none: {r["title"]: r["outcome"] for r in proposals.create_drafts(asked, prepared, board, sources({}), ruled, NOW).collect()}
    made = proposals.create_drafts(keys, prepared, held, sources({}), none, NOW)
    rows = proposals.draft_rows(made, held, NOW, 9)
    row = rows.first()
    assert (row["id"], row["title"], row["status"], row["review_status"], row["published_at"]) == (2, "Recruitment of Clerks", "DRAFT", "MANUAL_VERIFIED", None)
    log = {r["candidate_title"]: (r["action"], r["job_id"]) for r in proposals.draft_items(made, rows, "r").collect()}
    assert log == {"Recruitment of Clerks": ("ADDED", 2), "Recruitment of Engineers": ("SKIPPED", 1)}
    first = outcomes(keys, held)
    assert first["Recruitment of Clerks"] == "DRAFT_CREATED" and first["Recruitment of Engineers"] == "WOULD_UPDATE"
    assert first["Corrigendum: Posts of Tutors"] == "NOT_ELIGIBLE"
    assert set(outcomes(keys.withColumn("snapshot_hash", F.lit("0" * 64)), held).values()) == {"STALE"}
    rejected = keys.select("source_id", "candidate_key", "snapshot_hash", F.lit("REJECTED").alias("decision"), F.lit("no").alias("reason"))
    assert outcomes(keys, held, rejected)["Recruitment of Clerks"] == "REVIEW_REQUIRED"
    board = held.unionByName(listings({"id": 2, "title": "Recruitment of Clerks", "source_id": 1, "source_job_id": "cl/1"}))
    assert outcomes(keys, board)["Recruitment of Clerks"] == "WOULD_UPDATE"


def test_files_round_trip(spark, listings):
    folder = tempfile.mkdtemp(prefix="gazette-test-")
    rows = listings(*[{"id": i, "title": f'=say "{i}"', "created_at": datetime(2026, 1, 1 + i), "updated_at": datetime(2026, 1, 1), "last_date": datetime(2026, 2, 1)} for i in range(5)])
    files.export_csv(rows, f"{folder}/csv")
    import glob

    text = "".join(open(p, newline="", encoding="utf-8").read() for p in sorted(glob.glob(f"{folder}/csv/part-*")))
    lines = text.split("\r\n")
    assert lines[0].startswith('﻿"ID","Job Title"') and lines[1].startswith('"4","\'=say ""4"""') and '"2026-02-01"' in lines[1]
    files.export_json(rows, f"{folder}/json")
    back = files.read_backup(spark, f"{folder}/json")
    assert [r["id"] for r in back.orderBy("seq").collect()] == list(range(5))
    files.write_snapshot(rows, f"{folder}/snap", 3)
    assert files.read_snapshot(spark, f"{folder}/snap", 3).count() == 5


def test_streaming_counters_and_quota(spark):
    folder = tempfile.mkdtemp(prefix="gazette-test-")
    rows, df = _events(spark, 9, 60)
    df.coalesce(1).write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/events")
    q = jobs.stream_quota(stream, "user_id", 3, 7).writeStream.format("memory").queryName("quota_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = {r["event_id"]: (r["count"], r["allowed"]) for r in quota.fixed_window_quota(df, "user_id", 3, 7).collect()}
    assert {r["event_id"]: (r["count"], r["allowed"]) for r in spark.table("quota_out").collect()} == batch
    items = stream.select(F.col("ts").alias("created_at"), F.col("user_id").alias("source_id"), F.lit("ADDED").alias("action"))
    q = jobs.stream_run_counters(items).writeStream.format("memory").queryName("counters").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.table("counters").collect()) == 60


def test_streamed_alerts_send_each_pair_once(spark, listings):
    folder = tempfile.mkdtemp(prefix="gazette-test-")
    rows = listings({"id": 1, "title": "clerk", "created_at": datetime(2044, 1, 5)}, {"id": 2, "title": "tutor", "created_at": datetime(2044, 1, 5)}, {"id": 3, "title": "clerk"})
    rows.coalesce(1).write.parquet(f"{folder}/l")
    rows.where("id = 1").coalesce(1).write.mode("append").parquet(f"{folder}/l")
    prefs = spark.createDataFrame([(5, ["clerk"], [], [], None, True, datetime(2026, 1, 1)), (6, ["tutor"], [], [], None, True, None)],
                                  "id bigint, keywords array<string>, categories array<string>, locations array<string>, qualification string, active boolean, verified_at timestamp_ntz")
    # A day no listing of the stream is of holds what no reader could read.
    os.makedirs(f"{folder}/sent/day=2043-01-01/batch=7")
    with open(f"{folder}/sent/day=2043-01-01/batch=7/part-0.parquet", "w") as f:
        f.write("not parquet")

    def run(check):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/l")
        jobs.stream_alerts(stream, lambda: prefs, f"{folder}/sent", f"{folder}/{check}").trigger(availableNow=True).start().awaitTermination()
        days = [f"{folder}/sent/day={d}" for d in ("2044-01-05", "1970-01-01")]
        return sorted(tuple(r) for r in spark.read.option("basePath", f"{folder}/sent").parquet(*days).select("pref_id", "listing_id").collect())

    assert run("check") == [(5, 1), (5, 3)]
    # The whole stream again, under the batch numbers it had.
    assert run("again") == [(5, 1), (5, 3)]


def test_long_terms_have_few_candidates(spark, monkeypatch):
    from gazette.operators import alerts

    kept = {}
    monkeypatch.setattr(alerts, "written", lambda df, name: kept.setdefault(name, df.localCheckpoint()))
    names = [f"customer#{i:09d}" for i in range(400)]
    texts = spark.createDataFrame([(i, f"clerks for {n} wanted") for i, n in enumerate(names)] + [(-1, "x" * 50 + "yz" + "x" * 50)], "text_id bigint, text string")
    terms = [*names, "k", "fo", "cle", "clerk", "xyz", "x" * 30 + "yz" + "x" * 30, "customer#00000000", "nothing", "customer#0000000000", ""]
    found = {(r["term"], r["text_id"]) for r in alerts.occurrences(spark.createDataFrame([(t,) for t in terms], "term string"), texts).collect()}
    assert found == {(t, r["text_id"]) for r in texts.collect() for t in terms if t and t in r["text"]}
    # The grams of three characters took some hundred rows per text.
    assert kept["gram-places"].where("text_id = 123").count() <= 12


def test_alerts_join_no_rule_with_what_it_does_not_fit(spark, listings, monkeypatch):
    from gazette.operators import alerts

    kept = {}
    monkeypatch.setattr(alerts, "written", lambda df, name: kept.setdefault(f"{name}-{len(kept)}", df.localCheckpoint()))
    board = listings(*[{"id": i, "title": "Clerks wanted", "department": "", "qualification": "", "location": f"town{i % 10}x"} for i in range(60)])
    schema = "id bigint, keywords array<string>, categories array<string>, locations array<string>, qualification string, active boolean"
    rows = [(i, ["clerks", f"name{i}", "wanted"], None, [f"town{i % 10}"], None, True) for i in range(40)] + [(90, ["Clerks"], None, None, "", True), (91, ["clerks"], None, None, "low", True), (None, [], [], ["town3"], None, True), (92, [""], None, None, None, False)]
    prefs = spark.createDataFrame(rows + [rows[0]], schema)
    matches = alerts.match_alerts(board, prefs)
    want = [(r[0], i) for r in rows + [rows[0]] if r[5] and r[4] != "low" for i in range(60) if not r[3] or r[3][0] == f"town{i % 10}"]
    assert sorted(map(tuple, matches.collect()), key=lambda r: (r[0] or -1, r[1])) == sorted(want, key=lambda r: (r[0] or -1, r[1]))
    wanted = next(df for name, df in kept.items() if name.startswith("alert-wanted"))
    assert wanted.count() == 40 * 2 + 10
    twice = alerts.match_alerts(board.unionAll(board.where("id = 3").withColumn("title", F.lit("k"))), prefs.where("id = 90").withColumn("keywords", F.array(F.lit("k"))))
    assert sorted(r["listing_id"] for r in twice.collect()) == sorted([*range(60), 3])
    # A repeated preference has its matches and totals as often as it is listed; one without a match has an empty row.
    digest = alerts.alert_digest(matches, prefs).collect()
    assert sum(r["pref_id"] == 0 and r["matches"] == 12 for r in digest) == 24
    assert [tuple(r) for r in digest if r["pref_id"] in (None, 91, 92)] and all(r["matches"] == 0 and r["listing_id"] is None for r in digest if r["pref_id"] in (None, 91, 92))


def test_backups_are_not_sorted_again(spark):
    from pyspark.sql.types import StringType

    folder = tempfile.mkdtemp(prefix="gazette-test-")
    spark.range(5000).select("id", F.concat(F.lit("t"), F.col("id").cast(StringType())).alias("title")).repartitionByRange(7, "id").sortWithinPartitions("id").write.json(f"{folder}/json")
    rows = files.read_backup(spark, f"{folder}/json")
    assert "Exchange rangepartitioning" not in rows._jdf.queryExecution().toString()
    assert sorted((r["seq"], r["id"]) for r in rows.collect()) == [(i, i) for i in range(5000)]


def test_compressed_backups_read_alike(spark, listings):
    folder = tempfile.mkdtemp(prefix="gazette-test-")
    rows = listings(*[{"id": i, "title": f"t{i}", "last_date": datetime(2026, 2, 1)} for i in range(300)])
    files.export_json(rows, f"{folder}/plain")
    files.export_json(rows, f"{folder}/small", "gzip")
    plain, small = (sorted(map(str, files.read_backup(spark, f"{folder}/{d}").collect())) for d in ("plain", "small"))
    assert plain == small and len(plain) == 300


def test_wide_views_grow_by_tasks(spark, monkeypatch):
    from cases import views

    folder = tempfile.mkdtemp(prefix="gazette-test-")
    spark.range(1).select(F.lit(1).cast("bigint").alias("page_id"), F.lit("u").alias("url"), F.lit("h").alias("html")).write.parquet(f"{folder}/one/pages.parquet")
    spark.range(900).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("h").alias("html")).write.parquet(f"{folder}/many/pages.parquet")
    monkeypatch.setattr(views, "ROWS_PER_TASK", 100)
    tasks = lambda d: views.view(spark, f"{folder}/{d}", "pages_in").rdd.getNumPartitions()
    assert (tasks("one"), tasks("many")) == (4, 9)


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_numbers_are_dense_in_order(spark):
    from gazette.scale import in_order, number_rows

    df = spark.range(3000).select((F.col("id") * F.lit(1 << 40)).alias("pos"), (F.col("id") % 3).alias("k")).repartition(7)
    assert sorted((r["pos"] >> 40, r["n"]) for r in number_rows(df, [], "pos").collect()) == [(i, i) for i in range(3000)]
    assert all(r["n"] == (r["pos"] >> 40) // 3 for r in number_rows(df, ["k"], "pos").collect())
    far = spark.createDataFrame([(2**40, 3), (2**40, 1), (5, 9)], "page_id bigint, place int")
    assert [r["place"] for r in in_order(far, ["page_id", "place"], "pos").orderBy("pos").collect()] == [9, 1, 3]


def test_run_accounting(spark):
    from gazette.operators import runs

    at = datetime(2026, 1, 1)
    rows = [(1, "r", 1, "ERROR", None, None), (2, "r", 2, "ERROR", "Clerk", None), (3, "r", 2, "SKIPPED", "Tutor", None), (4, "s", 1, "ADDED", "Pilot", None),
            (5, "s", None, "SKIPPED", None, '{"kind":"metrics","processed":9,"skipped":4,"expired":2,"candidates":11}')]
    items = spark.createDataFrame([(i, r, s, a, t, d, at + timedelta(minutes=i)) for i, r, s, a, t, d in rows],
                                  "id bigint, run_id string, source_id bigint, action string, candidate_title string, details string, created_at timestamp_ntz")
    got = {r["run_id"]: r for r in runs.run_summary(items).collect()}
    assert (got["r"]["sources_failed"], got["r"]["sources_succeeded"], got["r"]["errors"], got["r"]["skipped"]) == (1, 1, 2, 1)
    assert (got["s"]["processed"], got["s"]["skipped"], got["s"]["expired"], got["s"]["candidates"]) == (9, 4, 2, 11)
    health = {r["source_id"]: r["consecutive_failures"] for r in runs.source_health(items).collect()}
    assert health[2] == 0 and health[1] == 0
    assert runs.recent_runs(spark.createDataFrame([("r", at), ("s", at + timedelta(1))], "run_id string, started_at timestamp_ntz"), items, 1, 9).count() == 2


def test_changes_move_the_time_of_update(spark, listings):
    before = datetime(2026, 1, 1)
    rows = listings({"id": 1, "last_date": datetime(2026, 2, 1), "updated_at": before}, {"id": 2, "last_date": datetime(2027, 2, 1), "updated_at": before})
    moved = lambda df: {r["id"]: r["updated_at"] > before for r in df.collect()}
    assert moved(snapshot.expire(rows, NOW)) == {1: True, 2: False}
    seen = spark.createDataFrame([(2, "DUPLICATE")], "listing_id bigint, action string")
    assert moved(snapshot.touch_duplicates(rows, seen, NOW, 1)) == {1: False, 2: True}


def test_only_stored_hashes_are_indexed(spark, candidates, listings):
    facts = {"title": "Recruitment of Pilots", "department": "Harbour", "location": "Quay", "last_date": datetime(2031, 4, 19)}
    held = listings({"id": 1, **facts, "source_job_id": "HB/8"}, {"id": 2, **facts, "source_job_id": "HB/9"})
    row = candidates({**facts, "last_date": "19/04/2031", "source_job_id": "HB/8", "source_id": 77})
    assert [(r["listing_id"], r["matched_by"]) for r in linkage.match_candidates(row, held).collect()] == [(2, "title/department/location/date")]
    stored = held.withColumn("source_hash", F.when(F.col("id") == 1, identity.fingerprint(F.col("title"), F.col("department"), F.col("location"), F.lit("2031-04-19"), F.col("source_job_id"))))
    assert [(r["listing_id"], r["matched_by"]) for r in linkage.match_candidates(row, stored).collect()] == [(1, "source fingerprint")]


def test_backups_of_several_files_keep_their_order(spark):
    folder = tempfile.mkdtemp(prefix="gazette-test-")
    for name, ids in (("a.json", range(3)), ("b.json", range(3, 400)), ("c.json", range(400, 402))):
        with open(f"{folder}/{name}", "w") as f:
            f.write("".join(f'{{"id": {i}, "title": "t{i}"}}\n' for i in ids) + ("not json\n" if name == "a.json" else ""))
    rows = files.read_backup(spark, folder).orderBy("seq").collect()
    assert [r["id"] for r in rows if r["id"] is not None] == list(range(402))
    assert rows[3]["_broken"] == "not json"


def test_pages_stream_into_snapshots(spark, listings, sources):
    folder = tempfile.mkdtemp(prefix="gazette-test-")
    row = '<table><tr><td>Advt. No. MU-{1}/44</td><td><a href="/f/{1}.pdf">Engagement of {0} in the museum</a></td><td>Closing date: 19-04-2044</td></tr></table>'
    pages = spark.createDataFrame([(2**40 + i, 1, "https://example.gov.in/jobs", row.format(n, i)) for i, n in enumerate(["Guides", "Archivists"])], "page_id bigint, source_id bigint, url string, html string")
    for n in range(2):
        pages.where(F.col("page_id") == 2**40 + n).coalesce(1).write.mode("append").parquet(f"{folder}/pages")
    files.write_snapshot(listings({"id": 1, "title": "Recruitment of Wardens"}), f"{folder}/snap", 0)
    none = spark.createDataFrame([], "source_id bigint, candidate_key string, snapshot_hash string, decision string, reason string")
    newest = {"n": 0}

    def store(df, number):
        files.write_snapshot(df, f"{folder}/snap", number + 1)
        newest["n"] = number + 1

    load = lambda: files.read_snapshot(spark, f"{folder}/snap", newest["n"])
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/pages")
    q = jobs.stream_ingest(stream, load, store, sources({}), none, lambda: NOW, f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    titles = [r["title"] for r in load().collect()]
    assert newest["n"] == 2 and len(titles) == 3 and sorted(t.split()[-1] for t in titles)[0] == "Wardens"
    assert [sum(word in t for t in titles) for word in ("Guides", "Archivists")] == [1, 1]


def test_long_chains_are_settled_in_few_rounds(spark, candidates, monkeypatch):
    # Every row shares a link with the next one: in batch order every second stays.
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("cand_id"), ((F.col("id") * 7) % n).alias("pos"), F.concat(F.lit("https://m.example/"), F.col("id")).alias("apply_link"))
    rows = candidates({"source_id": None}).drop("cand_id", "pos", "apply_link").crossJoin(rows).withColumn("title", F.concat(F.lit("t"), "cand_id"))
    chain = rows.withColumn("notification_link", F.concat(F.lit("https://m.example/n"), F.floor((F.col("cand_id") + 1) / 2)))
    chain = chain.withColumn("apply_link", F.concat(F.lit("https://m.example/a"), F.floor(F.col("cand_id") / 2)))
    tables = []
    monkeypatch.setattr(linkage, "written", lambda df, name, held=linkage.written: (tables.append(name), held(df, name))[1])
    held = {(r.cand_id, r.keep) for r in linkage.dedupe_batch(chain).select("cand_id", "keep").collect()}
    assert len(tables) < 10
    taken, want = set(), set()
    for i in sorted(range(n), key=lambda i: i * 7 % n):
        keys = {("a", i // 2), ("n", (i + 1) // 2)}
        want.add((i, not keys & taken))
        taken |= keys if not keys & taken else set()
    assert held == want
    small = chain.where("cand_id < 60")
    by_rounds = {r.cand_id for r in linkage.batch_keepers(small, group_keys=1).collect()}
    assert by_rounds == {r.cand_id for r in linkage.batch_keepers(small).collect()}


def test_rows_of_a_batch_meet_its_new_listings(spark, listings, sources):
    card = '<table><tr><td>{number}</td><td><a href="/f/{file}.pdf">{title}</a></td><td>Closing date: {last}</td></tr></table>'
    cards = [
        {"title": "Engagement of Museum Guides for the North Wing", "number": "Advt. No. MU-1/44", "last": "19-04-2044", "file": 1},
        # The same document without its number, with a later date.
        {"title": "Engagement of Museum Guides for the North Wing", "number": "", "last": "25-04-2044", "file": 1},
        # An amendment of a notice that comes after it, the notice, and an amendment that follows its notice.
        {"title": "Corrigendum: Engagement of Paper Archivists in the Tower", "number": "Advt. No. MU-8/44", "last": "30-05-2044", "file": 8},
        {"title": "Engagement of Paper Archivists in the Tower", "number": "Advt. No. MU-2/44", "last": "19-05-2044", "file": 2},
        {"title": "Corrigendum: Engagement of Museum Guides for the North Wing", "number": "Advt. No. MU-9/44", "last": "30-04-2044", "file": 9},
    ]
    pages = spark.createDataFrame([(i, 1, "https://example.gov.in/jobs", card.format(**c)) for i, c in enumerate(cards)], "page_id bigint, source_id bigint, url string, html string")
    none = spark.createDataFrame([], "source_id bigint, candidate_key string, snapshot_hash string, decision string, reason string")
    held = listings({"id": 1, "title": "Recruitment of Wardens"})
    result = lambda rows: sorted((r["id"], r["last_date"] and str(r["last_date"].date()), (r["notification_link"] or "")[-5:]) for r in rows.collect())
    got = result(jobs.ingest_pages(pages, held, sources({}), none, NOW, 7))
    assert got == [(1, None, ""), (2, "2044-04-30", "9.pdf"), (3, "2044-05-19", "2.pdf")]
