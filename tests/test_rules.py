"""Classification, cleaning, corrections, visibility and alert rules: one rule a case."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gazette.operators import alerts, cleaning, listing, normalize, review, scoring, stats, validate

NOW = "2026-09-01 00:00:00"


def test_a_listing_shows_until_either_date_has_passed(spark, listings):
    now = datetime(2044, 6, 1, 9)
    dates = [None, now, datetime(2044, 6, 1, 8, 59), datetime(2044, 7, 1), datetime(2044, 6, 5)]
    rows = [{"id": 10 * i + j, "last_date": a, "expires_at": b} for i, a in enumerate(dates) for j, b in enumerate(dates)]
    table = listings(*rows, {"id": 100, "status": "ARCHIVED"}, {"id": 101, "status": "DRAFT", "last_date": dates[3]})
    passed = lambda d: d is not None and d < now
    shown = {r["id"] for r in rows if not passed(r["last_date"]) and not passed(r["expires_at"])}
    assert {r["id"] for r in listing.active(table, "2044-06-01 09:00:00").collect()} == shown
    # The older rule knows one date: the later one counts only where the first is missing.
    assert 12 in {r["id"] for r in listing.visible_legacy(table, "2044-06-01 09:00:00").collect()}
    soon = {r["id"] for r in listing.closing_soon(table, "2044-06-01 09:00:00").collect()}
    assert soon <= shown and 43 in soon and 33 not in soon


def test_page_counts(spark, listings):
    assert listing.page_info(listings().where("false"), 1).first()["page_count"] == 1
    rows = listings(*[{"id": i, "created_at": datetime(2026, 1, 1)} for i in range(25)])
    info = listing.page_info(rows, 999_999).first()
    assert (info["page_count"], info["page"], info["first_result"], info["last_result"]) == (3, 3, 25, 25)
    assert [r["id"] for r in listing.page(rows, 50).collect()] == [0]


def test_public_columns_hide_automation(spark, listings):
    hidden = {"source_hash", "raw_source_reference", "automation_confidence", "automation_run_id", "review_status"}
    assert not hidden & set(listing.project_public(listings({"id": 1})).columns)


def test_readiness_needs_active_content(spark, listings, sources):
    runs = spark.createDataFrame([("r", "COMPLETED", datetime(2000, 1, 1))], "run_id string, status string, started_at timestamp_ntz")
    old = listings({"id": 1, "last_date": datetime(2000, 1, 1)})
    checks = {r["key"]: r for r in stats.readiness(sources({}), old, runs, NOW).collect()}
    assert not checks["content"]["ready"] and not checks["content"]["passed"] and not checks["recent-run"]["passed"]
    live = listings({"id": 1, "last_date": datetime(2099, 1, 1)})
    assert all(r["ready"] for r in stats.readiness(sources({}), live, runs, NOW).collect())


CLEANED = [
    # A field starts at its education term, ends where the next section does, and needs one.
    ("qualification", "Experience of years. Degree in conservation of paper How to apply by post", "Degree in conservation of paper"),
    ("qualification", "good eyesight and patience", None), ("qualification", "Diploma in the making of paper 2. Pay follows", "Diploma in the making of paper"),
    # Counts, words for counts, and a lone one only with the text behind it.
    ("vacancy", "25", "25"), ("vacancy", "Various", "Various"), ("vacancy", "25 posts", None), ("vacancy", "01", None),
    # A salary has an amount and is no row of a table.
    ("salary", "of Rs. 900 a month, paid late Age limit 50", "Rs. 900 a month, paid late"), ("salary", "as per rules", None), ("salary", "Rs. 3) Guide", None), ("salary", "₹ 5,000 a month, paid late b. Leave applies", "₹ 5,000 a month, paid late"),
    # An age has a number and doesn't end on an open reference.
    ("age_limit", "18 to 30 years Nationality any", "18 to 30 years"), ("age_limit", "not more than 30 years as on", None), ("age_limit", "as per rules", None),
    ("application_fee", "Rs 50", "Rs 50"), ("application_fee", "ask at the desk", None),
    ("department", "Search here Our Team", None), ("department", "Board of Archives", "Board of Archives"),
    ("location", "N/A", None), ("location", "Hill Fort", "Hill Fort"),
    ("selection_process", "Days to come. Selection process: written test in the museum Appendix A", "written test in the museum"), ("selection_process", "How to apply: by post. Selection by interview", None),
]


@pytest.mark.parametrize("field", sorted({f for f, _, _ in CLEANED}))
def test_cleaning_of_a_field(spark, candidates, field):
    cases = [(t, w) for f, t, w in CLEANED if f == field]
    got = cleaning.clean_notice_fields(candidates(*[{"title": "Guides", field: t} for t, _ in cases])).orderBy("cand_id").collect()
    assert [r[field] for r in got] == [w for _, w in cases]


def test_cleaning_infers_from_title_and_text(spark, candidates):
    got = cleaning.clean_notice_fields(candidates(
        {"title": "ARC-7 - guides for Mysore and Pune", "vacancy": "1", "raw_text": "No. of vacancies: 1"}, {"title": "POST, guides", "location": "na", "vacancy": "1", "raw_text": "Vacancies 11"},
    )).orderBy("cand_id").collect()
    assert [(r["department"], r["location"], r["vacancy"]) for r in got] == [("ARC-7", "Mysuru", "1"), (None, None, None)]


def _classified(candidates, confidence: str, **row):
    rows = candidates({"title": "Appointment of archivists", "source_job_id": "A-3", "last_date": "01/02/2044", **row})
    return scoring.classify_quality(rows.withColumn("confidence", F.lit(confidence).cast("decimal(3,2)")), NOW).first()


def test_quality_gate(spark, candidates):
    # The first rule that fails gives the reason, in this order.
    broken = {"title": "Museum", "salary": "ï¿½", "last_date": "01/01/2020", "source_job_id": None, "raw_text": "short"}
    steps = [
        ({}, "LOW_CONFIDENCE"), ({"title": "Appointment of archivists: result"}, "LOW_CONFIDENCE"), ({"salary": None}, "EXPIRED"),
        ({"last_date": None}, "REJECTED"), ({"title": "Appointment of archivists"}, "LOW_CONFIDENCE"), ({"source_job_id": "A"}, "LOW_CONFIDENCE"), ({"raw_text": "t" * 40}, "WOULD_ADD"),
    ]
    reasons = []
    for change, action in steps:
        broken |= change
        row = _classified(candidates, "0.75", **broken)
        reasons.append(row["reason"])
        assert row["action"] == action, change
    assert len({*reasons}) == len(steps)
    low, enough = _classified(candidates, "0.599"[:4]), _classified(candidates, "0.60")
    assert (low["action"], enough["action"]) == ("LOW_CONFIDENCE", "WOULD_ADD") and "59%" in low["reason"]


SCORED = [
    ({}, "0.10"), ({"department": "D"}, "0.18"), ({"qualification": "Q", "vacancy": "2", "salary": "S"}, "0.30"), ({"location": "L", "age_limit": "A", "selection_process": "S", "how_to_apply": "H"}, "0.23"),
    ({"source_job_id": "A-3"}, "0.19"), ({"raw_text": "t" * 500}, "0.15"), ({"apply_link": "https://m.example/a"}, "0.22"), ({"apply_link": "nowhere"}, "0.10"), ({"notification_link": "https://m.example/n"}, "0.22"),
    ({"last_date": "01/02/2044"}, "0.26"), ({"last_date": "01/02/2004"}, "0.10"),
]


def test_what_each_fact_adds_to_the_score(spark, candidates, sources):
    rows = normalize.with_content_hash(candidates(*[{"title": "Guides", "raw_text": "text"} | r for r, _ in SCORED]))
    got = scoring.score_confidence(scoring.with_source(rows, sources({"trusted": False})), NOW).orderBy("cand_id").collect()
    assert [str(r["confidence"]) for r in got] == [w for _, w in SCORED] and not any(r["eligible"] for r in got)


def test_draft_gate(spark):
    good = (7, "0" * 64, "f" * 64, "WOULD_ADD")
    rows = [good, (0, *good[1:]), (7, "0" * 63, *good[2:]), (7, good[1], "F" * 64, good[3]), (*good[:3], "DUPLICATE"), (None, *good[1:])]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, source_id int, candidate_key string, snapshot_hash string, action string")
    assert [r["allowed"] for r in scoring.draft_eligibility(table, True).orderBy("i").collect()] == [True, False, False, False, False, False]
    assert scoring.draft_eligibility(table, False).where("allowed").count() == 0


CORRECTIONS = [
    ('{"age_limit": "  40 years "}', {"age_limit": "40 years"}), ('{"age_limit": "  "}', {"age_limit": None}), ('{"age_limit": null, "vacancy": "2"}', {"age_limit": None, "vacancy": "2"}),
    ('{"last_date": "2044-02-29"}', {"last_date": "2044-02-29"}), ('{"last_date": "29/02/2044"}', {"last_date": "2044-02-29"}), ('{"last_date": "29/02/2043"}', None), ('{"last_date": "1.2.2044"}', None),
    ('{"official_website": "HTTP://M.Example/?gclid=1&z=2&a=1#k"}', {"official_website": "http://m.example/?z=2&a=1#k"}), ('{"official_website": "mailto:a@m.example"}', None),
    ('{"official_website": "https://a:b@m.example"}', None), ('{"description": "x"}', None), ('{"ageLimit": "x"}', None), ('{"vacancy": [2]}', None), ('{"fee": 1}', None),
    ('{"location": "%s"}' % ("y" * 2000), {"location": "y" * 2000}), ('{"location": "%s"}' % ("y" * 2001), None), ("{}", {}),
]


def test_corrections(spark):
    table = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CORRECTIONS)], "i int, corrections string")
    for r in review.validate_corrections(table).orderBy("i").collect():
        text, want = CORRECTIONS[r["i"]]
        assert (r["correction_error"] is None) == (want is not None), text
        assert want is None or (r["corrections"] or {}) == want


@pytest.mark.parametrize("start,error", [("2044-02-01", None), ("2044-02-02", "must not be after"), (None, None)])
def test_corrected_dates_are_compared_with_the_others(spark, candidates, start, error):
    row = candidates({"title": "Guides", "last_date": "01/02/2044", "vacancy": "3"}).withColumns({"candidate_key": F.lit("a"), "snapshot_hash": F.lit("b")})
    patch = spark.createDataFrame([("a", "b", {"application_start_date": start, "vacancy": "4"})], "candidate_key string, snapshot_hash string, corrections map<string,string>")
    got = review.overlay_corrections(row, patch).first()
    assert got["vacancy"] == "4" and (error in got["correction_error"] if error else got["correction_error"] is None)


LISTINGS = [
    ({}, True), ({"title": "  "}, False), ({"title": "x" * 301}, False), ({"category": None}, False), ({"last_date": "2044-02-30"}, False), ({"last_date": "soon"}, False),
    ({"application_start_date": "02/03/2044", "last_date": "01/03/2044"}, False), ({"application_start_date": "01/03/2044", "last_date": "01/03/2044"}, True),
    ({"apply_link": "ftp://m.example"}, False), ({"apply_link": "https://a@m.example/"}, False), ({"apply_link": "https://m.example/a?b"}, True),
]


def test_listing_validation(spark):
    names = ["title", "category", "last_date", "application_start_date", "apply_link"]
    rows = [{"title": "Guides", "category": "Museums"} | r for r, _ in LISTINGS]
    table = spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{n} string" for n in names))
    errors = [r["error"] for r in validate.validate_listings(table, NOW).orderBy("id").collect()]
    assert [e is None for e in errors] == [ok for _, ok in LISTINGS]


def test_alert_rules_against_brute_force(spark, listings):
    words = ["clerk", "Bank", "mum", "e", "", "zz", "graduate"]
    rows = [{"id": i, "title": f"{words[i % 3]} {i}", "category": ["Banking Jobs", "Railway"][i % 2], "location": [None, "Mumbai", "Delhi"][i % 3], "qualification": ["Graduate", None][i % 2]} for i in range(40)]
    prefs = [{"id": p, "keywords": [words[p % 7]] * (p % 2) + [words[(p + 3) % 7]] * (p % 3 > 1), "categories": ["bank"] * (p % 4 == 1), "locations": ["MUM", "del"][: p % 3], "qualification": ["", None, "grad"][p % 3], "active": p % 5 > 0} for p in range(60)]
    df = spark.createDataFrame([(p["id"], p["keywords"], p["categories"], p["locations"], p["qualification"], p["active"]) for p in prefs],
                               "id int, keywords array<string>, categories array<string>, locations array<string>, qualification string, active boolean")

    def fits(job, p):
        low = lambda v: (v or "").lower()
        hay = " ".join(low(job.get(c)) for c in ("title", "department", "qualification", "location", "category"))
        return (p["active"] and (not p["keywords"] or any(k.lower() in hay for k in p["keywords"]))
                and (not p["categories"] or any(c.lower() in low(job["category"]) for c in p["categories"]))
                and (not p["locations"] or any(x.lower() in low(job["location"]) for x in p["locations"]))
                and (not p["qualification"] or p["qualification"].lower() in low(job["qualification"])))

    want = {(p["id"], j["id"]) for p in prefs for j in rows if fits(j, p)}
    got = [tuple(r) for r in alerts.match_alerts(listings(*rows), df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
