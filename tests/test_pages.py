"""Extraction from pages, payloads and documents: one rule a case."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gazette.operators import documents, extract, merge

PAGE = "page_id bigint, source_id bigint, url string, html string"


def pages(spark, *html):
    return spark.createDataFrame([(i, 1, "https://museum.example.org/news/list.html", h) for i, h in enumerate(html)], PAGE)


def column(df, name: str, order: str = "page_id") -> dict:
    return {r[order]: r[name] for r in df.select(order, name).collect()}


# Links


def test_links_with_their_text_and_address(spark):
    html = """<ul><li><a href='jobs.html'>One <b>two</b></a><li><A class=x HREF="//cdn.example.org/f?b=2&a=1#top">&amp;</A><li><a name="no">none</a><li><a href="javascript:go()">go</a></ul>"""
    got = extract.extract_links(pages(spark, html)).orderBy("pos").collect()
    assert [(r.pos, r.href, r.label) for r in got] == [
        (0, "https://museum.example.org/news/jobs.html", "One two"), (1, "https://cdn.example.org/f?a=1&b=2", "&"), (2, None, "go"),
    ]


def test_document_links_keep_the_last_label_and_the_first_place(spark):
    html = '<a href="/a.pdf">Vacancy list</a><a href="/b.pdf">Menu</a><a href="/career.pdf">x</a><a href="/a.pdf">Job list</a>'
    got = extract.extract_document_links(pages(spark, html)).collect()
    assert sorted((r.href.rsplit("/", 1)[1], r.label) for r in got) == [("a.pdf", "Job list"), ("career.pdf", "x")]


ANCHORS = {
    "Guides wanted": (False, "no word of a post"),
    "Trainee guides": (True, "a post named"),
    "Post": (False, "shorter than five characters"),
    "Vacancies": (False, "a bare label"),
    "Trainee " + "guide " * 40: (False, "an anchor longer than 220 characters"),
    "Undertaking for trainees": (False, "a supporting document"),
    "Trainees selected and waitlisted": (False, "an outcome"),
    "Trainees selected and waitlisted: extension": (True, "an outcome whose dates moved"),
}


def test_what_an_anchor_has_to_say(spark):
    table = pages(spark, *(f"<table><tr><td>Last date soon</td><td><a href='/n'>{a}</a></td></tr></table>" for a in ANCHORS))
    found = {r.page_id for r in extract.anchor_candidates(table).collect()}
    for i, (taken, why) in enumerate(ANCHORS.values()):
        assert (i in found) == taken, why
    assert extract.anchor_candidates(pages(spark, "<p>Open day</p><a href='/n'>Interview with our curator</a>")).count() == 0


def test_bare_labels_take_a_title_from_their_page(spark):
    table = pages(
        spark,
        "<a href='/g'>Read more</a> <a href='/g'>Engagement of night guides</a> <a href='/g'>Appointment of night guides</a>",
        "<ol><li>Appointment of two museum clerks</li><li>Opening hours</li></ol><span><a href='/c'>Details</a></span>",
        "<dl><dt>Engagement of stone masons <dd>Advt. No. 7/M <dd><a href='/m'>Read more</a></dl>",
        "<i>Opening hours</i><a href='/none'>View more</a>",
    )
    got = {(r.page_id, r.title) for r in extract.anchor_candidates(table).collect()}
    assert (0, "Appointment of night guides") in got and (1, "Appointment of two museum clerks") in got
    assert (2, "Engagement of stone masons") in got and not any(p == 3 for p, _ in got)
    # The last titled link of the address gives the title.
    titles = extract.backfill_titles(table.where("page_id = 0")).orderBy("pos").collect()
    assert [r.title for r in titles] == ["Appointment of night guides", "Engagement of night guides", "Appointment of night guides"]


def test_which_link_and_number_an_anchor_gives(spark):
    table = pages(
        spark,
        "<td>Notification No. A-1/x</td><td>Advt No B-2/x</td><td><a href='/form/apply'>Clerk posts</a></td>",
        "<td><a href='/clerk.pdf'>Apply for clerk posts</a></td>",
        "<td><a href='/clerk'>Clerk posts 01/02/2044 to 03.04.2044</a> last date</td>",
    )
    got = {r.page_id: r for r in extract.anchor_candidates(table).collect()}
    assert got[0].source_job_id == "B-2/X" and got[0].apply_link.endswith("/form/apply") and got[0].notification_link.endswith("list.html")
    assert got[1].apply_link is None and got[1].notification_link.endswith("/clerk.pdf")
    assert (got[2].application_start_date, got[2].last_date) == ("01/02/2044", "03.04.2044")


LABELLED = [
    ("vacancy", "Openings: 14", "14"), ("vacancy", "Openings: several", None), ("vacancy", "Vacancies 05/06/2044", None),
    ("salary", "Pay scale Rs. 100 Location Pune", "Rs. 100"), ("salary", "Salary good", None), ("age_limit", "Age: 40 years", "40 years"),
    ("last_date", "Closing date: 31/04/2044", None), ("last_date", "Due date - 30/04/2044", "30/04/2044"), ("application_fee", "Fee: nil", "nil"),
    ("location", "Place of posting: " + "far " * 60, None), ("selection_process", "Selection: by merit", "by merit"),
]


@pytest.mark.parametrize("field", sorted({f for f, _, _ in LABELLED}))
def test_labelled_values_need_evidence(spark, field):
    cases = [(i, t, w) for i, (f, t, w) in enumerate(LABELLED) if f == field]
    table = spark.createDataFrame([(i, t) for i, t, _ in cases], "i int, t string")
    assert column(extract.extract_labeled(table, "t", [field]), field, "i") == {i: w for i, _, w in cases}


# Merging and figures


def test_records_of_one_notice_become_one(spark, candidates):
    rows = candidates(
        {"title": "Vacancies", "source_job_id": "M/1", "salary": "", "location": "North wing", "notification_link": "https://m.example/n", "raw_text": "short"},
        {"title": "Engagement of guides for the north wing", "source_job_id": " m/1 ", "salary": "Rs 9", "location": "South wing", "notification_link": "https://m.example/n.pdf", "raw_text": "longer text"},
        {"title": "Engagement of guides", "source_job_id": "M/1", "is_corrigendum": True, "raw_text": "same size.."},
        {"title": "Engagement of guides", "source_job_id": "M/2"},
    )
    got = {r.identity: r for r in merge.merge_notices(rows).collect()}
    assert len(got) == 2
    one = next(r for r in got.values() if r.merged == 3)
    assert (one.title, one.salary, one.location) == ("Engagement of guides", "Rs 9", "North wing")
    assert (one.notification_link, one.raw_text, one.is_corrigendum, one.pos) == ("https://m.example/n.pdf", "longer text", True, 0)


def test_figures_of_a_collection(spark, candidates):
    links = spark.createDataFrame([(1,)] * 5 + [(2,)] * 2 + [(3,)], "source_id int")
    records = candidates(*[{"source_id": s, "title": "Clerk posts", "source_job_id": j} for s, j in ((1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "d"), (2, "d"))])
    notices = merge.merge_notices(records).where("source_job_id <> 'b'")
    got = {r.source_id: (r.raw_links, r.recruitment_links, r.unique_notices, r.rejected_noise) for r in merge.collection_metrics(links, records, notices).collect()}
    assert got == {1: (5, 2, 1, 3), 2: (2, 3, 2, 0), 3: (1, 0, 0, 1)}


# Structured data


def script(*values) -> str:
    return "".join(f"<script id=s type='application/ld+json'>{v if isinstance(v, str) else json.dumps(v)}</script>" for v in values)


def posting(title: str = "t", **more) -> dict:
    return {"@type": "JobPosting", "title": title, **more}


POSTINGS = [
    ({"@type": ["Thing", "JOBPOSTING"], "name": "n"}, "title", "n"), (posting(identifier={"value": 7}), "source_job_id", "7"), (posting(identifier=" x "), "source_job_id", "x"),
    (posting(jobLocation=[{"address": "A"}, {"address": {"addressLocality": "B", "addressCountry": "C"}}, {}]), "location", "A; B, C"), (posting(jobLocationType="REMOTE"), "location", "REMOTE"),
    (posting(baseSalary="10"), "salary", "10"), (posting(baseSalary={"currency": "X", "minValue": 1, "maxValue": 2}), "salary", "X 1 - 2"),
    (posting(baseSalary={"value": {"value": 5, "unitText": "DAY"}}), "salary", "5 DAY"), (posting(description="<p>a&nbsp;b</p>"), "description", "a b"),
    (posting(educationRequirements="", experienceRequirements="two years"), "qualification", "two years"), (posting(hiringOrganization={"legalName": "L", "url": "/o"}), "official_website", "https://museum.example.org/o"),
]


def test_fields_of_a_posting(spark):
    rows = {r.page_id: r for r in extract.extract_jsonld(pages(spark, *(script(p) for p, _, _ in POSTINGS))).collect()}
    for i, (_, field, want) in enumerate(POSTINGS):
        assert rows[i][field] == want, field


def test_what_is_no_posting(spark):
    html = [script("{'single': 1}"), script({"@type": "Event", "title": "t"}), script(posting("")), script([[posting()]]), script({"nested": posting()}), "<script>" + json.dumps(posting()) + "</script>"]
    assert extract.extract_jsonld(pages(spark, *html)).count() == 0


def nested(depth: int) -> dict:
    """Graphs of `depth` levels: a posting before, inside and after each."""
    inner = posting("core")
    for level in range(depth):
        inner = posting(f"head {level}", **{"@graph": [inner, posting(f"tail {level}")]})
    return inner


@pytest.mark.parametrize("depth", [0, 1, 9, 490])
def test_graphs_of_any_depth_in_document_order(spark, depth):
    got = extract.extract_jsonld(pages(spark, script([nested(depth), posting("next")], posting("other")))).orderBy("pos").collect()
    want = [*(f"head {i}" for i in reversed(range(depth))), "core", *(f"tail {i}" for i in range(depth)), "next", "other"]
    assert [r.title for r in got] == want and [r.pos for r in got] == [*range(len(want))]


def test_a_hostile_page_costs_only_itself(spark):
    deep = '{"@graph":' * 3000 + "[]" + "}" * 3000
    wide = [{"@graph": [posting()]} for _ in range(3000)]
    bad = [script(deep), script(wide), script({"@graph": "@graph" * 2000}), script(nested(60))]
    good = [script({"@graph": posting(f"p{i}")}) for i in range(1000)]
    got = extract.extract_jsonld(pages(spark, *bad, *good)).groupBy("page_id").count().collect()
    counts = {r.page_id: r["count"] for r in got}
    assert all(counts[i] == 1 for i in range(4, 1004)) and counts[1] == 3000 and counts[3] == 121 and len(counts) == 1002


# Payloads


def payload_rows(spark, *values):
    return spark.createDataFrame([(i, "https://api.museum.example.org/v1/list?p=2", json.dumps(v)) for i, v in enumerate(values)], "payload_id int, url string, payload string")


def notices(spark, *values):
    return extract.ingest_notice_api(payload_rows(spark, *values), "https://museum.example.org/start", "Museum", "api.museum.example.org")


def record(**more) -> dict:
    return {"heading": "Recruitment of museum clerks", "link": "https://api.museum.example.org/n.pdf", **more}


RECORDS = [
    (record(_id="z"), "source_job_id", "z"), (record(noticeId="", id=4), "source_job_id", "4"), (record(closingDate="2044-05-06"), "last_date", "06/05/2044"),
    (record(applicationStartDate="soon"), "application_start_date", "soon"), (record(summary="s", examDescription="e"), "description", "e"),
    (record(heading="Recruitment of clerks 01/02/2044 03/04/2044"), "last_date", "03/04/2044"), (record(more={"applyHere": "/go"}), "apply_link", "https://api.museum.example.org/go"),
    (record(note="addendum: recruitment"), "is_corrigendum", False), (record(subject="Recruitment: addendum", heading=None), "is_corrigendum", True),
    (record(link=None, documentName="a b.pdf"), "notification_link", "https://api.museum.example.org/api/attachment/uploads/masterData/NoticeBoards/a%20b.pdf"),
]


def test_fields_of_a_record(spark):
    got = {r.payload_id: r for r in notices(spark, *([[r]] for r, _, _ in RECORDS))[0].collect()}
    for i, (_, field, want) in enumerate(RECORDS):
        assert got[i][field] == want, field


def test_records_that_are_no_notices_and_their_counts(spark):
    values = [record(link=None), record(heading="Museum"), record(heading="Recruitment: answer keys"), record(heading="Recruitment of clerks, corrigendum"), [record(), {"x": [record(second="https://o.example/a")]}]]
    found, counts = notices(spark, *values)
    assert [r.payload_id for r in found.collect()] == [4, 4]
    got = {r.payload_id: (r.records_scanned, r.raw_links, r.recruitment_links) for r in counts.collect()}
    assert got == {0: (1, 0, 0), 1: (1, 1, 0), 2: (1, 1, 0), 3: (1, 1, 0), 4: (2, 3, 3)}


def test_records_of_any_depth(spark):
    value = {"subject": "lowest"}
    for i in range(11):
        value = {"a": 1, "b": [0, value]} if i % 2 else [value, {"title": f"side {i}"}]
    got = extract.api_records(payload_rows(spark, value, "text", None)).orderBy("path").collect()
    assert {r.title for r in got} == {"lowest", *(f"side {i}" for i in range(0, 11, 2))} and got[0].title == "lowest"


# Documents

FACTS = [
    ("vacancy", "The total number of posts is 12 this year", "12"), ("vacancy", "No. of positions: 3. Archivist", None), ("vacancy", "Seats - 4", "4"),
    ("last_date", "The closing date shall be 2nd June 2044.", "2 June 2044"), ("last_date", "closing date unknown, opens 02/06/2044", "02/06/2044"),
    ("application_start_date", "Opening date 1.2.2044", "1.2.2044"), ("qualification", "Eligibility criteria: Diploma in conservation Tenure one year", "Diploma in conservation"),
    ("qualification", "Eligibility criteria: good eyesight", None), ("age_limit", "Maximum age 45 years How to apply by letter", "45 years"), ("age_limit", "Age limit as per rules", None),
    ("how_to_apply", "How to apply: send a letter. Selection process test", "send a letter."), ("location", "Posting at the city archive Note bring papers", "the city archive"),
    ("apply_link", "Read https://m.example.org/rules. Apply online at https://m.example.org/f1.", "https://m.example.org/f1"),
    ("apply_link", "See https://m.example.org/recruitment/x;", "https://m.example.org/recruitment/x"), ("apply_link", "See https://m.example.org/rules", None),
    ("department", "by the NATIONAL PAPER LABORATORY in town", "NATIONAL PAPER LABORATORY"),
]


def test_facts_of_a_document(spark):
    table = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(FACTS)], "i int, text string")
    got = {r.i: r for r in documents.extract_notice_facts(table).collect()}
    for i, (field, text, want) in enumerate(FACTS):
        assert got[i][field] == want, text


TITLES = [
    ("Engagement of two archivists", "anything", "Engagement of two archivists"),  # a telling label stays
    ("Notification", "Museum board\nEngagement of two archivists\nmore", "Engagement of two archivists"),  # else the first strong line
    ("Vacancies", "Museum. Notification for engagement of bookbinders for two years. Part-1", "Notification for engagement of bookbinders for two years"),  # else a heading
    ("Advertisement 4", "nothing of use", "Advertisement 4"),  # else the label after all
    ("", "nothing of use", "Recruitment notification"),
]


def test_the_title_of_a_document(spark):
    table = spark.createDataFrame([(i, label, text) for i, (label, text, _) in enumerate(TITLES)], "i int, label string, text string")
    assert column(documents.pick_title(table), "title", "i") == {i: w for i, (_, _, w) in enumerate(TITLES)}


AMENDED = [
    ("Addendum", "t", "", True), ("Engagement of two archivists", "t", "closing date extended", False), ("Archivists", "t", "The closing date extended.", True),
    ("Archivists", "t", "x" * 700 + " corrigendum", False), (None, "Corrigendum to the list", "", True),
]


def test_amendments_are_named_by_the_head_of_a_document(spark):
    table = spark.createDataFrame([(i, a, b, c) for i, (a, b, c, _) in enumerate(AMENDED)], "i int, label string, title string, text string")
    assert column(documents.corrigendum_flag(table), "is_corrigendum", "i") == {i: x[3] for i, x in enumerate(AMENDED)}


def test_empty_pages_and_missing_text(spark):
    table = spark.createDataFrame([(1, 1, "https://a.example/", None), (2, 1, None, "<a href='/x'>Clerk posts</a> apply")], PAGE)
    assert extract.extract_jsonld(table).count() == 0 and extract.anchor_candidates(table).count() == 0
    assert extract.extract_jsonld(table.limit(0)).count() == 0
    assert documents.extract_notice_facts(table.select(F.lit(None).cast("string").alias("text"))).where("vacancy is not null").count() == 0


def test_sources_are_discovered_in_all_page_families(spark, tmp_path):
    import __spark_entry__

    pages = [(50 * i, f"https://example.{d}/a", f"<article><a href='/careers/{i}'>Careers and jobs</a></article>") for i, d in enumerate(("com", "net", "org"))]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(0, "Board", 1, 1.0)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "X", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    found = {r.start_url for r in __spark_entry__.queries()["discover_sources"](spark, str(tmp_path)).collect()}
    assert {f"https://example.{d}/careers/{i}" for i, d in enumerate(("com", "net", "org"))} <= found
