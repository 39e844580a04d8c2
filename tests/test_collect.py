"""A collection over all kinds of sources, and a write run over it."""

from __future__ import annotations

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from gazette import vocabulary as V
from gazette.plans import collect as c, write_run
from gazette.sources.store import Store
from gazette.streaming import jobs

NOW = "2044-03-01 12:00:00"
SOURCES = [
    {"id": 1, "name": "Tower museum", "domain": "tower.example.org", "start_url": "https://tower.example.org/guides.pdf", "parser_type": "PDF_NOTIFICATION"},
    {"id": 2, "name": "Board", "domain": V.API_DOMAIN, "start_url": f"https://{V.API_DOMAIN}/home", "parser_type": "GOVERNMENT_HTML"},
    {"id": 3, "name": "Archive", "domain": "archive.example.org", "start_url": "https://archive.example.org/list", "parser_type": "GOVERNMENT_HTML"},
    {"id": 4, "name": "Garden", "domain": "garden.example.org", "start_url": "https://garden.example.org/", "parser_type": "GENERIC_HTML"},
    {"id": 5, "name": "Laboratory", "domain": "drdo.gov.in", "start_url": "https://drdo.gov.in/open", "parser_type": "GOVERNMENT_HTML"},
    {"id": 6, "name": "Closed", "enabled": False}, {"id": 7, "name": "Silent", "start_url": "https://silent.example.org/"}, {"id": 8, "name": "Empty", "start_url": "https://empty.example.org/"},
]
PAGES = [
    (30, "https://archive.example.org/list/", "<td>Advt No AR-1</td><td><a href='/paper.pdf'>Engagement of paper restorers</a></td><td><a href='/ink-recruitment.pdf'>Recruitment</a></td>"),
    (40, "https://garden.example.org/", '<script type="application/ld+json">{"@type":"JobPosting","title":"Gardeners wanted","identifier":"G-1"}</script><i>apply</i><a href="/x">Trainee gardeners</a>'),
    (50, "https://drdo.gov.in/open", "<td>Last date</td><td><a href='http://drdo.gov.in/one'>Engagement of glass blowers</a></td><td><a href='https://drdo.gov.in/two.pdf'>Engagement of metal workers</a></td><td><a href='https://else.example/z'>Engagement of others</a></td>"),
    (51, "https://drdo.gov.in/one", "<p>" + "All about glass and its blowers in the laboratory. " * 12 + "</p><li>Engagement of glass blowers</li><a href='/glass-notification.pdf'>Engagement of glass blowers 2044</a>"),
    (60, "https://closed.example.org/", "<a href='/x'>Trainee keepers</a> apply"), (80, "https://empty.example.org/", "<a href='/a'>Opening hours</a>"),
]
DOCUMENTS = [
    ("https://tower.example.org/guides.pdf", "Recruitment of tower guides. Advt. No. TW-9 of this year. No. of posts: 12 Essential Qualification: Degree in history Age limit 40 years"),
    ("https://archive.example.org/paper.pdf", "Paper. Advt. No. AR-1 again. Age limit 30 years"), ("https://archive.example.org/ink-recruitment.pdf", "Engagement of ink makers for two years. Advt No INK-2 too"),
    ("https://drdo.gov.in/two.pdf", "Metal. " * 60 + "Age limit 33 years Selection process: written test"), ("https://drdo.gov.in/glass-notification.pdf", "Corrigendum about glass. Age limit 44 years"),
]
PAYLOADS = [(1, f"https://{V.API_DOMAIN}/api?p=1", {"a": [{"subject": "Recruitment of clerks", "noticeId": "N1", "file": "/c.pdf"}, {"subject": "Menu"}]}), (2, f"https://{V.API_DOMAIN}/api?p=2", [{"subject": "Recruitment of drivers", "id": 5, "applyLink": "/apply"}]),
            (3, "https://foreign.example/api", [{"subject": "Recruitment of nobody", "applyLink": "/apply"}])]


@pytest.fixture(scope="module")
def inputs(spark):
    return (
        spark.createDataFrame(PAGES, "page_id bigint, url string, html string"), spark.createDataFrame(DOCUMENTS, "url string, text string"),
        spark.createDataFrame([(i, u, json.dumps(p)) for i, u, p in PAYLOADS], "payload_id bigint, url string, payload string"),
    )


def test_every_adapter_gives_its_notices_in_order(spark, sources, inputs):
    candidates, collected = c.collect(sources(*SOURCES), *inputs, NOW)
    rows = candidates.orderBy("pos").collect()
    assert [(r.source_id, r.adapter, r.title) for r in rows] == [
        (1, "document", "Tower museum"), (2, "notice_api", "Recruitment of clerks"), (2, "notice_api", "Recruitment of drivers"),
        (3, "government_html", "Engagement of paper restorers"), (3, "government_html", "Engagement of ink makers for two years."),
        (4, "generic_html", "Gardeners wanted"), (4, "generic_html", "Trainee gardeners"),
        (5, "government_html", "Engagement of glass blowers"), (5, "government_html", "Engagement of metal workers"), (5, "government_html", "Engagement of others"),
    ]
    by = {(r.source_id, r.title): r for r in rows}
    tower = by[1, "Tower museum"]
    assert (tower.vacancy, tower.source_job_id, tower.age_limit, tower.extraction_method, tower.official_website) == ("12", "TW-9", "40 years", "PDF", "https://tower.example.org")
    # The linked document of a notice with the same number is no second notice, and completes none outside the followed sources.
    assert by[3, "Engagement of paper restorers"].age_limit is None
    clerks = by[2, "Recruitment of clerks"]
    assert (clerks.source_job_id, clerks.department, clerks.source_url) == ("N1", V.API_ORGANISATION, f"https://{V.API_DOMAIN}/home")
    glass, metal, other = (by[5, f"Engagement of {w}"] for w in ("glass blowers", "metal workers", "others"))
    assert glass.notification_link.startswith("https://drdo.gov.in/") and glass.age_limit == "44 years" and not glass.is_corrigendum and "All about glass" in glass.raw_text
    assert (metal.age_limit, metal.selection_process, metal.extraction_method) == ("33 years", "written test", "HTML") and metal.raw_text.startswith("Metal.") and other.notification_link == "https://else.example/z"
    got = {r.source_id: r for r in collected.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7, 8} and got[7].error and not any(r.error for i, r in got.items() if i != 7)
    assert (got[1].raw_links, got[1].unique_notices) == (1, 1) and (got[2].raw_links, got[2].recruitment_links, got[2].unique_notices) == (2, 2, 2)
    assert got[8].warnings == [V.PAGE_WARNINGS["no notice"]] and got[8].rejected_noise == 1 and got[3].warnings == []


def test_pages_stream_into_versions(spark, sources, listings, inputs):
    folder = tempfile.mkdtemp(prefix="gazette-test-")
    store = Store(spark, f"{folder}/store")
    write_run.open_store(store, listings(*[{"id": i, "title": f"Hall {i}"} for i in range(30)]), sources(*SOURCES), 10, 4)
    inputs[0].where("page_id = 40").coalesce(1).write.parquet(f"{folder}/pages")
    none = [t.where("false") for t in inputs]
    decisions = spark.createDataFrame([], "source_id bigint, candidate_key string, snapshot_hash string, decision string, reason string")

    def run(check):
        stream = spark.readStream.schema(inputs[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/pages")
        job = jobs.stream_runs(stream, store.path, lambda: none[1], lambda: none[2], lambda: decisions, lambda: NOW, f"{folder}/{check}", listing_ids=10, parts=4)
        job.trigger(availableNow=True).start().awaitTermination()
        return Store(spark, store.path)

    after = run("check")
    # One run; the first three parts of the listings are those of the first version, and sources without a page are not logged.
    assert after.version == after.run == 2 and after.folders("listings")[:3] == store.folders("listings")
    log = after.read("run_items").collect()
    assert [(r.run_id, r.source_id) for r in log if r.source_id] == [(2, 4), (2, 4)] and not any(r.action == "ERROR" for r in log)
    # The stream from its start again is the same run, which changes nothing.
    assert run("again").version == 2


def test_collecting_nothing(spark, sources, inputs):
    none = [t.where("false") for t in inputs]
    candidates, collected = c.collect(sources(*SOURCES), *none, NOW)
    assert candidates.count() == 0 and {r.error is None for r in collected.collect()} == {False}
