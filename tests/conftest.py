from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


CANDIDATE = (
    "cand_id bigint, pos bigint, source_id bigint, title string, department string, qualification string, vacancy string, "
    "salary string, age_limit string, location string, application_fee string, selection_process string, description string, "
    "how_to_apply string, application_start_date string, last_date string, posted_date string, updated_date string, "
    "apply_link string, notification_link string, official_website string, source_job_id string, source_url string, "
    "raw_text string, is_corrigendum boolean, extraction_method string"
)
LISTING = (
    "id bigint, title string, department string, qualification string, vacancy string, salary string, age_limit string, "
    "location string, application_fee string, selection_process string, description string, how_to_apply string, "
    "important_dates string, application_start_date timestamp_ntz, last_date timestamp_ntz, expires_at timestamp_ntz, posted_date timestamp_ntz, "
    "published_at timestamp_ntz, expired_at timestamp_ntz, apply_link string, notification_link string, official_website string, "
    "category string, status string, featured boolean, source_id bigint, source_name string, source_url string, "
    "source_job_id string, review_status string, source_hash string, automation_run_id bigint, created_at timestamp_ntz, "
    "updated_at timestamp_ntz"
)
SOURCE = (
    "id bigint, name string, domain string, start_url string, type string, category string, parser_type string, "
    "enabled boolean, trusted boolean, auto_publish boolean, review_status string, last_content_hash string"
)


def frame(spark, schema: str, rows: list[dict]):
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture
def candidates(spark):
    def make(*rows: dict):
        base = {"source_id": 1, "is_corrigendum": False, "extraction_method": "HTML", "raw_text": "Official recruitment notice. " * 4,
                "source_url": "https://example.gov.in/jobs"}
        return frame(spark, CANDIDATE, [base | {"cand_id": i, "pos": i} | r for i, r in enumerate(rows)])

    return make


@pytest.fixture
def listings(spark):
    def make(*rows: dict):
        base = {"status": "PUBLISHED", "featured": False, "category": "Government Jobs", "review_status": "MANUAL_VERIFIED"}
        return frame(spark, LISTING, [base | r for r in rows])

    return make


@pytest.fixture
def sources(spark):
    def make(*rows: dict):
        base = {"id": 1, "name": "Official Board", "domain": "example.gov.in", "start_url": "https://example.gov.in/jobs", "type": "GOVERNMENT",
                "category": "Government Jobs", "parser_type": "GENERIC_HTML", "enabled": True, "trusted": True, "auto_publish": False, "review_status": "APPROVED"}
        return frame(spark, SOURCE, [base | r for r in rows])

    return make
