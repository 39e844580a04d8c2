"""Steps that are dear are made once, whoever reads them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gazette.operators import extract
from gazette.scale import in_order, once


def counted(spark, column: str = "text"):
    """A text that counts how often it is made, and the count."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(value):
        made.add(1)
        return value

    return count(column), made


def test_rows_are_made_once_before_they_are_put_in_order(spark):
    text, made = counted(spark)
    rows = spark.createDataFrame([(9 - i, f"row {i}") for i in range(10)], "place int, text string").select("place", text.alias("text"))
    got = in_order(rows, ["place"], "n").orderBy("n").collect()
    assert [r.text for r in got] == [f"row {i}" for i in range(9, -1, -1)]
    assert made.value == 10


def test_a_column_made_once_is_not_repeated_by_filters(spark):
    text, made = counted(spark)
    rows = once(spark.createDataFrame([(f"row {i}",) for i in range(10)], "text string"), shown=text)
    got = rows.where(F.length("shown") == 5).where(F.col("shown") != "row 3").select("shown").collect()
    assert len(got) == 9 and made.value == 10


def test_both_results_of_an_interface_read_its_payloads_once(spark):
    text, made = counted(spark)
    record = {"heading": "Recruitment of museum clerks", "link": "https://api.museum.example.org/n.pdf"}
    rows = spark.createDataFrame([(i, "https://api.museum.example.org/v1/list", json.dumps({"data": [record, [record]]})) for i in range(3)], "payload_id bigint, url string, text string")
    found, counts = extract.ingest_notice_api(rows.select("payload_id", "url", text.alias("payload")), "https://museum.example.org/start", "Museum", "api.museum.example.org")
    assert found.count() == 6 and {r.records_scanned for r in counts.collect()} == {2}
    assert made.value == 3
