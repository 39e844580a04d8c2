"""Text, date, URL and identity expressions on exact cases."""

from __future__ import annotations

import re
import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gazette.functions import dates, html, identity, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def each(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_dates_need_an_exact_calendar_day(spark):
    bad = ["March 2087", "2087", "2087-04-31", "30/02/2087", "2087-03-04 or later", "29/02/2087", "to be told", "0/1/2087", None, ""]
    assert each(spark, dates.parsed_day, bad) == [None] * len(bad)
    good = ["29/02/2088", "4 March 2087", "04-Mar-2087", "2087-03-04T10:20:30.000Z", "2nd Dec 2031", "7.6.2031"]
    assert each(spark, dates.parsed_day, good) == ["2088-02-29", "2087-03-04", "2087-03-04", "2087-03-04", "2031-12-02", "2031-06-07"]
    assert str(one(spark, dates.parse_date(F.lit("2031-05-17")))) == "2031-05-17 23:59:59.999000"


CANONICAL = [
    ("https://m.example/a?gclid=1&fbclid=2&mc_x=3&utm_y=4&k=5", "https://m.example/a?k=5"),  # tracking goes, the rest stays
    ("https://m.example/a#b", "https://m.example/a"), ("https://m.example/a/#b", "https://m.example/a"), ("https://m.example", "https://m.example/"),
    ("HTTP://WWW.M.Example:80/A", "http://m.example/A"), ("https://m.example:8443/", "https://m.example:8443/"),
    ("https://m.example/a/./b/../c?z=1&b=2&b=1", "https://m.example/a/c?b=2&b=1&z=1"), ("https://m.example/é x", "https://m.example/%C3%A9%20x"), ("https://m.example/?k", "https://m.example/?k="),
    ("mailto:a@m.example", None), ("#here", None), ("", None), ("ftp://m.example/", None), ("a/b", None), (None, None),
]


def test_canonical_urls(spark):
    assert each(spark, urls.canonical_url, [u for u, _ in CANONICAL]) == [w for _, w in CANONICAL]
    base = F.lit("https://m.example/a/b?c=1")
    refs = {"d/e": "https://m.example/a/d/e", "/f": "https://m.example/f", "//n.example/g": "https://n.example/g", "?h=i": "https://m.example/a/b?h=i", "../j": "https://m.example/j"}
    assert each(spark, lambda c: urls.canonical_url(c, base), list(refs)) == list(refs.values())


def test_addresses_of_corrections(spark):
    # Fragment, host prefix and order stay; tracking, credentials and other schemes don't.
    cases = {"HTTPS://www.M.Example/a?z=1&msclkid=2&b=3#p": "https://www.m.example/a?z=1&b=3#p", "https://m.example/a/": "https://m.example/a", "http://x:y@m.example/": None, "tel:1": None}
    assert each(spark, urls.correction_url, list(cases)) == list(cases.values())


def test_domains_and_https(spark):
    assert one(spark, urls.same_domain(F.lit("https://www.sub.coast.example.in/x"), F.lit("coast.example.in")))
    assert not one(spark, urls.same_domain(F.lit("https://otherexample.in/x"), F.lit("example.in")))
    upgraded = urls.https_upgrade(F.lit("http://coast.example.in/v/quay"), F.lit("coast.example.in"), F.lit("https://coast.example.in/v"))
    assert one(spark, upgraded) == "https://coast.example.in/v/quay"


def test_notice_ids(spark):
    cases = {
        "notice no. ab-1/c": "AB-1/C", "Advt: Q_9.z": "Q_9.Z", "notification # 2044&3": "2044&3", "Advertisement No. view": None, "Notice number N/A": None, "notice x1": None, "gazette 7/8": None,
    }
    assert each(spark, identity.notice_id, list(cases)) == list(cases.values())


def test_strip_html_decodes_before_and_after_the_tags(spark):
    cases = {
        "a&lt;i&gt;b&lt;/i&gt;c": "a b c", "&amp;lt;u&amp;gt;v": "v", "x<style>p{}</style><noscript>n</noscript>y": "x y", "<p>one</p>\n\t<p>two</p>": "one two", "&quot;&#39;&nbsp;": "\"'", None: "",
    }
    assert each(spark, html.strip_html, list(cases)) == list(cases.values())


def test_repair_cuts_at_a_sentence_or_a_word(spark):
    cases = [("Six words stand here. And five", 24, "Six words stand here."), ("Six words. And here more", 20, "Six words. And here"), ("short", 20, "short"), ("are paid", 20, "paid"), (r"a\.b\@c\/d", 20, "a.b@c/d")]
    for value, size, want in cases:
        assert one(spark, text.repair(F.lit(value), size)) == want
    # Doubly encoded signs are put right, words that stay broken go, and what can't be put right is no text.
    assert one(spark, text.repair(F.lit("pay â\u0082¹ 5 àॠend"), 50)) is None or "₹ 5" in one(spark, text.repair(F.lit("pay â\u0082¹ 5 end"), 50))
    assert one(spark, text.repair(F.lit("left \ufffd\ufffdx right"), 50)) == "left right"


def _fold(value: str) -> str:
    return re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", value).lower()).strip()


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=1, max_codepoint=0x2FFF, exclude_categories=("Cs",)), max_size=12), min_size=300, max_size=300))
def test_fold_matches_decomposition(spark, values):
    # Characters whose lower case differs before and after decomposition are left to the next test.
    values = [v for v in values if _fold(v) == _fold(v.lower())]
    assert each(spark, text.fold, values) == [_fold(v) for v in values]


def test_fold_cases(spark):
    assert each(spark, text.fold, ["  Senior–Engineer (IT) ", "résumé", "ﬁn ½ Ａb", None]) == ["senior engineer it", "re sume", "fin 1 2 ab", ""]


def test_a_bound_value_takes_its_type_once(spark):
    # `getItem` derives the type of the whole body for every row, which nested bodies multiply.
    nested = text.let(F.col("v"), lambda a: text.let(F.concat(a, a), lambda b: F.concat(b, b)))
    df = spark.createDataFrame([("x",), (None,)], "v string").select(nested.alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("element_at(transform(") == 2 and "[0]" not in plan
    assert [r["x"] for r in df.collect()] == ["xxxx", None]


def test_spaces_and_nulls_of_a_text(spark):
    odd = "\t\n\x0b\x0c\r\u00a0\u1680\u2003\u2028\u202f\u205f\u3000\ufeff"
    cases = {"a\x00b": "ab", "\x00": "", " a  b ": "a b", "a b": "a b", f"a{odd}b": "a b", f"a {odd} b": "a b", "é\u00a0\u00a0ü": "é ü", "a\u200bb": "a\u200bb", "\u3000": ""}
    cases |= {f"a{c}b": "a b" for c in odd}
    assert each(spark, text.clean, [*cases, None]) == [*cases.values(), ""]
    assert each(spark, text.fold, ["A\x00b", "a\x00 \x00b", "\x00"]) == ["ab", "a b", ""]


def test_even_texts_and_plain_links_take_no_other_way(spark):
    """Texts and links that need no work give what the full rules give, and their odd neighbours still get the rules."""
    texts = ["plain words", " a  b\tc\x00d ", "café  x", "is Graduate", "Island", "12. Clerk", "120", ": x", "a\\.b", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    found = rows.select("id", text.clean("t"), text.clean(F.col("t")), text.fold("t"), text.repair("t", 50)).orderBy("id").collect()
    assert [r[1] for r in found] == ["plain words", "a b cd", "café x", "is Graduate", "Island", "12. Clerk", "120", ": x", "a\\.b", "", ""]
    assert all(r[1] == r[2] for r in found)
    assert [r[3] for r in found] == ["plain words", "a b cd", "cafe x", "is graduate", "island", "12 clerk", "120", "x", "a b", "", ""]
    assert [r[4] for r in found] == ["plain words", "a b cd", "café x", "Graduate", "Island", "Clerk", "120", "x", "a.b", None, None]
    links = {
        "https://www.a.org/x/?b=2&a=1&utm_x=3#top": "https://a.org/x?a=1&b=2", "http://a.org": "http://a.org/", "http://a.org//x//": "http://a.org//x",
        "http://www.": None, "http://a.org/x/../y": "http://a.org/y", "HTTP://A.org:80/X": "http://a.org/X", "http://a.org/a.b?": "http://a.org/a.b", "http://a.org\x85": "http://a.org\x85/", "#x": None,
    }
    urls_ = spark.createDataFrame([(u,) for u in links], "u string")
    assert {r.u: r.c for r in urls_.select("u", urls.canonical_url("u").alias("c")).collect()} == links


def test_keys_of_one_kind_are_those_of_all_kinds(spark):
    from gazette.operators import linkage

    rows = spark.createDataFrame(
        [(1, 3, "ord-1", "http://www.a.org/x/", None, "Clerk", "D", "P", "2026-01-02"), (2, None, None, None, "http://a.org/n", "Driver", None, None, None)],
        "cand_id bigint, source_id bigint, source_job_id string, apply_link string, notification_link string, title string, department string, location string, last_date string",
    )
    every = {tuple(r) for r in linkage.candidate_keys(rows).select("kind", "key", "cand_id").collect()}
    single = [{tuple(r) for r in linkage.candidate_keys(rows, k).select("kind", "key", "cand_id").collect()} for k in (1, 3, 4, 5, 6)]
    assert all(single) and set.union(*single) == every and sum(map(len, single)) == len(every)
