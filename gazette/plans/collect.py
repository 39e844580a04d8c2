"""One collection over all kinds of sources: routed, read, completed and united.

The inputs are what a crawl has fetched: `pages` (page_id, url, html), the text
of `documents` (url, text), and `payloads` (payload_id, url, payload) of notice
interfaces. Every enabled source goes to the branch of its adapter; the branches
meet in one table of candidates in the order of the sources, which a write run
takes as it is, with a row per source of what was collected.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gazette import vocabulary as V
from gazette.functions.dates import ts
from gazette.functions.html import strip_html
from gazette.functions.identity import notice_id
from gazette.functions.text import blank_to_null, clean, content_hash, has
from gazette.functions.urls import canonical_url, host, https_upgrade, is_pdf, origin, same_domain
from gazette.operators import documents as docs, extract, merge
from gazette.scale import in_order, written

#: What every branch gives, beside source_id and its place in the source.
FACTS = ["title", *merge.FIRST_FIELDS, "notification_link", "raw_text", "source_url", "is_corrigendum", "extraction_method", "content_hash"]


def _shaped(rows: DataFrame, *kept: str) -> DataFrame:
    return merge.with_candidate_columns(rows).select(*kept, *FACTS)


def document_facts(documents: DataFrame) -> DataFrame:
    """Every document by its canonical address `at`, with the facts of its text: read once, whoever names it."""
    return written(docs.extract_notice_facts(_by_url(documents, "text")).withColumns({"source_job_id": notice_id("text"), "content_hash": content_hash("text")}), "document-facts")


def document_candidates(rows: DataFrame, *kept: str) -> DataFrame:
    """A candidate per named document: `document_facts` with the label and start_url it is named by, and the `kept` columns."""
    file = F.regexp_replace(F.try_url_decode(F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), F.lit(-1))), r"(?i)\.pdf$", "")
    named = rows.withColumn("label", F.coalesce(blank_to_null(clean("label")), blank_to_null(file), F.lit("Recruitment notification")))
    made = docs.corrigendum_flag(docs.pick_title(named)).withColumns({
        "raw_text": F.col("text"), "notification_link": F.col("url"), "source_url": F.col("url"), "official_website": origin("start_url"), "extraction_method": F.lit("PDF"),
    })
    return _shaped(made, *kept)


def page_records(pages: DataFrame) -> DataFrame:
    """The records of all pages (page_id, url, html), those of a page united in order: every page is read once."""
    # A small file is one task, and a page is much more work than bytes.
    given = pages.repartition("page_id").select("page_id", F.lit(None).cast("bigint").alias("source_id"), "url", "html")
    records = merge.with_candidate_columns(merge.ordered_union(extract.extract_jsonld(given), extract.anchor_candidates(given)))
    return written(in_order(records.drop("source_id").withColumnRenamed("pos", "place"), ["page_id", "place"], "pos").drop("place"), "page-records")


def notices_of(records: DataFrame, keys: list[str]) -> DataFrame:
    """One notice per identity within `keys`, outcomes left out."""
    return extract.drop_result_only(merge.merge_notices(records, keys))


def _by_url(table: DataFrame, *columns: str) -> DataFrame:
    """Fetched things by their canonical address; of several the first by it."""
    rows = table.select(canonical_url("url").alias("at"), "url", *columns).where(F.col("at").isNotNull())
    return rows.groupBy("at").agg(F.min_by(F.struct("url", *columns), F.struct("url", *columns)).alias("f")).select("at", "f.*")


def completed(notices: DataFrame, sources: DataFrame, pages: DataFrame, records: DataFrame, documents: DataFrame) -> DataFrame:
    """Notices of the sources that are completed, with what their detail pages and documents say; others as they are.

    `notices` carry `base_id`; `records` are the `page_records`, `documents` the
    `document_facts`. A document named by the notice completes it; a
    detail page gives its longer text, its closest notice, and its first document.
    """
    registry = sources.select(F.col("id").alias("source_id"), "domain", "start_url", "adapter")
    details, family = has("domain", V.DETAIL_DOMAINS), has("domain", V.SIBLING_DOMAINS)
    joined = notices.join(registry, "source_id")
    link = https_upgrade(canonical_url("notification_link", "source_url"), F.col("domain"), F.col("start_url"))
    followed = ((F.col("adapter") == "government_html") & details) | ((F.col("adapter") == "generic_html") & family)
    rows = joined.withColumn("_link", F.when(followed, link))
    rows = written(rows.withColumn("_link", F.when(same_domain("_link", F.col("domain")), F.col("_link"))), "followed")
    columns = notices.columns
    rest = rows.where(F.col("_link").isNull()).select(*columns)
    base = rows.where(F.col("_link").isNotNull()).withColumn("notification_link", F.col("_link"))

    # Detail pages: a longer text, then the closest notice of the page.
    paged = base.where(~is_pdf("_link") & (F.col("adapter") == "government_html"))
    fetched = _by_url(pages, "page_id", "html")
    met = written(paged.join(fetched.select(F.col("at").alias("_link"), "page_id", F.col("url").alias("page_url"), "html"), "_link"), "detail-pages")
    text = strip_html("html")
    longer = F.length(text) > F.length("raw_text")
    fuller = met.withColumns({"raw_text": F.when(longer, text).otherwise(F.col("raw_text")), "content_hash": F.when(longer, content_hash(text)).otherwise(F.col("content_hash"))})
    own_pages = met.select("page_id", "source_id", F.col("page_url").alias("url"), "html").dropDuplicates(["page_id"])
    found = notices_of(records.join(own_pages.select("page_id", "source_id"), "page_id"), ["source_id", "page_id"]).withColumn("detail_id", F.col("pos"))
    closest = merge.closest_detail(fuller.select("base_id", "page_id", "source_job_id", "title"), found)
    second = _shaped(closest.join(found, "detail_id"), "base_id").withColumn("pos", F.lit(1))
    pair = _shaped(fuller, "base_id").withColumn("pos", F.lit(0)).unionByName(second)
    merged = merge.merge_notices(pair, ["base_id"], identity=F.lit("notice")).select("base_id", *FACTS)
    # The first document of the page, by place.
    first = extract.extract_document_links(own_pages.select("page_id", "url", "html")).groupBy("page_id").agg(F.min_by("href", "pos").alias("document"))
    places = fuller.select("base_id", "source_id", "page_id", "start_url", *[c for c in columns if c not in (*FACTS, "base_id", "source_id")])
    paged_out = places.join(merged, "base_id").join(first, "page_id", "left")

    direct = base.withColumn("document", F.when(is_pdf("_link"), F.col("_link"))).join(met.select("base_id"), "base_id", "left_anti")
    waiting = written(direct.select(*columns, "start_url", "document").unionByName(paged_out.select(*columns, "start_url", "document")), "waiting")
    read = waiting.select("base_id", "start_url", F.col("document").alias("at"), F.col("title").alias("label")).join(documents, "at")
    completed_rows = merge.enrich_notice(waiting.drop("start_url", "document"), document_candidates(read, "base_id"), "base_id")
    return rest.unionByName(completed_rows.select(*columns))


def collect(
    sources: DataFrame, pages: DataFrame, documents: DataFrame, payloads: DataFrame, now: datetime | str, api_domain: str = V.API_DOMAIN, organisation: str = V.API_ORGANISATION,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, collected) of all enabled sources.

    `candidates` have cand_id, pos, source_id, adapter and the facts, in the order
    of the sources and of encounter; `collected` has per source the content hash,
    link figures, warnings, and an error where nothing was fetched for it.
    """
    routed = written(extract.dispatch(sources.where("enabled"), api_domain).withColumn("at", canonical_url("start_url")), "routed")
    of = lambda *adapters: routed.where(F.col("adapter").isin(*adapters))
    texts, every = document_facts(documents), page_records(pages)

    # Documents that are sources themselves.
    own = of("document").select("at", F.col("id").alias("source_id"), F.col("name").alias("label"), "start_url").join(texts, "at")
    from_documents = document_candidates(own, "source_id").withColumns({"adapter": F.lit("document"), "place": F.lit(0).cast("bigint")})

    # Pages: notices of the page, then documents it links to, the first of an identity.
    start = of("government_html", "generic_html").join(_by_url(pages, "page_id", "html"), "at")
    start = written(start.select("page_id", F.col("id").alias("source_id"), "url", "html", "adapter", "domain", "start_url"), "start-pages")
    records = every.join(start.select("page_id", "source_id"), "page_id")
    notices = extract.open_only(notices_of(records, ["source_id"]).join(start.select("source_id", "domain"), "source_id"), "domain", ts(now)).drop("domain")
    notices = written(notices, "page-notices")
    linked = extract.extract_document_links(start.where("adapter = 'government_html'").select("page_id", "url", "html"))
    linked = linked.join(start.select("page_id", "source_id", "start_url"), "page_id").select("source_id", "start_url", F.col("href").alias("at"), "label", "pos")
    attached = document_candidates(linked.join(texts, "at"), "source_id", "pos")
    united = merge.first_per_identity(_shaped(notices, "source_id", "pos"), attached.withColumn("pos", F.col("pos").cast("bigint")))
    # Documents come after the notices of the page.
    late = F.when(F.col("extraction_method") == "PDF", F.lit(1 << 62)).otherwise(F.lit(0)) + F.col("pos")
    ordered = written(united.withColumn("place", late).withColumn("base_id", F.xxhash64("source_id", "identity")), "united")
    whole = completed(_shaped(ordered, "base_id", "source_id", "place"), routed, pages, every, texts)
    from_pages = whole.join(start.select("source_id", "adapter"), "source_id").select("source_id", *FACTS, "adapter", "place")

    # Payloads of the notice interface.
    asked = payloads.join(of("notice_api").select(F.col("id").alias("source_id"), "start_url", host("start_url").alias("_host")), host("url") == F.col("_host")).drop("_host")
    asked = written(asked.select("payload_id", "url", "payload", "source_id", "start_url").repartition("payload_id"), "payloads")
    read, counted = extract.ingest_notice_api(asked.select("payload_id", "url", "payload"), "", organisation, api_domain)
    read = in_order(read, ["payload_id", "path"], "place").join(asked.select("payload_id", "source_id", "start_url"), "payload_id")
    read = read.withColumns({"source_url": F.col("start_url"), "official_website": origin("start_url")})
    from_payloads = _shaped(read, "source_id", "place").withColumn("adapter", F.lit("notice_api"))

    parts = [p.select("source_id", "adapter", "place", *FACTS) for p in (from_documents, from_pages, from_payloads)]
    candidates = in_order(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["source_id", "place"], "pos").withColumn("cand_id", F.col("pos")).drop("place")
    return candidates, _collected(routed, start, own, asked, counted, records, notices, candidates)


def _collected(routed, start, own, asked, counted, records, notices, candidates) -> DataFrame:
    links = extract.extract_links(start.select("page_id", "source_id", "url", "html"))
    figures = merge.collection_metrics(links, records, notices.withColumn("identity", merge.notice_identity()))
    interface = counted.join(asked.select("payload_id", "source_id"), "payload_id").groupBy("source_id").agg(F.sum("raw_links").alias("raw_links"), F.sum("recruitment_links").alias("recruitment_links"))
    sizes = candidates.groupBy("source_id").agg(F.count(F.lit(1)).alias("unique_notices"))
    interface = interface.join(sizes, "source_id", "left").withColumn("unique_notices", F.coalesce("unique_notices", F.lit(0)))
    interface = interface.withColumn("rejected_noise", F.greatest(F.lit(0), F.col("raw_links") - F.col("recruitment_links")))
    single = own.select("source_id", *[F.lit(n).alias(c) for c, n in (("raw_links", 1), ("recruitment_links", 1), ("unique_notices", 1), ("rejected_noise", 0))])
    names = ["raw_links", "recruitment_links", "unique_notices", "rejected_noise"]
    known = [t.select("source_id", *[F.col(c).cast("bigint").alias(c) for c in names]) for t in (figures, interface, single)]
    fetched = [start.select("source_id", F.lit("page").alias("got"), content_hash("html").alias("content_hash")), own.select("source_id", F.lit("document").alias("got"), content_hash("text").alias("content_hash"))]
    fetched.append(asked.groupBy("source_id").agg(F.lit("payload").alias("got"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("payload", 256))), ""), 256).alias("content_hash")))
    seen = fetched[0].unionAll(fetched[1]).unionAll(fetched[2])
    rows = routed.select(F.col("id").alias("source_id"), "domain").join(seen, "source_id", "left").join(known[0].unionAll(known[1]).unionAll(known[2]), "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    page = F.col("got") == "page"
    return rows.select(
        "source_id", "content_hash", *[zero(c).alias(c) for c in names], F.when(F.col("got").isNull(), "Nothing was fetched for the source").alias("error"),
        page_warnings(page, zero("raw_links"), zero("unique_notices"), F.col("domain")).alias("warnings"),
    )


def page_warnings(page: Column, raw_links: Column, notices: Column, domain: Column) -> Column:
    """What a page without notices calls for."""
    none = F.when(page & (raw_links > 0) & (notices == 0), V.PAGE_WARNINGS["no notice"])
    shell = F.when(page & (raw_links == 0) & (F.lower(domain) == V.API_DOMAIN), V.PAGE_WARNINGS["no link"])
    return F.array_compact(F.array(none, shell))
