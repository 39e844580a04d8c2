"""Notice extraction from crawled pages: links, anchors, structured data, API payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gazette import vocabulary as V
from gazette.functions.dates import parse_date, title_dates
from gazette.functions.html import strip_html
from gazette.functions.identity import notice_id
from gazette.functions.text import blank_to_null, clean, clean_or_null, col, content_hash, has, head, let, rx, tail
from gazette.functions.urls import canonical_url, host, is_pdf, origin, path_and_query, same_domain
from gazette.scale import once, written

BEFORE_CHARS, AFTER_CHARS = 15_000, 4_000


def oversize_filter(pages: DataFrame, max_bytes: int = V.MAX_HTML_BYTES, column: str = "html") -> DataFrame:
    return pages.where(F.octet_length(column) <= max_bytes)


# --- links ------------------------------------------------------------------------------
def _anchors(html: Column) -> Column:
    """array<struct(href_raw, inner)> of every link of a page."""
    pattern = F.lit(rx(V.ANCHOR))
    return F.arrays_zip(
        F.regexp_extract_all(html, pattern, F.lit(1)).alias("href_raw"),
        F.regexp_extract_all(html, pattern, F.lit(2)).alias("inner"),
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """(page columns, pos, href_raw, href, label): every link with its visible text."""
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, F.posexplode(_anchors(F.col("html"))).alias("pos", "a")).select(
        *kept,
        "pos",
        F.col("a.href_raw").alias("href_raw"),
        canonical_url("a.href_raw", "url").alias("href"),
        strip_html("a.inner").alias("label"),
    )


def extract_document_links(pages: DataFrame) -> DataFrame:
    """Document links with recruitment words: last label of a URL, position of its first link."""
    links = extract_links(pages).where(
        is_pdf("href") & has(F.concat_ws(" ", "label", "href"), V.DOCUMENT_LINK_WORDS)
    )
    return links.groupBy("page_id", "href").agg(F.max_by("label", "pos").alias("label"), F.min("pos").alias("pos"))


def discover_sources(pages: DataFrame, sources: DataFrame, n: int | None = 20) -> DataFrame:
    """Career-like links of a source's own domain as new source candidates."""
    links = extract_links(pages.select("page_id", "source_id", "url", "html"))
    registry = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), "domain", "type", "category",
        F.col("start_url").alias("discovered_from_url"),
    )
    rows = links.join(registry, "source_id").where(
        F.col("href").isNotNull()
        & has(F.concat_ws(" ", "label", "href"), V.DISCOVERY_TERMS)
        & same_domain("href", "domain")
        & ~has("href", r"\.pdf(?:$|\?)")
    )
    order = F.struct("page_id", "pos")
    found = rows.groupBy("source_id", "source_name", "type", "category", "discovered_from_url", "href").agg(
        F.max_by("label", order).alias("label"), F.min(order).alias("first")
    )
    if n is not None:
        rank = F.row_number().over(W.partitionBy("source_id").orderBy("first"))
        found = found.withColumn("_rank", rank).where(F.col("_rank") <= n)
    public = F.col("type").isin("GOVERNMENT", "PSU")
    return found.select(
        "source_id",
        F.coalesce(blank_to_null(head(F.col("label"), 120)), F.concat("source_name", F.lit(" Careers"))).alias("name"),
        host("href").alias("domain"),
        F.col("href").alias("start_url"),
        "type",
        "category",
        F.when(public, "GOVERNMENT_HTML").otherwise("GENERIC_HTML").alias("parser_type"),
        "discovered_from_url",
    )


def robots_filter(urls: DataFrame, rules: DataFrame, agent: str = V.ROBOTS_AGENT) -> DataFrame:
    """Adds `allowed` to URLs from rules (host, grp, agent, seq, allow, path).

    The group naming the agent beats `*`; the longest matching rule wins, the
    first in the file on ties; a host without rules is open.  The rules of one
    host are one robots file, so they travel as an array and rows never multiply.
    """
    named = F.min(F.when(F.col("agent") == agent, F.struct("grp", "agent")))
    anyone = F.min(F.when(F.col("agent") == "*", F.struct("grp", "agent")))
    chosen = rules.groupBy("host").agg(F.coalesce(named, anyone).alias("use")).select("host", "use.*")
    rule = F.struct(F.length("path").alias("size"), (-F.col("seq")).alias("order"), "allow", "path")
    per_host = rules.join(chosen, ["host", "grp", "agent"]).groupBy("host").agg(F.collect_list(rule).alias("rules"))
    target = path_and_query("url")
    matching = F.filter(
        F.col("rules"), lambda r: F.col("_path").startswith(F.regexp_replace(r["path"], r"\*.*$", ""))
    )
    return (
        urls.withColumns({"host": host("url"), "_path": target})
        .join(per_host, "host", "left")
        .withColumn("allowed", F.coalesce(F.array_max(matching)["allow"], F.lit(True)))
        .drop("rules", "_path")
    )


# --- titles ---------------------------------------------------------------------------------
def clean_title(c: Column) -> Column:
    """A notice title without markup rests, notice number tail, action words or repetition."""
    text = F.regexp_replace(clean(c), r"(?i)^[a-z-]+=[\"'][^\"']*[\"']>\s*", "")
    text = F.regexp_replace(text, rx(V.TITLE_TAIL) + r"[\s\S]*$", "")
    text = F.trim(F.regexp_replace(text, rx(V.TITLE_ACTION), ""))

    def unrepeat(t: Column) -> Column:
        sign = head(t, 32)
        again = F.position(sign, t, F.length(sign) + 1)
        return F.when((F.length(sign) >= 16) & (again > 0), F.substring(t, F.lit(1), again - 1)).otherwise(t)

    return head(F.trim(F.regexp_replace(let(text, unrepeat), "[â€¦…]+$", "")), V.FIELD_CAPS["title"])


def descriptive_title(c: Column) -> Column:
    """The cleaned title when it reads like a recruitment heading, else null."""

    def judge(t: Column) -> Column:
        words = F.size(F.regexp_extract_all(t, F.lit("(?i)[a-z]{2,}"), F.lit(0)))
        usable = (
            F.length(t).between(10, 240)
            & ~has(t, V.GENERIC_TITLE)
            & has(t, V.JOB_SIGNAL)
            & ~(t.rlike(r"(?i)^[a-z0-9&_./-]+$") & t.rlike("[/_.-]"))
            & ~has(t, V.NOTICE_NUMBER_PREFIX)
            & (words >= 3)
            & has(t, V.CONTEXT_POSITIVE)
        )
        return F.when(usable, t)

    return let(clean_title(c), judge)


_BLOCK = r"(?i)<(?:h[1-6]|div|p|li|a)(?!\w)[^>]*>([\s\S]*?)</(?:h[1-6]|div|p|li|a)>"
_MARKER = r"\b(?:advertisement|advt\.?)\s*(?:no\.?|number|#)?\s*[:\-]?"
_STRONG_START = (
    r"\b(?:recruitment|engagement|appointment|filling up|applications? (?:are )?invited|invites? applications?)\b"
)


def _before_last(text: Column, pattern: str) -> Column:
    """Text before the last match, null without one."""
    greedy = r"(?is)^(.*)" + rx(pattern).replace("(?i)", "").replace("(?iu)", "")
    return F.when(has(text, pattern), F.regexp_extract(text, greedy, 1))


def context_title(before_html: Column, before_text: Column | None = None) -> Column:
    """The last descriptive block before a link, else the heading before the last notice number.

    `before_text` is the visible text of `before_html`, where it is known.
    """
    blocks = F.transform(
        F.regexp_extract_all(before_html, F.lit(_BLOCK), F.lit(1)), lambda b: descriptive_title(strip_html(b))
    )
    before_text = strip_html(before_html) if before_text is None else before_text
    last_block = let(F.array_compact(blocks), lambda a: F.when(F.size(a) > 0, F.element_at(a, F.lit(-1))))

    def heading(prefix: Column) -> Column:
        start = F.length(_before_last(prefix, _STRONG_START))
        cut = F.when((F.length(prefix) > 500) & start.isNotNull(), F.substring(prefix, start + 1, F.length(prefix)))
        return descriptive_title(head(clean(F.coalesce(cut, prefix)), 500))

    marked = let(tail(before_text, 12_000), lambda t: _before_last(t, _MARKER))
    return F.coalesce(last_block, let(tail(marked, 900), heading))


def nearest_notice_id(before_text: Column) -> Column:
    """The last usable notice number in the visible text before a link."""
    text = tail(before_text, 8_000)
    found = F.transform(F.regexp_extract_all(text, F.lit(rx(V.NOTICE_ID)), F.lit(0)), notice_id)
    return let(F.array_compact(found), lambda a: F.when(F.size(a) > 0, F.element_at(a, F.lit(-1))))


# --- labelled values ----------------------------------------------------------------------------
def plausible(c: Column, kind: str) -> Column:
    """A short labelled value with the evidence its kind needs, else null."""

    def judge(v: Column) -> Column:
        ok = (v != "") & (F.length(v) <= 180) & ~has(v, V.LAYOUT_TEXT)
        if kind == "date":
            ok = ok & parse_date(v).isNotNull()
        elif kind == "vacancy":
            ok = ok & ~v.rlike(r"^\d{1,2}[/.\-]\d{1,2}[/.\-]20\d{2}$") & has(v, V.PLAUSIBLE[kind])
        elif kind in V.PLAUSIBLE:
            ok = ok & has(v, V.PLAUSIBLE[kind])
        return F.when(ok, v)

    return let(clean(c), judge)


def labeled(text: Column, label: str, kind: str = "text") -> Column:
    """The value after `label` up to the next known label."""
    pattern = r"\b(?:" + label + r")\b\s*[:\-]?\s*(.{1,180}?)(?=\s{2,}|\b(?:" + V.NEXT_LABELS + r")\b|$)"
    return plausible(F.regexp_extract(text, rx(pattern), 1), kind)


def extract_labeled(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Adds the labelled value of each field of `V.LABELS` found in a text column."""
    return df.withColumns({f: labeled(F.col(column), V.LABELS[f][1], V.LABELS[f][0]) for f in fields})


# --- anchors ---------------------------------------------------------------------------------------
def anchor_context(pages: DataFrame) -> DataFrame:
    """Links with the markup before and around them.

    Offsets come from the gaps between the links of the page, and titles of
    links sharing a URL are looked up inside the page row, so nothing shuffles.
    """
    pattern = rx(V.ANCHOR)
    kept = [c for c in pages.columns if c != "html"]
    whole = F.regexp_extract_all(F.col("html"), F.lit(pattern), F.lit(0))
    gaps = F.split("html", pattern, -1)
    sizes = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("g"), whole.alias("w")),
                        lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("size")))
    # Running start offset of every link.
    starts = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), x["size"].alias("size")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    anchors = F.transform(
        _anchors(F.col("html")),
        lambda a: F.struct(
            canonical_url(a["href_raw"], F.col("url")).alias("href"), strip_html(a["inner"]).alias("anchor_title")
        ),
    )
    rows = pages.select(*kept, "html", anchors.alias("anchors"), starts.alias("starts"))
    titled = F.filter(
        F.transform(F.col("anchors"), lambda a: F.struct(a["href"].alias("href"), clean_title(a["anchor_title"]).alias("title"))),
        lambda a: a["href"].isNotNull() & (F.length(a["title"]) >= 10) & ~has(a["title"], V.GENERIC_TITLE) & has(a["title"], V.JOB_SIGNAL),
    )
    rows = rows.withColumn("titled", titled)
    exploded = rows.select(
        *kept, "html", "titled", F.posexplode(F.arrays_zip("anchors", "starts")).alias("pos", "a")
    )
    start, size = F.col("a.starts.start"), F.col("a.starts.size")
    from_ = F.greatest(F.lit(0), start - BEFORE_CHARS)
    same_url = F.filter("titled", lambda x: x["href"] == F.col("a.anchors.href"))
    return exploded.select(
        *kept,
        "pos",
        F.col("a.anchors.href").alias("href"),
        F.col("a.anchors.anchor_title").alias("anchor_title"),
        F.when(F.size(same_url) > 0, F.element_at(same_url, F.lit(-1))["title"]).alias("url_title"),
        F.substring(F.col("html"), from_ + 1, start - from_).alias("before_html"),
        F.substring(F.col("html"), from_ + 1, start + size + AFTER_CHARS - from_).alias("around_html"),
    )


def backfill_titles(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, anchor_title, title): generic links take the title of the page's
    last titled link to the same URL."""
    rows = anchor_context(pages)
    title = F.when(has("anchor_title", V.GENERIC_TITLE), F.coalesce("url_title", "anchor_title")).otherwise(
        F.col("anchor_title")
    )
    return rows.select("page_id", "pos", "href", "anchor_title", clean_title(title).alias("title"))


def anchor_candidates(pages: DataFrame) -> DataFrame:
    """Candidate notices read from the links of (page_id, source_id, url, html) pages."""
    rows = anchor_context(pages).where(F.col("href").isNotNull() & F.length("anchor_title").between(2, 220))
    rows = rows.where(~has("anchor_title", V.SUPPORTING_DOCUMENT))
    # Long texts are read once each, and only for links that got so far.
    rows = once(rows, _pdf=is_pdf("href"), _generic=has("anchor_title", V.GENERIC_TITLE))
    untitled = F.col("_generic") & F.col("url_title").isNull()
    rows = once(rows, _before=F.when(F.col("_pdf") | untitled, strip_html("before_html")))
    nearby = F.concat_ws(" ", tail(F.col("_before"), 500), "anchor_title")
    generic = (F.col("_pdf") & has(nearby, V.DOWNLOAD_ADVERTISEMENT)) | F.col("_generic")
    chosen = F.when(
        generic, F.coalesce(F.col("url_title"), context_title(F.col("before_html"), F.col("_before")), F.col("anchor_title"))
    ).otherwise(F.col("anchor_title"))
    rows = once(rows, title=clean_title(chosen)).where(
        F.length("title").between(5, 500) & ~has("title", V.GENERIC_TITLE) & has("title", V.JOB_SIGNAL)
    )
    named = F.concat_ws(" ", "title", "anchor_title")
    rows = rows.where(~has(named, V.RESULT_ONLY_TITLE) | has(named, "corrigendum|extension"))
    rows = once(rows, raw_text=strip_html("around_html")).where(has(F.concat_ws(" ", "title", "raw_text"), V.RECRUITMENT_TEXT))
    applies = has(F.concat_ws(" ", "anchor_title", "href"), r"\bapply\b") & ~F.col("_pdf")
    before = F.coalesce("_before", strip_html("before_html"))
    rows = rows.withColumns({"_applies": applies, "_dates": title_dates("title")})
    value = lambda f: labeled(F.col("raw_text"), V.LABELS[f][1], V.LABELS[f][0])
    facts = ["department", "qualification", "vacancy", "salary", "age_limit", "location", "application_fee",
             "selection_process", "posted_date"]
    return rows.select(
        "page_id", "source_id", "pos", "title",
        *[value(f).alias(f) for f in facts],
        F.coalesce("_dates.start", value("application_start_date")).alias("application_start_date"),
        F.coalesce("_dates.end", value("last_date")).alias("last_date"),
        F.when(F.col("_applies"), F.col("href")).alias("apply_link"),
        F.when(F.col("_applies"), F.col("url")).otherwise(F.col("href")).alias("notification_link"),
        origin("url").alias("official_website"),
        F.coalesce(nearest_notice_id(before), notice_id("raw_text")).alias("source_job_id"),
        F.col("url").alias("source_url"),
        content_hash("raw_text").alias("content_hash"),
        has(F.concat_ws(" ", "title", "raw_text"), V.HTML_AMENDMENT).alias("is_corrigendum"),
        "raw_text",
        F.lit("HTML").alias("extraction_method"),
    )


def drop_result_only(df: DataFrame, column: str = "title") -> DataFrame:
    return df.where(~has(column, V.RESULT_ONLY_TITLE))


def notice_title_rule(c: Column | str) -> Column:
    return (
        ~has(c, V.RESULT_ONLY_TITLE) & ~has(c, V.NOTICE_NOISE) & ~has(c, V.NOTICE_AMENDMENT) & has(c, V.NOTICE_POSITIVE)
    )


def is_recruitment_notice(df: DataFrame, column: str = "title") -> DataFrame:
    return df.where(notice_title_rule(column))


def open_only(df: DataFrame, domain: str, now: Column) -> DataFrame:
    """For the one source family that keeps archives: only still-open parsed deadlines."""
    family = has(col(domain), V.OPEN_ONLY_DOMAINS)
    return df.where(~family | F.coalesce(parse_date("last_date") > now, F.lit(False)))


# --- structured data ----------------------------------------------------------------------------------
# Levels of a payload that are one plan; deeper ones are looked for and followed as well.
FIRST_DEPTH = 4
# The JSON parser takes documents of this many nested levels.
JSON_DEPTH = 1_000


def _elements(json: Column) -> Column:
    """A JSON array as its element texts; anything else as a single element."""
    return F.when(json.startswith("["), F.from_json(json, "array<string>")).otherwise(F.array(json))


def _json(o: Column, *paths: str) -> Column:
    """First non-empty scalar of the paths, cleaned; null when there is none."""
    return F.coalesce(*[clean_or_null(F.get_json_object(o, f"$.{p}")) for p in paths])


def _place(location: Column) -> Column:
    address = F.get_json_object(location, "$.address")
    parts = [clean_or_null(F.get_json_object(location, f"$.address.{p}")) for p in ("addressLocality", "addressRegion", "addressCountry")]
    return F.when(address.startswith("{"), blank_to_null(F.concat_ws(", ", *parts))).otherwise(clean_or_null(address))


def _salary(o: Column) -> Column:
    base = F.get_json_object(o, "$.baseSalary")
    nested = F.coalesce(
        F.when(F.get_json_object(base, "$.value").startswith("{"), F.get_json_object(base, "$.value")), base
    )
    low, high = _json(nested, "minValue"), _json(nested, "maxValue")
    amount = F.coalesce(F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit(" - "), high)), low, high, _json(nested, "value"))
    parts = F.concat_ws(" ", _json(base, "currency"), amount, _json(nested, "unitText"))
    return F.when(base.startswith("{"), blank_to_null(parts)).otherwise(clean_or_null(base))


def _documents(script: Column) -> Column:
    """array<struct(path, json)>: the elements of a script, each followed by those of its graph, to any depth.

    The depth is followed by data, one level of all graphs a step; a script has no
    more levels than it names graphs, nor than the parser lets JSON nest. Paths hold
    the place in every graph on the way, so they sort in document order.
    """
    kind = "array<struct<path:array<int>,json:string>>"
    placed = lambda json, path: F.transform(_elements(json), lambda x, i: F.struct(F.concat(path, F.array(i)).alias("path"), x.alias("json")))

    def graph_of(element: Column) -> Column:
        graph = F.get_json_object(element["json"], "$['@graph']")
        return F.when(graph.isNull(), F.array().cast(kind)).otherwise(placed(graph, element["path"]).cast(kind))

    def step(state: Column, _: Column) -> Column:
        deeper = F.struct(F.flatten(F.transform(state["level"], graph_of)).alias("level"), F.concat(state["out"], state["level"]).alias("out"))
        return F.when(F.size(state["level"]) == 0, state).otherwise(deeper)

    named = F.size(F.split(script, "@graph", -1)) - 1
    start = F.struct(placed(script, F.array().cast("array<int>")).cast(kind).alias("level"), F.array().cast(kind).alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), F.least(named, F.lit(JSON_DEPTH))), start, step, lambda s: s["out"])
    return F.array_sort(walked)


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """Candidate notices from the JobPosting documents embedded in pages.

    Arrays and `@graph` are flattened to any depth, in document order; malformed JSON,
    which more than `JSON_DEPTH` nested levels are too, is ignored.
    """
    kept = [c for c in ("page_id", "source_id", "url") if c in pages.columns]
    scripts = F.filter(
        F.transform(F.regexp_extract_all("html", F.lit(rx(V.JSON_LD_SCRIPT)), F.lit(1)), lambda s: F.trim(s)),
        lambda s: F.try_parse_json(s).isNotNull(),
    )
    rows = pages.select(*kept, scripts.alias("scripts"))
    flat = F.flatten(F.transform("scripts", lambda s: F.transform(_documents(s), lambda d: d["json"])))
    objects = rows.select(*kept, F.posexplode(flat).alias("pos", "raw"))
    kind = F.get_json_object("raw", "$['@type']")
    posting = F.exists(_elements(kind), lambda t: F.lower(t) == "jobposting")
    objects = objects.where(posting).withColumn("o", F.get_json_object("raw", "$"))
    o = F.col("o")
    places = F.array_compact(F.transform(_elements(F.get_json_object(o, "$.jobLocation")), _place))
    identifier = F.get_json_object(o, "$.identifier")
    return objects.select(
        *[c for c in kept if c != "url"],
        "pos",
        _json(o, "title", "name").alias("title"),
        _json(o, "hiringOrganization.name", "hiringOrganization.legalName").alias("department"),
        _json(o, "qualifications", "educationRequirements", "experienceRequirements").alias("qualification"),
        _json(o, "totalJobOpenings").alias("vacancy"),
        _salary(o).alias("salary"),
        F.coalesce(blank_to_null(F.array_join(places, "; ")), _json(o, "jobLocationType")).alias("location"),
        blank_to_null(strip_html(_json(o, "description"))).alias("description"),
        _json(o, "validThrough").alias("last_date"),
        _json(o, "datePosted").alias("posted_date"),
        _json(o, "dateModified").alias("updated_date"),
        canonical_url(F.get_json_object(o, "$.url"), "url").alias("apply_link"),
        F.col("url").alias("notification_link"),
        canonical_url(_json(o, "hiringOrganization.sameAs", "hiringOrganization.url"), "url").alias("official_website"),
        F.coalesce(
            F.when(identifier.startswith("{"), _json(o, "identifier.value")).otherwise(clean_or_null(identifier)), notice_id(o)
        ).alias("source_job_id"),
        F.col("url").alias("source_url"),
        content_hash(o).alias("content_hash"),
        o.alias("raw_text"),
        F.lit(False).alias("is_corrigendum"),
        F.lit("JSON_LD").alias("extraction_method"),
    ).where(F.col("title").isNotNull())


# --- notice API -------------------------------------------------------------------------------------------
def _children(v: Column, path: Column) -> Column:
    """array<struct(path, v)>: the elements of an array or the values of an object, in order; empty for anything else."""
    kind = F.schema_of_variant(v)
    values = (
        F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        .when(kind.startswith("OBJECT"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))
    )
    placed = F.transform(values, lambda x, i: F.struct(F.concat(path, F.array(i)).alias("path"), x.alias("v")))
    return F.coalesce(placed, F.array().cast("array<struct<path:array<int>,v:variant>>"))


def api_records(payloads: DataFrame) -> DataFrame:
    """(payload_id, path, record, title): every object with a title-like key, at any depth.

    The first levels are one pass over the payloads: every level adds its children
    to what is known. Whether anything lies deeper is asked after them, and deeper
    levels are written before they are taken apart.
    """
    nodes = payloads.select("payload_id", "url", F.array().cast("array<int>").alias("path"), F.try_parse_json("payload").alias("v"))
    found, depth = [], 0
    while True:
        for _ in range(FIRST_DEPTH + 2 if not found else 1):
            self_ = F.array(F.struct("path", "v"))
            last = F.size("path") == depth
            nodes = nodes.select("payload_id", "url", F.inline(F.when(last, F.concat(self_, _children(F.col("v"), F.col("path")))).otherwise(self_)))
            depth += 1
        titles = [F.try_variant_get("v", f"$.{k}", "string") for k in V.API_TITLE_KEYS]
        title = F.coalesce(*[clean_or_null(t) for t in titles])
        kind = F.schema_of_variant("v")
        rows = written(
            nodes.where(kind.rlike("^(OBJECT|ARRAY)")).select("payload_id", "url", "path", F.when(kind.startswith("OBJECT"), title).alias("title"), F.to_json("v").alias("record"))
            .where(F.col("title").isNotNull() | (F.size("path") == depth)), "api-level"
        )
        found.append(rows.where(F.col("title").isNotNull() & (F.size("path") < depth)))
        held = rows.where(F.size("path") == depth)
        if held.isEmpty():
            break
        nodes = held.select("payload_id", "url", "path", F.try_parse_json("record").alias("v"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select("payload_id", "url", "path", "title", "record")


_STRING_TOKEN = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(\s*:)?'


def _record_urls(record: Column, base: Column) -> Column:
    """array<struct(url, key)>: URLs of every text value of a record with the key they stand under."""
    pattern = F.lit(_STRING_TOKEN)
    tokens = F.arrays_zip(
        F.regexp_extract_all(record, pattern, F.lit(1)).alias("text"),
        F.regexp_extract_all(record, pattern, F.lit(2)).alias("colon"),
    )
    pairs = F.aggregate(
        tokens,
        F.struct(F.lit("").alias("key"), F.array().cast("array<struct<text:string,key:string>>").alias("out")),
        lambda s, t: F.struct(
            F.when(t["colon"] != "", t["text"]).otherwise(s["key"]).alias("key"),
            F.when(t["colon"] != "", s["out"])
            .otherwise(F.concat(s["out"], F.array(F.struct(F.replace(t["text"], F.lit("\\/"), F.lit("/")).alias("text"), s["key"].alias("key")))))
            .alias("out"),
        ),
        lambda s: s["out"],
    )

    def address(p: Column) -> Column:
        text = clean(p["text"])
        attached = has(p["key"], V.API_ATTACHMENT_KEY) & has(text, r"^[^/]+\.pdf(?:\?.*)?$")
        link = (
            F.when(attached, F.concat(F.lit(V.API_ATTACHMENT_PATH), text))
            .when(has(head(text, 4), r"^api/"), F.concat(F.lit("/"), text))
            .when(has(head(text, 8), r"^https?://") | text.startswith("/"), text)
        )
        return F.struct(canonical_url(link, base).alias("url"), p["key"].alias("key"))

    return F.array_distinct(F.filter(F.transform(pairs, address), lambda x: x["url"].isNotNull()))


def api_date(c: Column) -> Column:
    return F.when(c.rlike(r"^20\d{2}-\d{2}-\d{2}"), F.regexp_replace(c, r"^(20\d{2})-(\d{2})-(\d{2})[\s\S]*$", "$3/$2/$1")).otherwise(c)


def ingest_notice_api(payloads: DataFrame, source_url: str, organisation: str, document_host: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, counts per payload) of (payload_id, url, payload) API answers."""
    records = api_records(payloads).withColumn("urls", _record_urls(F.col("record"), F.col("url")))
    first = lambda keys: _json(F.col("record"), *keys)
    pdf = F.filter("urls", lambda u: is_pdf(u["url"]) & (host(u["url"]) == document_host))
    redirect = F.filter("urls", lambda u: has(F.concat_ws(" ", u["key"], u["url"]), V.API_REDIRECT))
    staged = records.withColumns(
        {
            "_pdf": F.try_element_at(pdf, F.lit(1))["url"],
            "_apply": F.try_element_at(redirect, F.lit(1))["url"],
            "_dates": title_dates("title"),
        }
    )
    accepted = (
        F.length("title").between(8, 500) & notice_title_rule("title")
        & (F.col("_pdf").isNotNull() | F.col("_apply").isNotNull())
    )
    # Both results read the records, which are made once.
    staged = written(staged.withColumn("accepted", accepted), "api-records")
    counts = staged.groupBy("payload_id").agg(
        F.count(F.lit(1)).alias("records_scanned"),
        F.sum(F.size("urls")).alias("raw_links"),
        F.sum(F.when(F.col("accepted"), F.greatest(F.lit(1), F.size("urls"))).otherwise(0)).alias("recruitment_links"),
    )
    related = F.concat_ws(" ", "title", F.array_join(F.transform("urls", lambda u: u["url"]), " "))
    description = first(V.API_DESCRIPTION_KEYS)
    candidates = staged.where("accepted").select(
        "payload_id",
        "path",
        head(F.col("title"), 240).alias("title"),
        F.lit(organisation).alias("department"),
        head(description, 4_000).alias("description"),
        F.coalesce(api_date(first(V.API_START_DATE_KEYS)), F.col("_dates.start")).alias("application_start_date"),
        F.coalesce(api_date(first(V.API_LAST_DATE_KEYS)), F.col("_dates.end")).alias("last_date"),
        F.col("_apply").alias("apply_link"),
        F.coalesce("_pdf", "_apply").alias("notification_link"),
        origin(F.lit(source_url)).alias("official_website"),
        F.coalesce(notice_id("record"), first(V.API_ID_KEYS)).alias("source_job_id"),
        F.lit(source_url).alias("source_url"),
        api_date(first(V.API_POSTED_KEYS)).alias("posted_date"),
        F.concat_ws(" ", "title", first(V.API_EXAM_KEYS), description, "record").alias("raw_text"),
        content_hash("record").alias("content_hash"),
        has(related, V.API_AMENDMENT).alias("is_corrigendum"),
        F.lit("HTML").alias("extraction_method"),
    )
    return candidates, counts


# --- routing -----------------------------------------------------------------------------------------------
def dispatch(sources: DataFrame, api_domain: str) -> DataFrame:
    """Adds `adapter`: the first collector that handles the source."""
    parser = F.col("parser_type")
    return sources.withColumn(
        "adapter",
        F.when((parser == "PDF_NOTIFICATION") | has("start_url", r"\.pdf(?:$|\?)"), "document")
        .when((parser == "GOVERNMENT_HTML") & (F.lower("domain") == api_domain), "notice_api")
        .when(parser == "GOVERNMENT_HTML", "government_html")
        .otherwise("generic_html"),
    )
