"""URL expressions: canonical form, hosts, domains."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gazette import vocabulary as V
from gazette.functions.text import clean, col, has, kept, let

_PARTS = r"(?i)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
# Links that are canonical but for `www.`, closing slashes, query and fragment: scheme, host, path without its first slash, query.
_SEGMENT = r"[A-Za-z0-9_~\-][A-Za-z0-9_~.\-]*+"
_PLAIN_URL = (
    r"^(https?://)(?:www\.)?+([a-z0-9][a-z0-9.\-]*+)"
    rf"(?:/(/*+{_SEGMENT}(?:/++{_SEGMENT})*+)?+/*+)?+(\?[^#]*+)?+(?:#[\x20-\x7E]*+)?+\z"
)
_AUTHORITY = r"^((?:[^@]*@)?)([^@:\[\]\s<>^|%\"`{}\\]+)(:\d*)?$"
_PATH_UNSAFE = r"[^\x21-\x7E]|[\"<>`{}^]"


def _encode_path(path: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.split(path, ""),
            lambda ch: F.when(ch.rlike(_PATH_UNSAFE), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(
                ch
            ),
        ),
        "",
    )
    return F.when(path.rlike(_PATH_UNSAFE), encoded).otherwise(path)


def _drop_dot_segments(path: Column) -> Column:
    """Resolve `.` and `..` path segments."""
    walked = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == ".", kept)
        .when(part == "..", F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept))
        .otherwise(F.concat(kept, F.array(part))),
    )
    folded = F.concat(F.array_join(walked, "/"), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), folded).otherwise(path)


def _sorted_query(query: Column, tracking: str, sort: bool) -> Column:
    """Query text without tracking parameters, form-encoded, sorted by name."""
    plain = r"^[A-Za-z0-9*._-]*$"

    def form(text: Column) -> Column:
        return F.when(text.rlike(plain), text).otherwise(F.url_encode(F.coalesce(F.try_url_decode(text), text)))

    def decoded(text: Column) -> Column:
        return F.when(text.rlike(plain), text).otherwise(F.coalesce(F.try_url_decode(text), text))

    pairs = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda p: p != "")
    named = F.transform(
        pairs,
        lambda p, i: F.struct(
            decoded(F.substring_index(p, "=", 1)).alias("name"),
            i.alias("i"),
            F.concat(
                form(F.substring_index(p, "=", 1)),
                F.lit("="),
                form(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")),
            ).alias("text"),
        ),
    )
    kept = F.filter(named, lambda x: ~x["name"].rlike("(?i)" + tracking))
    kept = F.array_sort(kept) if sort else kept
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "&")
    return let(text, lambda t: F.when(t == "", F.lit("")).otherwise(F.concat(F.lit("?"), t)))


def _host(authority: Column, scheme: Column, drop_www: bool) -> Column:
    """Normalised authority, null when malformed."""
    host = F.lower(F.regexp_extract(authority, _AUTHORITY, 2))
    host = F.regexp_replace(host, r"^www\.", "") if drop_www else host
    port = F.regexp_extract(authority, _AUTHORITY, 3)
    default = F.when(scheme == "https", F.lit(":443")).otherwise(F.lit(":80"))
    port = F.when((port == default) | (port == ":"), F.lit("")).otherwise(port)
    return F.when(
        authority.rlike(_AUTHORITY) & (host != ""),
        F.concat(F.regexp_extract(authority, _AUTHORITY, 1), host, port),
    )


def _path(raw: Column) -> Column:
    path = F.when(raw == "", F.lit("/")).otherwise(_drop_dot_segments(_encode_path(raw)))
    return let(path, lambda p: F.when(p.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(p, "/+$", "")))


def _absolute(raw: Column, base: Column | None) -> Column:
    """Resolve a reference against a base URL."""
    if base is None:
        return raw
    scheme = F.regexp_extract(base, _PARTS, 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, _PARTS, 2))
    path = F.regexp_extract(base, _PARTS, 3)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), raw)
        .when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(origin, raw))
        .when(raw.startswith("?"), F.concat(origin, path, raw))
        .otherwise(F.concat(origin, folder, raw))
    )


@kept
def canonical_url(c: Column | str, base: Column | str | None = None) -> Column:
    """http(s) URL without fragment, `www.`, tracking parameters or trailing `/`.

    Parameters are sorted by name and form-encoded.  Anything else is null.
    """
    base = None if base is None else col(base)

    def build(url: Column) -> Column:
        part = lambda i: F.regexp_extract(url, _PARTS, i)
        scheme = F.lower(part(1))
        sorted_query = lambda text: let(text, lambda q: F.when(q == "", q).otherwise(_sorted_query(q, V.TRACKING_PARAM, True)))
        plain_query = F.when(url.contains("?"), sorted_query(F.regexp_extract(url, _PLAIN_URL, 4))).otherwise("")
        return F.when(
            url.rlike(_PLAIN_URL), F.concat(F.regexp_replace(url, _PLAIN_URL, "$1$2/$3"), plain_query)
        ).when(
            url.rlike(_PARTS),
            F.concat(scheme, F.lit("://"), _host(part(2), scheme, True), _path(part(3)), sorted_query(part(4))),
        )

    raw = clean(c)
    return let(
        raw, lambda r: F.when((r != "") & ~r.startswith("#"), let(_absolute(r, base), build))
    )


def correction_url(c: Column) -> Column:
    """Operator-entered link: tracking parameters go, host, order and fragment stay."""

    def build(url: Column) -> Column:
        part = lambda i: F.regexp_extract(url, _PARTS, i)
        scheme = F.lower(part(1))
        params = F.split(F.substring(part(4), 2, 1 << 30), "&")
        tracked = F.exists(
            params, lambda p: F.substring_index(p, "=", 1).rlike("(?i)" + V.CORRECTION_TRACKING_PARAM)
        )
        query = F.when(tracked, _sorted_query(part(4), V.CORRECTION_TRACKING_PARAM, False)).otherwise(part(4))
        path = F.when(F.length(part(3)) > 1, F.regexp_replace(part(3), "/+$", "")).otherwise(F.lit("/"))
        valid = url.rlike(_PARTS) & ~part(2).contains("@")
        return F.when(valid, F.concat(scheme, F.lit("://"), _host(part(2), scheme, False), path, query, part(5)))

    return let(c, build)


def plain_http_url(c: Column | str) -> Column:
    """True for an http(s) URL without credentials."""
    c = col(c)
    authority = F.regexp_extract(c, _PARTS, 2)
    return F.coalesce(c.rlike(_PARTS) & ~authority.contains("@") & authority.rlike(_AUTHORITY), F.lit(False))


def host(c: Column | str) -> Column:
    """Lower-case host without `www.`, null when the URL has none."""
    c = col(c)
    authority = F.regexp_extract(c, _PARTS, 2)
    name = F.regexp_replace(F.lower(F.regexp_extract(authority, _AUTHORITY, 2)), r"^www\.", "")
    return F.when(c.rlike(_PARTS), F.nullif(name, F.lit("")))


def origin(c: Column | str) -> Column:
    c = col(c)
    return F.when(
        c.rlike(_PARTS),
        F.lower(F.concat(F.regexp_extract(c, _PARTS, 1), F.lit("://"), F.regexp_extract(c, _PARTS, 2))),
    )


def path_and_query(c: Column | str) -> Column:
    c = col(c)
    path = F.regexp_extract(c, _PARTS, 3)
    return F.concat(F.when(path == "", F.lit("/")).otherwise(path), F.regexp_extract(c, _PARTS, 4))


def _bare(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def same_domain(url: Column | str, domain: Column | str) -> Column:
    """The host is the domain or one of its subdomains."""
    wanted = _bare(col(domain))
    name = host(url)
    return F.coalesce((name == wanted) | name.endswith(F.concat(F.lit("."), wanted)), F.lit(False))


def official_url(url: Column | str, domain: Column | str) -> Column:
    """`same_domain`, or both sides belong to the one allowed sibling family."""
    siblings = has(host(url), V.SIBLING_DOMAINS) & has(F.lower(col(domain)), V.SIBLING_DOMAINS)
    return same_domain(url, domain) | siblings


def https_upgrade(url: Column | str, domain: Column | str, start_url: Column | str) -> Column:
    """Canonical URL; a same-domain http link becomes https when the source is https."""
    return let(
        canonical_url(url, start_url),
        lambda u: F.when(
            u.startswith("http:") & F.lower(col(start_url)).startswith("https:") & same_domain(u, domain),
            F.regexp_replace(u, "^http:", "https:"),
        ).otherwise(u),
    )


def is_pdf(url: Column | str) -> Column:
    return has(url, V.PDF_LINK)
