"""Markup expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gazette.functions.text import clean, col, let

ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")]
REMOVED = [
    r"<script[\s\S]*?</script>",
    r"<style[\s\S]*?</style>",
    r"<noscript[\s\S]*?</noscript>",
    r"<[^>]+>",
]


# What any of the rules above starts from; most texts have none of it and pass them unread.
_ENTITY = "(?i)&(?:nbsp|amp|quot|#39|apos|lt|gt);"
_BLOCK = "(?i)<(?:script|style|noscript)"


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.regexp_replace(c, "(?i)" + entity, char)
    return c


def strip_html(c: Column | str) -> Column:
    """Visible text: entities decoded before and after the tags are removed."""

    def decoded(text: Column) -> Column:
        return F.when(text.contains("&") & text.rlike(_ENTITY), decode_entities(text)).otherwise(text)

    def without(text: Column, patterns: list[str]) -> Column:
        for pattern in patterns:
            text = F.regexp_replace(text, "(?i)" + pattern, " ")
        return text

    def untagged(text: Column) -> Column:
        blocks = F.when(text.rlike(_BLOCK), without(text, REMOVED[:-1])).otherwise(text)
        return F.when(text.contains("<"), without(blocks, REMOVED[-1:])).otherwise(text)

    text = let(F.coalesce(col(c), F.lit("")), decoded)
    return clean(let(let(text, untagged), decoded))
