"""Text expressions: cleaning, folding, cutting and pattern helpers (Columns only)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from gazette import vocabulary as V

# Java 17 treats `\b` as a Unicode boundary; the rules need the ASCII one.
_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_ODD_SPACE = r"\t\n\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Only what has to change: a run that is not one plain space.
# The look ahead passes over printable characters with one comparison.
_SPACES = rf"(?![\x21-\x7E])(?:[{_ODD_SPACE}][ {_ODD_SPACE}]*| [ {_ODD_SPACE}]+)"

# What `repair` can take from the start of a cleaned text; the first character alone rules most texts out.
_LEADING_NOISE = r"^(?:(?i:is|are)\s|\(?\d{1,2}[.)]|[\s:;,./-])"
_LEADING = "iIaA(0123456789 \t\n\x0b\f\r:;,./-"


def rx(pattern: str, ignore_case: bool = True) -> str:
    """A vocabulary pattern as a Java regex."""
    flags = "" if not ignore_case else "(?i)" if pattern.isascii() else "(?iu)"
    # Every pattern that opens with a boundary continues with a word character.
    start = r"(?<!\w)" if pattern.startswith(r"\b") else ""
    body = pattern[2:] if start else pattern
    return flags + start + body.replace(r"\b", _ASCII_BOUNDARY)


def kept(build: Callable[..., Column]) -> Callable[..., Column]:
    """Expressions over a column given by name are built once for a JVM; each takes up to hundreds of calls to it."""
    made: dict = {}

    @wraps(build)
    def get(*given) -> Column:
        if not all(isinstance(x, str | int | None) for x in given):
            return build(*given)
        jvm = SparkContext._jvm
        if made.get("jvm") is not jvm:
            made.clear()
            made["jvm"] = jvm
        if given not in made:
            made[given] = build(*given)
        return made[given]

    return get


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`.

    `element_at` knows its type once; `getItem` would derive it from the whole
    body again for every row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def present(c: Column | str) -> Column:
    """True when the value is neither null nor an empty string."""
    return F.coalesce(col(c) != "", F.lit(False))


def is_ascii(s: Column) -> Column:
    return F.length(s) == F.octet_length(s)


@kept
def clean(c: Column | str) -> Column:
    """NUL removed, whitespace runs collapsed, trimmed; null becomes ''."""

    def spaced(text: Column) -> Column:
        # Most texts have nothing to collapse, which one character class and a byte search tell at a fraction of the pattern's cost.
        even = ~text.rlike(r"[^\x20-\x7E]") & ~text.contains("  ")
        without = F.replace(text, F.lit("\x00"), F.lit(""))
        return F.trim(F.when(even, text).otherwise(F.regexp_replace(without, _SPACES, " ")))

    text = F.coalesce(col(c), F.lit(""))
    return spaced(text) if isinstance(c, str) else let(text, spaced)


def clean_or_null(c: Column | str) -> Column:
    return blank_to_null(clean(c))


def has(c: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    """Null-safe `pattern occurs in c`."""
    return F.coalesce(col(c).rlike(rx(pattern, ignore_case)), F.lit(False))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str, dict[str, str]]:
    """Compatibility decompositions of the BMP that yield ASCII letters or digits.

    Returns (letters that leave a mark behind, all single-letter sources, their
    replacements, other characters with their full replacement).
    """
    marked, source, target, other = [], [], [], {}
    for code in range(0x80, 0x10000):
        char = chr(code)
        folded = unicodedata.normalize("NFKD", char).lower()
        kept = [x for x in folded if x.isascii() and x.isalnum()]
        if folded == char or not kept:
            continue
        if len(kept) == 1 and folded[0] == kept[0]:
            source.append(char)
            target.append(kept[0])
            if len(folded) > 1:
                marked.append(char)
        else:
            other[char] = "".join(x if x.isascii() and x.isalnum() else " " for x in folded)
    return "".join(marked), "".join(source), "".join(target), other


def _char_class(chars: str) -> str:
    """A compact regex class of the given characters, with runs as ranges."""
    codes, parts, i = sorted(map(ord, chars)), [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(f"\\x{{{codes[i]:x}}}" + (f"-\\x{{{codes[j]:x}}}" if j > i else ""))
        i = j + 1
    return "[" + "".join(parts) + "]"


@kept
def fold(c: Column | str) -> Column:
    """Lower-case ASCII words separated by single spaces.

    Letters are decomposed first, so an accent acts as a separator after its
    base letter ("résumé" -> "re sume").
    """
    marked, source, target, other = _folding()

    def decompose(s: Column) -> Column:
        table = F.from_json(F.lit(json.dumps(other)), "map<string,string>")  # folded to one literal
        spelled = F.when(
            s.rlike(_char_class("".join(other))),
            F.array_join(
                F.transform(F.split(s, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
            ),
        ).otherwise(s)
        return F.translate(
            F.regexp_replace(spelled, "(" + _char_class(marked) + ")", "$1 "), source, target
        )

    def separated(text: Column) -> Column:
        flat = F.when(is_ascii(text), text).otherwise(decompose(text))
        return F.trim(F.regexp_replace(F.replace(flat, F.lit("\x00"), F.lit("")), "[^a-z0-9]+", " "))

    text = F.lower(F.coalesce(col(c), F.lit("")))
    return separated(text) if isinstance(c, str) else let(text, separated)


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def content_hash(c: Column | str) -> Column:
    return sha(clean(c))


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def first_match(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Zero-based offset of the first match, -1 when there is none."""
    return F.regexp_instr(c, F.lit(rx(pattern, ignore_case))) - 1


def cut_at(c: Column, patterns: list[tuple[str, bool]], minimum: int = 20) -> Column:
    """Truncate at the earliest of the patterns' first matches not before `minimum`.

    `patterns` are (pattern, ignore_case) pairs.  Only the first match of each
    pattern counts, even when it lies before `minimum`.
    """

    def cut(s: Column) -> Column:
        hits = [first_match(s, p, i) for p, i in patterns]
        usable = [F.when(h >= minimum, h) for h in hits]
        stop = F.coalesce(F.least(*usable) if len(usable) > 1 else usable[0], F.length(s))
        return F.trim(F.substring(s, F.lit(1), stop))

    return let(c, cut)


def last_index(c: Column, needle: str) -> Column:
    """Zero-based offset of the last occurrence of `needle`, -1 when absent."""
    at = F.instr(F.reverse(c), needle[::-1])
    return F.when(at > 0, F.length(c) - at - (len(needle) - 1)).otherwise(-1)


def bounded(c: Column, limit: int) -> Column:
    """At most `limit` characters, cut after a sentence (>= 55 %) or at a word."""

    def cut(prefix: Column) -> Column:
        sentence = F.greatest(*[last_index(prefix, x) for x in (". ", "; ", " • ")])
        at = F.when(sentence >= int(limit * 0.55), sentence + 1).otherwise(last_index(prefix, " "))
        return F.trim(F.substring(prefix, F.lit(1), F.when(at > 0, at).otherwise(limit)))

    return let(c, lambda s: F.when(F.length(s) <= limit, s).otherwise(let(head(s, limit), cut)))


@kept
def repair(c: Column | str, limit: int) -> Column:
    """Undo common double-encoding, strip list noise, bound the length.

    Null when nothing is left or broken characters remain.
    """

    def undo(text: Column) -> Column:
        fixed = text
        for broken, good in V.MOJIBAKE_REPAIRS:
            fixed = F.regexp_replace(fixed, broken, good)
        return F.when(text.rlike(r"[\\âÂàï\x{FFFD}]"), clean(fixed)).otherwise(text)

    def stripped(cleaned: Column) -> Column:
        text = F.regexp_replace(let(cleaned, undo), r"(?i)^(?:is|are)\s+", "")
        text = F.regexp_replace(text, r"^(?:\(?\d{1,2}[.)]\s*)+", "")
        text = F.trim(F.regexp_replace(text, r"^[\s:;,./-]+", ""))
        return let(
            text,
            lambda s: F.when((s != "") & ~s.rlike(V.RESIDUAL_MOJIBAKE), blank_to_null(bounded(s, limit))),
        )

    def sound(s: Column) -> Column:
        """Nothing of the above applies: broken characters are outside ASCII or backslashes."""
        noisy = (F.instr(F.lit(_LEADING), F.left(s, F.lit(1))) > 0) & s.rlike(_LEADING_NOISE)
        return (s != "") & is_ascii(s) & (F.octet_length(s) <= limit) & ~s.contains("\\") & ~noisy

    return let(clean(c), lambda s: F.when(sound(s), s).otherwise(stripped(s)))
