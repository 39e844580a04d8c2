"""URL filter: a bit-parallel automaton over all glob rules at once.

Every rule is a glob over the canonical URL, `.host`, a byte 0xFF that no text
holds, and the path: `*` stands for any bytes inside the host or inside the path,
`**` for any bytes at all. The
states of all globs lie side by side in 64-bit words. One Shift-And step per
byte moves every state of every glob for a whole block of URLs: shift, mask by
the byte's table, and keep the states that a wildcard lets stand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gazette.llm.words import buffer_of, row_chunks, without

#: Between host and path: in globs the character that stands for the byte 0xFF, which UTF-8 never uses.
SEPARATOR, _BETWEEN = "\udcff", 0xFF
_COLUMNS = "host string, path string, rule string, verdict string, matched_glob string"


@dataclass(frozen=True)
class Rule:
    """A glob with its verdict; `shown` names host-and-path rules, which outrank plain globs."""

    glob: str
    verdict: str
    shown: str | None = None


def host_rule(text: str, verdict: str) -> Rule:
    """`host/path`: the host and its subdomains, where the path starts as given."""
    host, _, path = text.partition("/")
    return Rule(f"*.{host.lower()}{SEPARATOR}/{path}**", verdict, text)


#: The rules every page is judged by.
HOST_RULES = (
    host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"),
)
#: What decides where no host rule fits; the last fitting one of the longest wins.
GLOBS = (
    Rule("**", "allow"),
    Rule(f"*{SEPARATOR}**.exe", "block"), Rule(f"*{SEPARATOR}**.zip", "block"), Rule(f"*{SEPARATOR}**/ads/**", "block"),
    Rule(f"*{SEPARATOR}**/login**", "block"), Rule(f"*.ads.*{SEPARATOR}**", "block"), Rule(f"*.tracker.*{SEPARATOR}**", "block"),
)


class Automaton:
    """All globs in one bit vector of as many 64-bit words as they need."""

    def __init__(self, globs: list[str]):
        first, last, letters, stays = [], [], [], []
        for glob in globs:
            first.append(len(letters))
            letters.append(None)  # the start state is never entered
            stays.append("")
            for sign in self._signs(glob):
                if sign in ("*", "**"):
                    stays[-1] = "**" if "**" in (sign, stays[-1]) else "*"
                else:
                    letters.append(sign)
                    stays.append("")
            last.append(len(letters) - 1)
        self.width = max(1, -(-len(letters) // 64))
        self.enter = np.zeros((256, self.width), np.uint64)
        self.stay = np.zeros((256, self.width), np.uint64)
        self.start = np.zeros(self.width, np.uint64)
        for state, letter in enumerate(letters):
            word, bit = state // 64, np.uint64(1 << state % 64)
            if letter is not None:
                self.enter[letter, word] |= bit
            if stays[state]:
                self.stay[:, word] |= bit
                if stays[state] == "*":
                    self.stay[_BETWEEN, word] &= ~bit
        for state in first:
            self.start[state // 64] |= np.uint64(1 << state % 64)
        self.last = np.array(last, np.int64)

    @staticmethod
    def _signs(glob: str):
        data, i = glob.encode("utf-8", "surrogateescape"), 0
        while i < len(data):
            if data[i] == ord("*"):
                wide = data[i : i + 2] == b"**"
                yield "**" if wide else "*"
                i += 1 + wide
            else:
                yield data[i]
                i += 1

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which globs match which whole strings: (strings, globs) booleans."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = offsets[:-1][order], lengths[order]
        state = np.repeat(self.start[None, :], len(order), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = len(order)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths[:live], -step, side="left"))
            byte = data[begin[:live] + step]
            now = state[:live]
            moved = now << one
            if self.width > 1:
                moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.enter[byte]) | (now & self.stay[byte])
        out = np.empty((len(order), len(self.last)), bool)
        out[order] = (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & one != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host up to `/`, `?`, `#` or the end, A-Z lower-cased, and the path up to `?`, `#` or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), letters, letters.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, url: str = "url", host_rules: tuple[Rule, ...] = HOST_RULES, globs: tuple[Rule, ...] = GLOBS) -> DataFrame:
    """Every page with host, path, rule, verdict and matched_glob in place of its url.

    Of the host rules that fit, the longest decides and is named in `rule`; of
    equally long ones the first. Where none fits, the longest fitting glob
    decides, the last of equally long ones, and `rule` is null. A null url and
    one without `://` have an empty host and path, which only globs can fit.
    Rows and other columns pass through; one with the name of a new column is replaced.
    """
    host, path = host_and_path(F.col(url))
    rules = [*sorted(host_rules, key=lambda r: -len(r.shown)), *sorted(reversed(globs), key=lambda r: -len(r.glob))]
    automaton = Automaton([r.glob for r in rules])
    shown, verdicts, names = [r.shown for r in rules], [r.verdict for r in rules], [r.glob.replace(SEPARATOR, " ") for r in rules]
    others = without([c for c in pages.columns if c != url], ["host", "path", "rule", "verdict", "matched_glob"])
    table = pages.select(*others, host.alias("host"), path.alias("path"), F.concat(F.encode(F.concat(F.lit("."), host), "UTF-8"), F.lit(bytes([_BETWEEN])), F.encode(path, "UTF-8")).alias("_canonical"))

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(len(others) + 2))
            for a, b in row_chunks(offsets):
                fits = automaton.run(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                best = fits.argmax(axis=1)
                best[~fits.any(axis=1)] = -1
                pick = lambda values, none=None: pa.array([values[i] if i >= 0 else none for i in best.tolist()], pa.string())
                kept = [batch.column(i).slice(a, b - a) for i in range(len(others) + 2)]
                yield pa.RecordBatch.from_arrays([*kept, pick(shown), pick(verdicts, "allow"), pick(names)], names=[*others, "host", "path", "rule", "verdict", "matched_glob"])

    from pyspark.sql.types import StructType

    return table.mapInArrow(run, StructType([*(table.schema[c] for c in others), *StructType.fromDDL(_COLUMNS).fields]))
