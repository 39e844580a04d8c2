"""Exact token counts of every prefix by dynamic programming.

The last token of a prefix of a piece is the one vocabulary entry that ends
there and stays apart from the last token of what lies before it; so the count
of a prefix is the count of a shorter prefix plus one, and the library is asked
only whether two neighbouring tokens stay apart. Counts of pieces add up to
those of the text. With the count of every prefix at hand, how much of a text
fits a budget is a search, not another encoding.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from gazette.llm.tokens import SPACE, Pieces
from gazette.llm.words import without

LIMIT = 512
#: Token pairs a worker remembers.
PAIRS = 500_000
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_signs() -> list[str]:
    """How a byte-level vocabulary writes each byte: printable ones as themselves, the others from U+0100 on."""
    signs = {b: chr(b) for b in _PRINTED}
    for n, b in enumerate(x for x in range(256) if x not in signs):
        signs[b] = chr(256 + n)
    return [signs[b] for b in range(256)]


class PrefixCounter(Pieces):
    """Pieces that remember the token count of each of their prefixes instead of their ids."""

    def __init__(self, path: str):
        super().__init__(path)
        if not self.joined:
            raise ValueError("prefix counts need a byte-level tokenizer file without normalisation")
        self.signs = _byte_signs()
        self.vocabulary = set(self.library.get_vocab(with_added_tokens=False))
        self.longest = max(map(len, self.vocabulary))
        self.model = self.library.model
        self.apart: dict[tuple[str, str], bool] = {}
        self.runs: dict[str, int] = {}

    def _stays(self, left: str, right: str) -> bool:
        """Whether the library leaves these two tokens as they are."""
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            found = [t.value for t in self.model.tokenize(left + right)]
            known = self.apart[left, right] = found == ([left, right] if left else [right])
        return known

    def counts(self, piece: str) -> list[int]:
        """Tokens of every prefix of a piece, by characters."""
        if piece in ("'re", "'ve", "'ll"):
            return [1, 2, self._dp(piece)[2]]  # cut short, it is a quote and a letter
        return self._dp(piece)

    def _dp(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        text = "".join([self.signs[b] for b in data])
        vocabulary, stays, n = self.vocabulary, self._stays, len(text)
        last, count = [""] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                token = text[i:j]
                if token in vocabulary and (i == 0 or last[i]) and stays(last[i], token):
                    last[j], count[j] = token, count[i] + 1
                    break
        if n == len(piece):
            return count[1:]
        return [c for c, byte in zip(count[1:], [*data[1:], 0], strict=True) if byte & 0xC0 != 0x80]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        found = [self.counts(p) for p in pieces]
        self.remember(hashes, np.array([c for own in found for c in own], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _run(self, run: str) -> int:
        """Tokens of a run of white space that ends a text."""
        known = self.runs.get(run)
        if known is None:
            if len(self.runs) > 100_000:
                self.runs.clear()
            known = self.runs[run] = self.counts(run)[-1]
        return known

    def prefixes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token count of every prefix of every text, one text after another, and where each text's begin."""
        out, sizes = [], np.array([len(t) for t in texts], np.int64)
        for rows, plain in self._groups(texts):
            out.append(self._special(texts[rows[0]]) if plain is None else self._plain_prefixes(plain))
        return np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes)])

    def _plain_prefixes(self, texts: list[str]) -> np.ndarray:
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        big = "".join(texts)
        numbers, starts, ends = self.numbers(texts, offsets, big)
        if not len(numbers):
            return np.zeros(0, np.int64)
        sizes = ends - starts
        inner = self.flat[np.arange(len(big)) + np.repeat(self.first[numbers] - starts, sizes)].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(inner[ends - 1])])
        text_first = np.searchsorted(starts, offsets)
        before = total[:-1] - np.repeat(total[text_first[:-1]], np.diff(text_first))
        out = inner + np.repeat(before, sizes)
        # After the first character of a piece that goes on a run of white space, the prefix ends in the whole run.
        chars = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = self.kinds[chars] == SPACE
        follows = np.flatnonzero(blank[starts[1:]] & blank[starts[1:] - 1]) + 1
        follows = follows[~np.isin(starts[follows], offsets)]
        for i, a, b in zip(follows.tolist(), starts[follows - 1].tolist(), (starts[follows] + 1).tolist(), strict=True):
            out[b - 1] = before[i - 1] + self._run(big[a:b])
        return out

    def _special(self, text: str) -> np.ndarray:
        """Counts of a text that holds special strings: each is one token, and before its end the text it begins with."""
        out, base, rest = [], 0, text
        while True:
            at, special = min(((rest.find(s), s) for s in self.specials if s in rest), default=(-1, ""))
            if at < 0:
                return np.concatenate([*out, base + self.prefixes([rest])[0] if rest else np.zeros(0, np.int64)])
            part = self.prefixes([rest[: at + len(special) - 1]])[0]
            end = base + (int(part[at - 1]) if at else 0) + 1
            out += [base + part, np.array([end])]
            base, rest = end, rest[at + len(special) :]


_open: dict[str, PrefixCounter] = {}


def counter_of(path: str) -> PrefixCounter:
    if path not in _open:
        _open[path] = PrefixCounter(path)
    return _open[path]


def _columns(docs: DataFrame, path: str, text: str, fields: list[StructField], make: Callable) -> DataFrame:
    names = docs.columns
    others = without([c for c in names if c != text], [f.name for f in fields])

    def run(batches):
        counter = counter_of(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                texts = [t or "" for t in rows.column(names.index(text)).to_pylist()]
                counts, first = counter.prefixes(texts)
                yield pa.RecordBatch.from_arrays([*(rows.column(names.index(c)) for c in others), *make(texts, counts, first)], names=[*others, *(f.name for f in fields)])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in others), *fields]))


def prefix_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row with `prefix_tokens`, the token count of each prefix by characters, in place of its text.

    Null and empty texts have none. Other columns pass through; one of the name
    `prefix_tokens` is replaced.
    """

    def make(texts, counts, first):
        return [pa.ListArray.from_arrays(first.astype(np.int32), pa.array(counts.astype(np.int32)))]

    return _columns(docs, path, text, [StructField("prefix_tokens", ArrayType(IntegerType()))], make)


def measure(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """Every row with n_bytes, n_tokens, over_limit and fit_chars (the longest prefix of at most `limit` tokens) in place of its text.

    All of them are read off the counts of the prefixes. Null and empty texts
    have no bytes and no tokens. Other columns pass through; one with the name of
    a new column is replaced.
    """
    from pyspark.sql.types import BooleanType, LongType

    def make(texts, counts, first):
        size = np.diff(first)
        tokens = np.zeros(len(texts), np.int64)
        tokens[size > 0] = counts[first[1:][size > 0] - 1]
        at = np.flatnonzero(counts <= limit)
        whose = np.searchsorted(first, at, side="right") - 1
        fit = np.zeros(len(texts), np.int64)
        fit[whose] = at - first[whose] + 1  # the last of equal places stays
        return [pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(tokens), pa.array(tokens > limit), pa.array(fit)]

    fields = [StructField(n, LongType()) for n in ("n_bytes", "n_tokens")] + [StructField("over_limit", BooleanType()), StructField("fit_chars", LongType())]
    return _columns(docs, path, text, fields, make)
