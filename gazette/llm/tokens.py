"""Token ids of whole texts by a public tokenizer file, one library call per distinct piece.

The tokenizers library cuts a text into pieces (words with their space, runs
of signs, ...) and encodes each piece for itself. Here the pieces of a whole
chunk of texts are found at once from the classes of their characters, equal
pieces are recognised by hash, and only pieces not met before go to the
library. The class of a character that is unassigned here is asked of the
library, whose edition of Unicode may be another. Texts holding a special
string, and for a tokenizer that normalises also those with unassigned
characters or letters whose lower case depends on the neighbours (final
sigma), go to the library whole; so does every text if the file cuts by rules
other than the two known here.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

from gazette.llm.words import mix, powers

#: Pieces a worker remembers; when full it starts over.
REMEMBERED = 1_500_000
#: Characters worked on at once.
CHUNK_CHARS = 1 << 19
LETTER, NUMBER, SIGN, SPACE, UNASSIGNED = 1, 2, 3, 4, 5
_POINTS = 0x110000
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK, _QUOTE = ord(" "), ord("'")
#: The contractions that are pieces of their own: fixed values of both tokenizer files.
_SHORT, _PAIRS = "stmd", ("re", "ve", "ll")
#: How the word tokenizer file cuts: a fixed value that the cutting here follows.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str) -> str:
    """Where a named public tokenizer file lies; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, white space, other sign or nothing yet for every code point."""
    out = np.full(_POINTS, SIGN, np.uint8)
    points = [p for p in range(_POINTS) if not 0xD800 <= p < 0xE000]
    every = "".join(map(chr, points))
    points = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            out[points[found.start() : found.end()]] = kind
    out[[p for p in points.tolist() if unicodedata.category(chr(p)) == "Cn"]] = UNASSIGNED
    return out


def _joins_spaces(spec: dict) -> bool:
    """Byte-level pieces as they stand, a space with the word after it."""
    cutter = spec["pre_tokenizer"] or {}
    return spec["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]


def _drops_spaces(spec: dict) -> bool:
    """Composed, lower-cased pieces without white space, single digits, each with an end sign."""
    types = lambda part, name: [x["type"] for x in (part or {}).get(name, [])]
    if types(spec["normalizer"], "normalizers") != ["NFC", "Replace", "Lowercase"] or types(spec["pre_tokenizer"], "pretokenizers") != ["Split", "ByteLevel"]:
        return False
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    return split["pattern"].get("Regex") == WORD_PATTERN and split["invert"] and spec["model"]["end_of_word_suffix"] == "</w>"


class Pieces:
    """The pieces of a tokenizer file and their ids, remembered across batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.joined = _joins_spaces(spec)
        self.known = self.joined or _drops_spaces(spec)
        # Ids that begin a piece after a blank, or end a word: they part pieces that are encoded together.
        self.edge = np.zeros(self.library.get_vocab_size() + 1, bool)
        for token, number in self.library.get_vocab(with_added_tokens=False).items():
            self.edge[number] = token.startswith("\u0120") if self.joined else token.endswith("</w>")
        self.kinds = classes().copy()
        self._forget()

    def _forget(self) -> None:
        # Recent pieces are looked up apart, so that the large index is rebuilt seldom.
        self.old = self.recent = pd.Index(np.zeros(0, np.uint64))
        self.hashes = np.zeros(0, np.uint64)
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def _ask(self, char: str) -> int:
        """The class that the library takes a character for: it joins a piece of its own class."""
        for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", SIGN)):
            if len(self.library.pre_tokenizer.pre_tokenize_str(probe + char)) == 1:
                return kind
        return SPACE

    def _plain(self, text: str) -> str | None:
        """The text as its pieces are cut from it; None if only the library can tell."""
        if not self.known or any(s in text for s in self.specials):
            return None
        if text.isascii():
            return text if self.joined else text.lower()
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        unsure = np.unique(chars[self.kinds[chars] == UNASSIGNED]).tolist()
        if self.joined:
            for point in unsure:
                self.kinds[point] = self._ask(chr(point))
            return text
        if unsure or "Σ" in text:
            return None
        return unicodedata.normalize("NFC", text).lower()

    def cut(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece of the texts that lie one after another in `chars`."""
        n = len(chars)
        kind = self.kinds[chars]
        lead = np.zeros(n + 1, bool)
        lead[offsets] = True
        tail = lead[1:]
        lead = lead[:-1]
        before = np.concatenate([[0], kind[:-1]])
        before[lead] = 0
        after = np.concatenate([kind[1:], [0]])
        after[tail] = 0
        space = kind == SPACE
        blank = chars == _BLANK
        blank_before = np.concatenate([[False], blank[:-1]]) & ~lead
        if self.joined:
            start = ~space & (kind != before) & ~blank_before
            start |= space & ((before != SPACE) | ((after != SPACE) & (after != 0)))
        else:
            start = ~space & ((kind != before) | (kind == NUMBER))
        quotes = (chars == _QUOTE) & (before != SIGN)
        quotes = np.flatnonzero(quotes & ~blank_before if self.joined else quotes)
        closed = np.zeros(0, np.int64)
        if len(quotes):
            text = np.searchsorted(offsets, quotes, side="right") - 1
            stop = offsets[text + 1]
            one = np.where(quotes + 1 < stop, chars[np.minimum(quotes + 1, n - 1)], 0)
            two = np.where(quotes + 2 < stop, chars[np.minimum(quotes + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in _SHORT])
            pair = np.zeros(len(quotes), bool)
            for a, b in _PAIRS:
                pair |= (one == ord(a)) & (two == ord(b))
            size = np.where(short, 1, np.where(pair, 2, 0))
            quotes, size, stop = quotes[size > 0], size[size > 0], stop[size > 0]
            start[quotes + 1] = False
            closed = quotes + 1 + size
            start[closed[(closed < stop)]] |= ~space[closed[(closed < stop)]]
        starts = np.flatnonzero(start)
        if self.joined:
            return starts, np.append(starts[1:], n)
        # A piece ends where the next one starts or white space or the text begins to follow.
        bound = start | space | lead
        edges = np.flatnonzero(bound)
        return starts, np.append(edges, n)[np.searchsorted(edges, starts, side="right")]

    def numbers(self, texts: list[str], offsets: np.ndarray, big: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The remembered number, first character and end of every piece of `big`, the texts run together."""
        chars = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = self.cut(chars, offsets)
        if not len(starts):
            return starts, starts, ends
        n = len(chars)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((chars.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)) * powers(n), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * powers(n, _INVERSE)[starts] + ((ends - starts).astype(np.uint64) << np.uint64(40)))
        codes, distinct = pd.factorize(hashes)
        known = self.old.get_indexer(distinct)
        fresh = np.flatnonzero(known < 0)
        late = self.recent.get_indexer(distinct[fresh])
        known[fresh] = np.where(late >= 0, late + len(self.old), -1)
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            where = np.full(len(distinct), -1, np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            found = [big[a:b] for a, b in zip(starts[where[fresh]].tolist(), ends[where[fresh]].tolist(), strict=True)]
            if len(self.hashes) + len(fresh) > REMEMBERED and len(self.hashes):
                self._forget()
                return self.numbers(texts, offsets, big)
            self._learn(distinct[fresh], found)
            known[fresh] = len(self.hashes) - len(fresh) + np.arange(len(fresh))
        return known[codes], starts, ends

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces, those that keep apart in one text together."""
        apart = [not self.joined or (p[0] == " " and len(p) > 1 and not p[1].isspace()) for p in pieces]
        together, alone = [p for p, own in zip(pieces, apart, strict=True) if own], [p for p, own in zip(pieces, apart, strict=True) if not own]
        run = self._ids(["".join(together) if self.joined else " ".join(together)])[0]
        rest = self._ids(alone)
        edges = np.flatnonzero(self.edge[run])
        sizes = np.diff(np.append(edges, len(run)) if self.joined else np.concatenate([[-1], edges]))
        if len(sizes) != len(together):
            raise ValueError("pieces that lie apart were not encoded apart")
        apart = np.array(apart, bool)
        counts = np.empty(len(pieces), np.int64)
        counts[apart], counts[~apart] = sizes, [len(x) for x in rest]
        first = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(first[-1], np.uint32)
        whose = np.repeat(apart, counts)
        flat[whose] = run
        flat[~whose] = np.concatenate(rest) if rest else []
        self.remember(hashes, flat, counts)

    def remember(self, hashes: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.hashes = np.concatenate([self.hashes, hashes])
        if len(self.hashes) > 1.25 * len(self.old) + 20_000:
            self.old, self.recent = pd.Index(self.hashes), self.recent[:0]
        else:
            self.recent = pd.Index(self.hashes[len(self.old) :])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (n + 1 values)."""
        parts, counts = [], np.zeros(len(texts), np.int64)
        for rows, plain in self._groups(texts):
            if plain is None:
                ids = np.array(self.library.encode(texts[rows[0]], add_special_tokens=False).ids, np.uint32)
                counts[rows[0]] = len(ids)
                parts.append(ids)
                continue
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in plain])]).astype(np.int64)
            numbers, starts, _ = self.numbers(plain, offsets, "".join(plain))
            sizes = self.first[numbers + 1] - self.first[numbers]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[numbers] - ends + sizes, sizes)
            parts.append(self.flat[at])
            edge = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
            counts[rows[0] : rows[-1] + 1] = np.diff(edge)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def _groups(self, texts: list[str]):
        """Runs of neighbouring texts to be worked on at once; a text for the library comes alone with None."""
        rows: list[int] = []
        plain: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            own = self._plain(text)
            if rows and (own is None or size + len(own) > CHUNK_CHARS):
                yield rows, plain
                rows, plain, size = [], [], 0
            if own is None:
                yield [i], None
            else:
                rows.append(i)
                plain.append(own)
                size += len(own)
        if rows:
            yield rows, plain


_open: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The tokenizer of a file, opened once per worker."""
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]
