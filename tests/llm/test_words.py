"""Words, tokens, prefix counts, packing, grammar shards and bundles without Spark."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gazette.llm import grammar, packing, prefix_counts, tokens, url_rules, warc, words

SIGNS = list("\u0378\u1c89abcXYZzé漢ß'rveldmst  \n\t\r .,!?|0129ΣİÉ́²Ⅷ😀　") + ["'s", "'re", "'ll", "<|endoftext|>", "<|startoftext|>", "<|endof", "  ", " the", "ing"]


def fuzz(n: int, size: int, seed: int = 5) -> list[str]:
    r = random.Random(seed)
    return ["", " ", *("".join(r.choice(SIGNS) for _ in range(r.randint(0, size))) for _ in range(n))]


def plain_words(text: str) -> list[str]:
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def test_words_are_those_of_the_pattern():
    texts = fuzz(500, 30)
    data, offsets = words.buffer_of(pa.array([*texts, None]))
    hashes, starts, ends, first = words.split_words(data, offsets)
    names: dict[str, int] = {}
    for i, text in enumerate([*texts, ""]):
        want = plain_words(text)
        got = [bytes(words.FOLD[data[a:b]]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
        assert got == want
        for w, h in zip(want, hashes[first[i] : first[i + 1]].tolist(), strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_shingles_of_long_short_and_empty_texts():
    texts = ["a b c d e f", "a b c", "", "b c d e f"]
    data, offsets = words.buffer_of(pa.array(texts))
    hashes, _, _, first = words.split_words(data, offsets)
    values, at = words.shingles(hashes, first)
    assert len(values) == 4 and values[1] == values[3] and len(set(values.tolist())) == 3
    assert at.tolist() == [0, 1, 6, 9]


def test_row_chunks_keep_every_row():
    offsets = np.array([0, 5, 5, 30, 31, 100])
    assert list(words.row_chunks(offsets, 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    pieces = tokens.Pieces(tokens.tokenizer_path(name))
    texts = fuzz(3000, 40)
    ids, first = pieces.encode(texts)
    for i, want in enumerate(pieces.library.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[i] : first[i + 1]].tolist() == want.ids, texts[i]


def test_unknown_rules_are_left_to_the_library(tmp_path):
    import json

    with open(tokens.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    pieces = tokens.Pieces(str(tmp_path / "other.json"))
    assert not pieces.known and tokens.Pieces(tokens.tokenizer_path("word_bpe_49k.json")).known
    texts = fuzz(50, 30)
    ids, first = pieces.encode(texts)
    for i, want in enumerate(pieces.library.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[i] : first[i + 1]].tolist() == want.ids


def test_a_full_memory_starts_over(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 100)
    pieces = tokens.Pieces(tokens.tokenizer_path("byte_bpe_50k.json"))
    texts = fuzz(200, 40)
    ids, first = pieces.encode(texts)
    for i, want in enumerate(pieces.library.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[i] : first[i + 1]].tolist() == want.ids


def test_classes_agree_with_the_library():
    """The library cuts a run of one class as one piece: letter, number and sign next to each other are parted."""
    pieces = tokens.Pieces(tokens.tokenizer_path("byte_bpe_50k.json"))
    points = [p for p in range(0x3100) if pieces._plain(chr(p)) is not None]
    for probe in ("", "a", "1", "!"):
        text = "".join(f"{probe}{chr(p)}\n" for p in points)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        assert pieces.cut(chars, np.array([0, len(text)]))[0].tolist() == [a for _, (a, _) in pieces.library.pre_tokenizer.pre_tokenize_str(text)]


def test_every_prefix_count_is_that_of_the_library():
    counter = prefix_counts.PrefixCounter(tokens.tokenizer_path("byte_bpe_50k.json"))
    texts = fuzz(400, 25)
    counts, first = counter.prefixes(texts)
    for i, text in enumerate(texts):
        want = [len(e.ids) for e in counter.library.encode_batch([text[: k + 1] for k in range(len(text))], add_special_tokens=False)]
        assert counts[first[i] : first[i + 1]].tolist() == want, text


def test_prefix_counts_refuse_a_normalising_tokenizer():
    with pytest.raises(ValueError, match="byte-level"):
        prefix_counts.PrefixCounter(tokens.tokenizer_path("word_bpe_49k.json"))


@pytest.mark.parametrize("lengths", [[1], [2048], [5000, 1, 1, 1, 700], [100] * 333, [], [2047, 2047, 2]])
def test_packing_fills_every_sequence(lengths):
    rows = packing.pack(lengths)
    used: dict[int, list] = {}
    for doc, start, n, sequence, offset in rows:
        used.setdefault(sequence, []).append((offset, n))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == 2048 or at & (at - 1) == 0
    for doc, n in enumerate(lengths):
        at = 0
        for _, start, size, _, _ in sorted(r for r in rows if r[0] == doc):
            assert start == at
            at += size
        assert at == n


def test_packing_balances_the_cost():
    r = random.Random(1)
    lengths = [r.randint(1, 900) for _ in range(2000)]
    cost: dict[int, float] = {}
    size: dict[int, int] = {}
    for _, _, n, sequence, _ in packing.pack(lengths):
        cost[sequence] = cost.get(sequence, 0) + n + n * n / 2048
        size[sequence] = size.get(sequence, 0) + n
    full = [cost[s] for s in cost if size[s] == 2048]
    assert max(full) / (sum(full) / len(full)) < 1.5


class Bytes:
    """A file in memory with the reader's interface."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, offset: int, size: int) -> bytes:
        return self.data[offset : offset + size]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_grammar_round_trip_and_random_access(seed):
    r = np.random.default_rng(seed)
    phrase = r.integers(1, 50, 40)
    docs = [np.concatenate([phrase[: r.integers(0, 41)] if r.random() < 0.8 else r.integers(1, 50_000, r.integers(0, 30)), [0]]).astype(np.uint32) for _ in range(800)]
    docs.append(np.array([7] * 501 + [0], np.uint32))  # overlapping pairs
    ids, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    data = grammar.encode_shard([None, *range(1, len(docs))], ids, first, 50_257)
    assert len(data) < 2 * len(ids)
    shard = grammar.Shard(Bytes(data))
    assert shard.doc_ids[:2] == [None, 1] and (shard.first == first).all()
    for i, got in shard.documents(least_symbols=100):
        assert (got == docs[i]).all()
    for i in r.integers(0, len(docs), 100).tolist():
        a = int(r.integers(0, len(docs[i])))
        b = int(r.integers(a, len(docs[i]) + 1))
        assert (shard.document(i, a, b) == docs[i][a:b]).all()


@pytest.mark.parametrize("terminals", [65_536, 100_000])
def test_large_vocabularies_are_compressed_until_no_pair_is_frequent(terminals):
    r = np.random.default_rng(terminals)
    phrases = [r.integers(1, terminals, 12) for _ in range(300)]
    docs = [np.concatenate([phrases[j] for j in r.integers(0, 300, 20)] + [[0]]).astype(np.uint32) for _ in range(400)]
    ids, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    symbols, starts, _ = grammar.compress(ids, first, terminals)
    assert len(symbols) < len(ids) / 6
    inside = np.ones(len(symbols), bool)
    inside[starts[1:] - 1] = False
    pairs = np.stack([symbols[:-1], symbols[1:]], axis=1)[inside[:-1]]
    # Overlapping uses of a pair of equal symbols count once, so only pairs of different ones are bounded.
    uses = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0, return_counts=True)[1]
    assert uses.max() < grammar.LEAST_USES
    data = grammar.encode_shard([*range(len(docs))], ids, first, terminals)
    assert len(data) < 1.2 * len(ids)
    shard = grammar.Shard(Bytes(data))
    assert all((got == docs[i]).all() for i, got in shard.documents(least_symbols=500)) and (shard.document(7, 30, 50) == docs[7][30:50]).all()


def test_grammar_rules_stay_inside_documents():
    ids = np.array([5, 6, 0] * 200, np.uint32)
    first = np.arange(0, 601, 3)
    _, starts, rules = grammar.compress(ids, first, 10)
    assert len(rules) and (0, 5) not in [tuple(x) for x in rules.tolist()] and len(starts) == 201


def test_bundles_are_seekable_and_one_plain_stream():
    import zstandard

    bundle = warc.Bundle(frame_bytes=2000)
    kept = {}
    for page in range(50):
        payload = f"<p>{page}</p>".encode() * (page % 7) * 20
        own, data = warc.record(page, f"http://a.example/{page}", payload, warc.base32_sha1(payload), None, False)
        bundle.add(own, data)
        kept[own] = (page, payload, data)
    raw = b"".join(bundle.chunks())
    archive = warc.Archive(Bytes(raw))
    assert len(archive.frames) > 5
    for own, (page, payload, data) in kept.items():
        got = archive.record(own)
        assert got == data and warc.parse(got)[1] == payload and warc.parse(got)[0]["X-Page-ID"] == str(page)
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(d for _, _, d in kept.values())
    with pytest.raises(KeyError):
        archive.record(b"\1" * 16)


def test_the_automaton_agrees_with_regular_expressions():
    r = random.Random(3)
    letters = ["a", "b", "é", ".", url_rules.SEPARATOR, "/"]
    globs = ["".join(r.choice([*letters, "*", "**"]) for _ in range(r.randint(0, 9))) for _ in range(60)] + ["a" * 70 + "**", "**", ""]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(300)] + ["a" * 75, ""]

    def pattern(glob: str) -> re.Pattern:
        signs = re.findall(r"\*\*|\*|[^*]", glob)
        return re.compile("".join({"*": f"[^{url_rules.SEPARATOR}]*", "**": ".*"}.get(s, re.escape(s)) for s in signs), re.S)

    fits = url_rules.Automaton(globs).run(*words.buffer_of(pa.array([t.encode("utf-8", "surrogateescape") for t in texts], pa.binary())))
    for i, text in enumerate(texts):
        assert fits[i].tolist() == [bool(pattern(g).fullmatch(text)) for g in globs], text


@pytest.mark.parametrize("seed", range(4))
def test_frequent_pairs_are_those_of_a_full_count(seed):
    from collections import Counter

    rng = np.random.default_rng(seed)
    symbols = (rng.zipf(1.3, 60_000) % 3000).astype(np.int64)
    ends = np.sort(rng.choice(len(symbols) - 1, 300, replace=False))
    pairs = list(zip(symbols[:-1].tolist(), symbols[1:].tolist()))
    skipped = set(ends.tolist())
    uses = Counter(p for i, p in enumerate(pairs) if i not in skipped)
    for most in (1, 7, 40, 100_000):
        want = sorted((p for p in uses if uses[p] >= grammar.LEAST_USES), key=lambda p: (-uses[p], p))[:most]
        at, rank, found = grammar._frequent(symbols, ends, most)
        assert [(int(f) >> 32, int(f) & 0xFFFFFFFF) for f in found] == want
        place = {p: i for i, p in enumerate(want)}
        assert list(zip(at.tolist(), rank.tolist())) == [(i, place[p]) for i, p in enumerate(pairs) if i not in skipped and p in place]
