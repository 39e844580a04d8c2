"""The learners against plain versions: per-coordinate FTRL row by row, and expectation maximisation over single documents."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from gazette.llm import linear, quality, toxicity
from gazette.llm.words import buffer_of


def plain_ftrl(rows, dim, alpha, beta, l1, l2, rounds):
    """Weights by coordinate, one row after another; the last coordinate is the bias, without L1."""
    z, n = {}, {}

    def weight(i):
        bound = 0.0 if i == dim else l1
        if abs(z.get(i, 0.0)) <= bound:
            return 0.0
        return -(z[i] - math.copysign(bound, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(rounds):
        for features, target in rows:
            w = {i: weight(i) for i in features}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in features.items())))
            for i, x in features.items():
                g = (p - target) * x
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return [weight(i) if i in z else 0.0 for i in range(dim + 1)]


def sample_rows(seed: int):
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(30)]
    return [(i, " ".join(r.choice(vocabulary, 12)) + (" vile" if i % 3 == 0 else ""), float(i % 3 == 0)) for i in range(60)]


def test_one_shard_is_plain_ftrl(spark):
    rows = sample_rows(1)
    dim = 1 << toxicity.DIMENSION_BITS
    settings = dict(alpha=0.3, beta=1.0, l1=0.2, l2=0.5, rounds=2)
    table = spark.createDataFrame([(0 if i < 30 else 1, t, y) for i, t, y in rows], "shard_key bigint, text string, target double")
    got = linear.fit(table, toxicity.featurize, dim, shards=1, **settings)
    ordered = sorted((0 if i < 30 else 1, t, y) for i, t, y in rows)
    plain = []
    for _, text, target in ordered:
        columns, values, _ = toxicity.featurize(*buffer_of(pa.array([text])))
        plain.append((dict(zip(columns.tolist(), values.tolist())) | {dim: 1.0}, target))
    want = plain_ftrl(plain, dim, **settings)
    assert np.allclose(got, want, atol=1e-9) and 0 < np.count_nonzero(got) < len({i for f, _ in plain for i in f})


def test_shards_mix_the_plain_changes(spark):
    # Two shards of one round: the accumulators move by the mean of what each shard alone would move them.
    rows = sample_rows(2)
    dim = 1 << toxicity.DIMENSION_BITS
    table = spark.createDataFrame([(i % 2, t, y) for i, t, y in rows], "shard_key bigint, text string, target double")
    got = linear.fit(table, toxicity.featurize, dim, l1=0.0, l2=0.0, shards=2, rounds=1)
    alone = [linear.fit(table.where(f"shard_key = {k}"), toxicity.featurize, dim, l1=0.0, l2=0.0, shards=1, rounds=1) for k in (0, 1)]
    # The word of the toxic rows has weight in both, hence in the mix, between them or near.
    text = buffer_of(pa.array(["vile"]))
    at = toxicity.featurize(*text)[0]
    assert (got[at] > 0).all() and all((a[at] > 0).all() for a in alone) and (got[at] <= np.maximum(*[a[at] for a in alone]) + 1e-9).all()


def plain_em(documents: list[list[int]], rounds: int = 100):
    """P(good) per document of votes (1 good, -1 bad, 0 none) and accuracies, document by document."""
    labellers = len(documents[0])
    accuracy = [0.8] * labellers
    for _ in range(rounds):
        good = []
        for votes in documents:
            a = b = 0.5
            for j, v in enumerate(votes):
                if v:
                    a, b = a * (accuracy[j] if v > 0 else 1 - accuracy[j]), b * (accuracy[j] if v < 0 else 1 - accuracy[j])
            good.append(a / (a + b))
        for j in range(labellers):
            right = sum(q if votes[j] > 0 else 1 - q for q, votes in zip(good, documents) if votes[j])
            accuracy[j] = min(0.99, max(0.05, (right + 8) / (sum(votes[j] != 0 for votes in documents) + 10)))
    return good, accuracy


def test_posteriors_agree_with_plain_expectation_maximisation():
    r = np.random.default_rng(4)
    labellers = len(quality.LABELLERS)
    truth = r.random(300) < 0.7
    skill = r.uniform(0.55, 0.95, labellers)
    documents = []
    for t in truth:
        right = r.random(labellers) < skill
        documents.append([0 if r.random() < 0.5 else (1 if t == ok else -1) for ok in right])
    code = {0: 0, 1: quality.GOOD, -1: quality.BAD}
    patterns = [sum(code[v] * 3**j for j, v in enumerate(d)) for d in documents]
    counts = {p: patterns.count(p) for p in patterns}
    got, accuracy = quality.posteriors(counts)
    want, plain = plain_em(documents)
    assert np.allclose([got[p] for p in patterns], want, atol=1e-6) and np.allclose(accuracy, plain, atol=1e-6)
    assert np.mean([(got[p] > 0.5) == t for p, t in zip(patterns, truth)]) > 0.85
