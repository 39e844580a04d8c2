"""Whitening against plain eigendecomposition, with ties, deficient ranks, odd vectors and small tables."""

from __future__ import annotations

import numpy as np
import pytest

from gazette.llm import whitening
from gazette.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<float>"


def brute_force(rows: list[tuple], components: int = 4) -> dict:
    """Per vector length: ids, integer vectors, n, sums, eigenvalues and vectors, by falling eigenvalue."""
    out = {}
    usable = [(i, e) for i, e in rows if e and all(c is not None and np.isfinite(c) for c in e)]
    for k in {len(e) for _, e in usable}:
        own = [(i, np.floor(256 * np.asarray(e, np.float32).astype(np.float64)).astype(np.int64)) for i, e in usable if len(e) == k]
        distinct = np.unique(np.stack([x for _, x in own]), axis=0)
        n, sums = len(distinct), distinct.sum(axis=0)
        centred = (n * distinct - sums) / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        out[k] = own, n, sums, values[::-1], vectors[:, ::-1]
    return out


def compare(got: list, rows: list[tuple]) -> None:
    expected = 0
    for own, n, sums, values, vectors in brute_force(rows).values():
        held = [j for j in range(min(4, len(values))) if values[j] > 1e-9 * max(values.sum(), 1e-300)]
        expected += len(own) * len(held)
        for j in held:
            mine = [r for r in got if r.component == j + 1 and r.n == n]
            by_id = {i: ((n * x - sums) / n @ vectors[:, j] / np.sqrt(values[j]), sum((n * a - b) ** 2 for a, b in zip(x.tolist(), sums.tolist()))) for i, x in own}
            signs = {np.sign(r.whitened * by_id[r.vec_id][0]) for r in mine if abs(r.whitened) > 1e-6}
            assert len(signs) == 1
            for r in mine:
                assert abs(abs(r.whitened) - abs(by_id[r.vec_id][0])) < 1e-8 and r.deviation == by_id[r.vec_id][1]
                assert abs(r.explained - values[j] / values.sum()) < 1e-12 and r.identity_error < 1e-9
    assert len(got) == expected


@pytest.mark.parametrize("dims,n,kind", [(16, 300, "plain"), (16, 9, "few rows"), (12, 200, "deficient"), (8, 300, "axes")])
@pytest.mark.parametrize("block", [1, 50])
def test_rank_one_updates_give_the_scatter(dims, n, kind, block):
    r = np.random.default_rng(dims)
    x = r.normal(size=(n, dims)) * 100
    if kind == "deficient":
        x[:, 6:] = x[:, :6]
    if kind == "axes":
        x = np.eye(dims)[r.integers(0, dims, n)] * 256
    parts = [whitening.Spectrum(dims) for _ in range(3)]
    for p, rows in zip(parts, np.array_split(x, 3), strict=True):
        for a in range(0, len(rows), block):
            p.add(rows[a : a + block])
    for p in parts[1:]:
        parts[0].merge(p)
    whole, away = parts[0], x - x.mean(axis=0)
    assert whole.n == n and np.allclose(whole.mean, x.mean(axis=0), atol=1e-10)
    assert np.abs(whole.u @ np.diag(whole.d) @ whole.u.T - away.T @ away).max() < 1e-11 * np.abs(away.T @ away).max()
    assert np.abs(whole.u.T @ whole.u - np.eye(whole.u.shape[1])).max() < 1e-12


def test_secular_roots_interlace_also_when_poles_nearly_meet():
    d = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0, 5.0 + 1e-12, 1e6])
    z = np.array([1e-8, 0.3, 0.2, 1e-3, 0.9, 0.1])
    values, u = whitening.rank_one(d, np.eye(6), z, 2.5)
    assert np.allclose(u @ np.diag(values) @ u.T, np.diag(d) + 2.5 * np.outer(z, z), rtol=1e-12, atol=1e-9)
    assert np.abs(u.T @ u - np.eye(6)).max() < 1e-13


def test_whitened_rows_agree_with_brute_force(spark):
    r = np.random.default_rng(3)
    stretch = np.array([3.0, 2.0, 1.5, 1.2, 1, 1, 1, 1])
    plain = [(i, [float(v) for v in np.float32(r.normal(size=8) * stretch)]) for i in range(60)]
    flat = [(100 + i, [float(i), 2.0 * i, 1.0]) for i in range(5)]
    odd = [(200, None), (201, []), (202, [1.0, None]), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, [-0.0] * 8)]
    copies = [(300, plain[0][1]), (300, plain[0][1]), (301, plain[1][1])]
    single = [(400, [1.0, 2.0]), (401, [1.0, 2.0])]
    rows = plain + flat + odd + copies + single
    table = spark.createDataFrame([(*x, "s") for x in rows], f"{VECTORS}, whitened string").repartition(5)
    got = whitening.whiten(table, block_rows=7).collect()
    compare(got, rows)
    assert {r.component for r in got if 100 <= r.vec_id < 105} == {1} and not {200, 201, 202, 203, 204, 400} & {r.vec_id for r in got}
    assert sum(r.vec_id == 300 for r in got) == 8
    unnamed = whitening.whiten(spark.createDataFrame([(None, [1.0]), (None, [2.0])], VECTORS)).collect()
    assert [r.vec_id for r in unnamed] == [None, None] and {round(abs(r.whitened), 12) for r in unnamed} == {1.0}


def test_whitening_of_nothing_and_of_large_numbers(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [0.5, 0.5])], VECTORS)).count() == 0
    big = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 5e8])]
    got = whitening.whiten(spark.createDataFrame(big, VECTORS)).collect()
    assert len(got) == 6 and {r.deviation for r in got} == {None} and max(r.identity_error for r in got) < 1e-9


def test_the_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [*r.embedding] if r.embedding is not None else None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op13_embedding_whitening"](spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), rows)
