"""Embedding whitening by incremental eigendecomposition.

Every partition keeps the spectrum (U, d) of the centred scatter U diag(d) U^T of
the vectors it has seen. A rank-one update of it solves the secular equation
1 + rho * sum(z_i^2 / (d_i - x)) = 0 for the new eigenvalues after deflating what
the update does not move, and turns U by the eigenvectors of the small problem.
Vectors enter by the rows of their block's triangular factor (the same scatter in
as many updates as dimensions, not as rows) and by the shift of the mean; blocks of
one row are the classical update by a centred vector. Spectra of partitions are
combined by rank-one updates too, in groups, round by round. A last distributed
pass projects all vectors on the orthonormal basis found (Rayleigh-Ritz), so the
components are exact to double precision whatever the updates have rounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gazette.scale import written

SCALE = 256
COMPONENTS = 4
#: Values of a block of vectors, and spectra that one task combines.
BLOCK_VALUES, FAN_IN = 1 << 20, 16
_EPS = np.finfo(np.float64).eps


def _secular(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z2 / (d - x)), d ascending and distinct: the nearest pole of each and its distance from it."""
    m = len(d)
    low, high = np.arange(m), np.minimum(np.arange(1, m + 1), m - 1)
    gap = np.append(np.diff(d), rho * z2.sum())
    last = np.arange(m) == m - 1
    value = lambda poles, x: 1 + rho * (z2 / (poles - x[:, None])).sum(axis=1)
    # A root in the upper half of its interval is measured from the upper pole.
    upper = (value(d[None, :] - d[low][:, None], gap / 2) < 0) & ~last
    pole = np.where(upper, high, low)
    poles = d[None, :] - d[pole][:, None]
    a = np.where(upper, -gap / 2, 0.0)
    b = np.where(upper, 0.0, np.where(last, gap, gap / 2))
    x = (a + b) / 2
    below = np.arange(m)[None, :] <= np.arange(m)[:, None]
    near, far = poles[np.arange(m), low], np.where(last, 1.0, poles[np.arange(m), high])
    for _ in range(60):
        away = poles - x[:, None]
        term = rho * z2 / away
        slope = term / away
        psi, phi = (term * below).sum(axis=1), (term * ~below).sum(axis=1)
        f = 1 + psi + phi
        a, b = np.where(f < 0, x, a), np.where(f > 0, x, b)
        if (done := (np.abs(f) <= 4 * m * _EPS * (1 + np.abs(psi) + np.abs(phi))) | (b - a <= 2 * _EPS * np.maximum(np.abs(a), np.abs(b)))).all():
            break
        # Both sums are replaced by one pole each with the same value and slope; the root of that is the next guess.
        dpsi, dphi = (slope * below).sum(axis=1), (slope * ~below).sum(axis=1)
        e, g = near - x, far - x
        s, t = dpsi * e * e, dphi * g * g
        c = 1 + psi - dpsi * e + phi - dphi * g
        with np.errstate(all="ignore"):
            p = -(c * (near + far) + s + t)
            q = c * near * far + s * far + t * near
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            h = -0.5 * (p + np.where(p < 0, -root, root))
            one, two = h / c, q / h
            guess = np.where((one > a) & (one < b), one, two)
            guess = np.where(last, near + s / np.where(last, 1 + psi - dpsi * e, 1), guess)
        inside = np.isfinite(guess) & (guess > a) & (guess < b)
        x = np.where(done, x, np.where(inside, guess, (a + b) / 2))
    return pole, x


def rank_one(d: np.ndarray, u: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of U (diag(d) + rho z z^T) U^T, rho over 0, eigenvalues ascending."""
    order = np.argsort(d, kind="stable")
    d, u, z = d[order], u[:, order], z[order].copy()
    size = np.linalg.norm(z)
    tol = 8 * _EPS * max(np.abs(d).max(initial=0.0), rho * size * size)
    # Deflation: directions that the update does not reach stay; of two equal eigenvalues one is turned out of reach.
    live = rho * size * np.abs(z) > tol
    at = np.flatnonzero(live)
    if len(at) > 1:
        r = np.hypot(z[at[:-1]], z[at[1:]])
        if (np.abs((d[at[1:]] - d[at[:-1]]) * z[at[:-1]] * z[at[1:]]) <= tol * r * r).any():
            d, u = d.copy(), u.copy()
            i = at[0]
            for j in at[1:]:
                r = math.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                if abs((d[j] - d[i]) * c * s) <= tol:
                    z[i], z[j] = 0.0, r
                    u[:, i], u[:, j] = c * u[:, i] - s * u[:, j], s * u[:, i] + c * u[:, j]
                    d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                    live[i] = False
                i = j
            at = np.flatnonzero(live)
    if not len(at):
        return d, u
    sorting = np.argsort(d[at], kind="stable")
    at = at[sorting]
    poles, z = d[at], z[at]
    pole, x = _secular(poles, z * z, rho)
    # away[j, i] = d_i - x_j without cancellation; the z that has exactly these roots makes the vectors orthogonal.
    away = (poles[None, :] - poles[pole][:, None]) - x[:, None]
    between = poles[None, :] - poles[:, None]
    np.fill_diagonal(between, 1.0)
    ratio = -away / np.where(np.eye(len(at), dtype=bool), 1.0, between.T)
    own = np.sqrt(np.abs(np.prod(ratio, axis=0) / rho))
    vectors = np.where(z < 0, -own, own)[None, :] / away
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    d, u = d.copy(), u.copy()
    u[:, at] = u[:, at] @ vectors.T
    d[at] = poles[pole] + x
    return d, u


class Spectrum:
    """Count, mean and the eigenpairs of the centred scatter of the vectors seen."""

    def __init__(self, dims: int, n: int = 0, mean=None, d=None, u=None):
        self.n = n
        self.mean = np.zeros(dims) if mean is None else np.asarray(mean, np.float64)
        self.d = np.zeros(0) if d is None else np.asarray(d, np.float64)
        self.u = np.zeros((dims, 0)) if u is None else np.asarray(u, np.float64).reshape(dims, -1)

    def update(self, v: np.ndarray, rho: float) -> None:
        """Add rho v v^T to the scatter."""
        size = np.linalg.norm(v)
        if not rho * size > 0:
            return
        v = v / size
        z = self.u.T @ v
        rest = v - self.u @ z
        again = self.u.T @ rest
        rest, z = rest - self.u @ again, z + again
        out = np.linalg.norm(rest)
        if out > 1e-13 and self.u.shape[1] < len(v):
            self.u, self.d, z = np.column_stack([self.u, rest / out]), np.append(self.d, 0.0), np.append(z, out)
        self.d, self.u = rank_one(self.d, self.u, z, rho * size * size)

    def absorb(self, n: int, mean: np.ndarray, rows: np.ndarray, weights: np.ndarray | None = None) -> None:
        """Add n vectors of the given mean whose centred scatter is the weighted sum of the rows' squares."""
        for i, row in enumerate(rows):
            self.update(row, 1.0 if weights is None else weights[i])
        if self.n:
            self.update(mean - self.mean, self.n * n / (self.n + n))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add(self, block: np.ndarray) -> None:
        """Add the rows of a block."""
        mean = block.mean(axis=0)
        self.absorb(len(block), mean, np.linalg.qr(block - mean, mode="r") if len(block) > 1 else block[:0])

    def merge(self, other: Spectrum) -> None:
        """Add another spectrum, one rank-one update per eigenpair."""
        self.absorb(other.n, other.mean, other.u.T, np.maximum(other.d, 0.0))


_SPECTRA = "k int, part bigint, n bigint, mean array<double>, d array<double>, u array<double>"


def _lists(rows: list[np.ndarray], kind=None) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else np.zeros(0), kind or pa.float64()))


def _spectra_table(found: list[tuple[int, int, Spectrum]]) -> pa.Table:
    k, part = [f[0] for f in found], [f[1] for f in found]
    s = [f[2] for f in found]
    return pa.table({
        "k": pa.array(k, pa.int32()), "part": pa.array(part, pa.int64()), "n": pa.array([x.n for x in s], pa.int64()),
        "mean": _lists([x.mean for x in s]), "d": _lists([x.d for x in s]), "u": _lists([x.u.ravel() for x in s]),
    })


def _by_length(batches, name: str = "x"):
    """(length, integer matrix, positions, batch) for the vectors of a batch, length by length."""
    for batch in batches:
        column = batch.column(batch.schema.names.index(name))
        lengths = np.diff(column.offsets.to_numpy())
        for k in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == k)
            own = column if len(at) == len(column) else column.take(pa.array(at))
            yield k, own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), k), at, batch


def _local_spectra(block_rows: int | None):
    def run(batches):
        from gazette.llm.files import partition_id

        states: dict[int, Spectrum] = {}
        waiting: dict[int, list[np.ndarray]] = {}

        def settle(k: int) -> None:
            rows = np.concatenate(waiting.pop(k)).astype(np.float64)
            size = block_rows or max(2 * k, BLOCK_VALUES // k)
            for a in range(0, len(rows), size):
                states.setdefault(k, Spectrum(k)).add(rows[a : a + size])

        for k, x, _, _ in _by_length(batches):
            waiting.setdefault(k, []).append(x)
            if sum(map(len, waiting[k])) >= max(2 * k, BLOCK_VALUES // k):
                settle(k)
        for k in [*waiting]:
            settle(k)
        yield from _spectra_table([(k, partition_id(), s) for k, s in states.items()]).to_batches()

    return run


def _combine(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    rows = table.to_pydict()
    k = rows["k"][0]
    total = Spectrum(k, rows["n"][0], rows["mean"][0], rows["d"][0], rows["u"][0])
    for n, mean, d, u in zip(rows["n"][1:], rows["mean"][1:], rows["d"][1:], rows["u"][1:], strict=True):
        total.merge(Spectrum(k, n, mean, d, u))
    return _spectra_table([(k, rows["part"][0] // FAN_IN, total)])


@dataclass
class Model:
    """The components of the vectors of one length, by falling eigenvalue."""

    n: int
    sums: np.ndarray  # exact, per dimension
    vectors: np.ndarray  # a column per component
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        # n * x - S is exact; the quotient is rounded once.
        top = self.n * max(int(np.abs(x).max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums.tolist()), default=0)
        if top < 1 << 62:
            return (self.n * x - self.sums) / self.n
        return x.astype(np.float64) - self.sums.astype(np.float64) / self.n

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        return self.centred(x) @ self.vectors[:, :components] / np.sqrt(self.values[:components])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n * x - S)^2; null where a sum is beyond 64 bits."""
        top = self.n * max(int(np.abs(x).max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums.tolist()), default=0)
        if top * top * max(x.shape[1], 1) < 1 << 63:
            away = self.n * x - self.sums
            return pa.array((away * away).sum(axis=1), pa.int64())
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums.tolist(), strict=True)) for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _products(models, project):
    """Per length, the upper triangle of sum(y^T y) over the rows y = project(model, x) of a partition."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for k, x, _, _ in _by_length(batches):
            if k in models.value:
                y = project(models.value[k], x)
                sums[k] = sums.get(k, 0) + y.T @ y
        for k, h in sums.items():
            i, j = np.triu_indices(len(h))
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(i), k, np.int32)), "i": i.astype(np.int32), "j": j.astype(np.int32), "h": h[i, j]})

    return run


def _gram(fit: DataFrame, models: dict[int, Model], project) -> dict[int, np.ndarray]:
    """The products of all rows, d(d+1)/2 values per length."""
    state = fit.sparkSession.sparkContext.broadcast(models)
    found = fit.mapInArrow(_products(state, project), "k int, i int, j int, h double").groupBy("k", "i", "j").agg(F.sum("h").alias("h")).toArrow()
    k, i, j, h = (found.column(c).to_numpy() for c in ("k", "i", "j", "h"))
    out = {}
    for length in np.unique(k).tolist():
        own = k == length
        full = np.zeros((i[own].max() + 1,) * 2)
        full[i[own], j[own]] = full[j[own], i[own]] = h[own]
        out[length] = full
    state.unpersist()
    return out


def usable(embedding: str) -> F.Column:
    """Not null, with no null, NaN or infinite component."""
    v = F.col(embedding)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def integers(embedding: str, scale: int = SCALE) -> F.Column:
    """The components as whole numbers, floor(scale * c)."""
    return F.transform(F.col(embedding), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))


def fit(rows: DataFrame, components: int | None = None, block_rows: int | None = None) -> dict[int, Model]:
    """The model of every vector length of `rows` (x array<bigint>), each distinct vector counted once."""
    distinct = written(rows.select("x").where(F.size("x") > 0).distinct(), "whitening-fit")
    # Exact sums: one row per length and dimension.
    sums, counts = {}, {}

    def totals(batches):
        held: dict[int, list] = {}
        for k, x, _, _ in _by_length(batches):
            n, s = held.get(k, (0, 0))
            held[k] = n + len(x), s + x.sum(axis=0)
        for k, (n, s) in held.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(k, k, np.int32)), "dim": np.arange(k, dtype=np.int32), "n": pa.array(np.full(k, n, np.int64)), "s": s})

    for r in distinct.mapInArrow(totals, "k int, dim int, n bigint, s bigint").groupBy("k", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        counts[r.k] = r.n
        sums.setdefault(r.k, np.zeros(r.k, np.int64))[r.dim] = r.s
    spectra = written(distinct.mapInArrow(_local_spectra(block_rows), _SPECTRA), "spectra")
    while spectra.groupBy("k").count().where("count > 1").limit(1).count():
        groups = spectra.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("k", "group")
        spectra = written(groups.applyInArrow(_combine, _SPECTRA), "spectra")
    models = {}
    for r in spectra.collect():
        basis = np.linalg.qr(np.asarray(r.u).reshape(r.k, -1))[0] if r.u else np.zeros((r.k, 0))
        models[r.k] = Model(counts[r.k], sums[r.k], basis, np.zeros(basis.shape[1]), 0.0)
    for k, h in _gram(distinct, {k: m for k, m in models.items() if m.vectors.shape[1]}, lambda m, x: m.centred(x) @ m.vectors).items():
        m = models[k]
        values, turn = np.linalg.eigh(h / m.n)
        values, turn = values[::-1], turn[:, ::-1]
        m.trace = float(values.sum())
        # Directions without variance can't be scaled to variance one.
        real = values > m.trace * k * _EPS
        vectors = m.vectors @ turn[:, real]
        vectors /= np.linalg.norm(vectors, axis=0)
        sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        m.vectors, m.values = vectors * sign, values[real]
        if components is not None:
            m.vectors, m.values = m.vectors[:, :components], m.values[:components]
    models = {k: m for k, m in models.items() if len(m.values)}
    for k, h in _gram(distinct, models, lambda m, x: m.whitened(x, len(m.values))).items():
        models[k].identity_error = float(np.abs(h / models[k].n - np.eye(len(h))).max())
    return models


_RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, block_rows: int | None = None,
) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite component are left
    out. Vectors of different lengths are whitened apart, each length by its own
    distinct vectors; empty vectors, and lengths whose vectors are all equal, have
    no component with variance and give no rows. Repeated rows count once in the
    fit and keep a row each in the result; rows without an id are kept with a null
    one. Components of equal eigenvalue are any basis of their space. A deviation
    beyond 64 bits is null. Other columns are not read.
    """
    rows = vectors.where(usable(embedding)).select(F.col(vec_id).cast("bigint").alias("vec_id"), integers(embedding, scale).alias("x"))
    models = fit(rows, components, block_rows)
    state = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for k, x, at, batch in _by_length(batches):
            m = state.value.get(k)
            if m is None:
                continue
            c = len(m.values)
            ids = batch.column(0).take(pa.array(np.repeat(at, c)))
            each = lambda v, kind: pa.array(np.full(len(x) * c, v), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), each(m.n, pa.int64()),
                    m.deviations(x).take(pa.array(np.repeat(np.arange(len(x)), c))), pa.array(m.whitened(x, c).ravel()),
                    pa.array(np.tile(m.values / m.trace, len(x))), each(m.identity_error, pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, _RESULT)
