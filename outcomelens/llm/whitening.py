"""Whitening of embeddings by an incremental eigendecomposition.

Entries become integers, x = floor(64 * c) + 1000000; as covariances don't see
the offset, all work is done on floor(64 * c).  The fit list has each distinct
vector once.  Every partition of it keeps a spectrum (count, mean, eigenvalues,
eigenvectors of the scatter matrix) and adds a vector by a centred rank-one
update: the new eigenvalues are the roots of the secular equation, solved
between neighbouring poles by rational interpolation; places with no part in the
update, and all but one of equal eigenvalues, are deflated.  ``LANES`` spectra of
a partition take turns with the rows, so that numpy updates them together.
Spectra are combined by rank-one updates with the other's scaled eigenvectors and
with the difference of the means, eight partitions at a time, until one is left.

A Rayleigh-Ritz refinement then passes over the fit list with the leading
eigenvectors and a few more: tasks add up X'(XQ), the small projected matrix is
diagonalised, and what is left over is corrected along the spectrum's other
eigenvectors; passes are repeated until nothing of weight is left over.

What reaches the driver is bounded by the square of the vectors' length.

Defined cases: rows whose vector is null, empty, of a length other than the
commonest (the smaller of two), or has a null or non-finite entry are dropped;
rows without vec_id and repeated rows stay, each.  64 * c beyond 2^53 counts as
2^53.  Components whose eigenvalue is under 1e-10 of the largest are left out, so
a table of equal vectors, like an empty one, gives no rows; of equal
eigenvalues any basis of unit vectors is taken, the same for all rows.
``deviation`` is null where it is beyond a long.  Vectors of thousands of entries
are taken, at the cost of their square in memory.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcomelens.llm.common import written

COMPONENTS = 16
GUARD = 8  # further vectors in the refinement's basis
LANES = 8
FAN = 8  # spectra combined by a task
PASSES = 6  # of the refinement, at most
LEAST = 1e-10  # of the largest eigenvalue: smaller ones are taken as zero
_EPS = np.finfo(float).eps
_LARGE = float(1 << 53)


class Spectrum(NamedTuple):
    """Spectra of L lanes: counts (L,), means (L, d), ascending eigenvalues (L, d) of the scatter, eigenvectors (L, d, d) as columns."""
    n: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def empty(lanes: int, d: int) -> Spectrum:
    return Spectrum(np.zeros(lanes), np.zeros((lanes, d)), np.zeros((lanes, d)), np.broadcast_to(np.eye(d), (lanes, d, d)).copy())


def secular(d: np.ndarray, z: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (L, m) of diag(d) + rho z z' and the differences d_j - value_i as (L, j, i).

    ``d`` ascends, and no z is zero.  Each root is looked for as its distance from the
    nearer pole, which keeps the differences exact to the last digits.
    """
    lanes, m = d.shape
    weight = rho[:, None] * z * z
    right = np.concatenate((d[:, 1:], d[:, -1:] + weight.sum(1, keepdims=True)), 1)
    half = (right - d) / 2
    pole = np.arange(m)
    left = pole[:, None] <= pole[None, :]  # poles j up to root i
    gap = d[:, :, None] - d[:, None, :]

    def sums(delta: np.ndarray) -> tuple[np.ndarray, ...]:
        part = weight[:, :, None] / delta
        slope = part / delta
        low, low_slope = np.where(left, part, 0).sum(1), np.where(left, slope, 0).sum(1)
        return low, part.sum(1) - low, low_slope, slope.sum(1) - low_slope

    psi, phi, _, _ = sums(gap - half[:, None, :])
    near = np.where((1 + psi + phi > 0) | (pole == m - 1), pole, pole + 1)
    origin = np.take_along_axis(d, near, 1)
    base = d[:, :, None] - origin[:, None, :]
    first, second = d - origin, right - origin
    at_left = near == pole
    lo = np.where(at_left, 0.0, -half)
    hi = np.where(at_left, np.where(pole == m - 1, 2 * half, half), 0.0)
    tau = (lo + hi) / 2
    for _ in range(80):
        psi, phi, dpsi, dphi = sums(base - tau[:, None, :])
        f = 1 + psi + phi
        done = np.abs(f) <= 4 * _EPS * m * (1 + np.abs(psi) + np.abs(phi))
        if done.all():
            break
        lo, hi = np.where(f < 0, tau, lo), np.where(f > 0, tau, hi)
        d1, d2 = first - tau, second - tau
        s, t = dpsi * d1 * d1, dphi * d2 * d2
        c = f - dpsi * d1 - dphi * d2
        a, b = c * (d1 + d2) + s + t, d1 * d2 * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[:, -1] = d1[:, -1] + s[:, -1] / c[:, -1]
        new = tau + step
        fine = np.isfinite(new) & (new > lo) & (new < hi)
        new = np.where(fine, new, (lo + hi) / 2)
        still = done | (new == tau) | (hi - lo <= _EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if still.all():
            break
        tau = np.where(done, tau, new)
    return origin + tau, base - tau[:, None, :]


def _rotation(d: np.ndarray, z: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z', the vectors from the weights that fit the roots found."""
    values, diff = secular(d, z, rho)
    gap = d[:, None, :] - d[:, :, None]
    one = np.arange(d.shape[1])
    gap[:, one, one] = 1
    fitted = np.sqrt(np.prod(np.abs(diff / gap), 2) / rho[:, None]) * np.sign(z)
    vectors = fitted[:, :, None] / diff
    vectors /= np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return values, vectors


def rank_one(values: np.ndarray, vectors: np.ndarray, y: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of the matrices after rho y y' was added to each."""
    z = np.matmul(y[:, None, :], vectors)[:, 0, :]
    size = rho * (z * z).sum(1)
    bound = 8 * _EPS * np.maximum(values[:, -1], size)
    some = size > 0
    plain = some & (np.diff(values, axis=1) > bound[:, None]).all(1) & (rho * np.sqrt((z * z).sum(1)) * np.abs(z).min(1) > bound)
    out, basis = values.copy(), vectors.copy()
    if plain.any():
        out[plain], turn = _rotation(values[plain], z[plain], rho[plain])
        basis[plain] = np.matmul(vectors[plain], turn)
    for k in np.flatnonzero(some & ~plain):
        out[k], basis[k] = _deflated(values[k], vectors[k], z[k], rho[k], bound[k])
    return out, basis


def _deflated(d: np.ndarray, u: np.ndarray, z: np.ndarray, rho: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """One update with deflation: in a run of equal values one direction takes the whole part of z, small parts stay as they are."""
    u, z = u.copy(), z.copy()
    ends = np.flatnonzero(np.append(np.diff(d) > bound, True))
    start = 0
    for end in ends + 1:
        if end - start > 1:
            part = z[start:end]
            length = np.linalg.norm(part)
            if length:
                h = part.copy()
                h[-1] += np.copysign(length, h[-1])
                h /= np.linalg.norm(h)
                u[:, start:end] -= 2 * np.outer(u[:, start:end] @ h, h)
                z[end - 1] = -np.copysign(length, part[-1])
                z[start:end - 1] = 0
        start = end
    live = rho * np.linalg.norm(z) * np.abs(z) > bound
    if live.any():
        value, turn = _rotation(d[None, live], z[None, live], np.array([rho]))
        d = d.copy()
        d[live] = value[0]
        u[:, live] = u[:, live] @ turn[0]
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


def add(s: Spectrum, x: np.ndarray) -> Spectrum:
    """Each lane's spectrum with one vector more, by a centred rank-one update."""
    y = x - s.mean
    values, vectors = rank_one(s.values, s.vectors, y, s.n / (s.n + 1))
    return Spectrum(s.n + 1, s.mean + y / (s.n + 1)[:, None], values, vectors)


def combined(a: Spectrum, b: Spectrum) -> Spectrum:
    """Lane by lane the spectrum of both row sets, by successive rank-one updates."""
    values, vectors = a.values, a.vectors
    for k in range(values.shape[1]):
        values, vectors = rank_one(values, vectors, b.vectors[:, :, k], np.maximum(b.values[:, k], 0))
    n = a.n + b.n
    share = np.divide(b.n, n, out=np.zeros_like(n), where=n > 0)
    gap = b.mean - a.mean
    values, vectors = rank_one(values, vectors, gap, a.n * share)
    return Spectrum(n, a.mean + gap * share[:, None], values, vectors)


def folded(s: Spectrum) -> Spectrum:
    """All lanes combined into one, halving their number each time."""
    while len(s.n) > 1:
        half = len(s.n) // 2
        whole = combined(Spectrum(*(p[:half] for p in s)), Spectrum(*(p[half:2 * half] for p in s)))
        s = whole if len(s.n) % 2 == 0 else Spectrum(*(np.concatenate((p, q[-1:])) for p, q in zip(whole, s)))
    return s


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


_ROW = "n double, mean binary, eigenvalues binary, eigenvectors binary"


def _row(s: Spectrum) -> pd.DataFrame:
    return pd.DataFrame([[s.n[0], *(np.ascontiguousarray(p[0]).tobytes() for p in s[1:])]], columns=["n", "mean", "eigenvalues", "eigenvectors"])


def _spectra(rows) -> Spectrum:
    mean = np.stack([np.frombuffer(r) for r in rows["mean"]])
    d = mean.shape[1]
    return Spectrum(np.array(rows["n"], float), mean, np.stack([np.frombuffer(r) for r in rows["eigenvalues"]]),
                    np.stack([np.frombuffer(r).reshape(d, d) for r in rows["eigenvectors"]]))


def _grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    s = None
    for batch in batches:
        if not len(batch):
            continue
        x = matrix(batch["y"]).astype(float)
        if s is None:
            s = empty(LANES if len(x) >= 4 * LANES * x.shape[1] else 1, x.shape[1])
        lanes = len(s.n)
        full = len(x) // lanes * lanes
        for k in range(0, full, lanes):
            s = add(s, x[k:k + lanes])
        for k, row in enumerate(x[full:]):
            one = add(Spectrum(*(p[k:k + 1] for p in s)), row[None])
            for p, q in zip(s, one):
                p[k] = q[0]
    if s is not None:
        yield _row(folded(s))


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    s = None
    for batch in batches:
        for k in range(len(batch)):
            one = _spectra(batch.iloc[k:k + 1])
            s = one if s is None else combined(s, one)
    if s is not None:
        yield _row(s)


def spectrum(fit: DataFrame) -> Spectrum:
    """The spectrum of the fit list's scatter matrix."""
    parts = max(fit.rdd.getNumPartitions(), 1)
    rows = fit.select("y").mapInPandas(_grow, _ROW)
    while parts > 1:
        parts = -(-parts // FAN)
        rows = written(rows, "spectra").repartition(parts).mapInPandas(_merge, _ROW)
    found = rows.collect()  # one
    return _spectra(pd.DataFrame([r.asDict() for r in found]))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, y (floor of 64 times each entry) of the rows that take part."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
            .filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine))
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    wide = F.lit(width[0]["d"] if width else 0)
    scaled = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * 64, F.lit(_LARGE)), F.lit(-_LARGE))).cast("long"))
    return rows.filter(F.size("v") == wide).select("vec_id", scaled.alias("y"))


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                y = matrix(batch["y"])
                exact = float(np.abs(y).max()) * len(y) < 2.0 ** 62
                s = y.sum(0) if exact else y.astype(object).sum(0)
                n, total = n + len(y), [int(a) for a in s] if total is None else [a + int(b) for a, b in zip(total, s)]
        if n:
            yield pd.DataFrame({"k": range(len(total)), "n": n, "s": [Decimal(a) for a in total]})

    rows = fit.mapInPandas(run, "k int, n long, s decimal(38,0)").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rows = sorted(rows.collect())  # one per dimension
    return (int(rows[0].n), [int(r.s) for r in rows]) if rows else (0, [])


def _added(parts: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Sums of binary columns of doubles, first in a few tasks, then here."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for row in batch[names].itertuples(index=False):
                row = [np.frombuffer(b) for b in row]
                total = row if total is None else [a + b for a, b in zip(total, row)]
        if total is not None:
            yield pd.DataFrame([[t.tobytes() for t in total]], columns=names)

    few = parts.repartition(4).mapInPandas(run, ", ".join(f"{n} binary" for n in names)).collect()
    return [sum(np.frombuffer(r[n]) for r in few) for n in names]


def _products(fit: DataFrame, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times the basis (both times n), and the sum of all squares."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, trace = np.zeros(basis.shape), 0.0
        for batch in batches:
            if len(batch):
                x = matrix(batch["y"]) - mean
                g += x.T @ (x @ basis)
                trace += float((x * x).sum())
        yield pd.DataFrame([[g.tobytes(), np.array([trace]).tobytes()]], columns=["g", "t"])

    g, trace = _added(fit.select("y").mapInPandas(run, "g binary, t binary"), ["g", "t"])
    return g.reshape(basis.shape), float(trace[0])


def refined(fit: DataFrame, n: int, mean: np.ndarray, s: Spectrum) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading eigenvalues and eigenvectors of the covariance, and its trace, by Rayleigh-Ritz passes over the fit list."""
    values, vectors = s.values[0, ::-1] / n, s.vectors[0][:, ::-1]
    k = min(COMPONENTS + GUARD, len(values))
    basis, _ = np.linalg.qr(vectors[:, :k])
    best = None
    for _ in range(PASSES):
        g, squares = _products(fit, mean, basis)
        small = basis.T @ g / n
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz = basis @ turn
        rest = g @ turn / n - ritz * theta
        size = np.abs(rest[:, :COMPONENTS]).max()
        if best is None or size < best[0]:
            best = size, theta, ritz
        if size <= 1e-14 * max(theta[0], 0) or k == len(values) or size > best[0]:
            break
        # what is left over lies along the other eigenvectors, whose eigenvalues the spectrum knows
        other, low = vectors[:, k:], values[k:]
        apart = theta[None, :] - low[:, None]
        apart = np.where(np.abs(apart) < 1e-9 * theta[0], np.inf, apart)
        basis, _ = np.linalg.qr(ritz + other @ ((other.T @ rest) / apart))
    _, theta, ritz = best
    keep = theta[:COMPONENTS] > LEAST * max(theta[0], 0)
    return theta[:COMPONENTS][keep], ritz[:, :COMPONENTS][:, keep], squares / n


class Whitening(NamedTuple):
    n: int
    sums: list  # exact, per dimension
    eigenvalues: np.ndarray  # falling
    components: np.ndarray  # (d, components), unit columns
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(s) for s in self.sums]) / self.n

    @property
    def factors(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)

    def deviations(self, y: np.ndarray) -> list:
        """Per row the exact sum of (n * x - sum)^2 over dimensions; None beyond a long."""
        most = self.n * float(np.abs(y).max(initial=0)) + max(abs(s) for s in self.sums)
        if y.shape[1] * most * most < 2.0 ** 62:
            apart = self.n * y - np.array(self.sums, np.int64)
            return (apart * apart).sum(1).tolist()
        apart = self.n * y.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (apart * apart).sum(1)]


def fitted(rows: DataFrame) -> tuple[DataFrame, Whitening | None]:
    """The fit list and what is learned from it."""
    fit = written(rows.select("y").distinct(), "fit-list")
    n, sums = totals(fit)
    if n < 2:
        return fit, None
    mean = np.array([float(s) for s in sums]) / n
    values, vectors, trace = refined(fit, n, mean, spectrum(fit))
    return fit, Whitening(n, sums, values, vectors, trace) if len(values) else None


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured on the list."""
    mean, factors, k = w.mean, w.factors, len(w.eigenvalues)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                z = (matrix(batch["y"]) - mean) @ factors
                total += z.sum(0)
                square += z.T @ z
        yield pd.DataFrame([[total.tobytes(), square.tobytes()]], columns=["a", "b"])

    total, square = _added(fit.mapInPandas(run, "a binary, b binary"), ["a", "b"])
    cov = square.reshape(k, k) / w.n - np.outer(total, total) / w.n ** 2
    return float(np.abs(cov - np.eye(k)).max())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, w: Whitening) -> DataFrame:
    """vec_id, deviation and the whitened entries of rows (vec_id, y)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                y = matrix(batch["y"])
                z = (y - w.mean) @ w.factors
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "deviation": pd.array(w.deviations(y), "Int64"), "z": list(z)})

    return rows.mapInPandas(run, "vec_id long, deviation long, z array<double>")


def digest(vectors: DataFrame) -> DataFrame:
    """Contract columns: a row per vector and component."""
    rows = usable(vectors)
    fit, w = fitted(rows)
    if w is None:
        return vectors.sparkSession.createDataFrame([], _OUT)
    out = whiten(rows, w).select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened"))
    share = F.lit([float(e / w.trace) for e in w.eigenvalues])
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
                      "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(identity_error(fit, w)).alias("identity_error"))
