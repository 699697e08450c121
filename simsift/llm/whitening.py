"""Whitening of embeddings by incremental eigendecomposition.

1. One pass counts the vectors and adds up each dimension, in exact integers.
2. Every partition keeps the eigenpairs of its own scatter and takes its rows in
   blocks.  A block of b rows changes the scatter by its rows less their mean and
   by one row for the shift of the mean; a block of more rows than dimensions is
   first turned by an orthogonal factor into as many rows as dimensions, with
   the same scatter.  Each such row is one rank-one update: entries that do
   not change anything are deflated (small ones, and one of two at equal
   eigenvalues, by a rotation), the others' secular equation is solved, and the
   vectors follow from its roots.  With ``block = 1`` every input row is one update.
3. The partitions' spectra are combined FAN at a time, in rounds: the eigenpairs
   of one are successive rank-one updates of the other, and one more for the
   distance of their means.
4. Rayleigh-Ritz: the basis is made orthonormal, one pass projects all centred
   rows on it and adds up their products, and the eigenvectors of that small
   matrix turn the basis into the components, to double precision whatever the
   updates' rounding was.

Vectors are centred exactly, ``(n * x - S) / n`` from integers, before anything is
multiplied.  The driver sees sums per dimension, one spectrum and one matrix of
dimensions by dimensions, never rows.

Defined results: a null or empty vector, or one with a null or non-finite entry,
has no rows in the result and no part in the fit; vectors of different lengths
raise ValueError; a null id stays null; repeated rows count each; equal
eigenvalues: any orthonormal basis of their space; a component without variance
(one row, equal rows, fewer rows than dimensions) has a null ``whitened``, and without any
variance ``explained`` and ``identity_error`` are null too; a deviation beyond a long is
null; an empty table gives an empty result; other columns are not looked at."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simsift.llm.common import materialize
from simsift.llm.vectors import floored, usable
from simsift.session import release

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BLOCK = 4_096        # rows of one block
FAN = 8              # spectra that one task combines in a round
_EPS = np.finfo(np.float64).eps
_LONG = (1 << 63) - 1


# --- rank-one updates ------------------------------------------------------------

def secular(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z2 / (d - root))`` for ascending d and positive z2, and
    ``delta[j, k] = d[j] - root[k]``.  Every root is kept as the distance from its
    nearer pole, so that delta has full relative precision.  Each step fits one
    pole on both sides of the root; a step that leaves the bracket is a bisection."""
    n, index = len(d), np.arange(len(d))
    width = np.append(d[1:] - d[:-1], z2.sum())
    spread = d[:, None] - d[None, :]
    middle = 1 + (z2[:, None] / (spread - width / 2)).sum(0)
    right = (middle < 0) & (index < n - 1)
    gap = spread - np.where(right, width, 0.0)              # d[j] - origin[k]
    lo = np.where(right, -width / 2, np.where(middle < 0, width / 2, 0.0))
    hi = np.where(right, 0.0, np.where(middle < 0, width, width / 2))
    tau = (lo + hi) / 2
    below = index[:, None] <= index[None, :]
    live = index
    for _ in range(100):
        delta = gap[:, live] - tau[live]
        terms = z2[:, None] / delta
        f = 1 + terms.sum(0)
        hi[live] = np.where(f > 0, tau[live], hi[live])
        lo[live] = np.where(f > 0, lo[live], tau[live])
        more = np.abs(f) > 4 * _EPS * n * (1 + np.abs(terms).sum(0))
        more &= hi[live] - lo[live] > 2 * _EPS * np.maximum(np.abs(lo[live]), np.abs(hi[live]))
        if not more.any():
            break
        live, delta, terms, f = live[more], delta[:, more], terms[:, more], f[more]
        slope = terms / delta
        down = np.where(below[:, live], slope, 0).sum(0)
        up = slope.sum(0) - down
        at = np.arange(len(live))
        near = delta[live, at]
        last = live == n - 1
        far = delta[np.minimum(live + 1, n - 1), at]
        with np.errstate(all="ignore"):
            c = f - near * down - np.where(last, 0, far * up)
            b = c * (near + far) + near * near * down + far * far * up
            root = np.sqrt(np.maximum(b * b - 4 * c * near * far * f, 0))
            step = np.where(b <= 0, (b - root) / (2 * c), 2 * near * far * f / (b + root))
            step = np.where(last, near + near * near * down / c, step)
        there = tau[live] + step
        inside = np.isfinite(there) & (there > lo[live]) & (there < hi[live])
        tau[live] = np.where(inside, there, (lo[live] + hi[live]) / 2)
    return d + np.where(right, width, 0.0) + tau, gap - tau


def _deflated(values: np.ndarray, z: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Indices that an update changes.  Of two (nearly) equal values one entry is
    rotated to zero; ``values``, ``z`` and ``basis`` are changed in place."""
    size = z @ z
    tol = 8 * _EPS * max(values[-1], size)
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tol)
    a, b = live[:-1], live[1:]
    if not ((values[b] - values[a]) * np.abs(z[a] * z[b]) <= tol * (z[a] ** 2 + z[b] ** 2)).any():
        return live
    kept: list[int] = []
    for j in live.tolist():
        if kept:
            i = kept[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if abs((values[j] - values[i]) * c * s) <= tol:
                z[i], z[j] = 0.0, r
                low, high = values[i], values[j]
                values[i], values[j] = low * c * c + high * s * s, low * s * s + high * c * c
                basis[:, [i, j]] = np.column_stack([c * basis[:, i] - s * basis[:, j],
                                                    s * basis[:, i] + c * basis[:, j]])
                kept.pop()
        kept.append(j)
    return np.array(kept, dtype=np.int64)


class Spectrum:
    """Eigenpairs of the scatter of ``n`` vectors around their mean; values ascend."""

    def __init__(self, width: int, n: int = 0, mean=None, values=None, basis=None):
        self.n = n
        self.mean = np.zeros(width) if mean is None else np.array(mean)
        self.values = np.zeros(width) if values is None else np.array(values)
        self.basis = np.eye(width) if basis is None else np.array(basis).reshape(width, width)

    def rank_one(self, v: np.ndarray) -> None:
        """The scatter plus ``v v'``."""
        z = self.basis.T @ v
        if not (z @ z) > 0:
            return
        live = _deflated(self.values, z, self.basis)
        if not len(live):
            return
        order = live[np.argsort(self.values[live], kind="stable")]
        d, w = self.values[order], z[order]
        roots, delta = secular(d, w * w)
        # The entries whose exact roots these are: vectors from them are orthogonal.
        n, index = len(d), np.arange(len(d))
        poles = d[None, :] - d[:, None]
        next_poles = np.concatenate([poles[:, 1:], np.ones((n, 1))], axis=1)
        ratio = -delta / np.where(index[None, :] < index[:, None], poles, next_poles)
        vectors = np.copysign(np.sqrt(np.abs(ratio.prod(axis=1))), w)[:, None] / delta
        vectors /= np.linalg.norm(vectors, axis=0)
        self.basis[:, order] = self.basis[:, order] @ vectors
        self.values[order] = roots
        if (np.diff(self.values) < 0).any():
            order = np.argsort(self.values, kind="stable")
            self.values, self.basis = self.values[order], self.basis[:, order]

    def _shift(self, n: int, mean: np.ndarray) -> None:
        away, total = mean - self.mean, self.n + n
        if self.n:
            self.rank_one(np.sqrt(self.n / total * n) * away)
        self.mean += away * (n / total)
        self.n = total

    def add(self, rows: np.ndarray) -> None:
        mean = rows.mean(axis=0)
        centred = rows - mean
        if len(centred) > centred.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        if len(rows) > 1:
            for v in centred:
                self.rank_one(v)
        self._shift(len(rows), mean)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.rank_one(np.sqrt(value) * vector)
        self._shift(other.n, other.mean)


# --- passes over the rows ---------------------------------------------------------

class Centre:
    """Exact centring: count and sums of the integer vectors."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self._long = np.array(sums, dtype=np.int64)

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``; Python integers where a long could overflow."""
        if float(np.abs(x).max(initial=0)) * self.n < 2.0 ** 61:
            return x * self.n - self._long
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.times_n(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        away = self.times_n(x)
        if len(away) and float(np.abs(away).max()) ** 2 * away.shape[1] >= 2.0 ** 62:
            found = (away.astype(object) ** 2).sum(axis=1).tolist()
            return [v if v <= _LONG else None for v in found]
        return (away * away).sum(axis=1).tolist()


def _integers(column: pa.Array, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    rows, vectors = usable(column)
    return rows, floored(vectors, scale) + shift


def _sums(scale: int, shift: int):
    """(dim, n, total) of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, size = 0, None, 0.0
        for batch in batches:
            rows, x = _integers(batch.column(0), scale, shift)
            if len(rows):
                if total is not None and len(total) != x.shape[1]:
                    raise ValueError("vectors of different lengths")
                size += float(np.abs(x).astype(np.float64).sum(axis=0).max())
                if size > 2.0 ** 62:
                    raise ValueError("sums of a dimension do not fit a long")
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
                n += len(rows)
        if n:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)),
                                   pa.array(np.full(len(total), n)), pa.array(total)],
                                  names=["dim", "n", "total"])
    return run


def centre_of(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> Centre | None:
    """Count and sums of ``vectors`` (one column); None without usable rows."""
    found = vectors.mapInArrow(_sums(scale, shift), "dim int, n long, total long") \
        .groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    if not found:
        return None
    if len({r.n for r in found}) > 1:
        raise ValueError("vectors of different lengths")
    return Centre(found[0].n, [r.total for r in found])


_PART = "part long, n long, mean array<double>, vals array<double>, basis array<double>"


def _spectra(centre: Centre, scale: int, shift: int, block: int):
    """The spectrum of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, held, count = Spectrum(len(centre.sums)), [], 0
        for batch in batches:
            rows, x = _integers(batch.column(0), scale, shift)
            for a in range(0, len(rows), block):
                held.append(centre.rows(x[a:a + block]))
                count += len(held[-1])
                if count >= block:
                    mine.add(np.concatenate(held))
                    held, count = [], 0
        if held:
            mine.add(np.concatenate(held))
        if mine.n:
            yield pa.record_batch(
                [pa.array([TaskContext.get().partitionId()]), pa.array([mine.n]), pa.array([mine.mean]),
                 pa.array([mine.values]), pa.array([mine.basis.ravel()])],
                names=["part", "n", "mean", "vals", "basis"])
    return run


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("part")
    whole = None
    for r in frame.itertuples():
        one = Spectrum(len(r.mean), r.n, r.mean, r.vals, r.basis)
        if whole is None:
            whole = one
        else:
            whole.merge(one)
    return pd.DataFrame({"part": [frame["part"].iloc[0]], "n": [whole.n], "mean": [whole.mean],
                         "vals": [whole.values], "basis": [whole.basis.ravel()]})


def _products(centre: Centre, scale: int, shift: int, basis: np.ndarray, mean: np.ndarray):
    """Sum, and sum of products, of the rows of a partition on ``basis``, less
    ``mean`` there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        total, products, n = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            rows, x = _integers(batch.column(0), scale, shift)
            if len(rows):
                z = centre.rows(x) @ basis - mean
                total += z.sum(axis=0)
                products += z.T @ z
                n += len(rows)
        if n:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([total]),
                                   pa.array([products.ravel()])], names=["part", "total", "products"])
    return run


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("part")
    return pd.DataFrame({"part": [frame["part"].iloc[0]], "total": [np.sum(np.stack(frame["total"]), axis=0)],
                         "products": [np.sum(np.stack(frame["products"]), axis=0)]})


def _rounds(parts: DataFrame, combine: Callable[[pd.DataFrame], pd.DataFrame], schema: str, fan: int):
    """The one row that is left when neighbouring rows are combined ``fan`` at a
    time, round after round.  A task holds at most ``fan`` rows."""
    table = materialize(parts, "whiten-parts")
    top, step = table.agg(F.max("part")).first()[0], 1
    while top // step > 0:
        step *= fan
        bucket = F.floor(F.col("part") / F.lit(step)).cast("long")
        done = materialize(table.groupBy(bucket.alias("bucket")).applyInPandas(combine, schema), "whiten-round")
        release(table)
        table = done
    row = table.first()
    release(table)
    return row


class Whitening:
    """A fit: ``components`` (columns, unit length), their eigenvalues, the trace of
    the covariance, and the ranks with variance."""

    def __init__(self, centre: Centre, components: np.ndarray, values: np.ndarray, trace: float,
                 mean: np.ndarray, error: float | None):
        self.centre, self.components, self.values, self.trace = centre, components, values, trace
        self.mean, self.error = mean, error

    @property
    def matrix(self) -> np.ndarray:
        """Centred rows times this are whitened; nothing for ranks without variance."""
        return self.components[:, :len(self.values)] / np.sqrt(self.values)


def fit(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT,
        block: int = BLOCK, fan: int = FAN) -> Whitening | None:
    """Fit all usable rows of ``vectors`` (one column, the vector)."""
    centre = centre_of(vectors, scale, shift)
    if centre is None:
        return None
    width = len(centre.sums)
    spectrum = _rounds(vectors.mapInArrow(_spectra(centre, scale, shift, block), _PART), _merged, _PART, fan)
    basis = np.linalg.qr(np.array(spectrum.basis).reshape(width, width))[0]
    sums = "part long, total array<double>, products array<double>"
    ritz = _rounds(vectors.mapInArrow(_products(centre, scale, shift, basis, np.zeros(width)), sums), _added, sums, fan)
    small = np.array(ritz.products).reshape(width, width) / centre.n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    components = (basis @ turn)[:, :k]
    components /= np.linalg.norm(components, axis=0)
    components *= np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])])
    varied = int((values[:k] > width * _EPS * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    out = Whitening(centre, components, values[:varied], float(np.trace(small)), np.zeros(varied), None)
    if varied:
        out.mean = (np.array(ritz.total) / centre.n) @ (basis.T @ out.matrix)
        found = _rounds(vectors.mapInArrow(_products(centre, scale, shift, out.matrix, out.mean), sums),
                        _added, sums, fan)
        away = np.array(found.products).reshape(varied, varied) / centre.n - np.eye(varied)
        out.error = float(np.abs(away).max())
    return out


def _whitened(fitted: Whitening, k: int, scale: int, shift: int):
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    varied = len(fitted.values)
    explained = [float(v / fitted.trace) for v in fitted.values]
    explained += [0.0 if varied else None] * (k - varied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _integers(batch.column(1), scale, shift)
            n = len(rows)
            if not n:
                continue
            values = np.zeros((n, k))
            values[:, :varied] = fitted.centre.rows(x) @ fitted.matrix
            none = np.tile(np.arange(k) >= varied, n)
            many = pa.array(np.repeat(np.arange(n), k))
            yield pa.record_batch([
                batch.column(0).take(pa.array(rows)).take(many), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, fitted.centre.n)),
                pa.array(fitted.centre.deviation(x), pa.int64()).take(many),
                pa.array(values.ravel(), mask=none), pa.array(explained * n, pa.float64()),
                pa.array([fitted.error] * (n * k), pa.float64())], names=names)
    return run


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): up to
    ``k`` rows for every usable row of ``table``.  Entries become
    ``floor(scale * entry) + shift``; ``explained`` is a component's share of the
    whole variance, ``identity_error`` the largest entry of the whitened rows'
    covariance less the identity."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows.select("vec"), k, scale, shift, block, fan)
    if fitted is None:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    k = min(k, fitted.components.shape[1])
    return rows.mapInArrow(_whitened(fitted, k, scale, shift), schema).withColumnRenamed("id", id_col)
