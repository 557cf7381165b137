"""Embedding whitening by incremental eigendecomposition.

Every partition of the fit list keeps a spectrum: count, mean, eigenvalues and eigenvectors of its centred scatter. New
rows are centred rank-one updates, each of which solves a secular equation for the new eigenvalues after deflation.
Spectra are combined by feeding the eigenpairs of one into the other as successive rank-one updates, in rounds. The
last spectrum spans the space in which a pass over all rows sums the centred products, whose eigenvectors rotate it
(Rayleigh-Ritz), so what rounding the updates left is gone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ship_by_value

#: Rows that are rotated into at most as many directions as a vector is long, each of them one update; 1: every row.
BLOCK = 500
#: Spectra that one task combines; components returned; entries are counted in parts of one over SCALE.
FAN, COMPONENTS, SCALE = 8, 4, 256
_EPS = float(np.finfo(np.float64).eps)
_SPECTRUM = "n bigint, sums array<decimal(38,0)>, mean array<double>, val array<double>, vec binary"


# ----------------------------------------------------------------- one spectrum


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z2 / (d - x))`` for ascending ``d`` and positive ``z2`` and ``rho``.

    Root i lies between ``d[i]`` and the next pole. Given as (origin, shift): the index of the nearer pole and the
    distance from it, so that differences to the poles keep their digits. All roots are iterated at once, by rational
    interpolation at the two poles around each, within brackets.
    """
    k = len(d)
    last = d[-1] + rho * z2.sum()
    poles = np.append(d, last)
    gap = poles[1:] - poles[:-1]
    mid = d + gap / 2
    value = 1 + rho * (z2 / (d[None, :] - mid[:, None])).sum(axis=1)
    origin = np.where(value >= 0, np.arange(k), np.arange(1, k + 1))
    base = poles[origin]
    low = np.where(value >= 0, 0.0, -gap / 2)
    high = np.where(value >= 0, gap / 2, 0.0)
    from_base = d[None, :] - base[:, None]
    left, right = poles[:-1] - base, poles[1:] - base
    below = np.tri(k)
    above = 1 - below
    x = (low + high) / 2
    for _ in range(80):
        away = from_base - x[:, None]
        away[away == 0] = 1e-300
        part = rho * z2 / away
        f = 1 + part.sum(axis=1)
        settled = np.abs(f) <= 4 * _EPS * (1 + np.abs(part).sum(axis=1))  # the sign of f is rounding from here on
        if settled.all():
            break
        slope = part / away
        psi, phi = (slope * below).sum(axis=1), (slope * above).sum(axis=1)
        low, high = np.where(f < 0, x, low), np.where(f >= 0, x, high)
        p, q = left - x, right - x
        with np.errstate(all="ignore"):
            c = f - p * psi - q * phi
            a = (p + q) * f - p * q * (psi + phi)
            b = p * q * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        new = np.where(settled, x, new)
        done = np.abs(new - x) <= _EPS * np.abs(new)
        x = new
        if done.all():
            break
    return origin, x


def rank_one(val: np.ndarray, vec: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of ``vec @ diag(val) @ vec.T + rho * v v^T``, ``rho`` > 0."""
    z = vec.T @ v
    size = float(np.sqrt(z @ z))
    if not rho > 0 or size == 0:
        return val, vec
    z, rho = z / size, rho * size * size
    tol = 8 * _EPS * max(float(np.abs(val).max()), rho)
    order = np.argsort(val, kind="stable")
    val, vec, z = val[order], vec[:, order].copy(), z[order]
    # deflation: directions that the update does not touch, then equal eigenvalues, rotated until one of them is free
    live = rho * np.abs(z) > tol
    kept = np.flatnonzero(live)
    for i, j in zip(kept[:-1], kept[1:]):
        if val[j] - val[i] <= tol:
            r = math.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            vec[:, [i, j]] = vec[:, [i, j]] @ np.array([[c, s], [-s, c]])
            z[i], z[j], live[i] = 0.0, r, False
    kept = np.flatnonzero(live)
    if len(kept):
        d, z = val[kept], z[kept]
        origin, shift = secular_roots(d, z * z, rho)
        poles = np.append(d, d[-1] + rho * (z * z).sum())
        # differences pole - root, by pole and root; then the update that has exactly these roots, for orthogonal vectors
        away = (d[:, None] - poles[origin][None, :]) - shift[None, :]
        away[away == 0] = -1e-300
        spread = d[:, None] - d[None, :]
        np.fill_diagonal(spread, 1.0)
        own = -np.diag(away)
        ratio = -away / -spread
        np.fill_diagonal(ratio, 1.0)
        z = np.sign(z) * np.sqrt(np.abs(own * ratio.prod(axis=1)))
        turn = z[:, None] / away
        turn /= np.sqrt((turn * turn).sum(axis=0))
        val[kept], vec[:, kept] = poles[origin] + shift, vec[:, kept] @ turn
    return val, vec


class Spectrum:
    """Count, exact sums, mean and eigenpairs of the centred scatter of some rows."""

    def __init__(self, size: int):
        self.n, self.sums = 0, [0] * size
        self.mean, self.val, self.vec = np.zeros(size), np.zeros(size), np.eye(size)

    def _toward(self, n: int, mean: np.ndarray) -> None:
        """The move of the mean is one update; afterwards the rows of the other part are counted."""
        total = self.n + n
        if self.n:
            self.val, self.vec = rank_one(self.val, self.vec, mean - self.mean, self.n / total * n)
        self.mean = self.mean + (mean - self.mean) * (n / total)
        self.n = total

    def add(self, rows: np.ndarray) -> None:
        """Whole numbers, one row each."""
        n = len(rows)
        self.sums = [a + int(b) for a, b in zip(self.sums, rows.sum(axis=0, dtype=object if np.abs(rows).max(initial=0) > 2**40 else np.int64))]
        rows = rows.astype(np.float64)
        mean = rows.sum(axis=0) / n
        self._toward(n, mean)
        if n > 1:
            rows = rows - mean
            for row in np.linalg.qr(rows, mode="r") if n > rows.shape[1] else rows:
                self.val, self.vec = rank_one(self.val, self.vec, row, 1.0)

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        if not self.n:
            self.n, self.mean, self.val, self.vec = other.n, other.mean, other.val, other.vec
            return
        self._toward(other.n, other.mean)
        for value, direction in zip(other.val, other.vec.T):
            self.val, self.vec = rank_one(self.val, self.vec, direction, float(value))

    def packed(self) -> pa.RecordBatch:
        cells = (self.n, [Decimal(x) for x in self.sums], self.mean.tolist(), self.val.tolist(), self.vec.tobytes())
        kinds = (pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, kinds)], ["n", "sums", "mean", "val", "vec"])

    @staticmethod
    def unpacked(row: dict) -> Spectrum:
        out = Spectrum(len(row["mean"]))
        out.n, out.sums = row["n"], [int(x) for x in row["sums"]]
        out.mean, out.val = np.array(row["mean"]), np.array(row["val"])
        out.vec = np.frombuffer(row["vec"]).reshape(len(out.mean), -1).copy()
        return out


# ----------------------------------------------------------------- passes over the fit list


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _spectra(size: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Spectrum(size)
        for batch in batches:
            rows = matrix(batch.column(0)) if len(batch) else np.empty((0, size), np.int64)
            for i in range(0, len(rows), block):
                out.add(rows[i : i + block])
        if out.n:
            yield out.packed()

    return run


def _combined(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    rows.sort(key=lambda r: (r["n"], r["vec"]))
    out = Spectrum.unpacked(rows[-1])
    for row in rows[:-1]:
        out.merge(Spectrum.unpacked(row))
    return pa.Table.from_batches([out.packed()])


def spectrum(fit: DataFrame, size: int, block: int = BLOCK) -> Spectrum:
    """Spectrum of all rows ``x`` of a table: one per partition, combined by ``FAN`` a round until one is left."""
    left = cut_lineage(fit.select("x").mapInArrow(_spectra(size, block), _SPECTRUM))
    while (count := left.count()) > 1:
        slots = -(-count // FAN)
        dealt = left.withColumn("slot", F.pmod(F.xxhash64("vec", "n"), F.lit(slots)))
        left = cut_lineage(dealt.groupBy("slot").applyInArrow(lambda t: _combined(t.drop_columns(["slot"])), _SPECTRUM))
    return Spectrum.unpacked(left.first().asDict())


def _products(mean: np.ndarray, basis: np.ndarray):
    """Sum of the products of the centred rows in a basis, and of the rows themselves, one row per partition."""
    size = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if len(batch):
                y = (matrix(batch.column(0)).astype(np.float64) - mean) @ basis
                products, sums = products + y.T @ y, sums + y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([products.ravel().tolist()]), pa.array([sums.tolist()])], ["products", "sums"])

    return run


def _added(t: pa.Table) -> pa.Table:
    return pa.table({c: pa.array([matrix(t.column(c).combine_chunks()).sum(axis=0).tolist()]) for c in ("products", "sums")})


def products(fit: DataFrame, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products and sums over all rows; partial sums are added by ``FAN`` squared a round, so one row reaches the driver."""
    ddl = "products array<double>, sums array<double>"
    left = cut_lineage(fit.select("x").mapInArrow(_products(mean, basis), ddl))
    while (count := left.count()) > 1:
        slots = -(-count // (FAN * FAN))
        dealt = left.withColumn("slot", F.pmod(F.xxhash64("products"), F.lit(slots)))
        left = cut_lineage(dealt.groupBy("slot").applyInArrow(lambda t: _added(t.drop_columns(["slot"])), ddl))
    row = left.first()
    return np.array(row["products"]).reshape(basis.shape[1], -1), np.array(row["sums"])


# ----------------------------------------------------------------- whitening


class Whitening:
    """Count and sums of the fit list, its mean, the leading components and the share of variance of each."""

    def __init__(self, fit: DataFrame, size: int, components: int = COMPONENTS, block: int = BLOCK):
        found = spectrum(fit, size, block)
        self.n, self.sums = found.n, found.sums
        self.mean = np.array([x / self.n for x in self.sums])  # correctly rounded
        basis, _ = np.linalg.qr(found.vec[:, ::-1])
        inner, _ = products(fit, self.mean, basis)
        val, turn = np.linalg.eigh(inner / self.n)
        vec = basis @ turn
        # a second look from the found vectors, where off-diagonal products are rounding alone
        inner, _ = products(fit, self.mean, vec)
        val, turn = np.linalg.eigh(inner / self.n)
        vec, val = (vec @ turn)[:, ::-1], val[::-1]
        k = min(components, size)
        self.trace = float(np.trace(inner) / self.n)
        self.val, vec = val[:k], vec[:, :k]
        vec = vec / np.sqrt((vec * vec).sum(axis=0))
        self.vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(k)])  # the largest entry is positive
        #: components without variance have no whitened value
        self.solid = self.val > 16 * size * _EPS * max(self.trace, 0.0)
        self.identity_error = None
        if self.solid.any():
            scaled = self.vec[:, self.solid] / np.sqrt(self.val[self.solid])
            inner, sums = products(fit, self.mean, scaled)
            cov = inner / self.n - np.outer(sums, sums) / self.n**2
            self.identity_error = float(np.abs(cov - np.eye(len(cov))).max())


def _applied(n: int, sums: list[int], mean: np.ndarray, vec: np.ndarray, val: np.ndarray, solid: np.ndarray, trace: float, error: float | None):
    k = len(val)
    explained = [float(e) / trace if trace > 0 else None for e in val]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            far = max(abs(int(x.max())), abs(int(x.min())))
            if (n * far + max(map(abs, sums))) ** 2 * x.shape[1] < 2**63:
                off = n * x - np.array(sums, np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:  # beyond 64 bits on the way
                deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
                deviation = [v if v < 2**63 else None for v in deviation]
            centred = x.astype(np.float64) - mean
            for i in range(k):
                white = pa.array(centred @ vec[:, i] / math.sqrt(val[i])) if solid[i] else pa.nulls(len(x), pa.float64())
                same = lambda v, t: pa.array([v] * len(x), t)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), same(i + 1, pa.int32()), same(n, pa.int64()), pa.array(deviation, pa.int64()), white,
                     same(explained[i], pa.float64()), same(error, pa.float64())],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per vector and leading component.

    Entries become whole numbers, the floor of 256 times the entry. Vectors that are NULL or empty, or hold a NULL or
    non-finite entry, or one whose whole number has more than 64 bits, take no part, nor do those of another length than
    the most frequent one (of equally frequent ones the shortest). Every distinct vector counts once in the fit;
    repeated rows all come back, and so do NULL keys. Components stand by falling variance and are at most as many as
    entries; one without variance (fewer distinct vectors than components) has a NULL ``whitened``, with a trace of
    zero ``explained`` is NULL, and ``identity_error`` is taken over the others. A ``deviation`` beyond 64 bits is NULL.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    limit = float(2**63) / SCALE
    usable = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (v >= -limit) & (v < limit))
    src = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x")).filter("x IS NOT NULL AND size(x) > 0").filter(usable)
    src = src.select("key", F.transform("x", lambda v: F.floor(v * SCALE).cast("bigint")).alias("x"))
    src = cut_lineage(src)
    common = src.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    ddl = f"key {vectors.select(key).schema[0].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], ddl).withColumnRenamed("key", key)
    src = src.filter(F.size("x") == common["size"])
    fit = cut_lineage(src.select("x").distinct())
    w = Whitening(fit, common["size"], components, block)
    out = src.mapInArrow(_applied(w.n, w.sums, w.mean, w.vec, w.val, w.solid, w.trace, w.identity_error), ddl)
    return out.withColumnRenamed("key", key)


ship_by_value(__name__)
