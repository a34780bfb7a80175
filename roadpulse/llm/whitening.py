"""Embedding whitening by spectral divide and conquer with QDWH polar decompositions.

Entries become whole numbers, x = floor(scale * c), so vectors can be compared exactly. The fit
list is each distinct vector once: a hot vector is merged within each task before the shuffle. Two
passes over it add up the sums and then the products of centred vectors (centred at the nearest
whole number, the rest of the mean is taken off exactly), in exact integers. What reaches the
driver is one number per pair of dimensions, however many vectors and tasks there are.

The covariance is split recursively: the polar factor U of (covariance - shift) has the spectral
projector (U + I) / 2 onto the eigenvalues above the shift; its range and the complement are two
invariant subspaces, each with a smaller covariance that is split in turn, until subspaces have
one dimension or one eigenvalue. U comes from the dynamically weighted Halley iteration in its QR
form. Blocks below the wanted number of components are not split. The components, a table of
dimensions x components, go with the tasks that whiten all rows.

Defined results: rows whose vector is null or has null or non-finite entries are left out, and so
are vectors of another length than the most frequent among distinct ones (of equals the longest);
values beyond the range of long count as its ends; a null ``vec_id`` stays; repeated rows stay; components without variance (a constant list) whiten to 0 and count for
nothing in ``identity_error``; a deviation beyond the range of long is null. Equal eigenvalues
share a subspace in which any orthonormal basis is right; one is chosen without chance. Other
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.session import stage

SCALE, COMPONENTS = 256, 4
_EPS = float(np.finfo(np.float64).eps)
_LONG_MIN, _LONG_MAX = -(2.0**63), 2.0**63 - 1024


# ---- Spectral divide and conquer ------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its matrix sign."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # No singular value is smaller than this but those that are rounding errors.
    low = _EPS
    for _ in range(20):
        sq = low * low
        gamma = (4 * (1 - sq) / (sq * sq)) ** (1 / 3)
        root = np.sqrt(1 + gamma)
        wa = root + 0.5 * np.sqrt(8 - 4 * gamma + 8 * (2 - sq) / (sq * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (wa + wb * sq) / (1 + wc * sq), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= 1e-8 * np.sqrt(n) and 1 - low < 1e-8:
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthonormal basis whose first k columns span the larger eigenvalues; None if all are equal."""
    n = len(a)
    diagonal, mean = np.diag(a), np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 8 * _EPS * np.sqrt(n) * np.linalg.norm(a):
        return None
    # The mean has eigenvalues on both sides; the median splits more evenly; the rest dodges eigenvalues.
    nudges = [mean + f * spread / n for f in (0.01, -0.01, 0.05, -0.05, 0.13, -0.13, 0.29, -0.29)]
    rng = np.random.default_rng(7)
    for shift in [float(np.median(diagonal)), mean, *nudges]:
        moved = a - shift * np.eye(n)
        if not moved.any():
            continue
        projector = (polar_factor(moved) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n or np.linalg.norm(projector @ projector - projector) > 1e-9 * n:
            continue
        basis = rng.standard_normal((n, k))
        for _ in range(3):
            basis, _ = np.linalg.qr(projector @ basis)
        whole, _ = np.linalg.qr(np.hstack([basis, rng.standard_normal((n, n - k))]))
        # The complement once more through its own projector.
        rest = whole[:, k:]
        rest, _ = np.linalg.qr(rest - projector @ rest)
        return np.hstack([basis, rest]), k
    return None


def leading_components(cov: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    dims = len(cov)
    count = min(count, dims)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    # Subspaces still to split, that of the largest eigenvalues on top.
    todo = [np.eye(dims)]
    while todo and len(vectors) < count:
        basis = todo.pop()
        block = basis.T @ cov @ basis
        parts = split((block + block.T) / 2) if basis.shape[1] > 1 else None
        if parts is None:
            for column in basis.T:
                unit = column / np.linalg.norm(column)
                vectors.append(unit)
                values.append(float(unit @ cov @ unit))
            continue
        turn, k = parts
        todo.append(basis @ turn[:, k:])
        todo.append(basis @ turn[:, :k])
    order = np.argsort(-np.array(values), kind="stable")[:count]
    return np.array(values)[order], np.array(vectors).reshape(-1, dims)[order].T


# ---- Vectors as whole numbers ---------------------------------------------------------------


def whole_numbers(column: pa.Array, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length among the usable vectors of a list column of doubles."""
    if not len(column):
        return
    offsets = column.offsets.to_numpy()
    flat = column.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(values)
    if flat.null_count:
        bad |= ~np.asarray(flat.is_valid())
    before = np.concatenate([[0], np.cumsum(bad)])
    fine = np.asarray(column.is_valid()) & (before[offsets[1:]] == before[offsets[:-1]])
    size = np.diff(offsets)
    for d in np.unique(size[fine]):
        rows = np.flatnonzero(fine & (size == d))
        with np.errstate(over="ignore"):
            at = values[offsets[rows][:, None] + np.arange(d)[None, :]] * scale
        yield rows, np.clip(np.floor(at), _LONG_MIN, _LONG_MAX).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """One string of bytes per row: the narrowest width that holds all its entries, then the entries."""
    peak = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
    out: list[bytes] = [b""] * len(x)
    width = np.select([peak < 1 << 7, peak < 1 << 15, peak < 1 << 31], [1, 2, 4], 8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        for i, row in zip(own, x[own].astype(f"<i{w}"), strict=True):
            out[i] = bytes([w]) + row.tobytes()
    return out


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    """The matrix of packed rows of ``d`` entries each."""
    rows = column.to_pylist()
    x = np.empty((len(rows), d), np.int64)
    width = np.fromiter((r[0] for r in rows), np.int64, len(rows))
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        raw = np.frombuffer(b"".join(rows[i] for i in own), np.uint8).reshape(len(own), 1 + d * w)
        x[own] = np.ascontiguousarray(raw[:, 1:]).view(f"<i{w}")
    return x


def _packed_rows(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole_numbers(batch.column(0), scale):
                d = np.full(len(x), x.shape[1], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(packed(x), pa.binary())], ["d", "x"])

    return run


def _halves(total: np.ndarray) -> list[pa.Array]:
    """Longs as upper and lower halves, whose sums don't overflow."""
    return [pa.array(total >> 32), pa.array(total & 0xFFFFFFFF)]


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpacked(batch.column(0), d)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d)), pa.array(high), pa.array(low), pa.array(x.min(axis=0)), pa.array(x.max(axis=0)), pa.array(np.full(d, len(x)))],
                ["cell", "high", "low", "least", "most", "n"],
            )

    return run


def _products(d: int, centre: np.ndarray, reach: int):
    """Sums of products of centred vectors, per pair of dimensions; exact while ``reach`` squared fits a double."""
    upper = np.triu_indices(d)
    cells = pa.array(upper[0] * d + upper[1])
    exact = reach < 1 << 26
    block = max(1, (1 << 53) // max(reach * reach, 1)) if exact else 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = pa.array(np.zeros(len(upper[0]), np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpacked(batch.column(0), d)
            y = (x - centre).astype(np.float64) if exact else x.astype(np.float64) - centre.astype(np.float64)
            for first in range(0, len(y), block):
                part = y[first : first + block]
                total = (part.T @ part)[upper]
                if exact:
                    arrays = [cells, *_halves(np.rint(total).astype(np.int64)), pa.array(np.zeros(len(total)))]
                else:
                    arrays = [cells, zeros, zeros, pa.array(total)]
                yield pa.RecordBatch.from_arrays(arrays, ["cell", "high", "low", "about"])

    return run


# ---- Fit and transform ----------------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit gives: sums of the distinct vectors, components as columns, their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int = SCALE

    def __post_init__(self) -> None:
        self.mean = np.array([s / self.n for s in self.sums])
        # Below this there is nothing but rounding.
        some = self.values > len(self.sums) * _EPS * self.trace
        self.has_variance = some
        self.factors = self.vectors * np.where(some, 1 / np.sqrt(np.where(some, self.values, 1)), 0.0)
        self.explained = np.where(some, self.values, 0.0) / (self.trace or 1.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.mean) @ self.factors

    def deviation(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of (n x - S) squared, and whether it is a long: the arithmetic modulo 2**64 is exact then."""
        own = np.array([s & (1 << 64) - 1 for s in self.sums], np.uint64)
        gap = x.astype(np.uint64) * np.uint64(self.n) - own
        about = ((x.astype(np.float64) - self.mean) ** 2).sum(axis=1) * float(self.n) ** 2
        return (gap * gap).sum(axis=1, dtype=np.uint64).view(np.int64), about < 2.0**63 * (1 - 1e-9)


def _spread(fit: DataFrame, n: int, d: int) -> tuple[list[int], np.ndarray]:
    """Sums per dimension and the covariance of the fit list, from exact integers."""
    add = (F.sum("high").alias("high"), F.sum("low").alias("low"))
    rows = fit.mapInArrow(_sums(d), "cell long, high long, low long, least long, most long, n long")
    rows = rows.groupBy("cell").agg(*add, F.min("least").alias("least"), F.max("most").alias("most")).orderBy("cell").collect()
    sums = [(r.high << 32) + r.low for r in rows]
    centre = [round(Fraction(s, n)) for s in sums]
    reach = max(max(r.most - c, c - r.least) for r, c in zip(rows, centre, strict=True))
    rows = fit.mapInArrow(_products(d, np.array(centre, np.int64), reach), "cell long, high long, low long, about double")
    rows = rows.groupBy("cell").agg(*add, F.sum("about").alias("about")).collect()
    off = [s - n * c for s, c in zip(sums, centre, strict=True)]
    cov = np.empty((d, d))
    for r in rows:
        i, j = divmod(r.cell, d)
        whole = ((r.high << 32) + r.low) * n - off[i] * off[j]
        cov[i, j] = cov[j, i] = whole / (n * n) + r.about / n
    return sums, cov


def fit_list(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Each distinct usable vector once, packed: (d, x), stored."""
    lists = vectors.select(F.col(f"`{column}`").cast("array<double>").alias("v"))
    return stage(lists.mapInArrow(_packed_rows(scale), "d int, x binary").distinct(), "whitening-fit")


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", scale: int = SCALE) -> tuple[Whitening, DataFrame] | None:
    """The whitening of the distinct vectors and the fit list; None without usable vectors."""
    fit = fit_list(vectors, column, scale)
    lengths = fit.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or not lengths.d:
        return None
    n, d = lengths.n, lengths.d
    fit = fit.where(F.col("d") == d).select("x")
    sums, cov = _spread(fit, n, d)
    values, columns = leading_components(cov, components)
    return Whitening(n, sums, values, columns, float(np.trace(cov)), scale), fit


def identity_error(model: Whitening, fit: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity, measured on its rows."""
    d, some = len(model.sums), np.flatnonzero(model.has_variance)
    k = len(some)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(unpacked(batch.column(0), d))[:, some]
                both = np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], ["cell", "total"])

    rows = fit.mapInArrow(run, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).orderBy("cell").collect()
    total = np.array([r.total for r in rows]) / model.n
    cov = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    return float(np.abs(cov - np.eye(k)).max())


def whitened_vectors(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """Per usable row: vec_id, deviation, whitened (one entry per component)."""
    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_numbers(batch.column(1), model.scale):
                if x.shape[1] != d:
                    continue
                total, fits = model.deviation(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(model.whiten(x).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(total, mask=~fits), lists], ["vec_id", "deviation", "whitened"])

    lists = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    return lists.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whitening_rows(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit_whitening(vectors, components, column)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    model, fit = fitted
    error = identity_error(model, fit)
    rows = whitened_vectors(vectors, model, column).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
