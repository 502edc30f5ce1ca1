"""Whitening of embeddings: covariance in whole numbers, eigenvectors by mixed-precision refinement.

Component c of a vector becomes x = floor(64 * c) + 1000000.  The fit list holds
every distinct x vector once; n, the sums S and the covariance V (divisor n) are
those of this list.

1. Tasks sum x per dimension.  With q, the whole number nearest to S/n, they sum
   the products (x - q)(x - q)', again in whole numbers, so that no order of rows
   and no partitioning changes a bit.  V is that sum over n less the product of
   what is left of the mean (at most a half), rounded once.
2. The eigenvectors of V are computed in 32-bit floats and corrected in 64 bits
   by Ogita and Aishima's iteration, which uses matrix products only:
   with R = I - X'X and T = X'VX, eigenvalue l_i = t_ii / (1 - r_ii), the vectors
   become X + XE, e_ij = (t_ij + l_j r_ij) / (l_j - l_i).  Where two eigenvalues
   are too close for that, e_ij = r_ij / 2, and once the iteration stands, the
   matrix is projected on each such cluster, less its mean eigenvalue, and solved
   there; then the iteration goes on from the turned vectors.  At the end the
   vectors are made orthogonal to the last bit by two steps X + XR / 2.
3. Every row is projected on the first components, centred before multiplying.
   The covariance of the projected fit list is summed once more, and its distance
   from the identity is a column of the result.

Nulls and edge cases: a row whose vector is null, empty, or holds a null or an
entry that is not finite is dropped; a null vec_id is kept.  Repeated rows each
give their rows.  64 * c is held to +-10**12.  Vectors of different lengths are
fitted apart, and each length has its own n.  A component whose eigenvalue is
zero up to rounding (a single vector, equal vectors, fewer vectors than
components) has whitened 0 and no part in the identity's error.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.scratch import settled

SCALE, SHIFT = 64, 1_000_000
LARGEST = 10**12
COMPONENTS = 16
# Corrections of the eigenvectors between two sub-solves, and sub-solves.
STEPS, TURNS = 12, 4


def shifted(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): rows that take part, as whole numbers."""
    c = F.col(vector).cast("array<double>")
    usable = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    held = lambda e: F.greatest(F.least(e * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    x = F.transform(c, lambda e: F.floor(held(e)).cast("long") + SHIFT)
    return rows.filter(F.size(vector) > 0).filter(usable).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


@dataclass
class Fit:
    """Facts of the fit list of one vector length."""

    n: int
    total: list[int]
    low: list[int]
    high: list[int]

    @property
    def centre(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.total]

    @property
    def rest(self) -> list[int]:
        """S - n * centre, at most n / 2."""
        return [s - self.n * q for s, q in zip(self.total, self.centre, strict=True)]

    @property
    def reach(self) -> int:
        return max(max(h - q, q - w) for h, w, q in zip(self.high, self.low, self.centre, strict=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length in a batch."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield at, flat[(ends[at] - length)[:, None] + np.arange(length)]


def _sums(batches):
    """(dim, i, n, total, low, high) of a task."""
    found: dict[int, list] = {}
    for batch in batches:
        for _, x in _by_length(batch.column("x")):
            exact = x.astype(object) if len(x) * int(np.abs(x).max()) >= 2**62 else x
            now = [len(x), *(np.array(f(exact, axis=0), object) for f in (np.sum, np.min, np.max))]
            old = found.get(x.shape[1])
            found[x.shape[1]] = now if old is None else [old[0] + now[0], old[1] + now[1], np.minimum(old[2], now[2]), np.maximum(old[3], now[3])]
    for dim, (n, total, low, high) in found.items():
        names = ["dim", "i", "n", "total", "low", "high"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64()]
        columns = [[dim] * dim, range(dim), [n] * dim, [Decimal(int(t)) for t in total], low.tolist(), high.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def fit_facts(fit: DataFrame) -> dict[int, Fit]:
    """Facts of each vector length: as many rows on the driver as there are dimensions."""
    parts = fit.mapInArrow(_sums, "dim int, i int, n long, total decimal(38,0), low long, high long")
    rows = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    found: dict[int, Fit] = {}
    for r in rows.orderBy("dim", "i").collect():
        one = found.setdefault(r["dim"], Fit(r["n"], [], [], []))
        one.total.append(int(r["total"]))
        one.low.append(r["low"])
        one.high.append(r["high"])
    return found


def _products(facts: dict[int, Fit]) -> Callable:
    """(dim, i, j, total): sums of (x - centre)(x - centre)' of a task, the upper half."""

    def work(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch.column("x")):
                fit = facts[x.shape[1]]
                y = x - np.array(fit.centre, np.int64)
                # A matrix product in doubles is exact while its sums stay below 2**53.
                few = max(1, 2**53 // max(1, fit.reach**2))
                if few >= 64:
                    parts = [y[k : k + few].astype(np.float64) for k in range(0, len(y), few)]
                    total = sum((p.T @ p).astype(np.int64).astype(object) for p in parts)
                else:
                    total = y.astype(object).T @ y.astype(object)
                found[x.shape[1]] = found.get(x.shape[1], 0) + total
        for dim, total in found.items():
            i, j = np.triu_indices(dim)
            columns = [np.full(len(i), dim, np.int32), i.astype(np.int32), j.astype(np.int32)]
            totals = pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), totals], names=["dim", "i", "j", "total"])

    return work


def covariances(fit: DataFrame, facts: dict[int, Fit]) -> dict[int, np.ndarray]:
    """The covariance matrix of each vector length, every entry rounded once."""
    parts = fit.mapInArrow(_products(facts), "dim int, i int, j int, total decimal(38,0)")
    found = {dim: np.zeros((dim, dim)) for dim in facts}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect():  # a matrix
        one, rest = facts[r["dim"]], facts[r["dim"]].rest
        value = (one.n * int(r["total"]) - rest[r["i"]] * rest[r["j"]]) / one.n**2
        found[r["dim"]][r["i"], r["j"]] = found[r["dim"]][r["j"], r["i"]] = value
    return found


def _corrected(matrix: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step of the iteration: vectors, eigenvalues, least usable gap, size of the correction."""
    left = np.eye(len(x)) - x.T @ x
    turned = x.T @ matrix @ x
    values = np.diag(turned) / (1 - np.diag(left))
    off = turned - np.diag(values)
    gap = 2 * (np.linalg.norm(off, 2) + np.linalg.norm(matrix, 2) * np.linalg.norm(left, 2))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    change = np.where(far, (turned + values[None, :] * left) / np.where(far, apart, 1), left / 2)
    np.fill_diagonal(change, np.diag(left) / 2)
    return x + x @ change, values, gap, float(np.abs(change).max(initial=0))


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Numbers of eigenvalues in a row (by size) that lie within ``gap`` of the next; two or more."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def refined_eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, from a solution in 32 bits."""
    size = float(np.abs(matrix).max(initial=0))
    if size == 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    matrix = matrix / size
    x = np.linalg.eigh(matrix.astype(np.float32))[1].astype(np.float64)
    for turn in range(TURNS):
        for _ in range(STEPS):
            x, values, gap, change = _corrected(matrix, x)
            if change < 1e-15:
                break
        groups = _clusters(values, gap)
        if turn == TURNS - 1 or not groups:
            break
        for group in groups:
            own = x[:, group]
            mean = values[group].mean()
            small = own.T @ (matrix @ own - mean * own)
            x[:, group] = own @ np.linalg.eigh((small + small.T) / 2)[1]
    for _ in range(2):
        # Close eigenvalues leave errors of rounding over gap, which are the same part of either vector.
        x = x + x @ (np.eye(len(x)) - x.T @ x) / 2
    # Without the rounding of large entries: what is left over the quotient.
    values = np.einsum("ij,ij->j", x, matrix @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


@dataclass
class Basis:
    """What every row of one vector length is projected with."""

    fit: Fit
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        y = (x - np.array(self.fit.centre, np.int64)) - np.array(self.fit.rest, np.float64) / self.fit.n
        scale = np.where(self.values > 0, self.values, 1)
        return (y @ self.vectors) / np.sqrt(scale) * (self.values > 0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums of (n * x - S)**2, exact."""
        y = x - np.array(self.fit.centre, np.int64)
        n, rest = self.fit.n, self.fit.rest
        if len(rest) * (n * (self.fit.reach + 1)) ** 2 < 2**62:
            return ((y * n - np.array(rest, np.int64)) ** 2).sum(axis=1)
        return ((y.astype(object) * n - np.array(rest, object)) ** 2).sum(axis=1)


def bases(fit: DataFrame, components: int) -> dict[int, Basis]:
    facts = fit_facts(fit)
    found = {}
    for dim, matrix in covariances(fit, facts).items():
        values, vectors = refined_eigenvectors(matrix)
        trace = float(np.trace(matrix))
        nothing = values <= trace * dim * np.finfo(float).eps
        values = np.where(nothing, 0, values)
        explained = values / trace if trace > 0 else values
        found[dim] = Basis(facts[dim], values[:components], vectors[:, :components], explained[:components])
    return found


def _moments(using: dict[int, Basis]) -> Callable:
    """(dim, i, j, total) of the whitened fit list; i = -1 for plain sums."""

    def work(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch.column("x")):
                w = using[x.shape[1]].whitened(x)
                found[x.shape[1]] = found.get(x.shape[1], 0) + np.vstack([w.sum(axis=0), w.T @ w])
        for dim, total in found.items():
            i, j = (k.ravel() for k in np.indices(total.shape))
            columns = [np.full(len(i), dim, np.int32), i.astype(np.int32) - 1, j.astype(np.int32), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "i", "j", "total"])

    return work


def identity_errors(fit: DataFrame, using: dict[int, Basis]) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    parts = fit.mapInArrow(_moments(using), "dim int, i int, j int, total double")
    sums = {dim: np.zeros((len(b.values) + 1, len(b.values))) for dim, b in using.items()}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect():  # a matrix
        sums[r["dim"]][r["i"] + 1, r["j"]] = r["total"]
    found = {}
    for dim, total in sums.items():
        some = using[dim].values > 0
        mean = total[0] / using[dim].fit.n
        error = (total[1:] / using[dim].fit.n - np.outer(mean, mean) - np.eye(len(some)))[some][:, some]
        found[dim] = float(np.abs(error).max(initial=0))
    return found


_RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _projected(using: dict[int, Basis], errors: dict[int, float]) -> Callable:
    def work(batches):
        for batch in batches:
            for at, x in _by_length(batch.column("x")):
                basis = using[x.shape[1]]
                k = len(basis.values)
                deviation = basis.deviations(x)
                exact = pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0))
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    batch.column("vec_id").take(pa.array(at[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), basis.fit.n, np.int64)),
                    exact.take(pa.array(each)),
                    pa.array(basis.whitened(x).ravel()),
                    pa.array(np.tile(basis.explained, len(x))),
                    pa.array(np.full(len(each), errors[x.shape[1]])),
                ]
                names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return work


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component.

    ``deviation`` is a decimal, as n * x - S squared may need more than 64 bits.
    """
    own = shifted(rows, vec_id, vector)
    fit = settled(own.select("x").distinct(), "fit-list")
    using = bases(fit, components)
    result = f"vec_id {own.schema['vec_id'].dataType.simpleString()}, {_RESULT}"
    return own.mapInArrow(_projected(using, identity_errors(fit, using)), result)
