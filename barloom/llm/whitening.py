"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of a covariance V are found without forming V: a pass
over the vectors multiplies a block Q by it, each task giving the sum of
X'(XQ) over its centred rows. A Lanczos run of a few passes bounds the lower
end of the spectrum. Then rounds of a Chebyshev polynomial of V, by its
three-term recurrence, damp all that lies between that bound and the smallest
value of the block; QR keeps the block apart, Rayleigh-Ritz turns it to
eigenvectors. The block is certified when the residuals of the wanted vectors
are at rounding and a filtered random block beside them finds nothing larger.

Vectors are fixed-point integers, so their sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.scratch import drop, keep

#: Vectors of a packed block, groups in which partial sums are added, vectors beside the wanted ones.
ROWS, GROUPS, GUARD = 1024, 64, 16
#: Degree of the filter, steps of Lanczos, rounds at most.
DEGREE, STEPS, ROUNDS = 10, 10, 40
#: Residual of a certified vector, and least eigenvalue that is whitened, over the largest.
CERTAIN, LEAST = 1e-13, 1e-10


class Spectrum(NamedTuple):
    """Unit eigenvectors as columns, falling eigenvalues, largest residual over the largest eigenvalue, passes made."""

    vectors: np.ndarray
    values: np.ndarray
    residual: float
    passes: int


def fixed_point(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """``(vec_id, x)``: entries as ``floor(scale * c) + shift``, of vectors that are not null and hold finite entries only."""
    entry = F.col(vector_col)
    finite = F.forall(entry, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(2**42)))
    whole = F.transform(entry, lambda v: F.floor(v.cast("double") * scale).cast("long") + shift)
    return vectors.where(F.coalesce(finite & (F.size(entry) > 0), F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def pack(rows: DataFrame) -> DataFrame:
    """``rows(vec_id, x)`` of one length as blocks ``(ids, data)`` of at most ROWS vectors."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                part = batch.slice(begin, ROWS)
                data = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                ids = pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([data], pa.binary())], ["ids", "data"])

    return rows.mapInArrow(blocks, "ids array<long>, data binary")


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, dim)


def _summed(packed: DataFrame, dim: int, part_sum, size: int, kind: str) -> np.ndarray:
    """Sum over all blocks of ``part_sum(matrix)``, an array of ``size`` numbers.

    Tasks add up their blocks, GROUPS groups of tasks are added up in order of
    the tasks, and GROUPS rows come to the driver, so a rerun adds alike.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, part = np.zeros(size, kind), TaskContext.get().partitionId()
        for batch in batches:
            for data in batch.column(0):
                total += part_sum(_matrix(data.as_py(), dim)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([part % GROUPS], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "part", "total"])

    def groups(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, kind)
        for x in frame.sort_values("part")["total"]:
            total += np.frombuffer(x, kind)
        return pd.DataFrame({"g": frame["g"][:1].to_numpy(), "total": [total.tobytes()]})

    parts = packed.select("data").mapInArrow(tasks, "g int, part int, total binary")
    found = parts.groupBy("g").applyInPandas(groups, "g int, total binary").collect()
    out = np.zeros(size, kind)
    for r in sorted(found, key=lambda r: r["g"]):
        out += np.frombuffer(bytes(r["total"]), kind)
    return out


def exact_sums(packed: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of every entry, as integers of any size."""
    low = (1 << 26) - 1
    got = _summed(packed, dim, lambda x: np.concatenate([[len(x)], (x >> 26).sum(axis=0), (x & low).sum(axis=0)]), 2 * dim + 1, "int64")
    return int(got[0]), [(int(h) << 26) + int(v) for h, v in zip(got[1 : dim + 1], got[dim + 1 :], strict=True)]


class Covariance:
    """V as an operator: each product with a block is one pass over the vectors."""

    def __init__(self, packed: DataFrame, n: int, sums: list[int]):
        self.packed, self.n, self.dim, self.passes = packed, n, len(sums), 0
        self.mean = np.array([s / n for s in sums])
        # the trace comes with the first product
        self.trace = 0.0

    def __matmul__(self, block: np.ndarray) -> np.ndarray:
        mean, k = self.mean, block.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return np.append(centred.T @ (centred @ block), (centred * centred).sum())

        got = _summed(self.packed, self.dim, part, self.dim * k + 1, "float64") / self.n
        self.trace, self.passes = float(got[-1]), self.passes + 1
        return got[:-1].reshape(self.dim, k)

    def whitened(self, found: Spectrum) -> np.ndarray:
        """Covariance of the whitened vectors."""
        mean, turn, k = self.mean, found.vectors / np.sqrt(found.values), len(found.values)

        def part(x: np.ndarray) -> np.ndarray:
            w = (x - mean) @ turn
            return np.append(w.T @ w, w.sum(axis=0))

        got = _summed(self.packed, self.dim, part, k * k + k, "float64") / self.n
        return got[: k * k].reshape(k, k) - np.outer(got[k * k :], got[k * k :])


def _lower_end(v: Covariance, rng: np.random.Generator) -> float:
    """A bound from below on the spectrum, by a few steps of Lanczos with full orthogonalisation."""
    basis, alphas, betas = [], [], []
    q = rng.standard_normal(v.dim)
    q /= np.linalg.norm(q)
    for _ in range(min(STEPS, v.dim)):
        basis.append(q)
        w = (v @ q[:, None])[:, 0]
        alphas.append(float(q @ w))
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(v.trace, 1e-300):
            break
        q = w / betas[-1]
    values, turns = np.linalg.eigh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))
    return max(0.0, float(values[0] - betas[-1] * abs(turns[-1, 0])))


def _filtered(v: Covariance, block: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of V on the block: small on [low, high], one at ``top``."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = half / (top - middle)
    twice = 2 / sigma
    before, now = block, (v @ block - middle * block) * (sigma / half)
    for _ in range(DEGREE - 1):
        following = 1 / (twice - sigma)
        before, now = now, (v @ now - middle * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def _ritz(v: Covariance, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orthonormal Ritz vectors of the block by falling value, the values and the residuals' norms."""
    q, _ = np.linalg.qr(block)
    product = v @ q
    small = q.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return vectors, values, np.linalg.norm(product @ turn - vectors * values, axis=0)


def leading_eigenvectors(v: Covariance, wanted: int, seed: int = 3) -> Spectrum:
    """The ``wanted`` leading eigenvectors of V, certified."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, v.dim)
    width = min(v.dim, wanted + GUARD)
    vectors, values, rest = _ritz(v, rng.standard_normal((v.dim, width)))
    if width < v.dim and v.trace > 0:
        low, probed, best, stuck = _lower_end(v, rng), False, np.inf, 0
        for _ in range(ROUNDS):
            high = max(values[-1], low + 1e-6 * (values[0] - low), 1e-9 * values[0])
            if high >= values[0] * (1 - 1e-12):
                break  # all of the spectrum that is left is one value
            vectors, values, rest = _ritz(v, _filtered(v, vectors, low, high, values[0]))
            worst = float(rest[:wanted].max())
            stuck = 0 if worst < best / 2 else stuck + 1
            best = min(best, worst)
            if worst > CERTAIN * values[0] and stuck < 2:
                continue  # two rounds without gain: rounding is reached
            if probed:
                break
            # a random block beside the found vectors, filtered alike, would show a larger value that they miss
            fresh = rng.standard_normal((v.dim, min(GUARD, v.dim - wanted)))
            fresh -= vectors[:, :wanted] @ (vectors[:, :wanted].T @ fresh)
            fresh = _filtered(v, fresh, low, high, values[0])
            fresh -= vectors[:, :wanted] @ (vectors[:, :wanted].T @ fresh)
            beside, beside_values, _ = _ritz(v, fresh)
            probed, best, stuck = True, np.inf, 0
            if beside_values[0] <= values[wanted - 1] * (1 + 1e-9):
                break
            vectors = np.hstack([vectors[:, :wanted], beside])[:, :width]
    live = values[:wanted] > LEAST * max(values[0], 0)
    return Spectrum(vectors[:, :wanted][:, live], values[:wanted][live], float(rest[:wanted].max() / max(values[0], 1e-300)), v.passes)


def _projected(packed: DataFrame, v: Covariance, sums: list[int], found: Spectrum) -> DataFrame:
    """``(vec_id, deviation, whitened)`` of every vector; ``deviation`` as digits, exact at any size."""
    n, mean, dim, turn = v.n, v.mean, v.dim, found.vectors / np.sqrt(found.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1), strict=True):
                x = _matrix(data.as_py(), dim)
                centred = x - mean
                most = int(np.abs(centred).max()) + 2
                if n * int(np.abs(x).max()) < 1 << 62 and dim * (n * most) ** 2 < 1 << 62:
                    gap = x * n - np.array(sums, np.int64)
                    deviation = (gap * gap).sum(axis=1)
                else:  # too large for 64 bits
                    gap = x.astype(object) * n - np.array(sums, object)
                    deviation = (gap * gap).sum(axis=1)
                white = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1], (centred @ turn).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.int64()), pa.array([str(d) for d in deviation]), white], ["vec_id", "deviation", "whitened"])

    return packed.mapInArrow(project, "vec_id long, deviation string, whitened array<double>")


def whiten(
    vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100000, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries (or such of
    2^42 and more) are left out. All others are fitted and projected; where
    lengths differ, those of the commonest length (of equally common ones the
    longest), as a covariance has one dimension. Rows that share an id or have
    none are rows of their own. ``deviation`` is a decimal of 38 digits, exact,
    and null where it has more.
    Directions without variance cannot be whitened: where the covariance has
    fewer than ``components`` eigenvalues above 1e-10 of the largest, only
    those are returned, so one vector, or equal ones, give no rows.
    """
    rows = keep(fixed_point(vectors, id_col, vector_col, scale, shift))
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    number = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if lengths is None:
        return rows.sparkSession.createDataFrame([], number)
    dim = lengths["dim"]
    packed = keep(pack(rows.where(F.size("x") == dim)))
    drop(rows)
    n, sums = exact_sums(packed, dim)
    v = Covariance(packed, n, sums)
    found = leading_eigenvectors(v, components)
    if not len(found.values):
        return rows.sparkSession.createDataFrame([], number)
    error = float(np.abs(v.whitened(found) - np.eye(len(found.values))).max())
    shares = F.array(*(F.lit(float(e / v.trace)) for e in found.values))
    placed = _projected(packed, v, sums, found).select("vec_id", F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return placed.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
