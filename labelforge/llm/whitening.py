"""Whitening of embeddings by a matrix-free block Lanczos method over distributed covariance products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the entries: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: An entry of a larger size has no exact x; its row counts as not finite.
LARGEST = 2.0**52 / SCALE
#: Components; vectors of a Lanczos block; basis vectors of a block after which the basis is drawn together.
COMPONENTS = 8
BLOCK = 16
BASIS_BLOCKS = 24
#: Rows that numpy holds as doubles at a time.
ROWS = 8192

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vector: Column) -> Column:
    """Whether a vector has entries, and all of them are finite."""
    c = F.transform(vector, lambda e: e.cast("double"))
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) > F.lit(LARGEST)))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def fit_rows(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x of the usable rows whose vectors have the commonest length (of equally common ones the longest)."""
    x = F.transform(F.col(vector), lambda e: F.floor(e.cast("double") * SCALE) + SHIFT)
    rows = common.saved(vectors.filter(usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")), "vectors")
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (top["d"] if top else 0))


def blocks(source: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in source:
        for low in range(0, batch.num_rows, ROWS):
            some = batch.slice(low, ROWS)
            flat = some.column(column).flatten().to_numpy()
            yield some, flat.reshape(some.num_rows, -1)


class Moments:
    """n and the exact sums S of the fit rows; every task centres its own rows with them."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        mid = [round(s / n) for s in sums]
        self._mid = np.array(mid, np.int64)
        self._rest = np.array([s - n * m for s, m in zip(sums, mid)], np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in longs, or in Python integers where longs may not do."""
        near = x - self._mid
        if len(near) and int(np.abs(near).max()) * self.n >= 1 << 62:
            near = near.astype(object)
        return near * self.n - self._rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Of each row the sum of (n * x - S)^2, exact."""
        d = self.scaled(x)
        if d.dtype != object and len(d) and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
            d = d.astype(object)
        return [int(v) for v in (d * d).sum(1)]


def moments(rows: DataFrame) -> Moments | None:
    """n and S by one row per partition and dimension, added up in Spark; None for no rows."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for some, x in blocks(source, 0):
            # Halves of the entries' bits are added apart, so that no sum overflows.
            part = (x >> 26).sum(0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(0).astype(object)
            n, total = n + some.num_rows, part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total)), pa.array([str(v) for v in total])], ["dim", "n", "total"])

    found = rows.select("x").mapInArrow(work, "dim int, n long, total string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return Moments(found[0].n, [int(r.total) for r in found]) if found else None


def added(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], columns: int) -> np.ndarray:
    """The sum over all rows of partial(x): a matrix of so many columns from each partition, added up in Spark by its rows."""
    names = [f"c{k}" for k in range(columns)]

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks(source, 0):
            made = partial(x)
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *[pa.array(total[:, k]) for k in range(columns)]], ["row", *names])

    sums = rows.select("x").mapInArrow(work, "row int, " + ", ".join(f"{c} double" for c in names)).groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
    return np.array([r[1:] for r in sums.orderBy("row").collect()], float)


def orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors for the block, orthogonal to the basis (twice, in full); directions that broke down are drawn anew."""
    d = len(block)
    out = np.zeros((d, 0))
    for k in range(min(block.shape[1], d - basis.shape[1])):
        v, least = block[:, k], scale * 1e-10
        for _ in range(20):
            size = np.linalg.norm(v)
            for _ in range(2):
                v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > least and left > 1e-10 * size:
                v = v / left
                v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            v, least = rng.standard_normal(d), 0.0
    return out


def top_components(multiply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = COMPONENTS, block: int = BLOCK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric d x d matrix known by its products.

    A block goes through `multiply` once and is orthogonalised against the whole basis; the matrix is projected on the basis.
    Done when the residuals of all wanted vectors are at rounding size or the basis is whole. A basis of BASIS_BLOCKS blocks
    starts again from its best vectors.
    """
    rng = np.random.default_rng(seed)
    wanted, block = min(wanted, d), min(block, d)
    basis = images = np.zeros((d, 0))
    fresh, last = orthonormal(rng.standard_normal((d, block)), basis, 1.0, rng), np.inf
    while True:
        basis, images = np.column_stack([basis, fresh]), np.column_stack([images, multiply(fresh)])
        t = basis.T @ images
        values, turned = np.linalg.eigh((t + t.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        best = turned[:, :wanted]
        scale = max(abs(values[0]), 1e-300)
        worst = np.linalg.norm(images @ best - (basis @ best) * values[:wanted], axis=0).max() / scale if len(values) >= wanted else np.inf
        small = 8 * np.finfo(float).eps * np.sqrt(d)
        if basis.shape[1] >= d or worst <= small or (worst <= 1e-12 and worst > last / 2):
            vectors = basis @ best
            return values[:wanted], vectors / np.linalg.norm(vectors, axis=0)
        last = worst
        rest = images[:, -fresh.shape[1] :]
        if basis.shape[1] + block > BASIS_BLOCKS * block:
            keep = turned[:, : wanted + block]
            # The residuals of the best vectors go on; the basis is theirs.
            rest = images @ turned[:, :block] - (basis @ turned[:, :block]) * values[:block]
            basis, images = basis @ keep, images @ keep
        fresh = orthonormal(rest, basis, scale * small, rng)


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Null vectors, empty ones, those with a null or non-finite entry (or one past LARGEST) and those not of the commonest
    length are dropped. Components without variance (a 1e-12th of the trace) have no rows, so equal vectors give none; an
    empty table has none. Repeated rows count each. Null ids stay. deviation is null where it fits no long. Other columns
    are not carried. The driver holds matrices of the vectors' length alone.
    """
    spark = vectors.sparkSession
    rows = fit_rows(vectors, vec_id, vector)
    held = moments(rows)
    if held is None:
        return spark.createDataFrame([], OUT)
    n, d = held.n, len(held.sums)

    def product(v: np.ndarray) -> np.ndarray:
        def partial(x: np.ndarray) -> np.ndarray:
            c = held.centred(x)
            return c.T @ (c @ v)

        return added(rows, partial, v.shape[1]) / n

    values, axes = top_components(product, d, components)
    trace = total_variance(rows, held)
    kept = values > 1e-12 * trace
    values, axes = values[kept], axes[:, kept]
    k = len(values)
    if not k:
        return spark.createDataFrame([], OUT)
    lay = axes / np.sqrt(values)

    def squares(x: np.ndarray) -> np.ndarray:
        w = held.centred(x) @ lay
        return np.vstack([w.T @ w, w.sum(0)])

    sums = added(rows, squares, k) / n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    explained = values / trace

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in blocks(source, 1):
            w, m = held.centred(x) @ lay, some.num_rows
            again = pa.array(np.arange(m).repeat(k))
            deviation = pa.array([v if v < 1 << 63 else None for v in held.deviations(x)], pa.int64()).take(again)
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation,
                    pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                [c.split()[0] for c in OUT.split(", ")],
            )

    return rows.select("vec_id", "x").mapInArrow(work, OUT)


def total_variance(rows: DataFrame, held: Moments) -> float:
    """The covariance's trace, from the rows' deviations."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([float(sum(sum(held.deviations(x)) for _, x in blocks(source, 0)))])], ["total"])

    return rows.select("x").mapInArrow(work, "total double").agg(F.sum("total")).first()[0] / float(held.n) ** 3
