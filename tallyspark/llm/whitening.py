"""Embedding whitening by a randomised range finder and Rayleigh-Ritz, in passes over all centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, table

COMPONENTS = 16
#: Directions beyond the components, and power passes before the range finder gives way to all dimensions.
OVERSAMPLING, PASSES = 10, 8
#: Largest residual of an accepted component, and smallest eigenvalue of one, in terms of the largest eigenvalue.
RESIDUAL, RANK = 1e-13, 1e-12
SEED = 42
#: x is the floor of SCALE times an entry, plus SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of x beyond this, in either direction, are held at it.
LARGEST = 1e15
LONG_MAX = 2**63 - 1
#: Bits of the pieces in which whole numbers are summed.
PIECE = 12


def whole_numbers(vector: str) -> Column:
    """The x vector of an embedding, or null if it is null or has null or non-finite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.greatest(F.least(F.lit(float(SCALE)) * c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(vector, lambda c: F.floor(held(c)).cast("long") + SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(x)``, an array of fixed length for each batch of rows, over all rows of ``fit``.

    Each task makes one partial sum; about the square root of their number meet
    in each of as many tasks, whose sums the driver adds up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column("x")))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["task", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(t, p) for b in batches for t, p in zip(b.column("task").to_pylist(), _matrix(b.column("part")), strict=True)]
        if parts:
            # In the order of the tasks, so that reruns round alike.
            total = np.sum([p for _, p in sorted(parts, key=lambda x: x[0])], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([min(t for t, _ in parts)]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["task", "part"])

    parts = fit.mapInArrow(run, "task long, part array<double>")
    met = parts.repartition(ceil(sqrt(fit.sparkSession.sparkContext.defaultParallelism)), "task").mapInArrow(add, "task long, part array<double>")
    return np.sum([r["part"] for r in sorted(met.collect(), key=lambda r: r["task"])], axis=0)


@dataclass(frozen=True)
class Whitening:
    """Fitted components: rows counted, per-dimension sums, eigenvalues, unit eigenvectors as columns, the trace, and what was measured of them."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int
    directions: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Of each row the exact sum of (n*x - S)**2; null where it is over the largest long."""
        whole, rest = _parts(self.n, self.sums)
        apart = x - whole
        most = self.n * int(np.abs(apart).max(initial=0)) + self.n
        if most * most * max(1, x.shape[1]) <= LONG_MAX:
            return ((self.n * apart - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in apart.tolist()]
        return [v if v <= LONG_MAX else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _parts(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of the means S/n the whole parts and what is left of S."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n: the whole part is taken off in whole numbers, so that nothing is lost to large means."""
    whole, rest = _parts(n, sums)
    return (x - whole).astype(np.float64) - rest / n


def _exact_sums(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    """The number of rows and the sum of each dimension, in whole numbers of any size."""
    n = fit.count()
    if not n:
        return 0, ()
    # In pieces of PIECE bits, whose sums doubles hold exactly for up to 2**(53 - PIECE) rows.
    shifts = range(0, 5 * PIECE, PIECE)
    pieces = _summed(fit, lambda x: np.concatenate([((x >> s) % (1 << PIECE) if s < shifts[-1] else x >> s).sum(axis=0) for s in shifts]).astype(np.float64))
    return n, tuple(sum(int(p) << s for p, s in zip(own, shifts, strict=True)) for own in pieces.reshape(len(shifts), -1).T)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the rows of ``fit`` (x: array of longs of one length); None if there are none or they do not vary.

    A block of random directions, some more than components, is sent through
    the covariance, orthonormalised and sent again; each pass sums the products
    of all centred rows. Rayleigh-Ritz on the block gives eigenvalues,
    eigenvectors and, from the same sums, their residuals. Once these are small
    the block is accepted; where PASSES passes do not suffice, as with a flat
    spectrum, the block becomes all dimensions, for which it is exact. What is
    sent to the tasks and comes back has dimensions times directions numbers.
    """
    n, sums = _exact_sums(fit)
    dims = len(sums)
    if not n or not dims:
        return None

    def through(block: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times a block, and the covariance's trace."""

        def of(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return np.append((c.T @ (c @ block)).ravel(), (c * c).sum())

        got = _summed(fit, of) / n
        return got[:-1].reshape(dims, -1), got[-1]

    width = components + OVERSAMPLING
    block = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, width)))[0] if width < dims else np.eye(dims)
    passes = 0
    while True:
        sent, trace = through(block)
        passes += 1
        small = block.T @ sent
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        if not values[0] > 0:
            return None
        kept = int((values[:components] > RANK * values[0]).sum())
        vectors = block @ turn[:, :kept]
        gaps = np.linalg.norm(sent @ turn[:, :kept] - vectors * values[:kept], axis=0)
        if block.shape[1] == dims or gaps.max() <= RESIDUAL * values[0]:
            break
        block = np.linalg.qr(sent)[0] if passes < PASSES else np.eye(dims)
    values = values[:kept]

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ vectors / np.sqrt(values)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = _summed(fit, moments) / n
    mean, second = got[:kept], got[kept:].reshape(kept, kept)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(kept)).max())
    return Whitening(n, sums, values, vectors, float(trace), error, passes, block.shape[1])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row of ``vectors`` and component.

    Rows whose embedding is null or has null or non-finite entries are left out,
    and so are those of another length than most rows have (of equals, the
    longer). The fit list has each x vector once, so copies count once there,
    while every row gets its result, whatever its vec_id. Components with
    eigenvalue zero are left out; rows that do not vary, and empty tables, give
    no rows. Further columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", whole_numbers("embedding").alias("x")).where("x IS NOT NULL")
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None or not lengths["dims"]:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths["dims"])
    model = fit_whitening(cut(rows.select("x").distinct()), components)
    if model is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = len(model.values)
        explained = model.values / model.trace
        for batch in batches:
            if batch.num_rows:
                x, count = _matrix(batch.column("x")), batch.num_rows
                ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(count), kept)))
                deviation = pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(count), kept)))
                columns = [
                    ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)), pa.array(np.full(count * kept, model.n, np.int64)), deviation,
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * kept, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
