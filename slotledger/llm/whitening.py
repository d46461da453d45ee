"""Embedding whitening by spectrum slicing (operator 11).

Vectors become whole numbers first, so the list of distinct vectors, their count and their sums are exact and independent of how rows
are dealt out. The covariance of the distinct vectors is summed from centred partial products, one small matrix per task; its leading
eigenpairs come from :mod:`slotledger.llm.spectrum`; every row is then projected where it lies.

Defined cases
- A null vector, or one with a null or non-finite entry, has no row in the result. A vector of another length than most of the table's
  vectors (of the longer length, where two are as common) is no vector of this table and has none either.
- Rows that repeat a vector, or a ``vec_id`` (null included), all have results; the vector counts once in the fit.
- Components whose eigenvalue is zero to rounding do not exist: one distinct vector, or none, gives an empty result.
- ``deviation`` is exact; where it does not fit a long it is null.
- Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.llm.common import stored
from slotledger.llm.spectrum import leading

COMPONENTS = 4
SCALE = 256
LONG_MAX = 2**63 - 1


def points(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): usable vectors as whole numbers, all of one length."""
    vector = embeddings["embedding"]
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    x = F.transform(vector, lambda e: F.floor(e.cast("double") * F.lit(float(SCALE))))
    usable = embeddings.where(vector.isNotNull() & finite).select(embeddings["vec_id"], x.alias("x"))
    lengths = usable.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return usable.where(F.size("x") == (lengths[0]["length"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of distinct vectors and exact sum of each dimension."""
    rows = fit.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")
    ).orderBy("dim").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def second_moments(df: DataFrame, project, size: int) -> np.ndarray:
    """Sum of outer products of ``project(x)`` over all rows: one small matrix per task, added up by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = project(_matrix(batch.column("x")))
            total += y.T @ y if len(y) else 0
        yield pa.RecordBatch.from_pydict({"cell": np.arange(size * size), "v": total.ravel()})

    cells = df.select("x").mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    return np.array([r["v"] for r in cells]).reshape(size, size) if cells else np.zeros((size, size))


class Model:
    """Centre, axes and scales of a fitted list: small, whatever the table's size."""

    def __init__(self, fit: DataFrame, components: int = COMPONENTS):
        self.n, self.total = sums(fit)
        size = len(self.total)
        self.centre = np.array([s / self.n for s in self.total])
        centre = self.centre
        covariance = second_moments(fit, lambda x: x - centre, size) / max(self.n, 1)
        covariance = (covariance + covariance.T) / 2
        self.values, self.axes = leading(covariance, components)
        self.explained = self.values / np.trace(covariance) if len(self.values) else self.values
        self.weights = self.axes / np.sqrt(self.values)
        self.identity_error = self._identity_error(fit)

    def _identity_error(self, fit: DataFrame) -> float:
        """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on the data."""
        k, centre, weights = len(self.values), self.centre, self.weights
        if not k:
            return 0.0
        moments = second_moments(fit, lambda x: np.column_stack([(x - centre) @ weights, np.ones(len(x))]), k + 1) / self.n
        mean = moments[k, :k]
        return float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n*x - S)^2; plain longs where they cannot overflow, unbounded integers elsewhere."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.total), default=0)
        if most * most * max(len(self.total), 1) <= LONG_MAX and int(x.min(initial=0)) > -LONG_MAX:
            y = self.n * x - np.array(self.total, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.total, strict=True)) for row in x.tolist()]
        return [v if v <= LONG_MAX else None for v in exact]


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, see ``RESULT``."""
    rows = stored(points(embeddings), "vectors")
    model = Model(stored(rows.select("x").distinct(), "fit-list"), components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches if k else ():
            x = _matrix(batch.column("x"))
            ids = batch.column("vec_id").cast(pa.int64())
            count = len(ids)
            deviation = pa.array(model.deviations(x), pa.int64())
            whitened = (x - model.centre) @ model.weights
            for c in range(k):
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(count, c + 1, np.int32)), pa.array(np.full(count, model.n, np.int64)), deviation,
                     pa.array(whitened[:, c]), pa.array(np.full(count, model.explained[c])), pa.array(np.full(count, model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
