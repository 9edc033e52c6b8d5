"""Whitening of embeddings by hierarchical SVD merging (operator 13).

Rows whose vector is null, empty, or holds null or non-finite entries go.  An entry c becomes
the whole number x = floor(scale * c) (saturating as a long does).  The model is fitted on
each distinct x once; so copies, however many, weigh nothing.

*Summary of a set of vectors*: their number n, the exact sums of each dimension, and the
factor F = diag(s) V' of their centred matrix, with all its singular values s and vectors V:
F'F is n times their covariance.  Nothing is cut off: F has as many rows as the set has
vectors, up to the number of dimensions.

*Merging* two summaries: F1 above F2 above the row sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2),
which makes up for the two means; the singular values and vectors of this stack are those
of the union.  Partitions build theirs block by block, then ``FAN`` partitions at a time
are merged in tasks until one is left: a matrix of dimensions squared, which is all that the
driver sees.  Means are differences of whole sums, so nothing is lost to large offsets.

Components are the vectors of the falling singular values, each with its largest entry
positive.  Those without variance (s below ``RANK`` of the largest) have no whitened values,
so a table whose vectors are all equal, or an empty one, gives no rows.  Vectors must be of one length;
if not, the length with the most distinct vectors is taken (of ties, the longer) and rows of
others go.  Repeated rows and rows with equal or null ids each get their own; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from llm.tables import written

FAN, BLOCK_ROWS, RANK = 16, 4096, 1e-12
_SUMMARY = "part long, n long, sums array<decimal(38,0)>, factor array<double>"


@dataclass
class Summary:
    n: int
    sums: list[int]
    factor: np.ndarray  # rows are singular vectors times singular values

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        rows = np.vstack([self.factor, other.factor, np.sqrt(self.n * other.n / n) * apart])
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], factored(rows))


def factored(rows: np.ndarray) -> np.ndarray:
    """All singular values times their vectors."""
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def summary_of(x: np.ndarray) -> Summary:
    """Of a block of whole vectors."""
    sums = [int(v) for v in x.sum(axis=0, dtype=object)] if np.abs(x.astype(np.float64)).max() > 2**40 else x.sum(axis=0).tolist()
    shift = [v // len(x) for v in sums]
    y = centred(x, shift)
    y -= np.array([(v - s * len(x)) / len(x) for v, s in zip(sums, shift)])
    return Summary(len(x), sums, factored(y))


def centred(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x less whole numbers, without rounding where a double holds the difference."""
    if np.abs(x.astype(np.float64)).max(initial=0) < 2**61:
        return (x - np.array(shift, np.int64)).astype(np.float64)
    return (x.astype(object) - np.array(shift, object)).astype(np.float64)


@dataclass
class Model:
    n: int
    sums: list[int]
    vectors: np.ndarray  # one row a component
    values: np.ndarray  # eigenvalues of the covariance with divisor n, falling
    trace: float

    @classmethod
    def of(cls, s: Summary, components: int) -> Model:
        _, sigma, v = np.linalg.svd(s.factor, full_matrices=False)
        keep = np.flatnonzero((sigma > 0) & (sigma > RANK * sigma[:1]))[:components]
        v = v[keep]
        v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None] if len(v) else v
        return cls(s.n, s.sums, v, sigma[keep] ** 2 / s.n, float((sigma**2).sum() / s.n))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole vectors, a column for each component."""
        shift = [v // self.n for v in self.sums]
        y = centred(x, shift) - np.array([(v - s * self.n) / self.n for v, s in zip(self.sums, shift)])
        return y @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; none where a long can't hold it."""
        most = self.n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most < 2**62 and x.shape[1] * most * most < 2**62:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        out = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def whole_vectors(table: DataFrame, scale: float = 256.0, vector_col: str = "embedding") -> DataFrame:
    """The table's rows with a usable vector, and it as whole numbers in ``x``."""
    vector = F.col(vector_col).cast("array<double>")
    usable = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & (F.size(vector) > 0)
    return table.where(usable).withColumn("x", F.transform(vector, lambda c: F.floor(c * scale)))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(distinct: DataFrame, components: int) -> Model | None:
    """distinct: x, each vector once, all of one length."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own: Summary | None = None
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                block = summary_of(_matrix(batch.column(0).slice(i, BLOCK_ROWS)))
                own = own.merged(block) if own else block
        if own:
            yield pa.RecordBatch.from_pandas(_row(TaskContext.get().partitionId(), own), schema=schema, preserve_index=False)

    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("factor", pa.list_(pa.float64()))])
    left = written(distinct.select("x").mapInArrow(parts, _SUMMARY), "summaries")
    last = left.agg(F.max("part")).first()[0]
    if last is None:
        return None

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        out: Summary | None = None
        for r in rows.itertuples():
            one = Summary(r.n, [int(v) for v in r.sums], np.array(r.factor).reshape(-1, len(r.sums)))
            out = out.merged(one) if out else one
        return _row(int(rows.part.iloc[0]) // FAN, out)

    while last > 0:
        left = left.groupBy(F.floor(F.col("part") / FAN).alias("next")).applyInPandas(merge, _SUMMARY)
        last //= FAN
    top = left.first()
    return Model.of(Summary(top["n"], [int(v) for v in top["sums"]], np.array(top["factor"]).reshape(-1, len(top["sums"]))), components)


def _row(part: int, s: Summary) -> pd.DataFrame:
    from decimal import Decimal

    return pd.DataFrame({"part": [part], "n": [s.n], "sums": [[Decimal(v) for v in s.sums]], "factor": [s.factor.ravel().tolist()]})


def identity_error(distinct: DataFrame, model: Model) -> float:
    """Largest absolute entry of the covariance of the fit list's whitened values, less the identity."""
    k = len(model.values)
    names = [f"m{i}" for i in range(k)] + [f"c{i}_{j}" for i in range(k) for j in range(k)]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = model.whiten(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in [*y.sum(axis=0).tolist(), *(y.T @ y).ravel().tolist()]], names)

    sums = distinct.select("x").mapInArrow(moments, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    mean = np.array(sums[:k]) / model.n
    return float(np.abs(np.array(sums[k:]).reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    kind = table.schema[id_col].dataType
    sql = f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), scale, "vector").select("id", "x")
    distinct = written(rows.select("x").distinct(), "distinct-vectors")
    lengths = distinct.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    model = fit(distinct.where(F.size("x") == lengths["size"]), components) if lengths else None
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], sql).withColumnRenamed("id", id_col)
    size = lengths["size"]
    error = identity_error(distinct.where(F.size("x") == size), model)
    k, id_type = len(model.values), to_arrow_type(kind)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column(1)), batch.num_rows
            again = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column(0).cast(id_type).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(again)]
            columns += [pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == size).mapInArrow(project, sql).withColumnRenamed("id", id_col)
