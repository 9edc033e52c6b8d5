"""Queries that come as a stream: each micro-batch is searched as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarryvec.operators.exact import filtered_knn
from quarryvec.operators.predicates import Predicate


def search_stream(queries: DataFrame, base: DataFrame, k: int, sink: str, checkpoint: str, predicate: Predicate | None = None):
    """Appends (qid, rank, id, dist, batch) to a Parquet folder; a batch that is repeated replaces its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        filtered_knn(base, batch, k, predicate).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
