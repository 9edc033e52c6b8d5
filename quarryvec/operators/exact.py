"""Exact filtered k nearest neighbours.

Result rows are (qid, rank, id, dist), nearest first, equal distances by id; a query that fewer
than k rows pass for has fewer rows.  Rows with a null vector don't take part.

Distances are matrix products over blocks of rows and queries, and the shortlist is scored again with the fold (see ``blocks``); a shared filter reaches the
scan, and a task keeps k rows a query before the shuffle.  A distance or a condition that is only known as an expression is
left to Catalyst, with the same bits.  The queries are broadcast
if their size is below ``BROADCAST_BYTES``; beyond that they are dealt into blocks that meet the base
one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryvec.functions.distances import DISTANCES, Distance, masked_l1
from quarryvec.operators import blocks
from quarryvec.operators.predicates import Predicate, compared, shared_parts

BROADCAST_BYTES = 64 << 20
#: Bytes beside a query's vector that a task holds for each of its k rows, over those that it holds for an element broadcast.
_HELD = 4


def top_k(scored: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k least (dist, id) of each query."""
    order = Window.partitionBy(by).orderBy("dist", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(by, "rank", "id", "dist")


def size_of(queries: DataFrame, vector: str = "q") -> tuple[int, int]:
    """Number of queries and bytes of their vectors."""
    row = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(vector)), F.lit(0)).alias("cells")).first()
    return row["n"], 8 * row["cells"]


def query_blocks(queries: DataFrame, vector: str = "q", more: int = 0) -> list[DataFrame]:
    """The queries in parts that may be broadcast; more: further bytes a query."""
    n, size = size_of(queries, vector)
    size += size_of(queries, "__met")[1] if "__met" in queries.columns else 0
    parts = max(1, -(-(size + more * n) // BROADCAST_BYTES))
    return [queries] if parts == 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) for i in range(parts)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filtered_knn(base: DataFrame, queries: DataFrame, k: int, predicate: Predicate | None = None, metric: str | Distance = "l2sq", vector: str = "embedding") -> DataFrame:
    """base: id, the vector and attributes; queries: qid, q and, for a predicate of its own, its columns.  A masked metric has one mask for all rows."""
    rows = base.where(F.col(vector).isNotNull())
    if predicate and not predicate.per_query:
        rows = rows.where(predicate.column())
    if isinstance(metric, masked_l1):
        rows, queries, metric = rows.withColumn(vector, metric.kept(F.col(vector))), queries.withColumn("q", metric.kept(F.col("q"))), "l1"
    if isinstance(metric, str) and blocks.usable(rows, queries, predicate):
        dealt = needed(rows, predicate, vector).repartition("id")  # the work goes by rows, whatever files they lie in
        return blockwise(dealt, queries, k, predicate, metric, vector)
    return expression_knn(rows, queries, k, predicate, DISTANCES[metric] if isinstance(metric, str) else metric, vector)


def needed(rows: DataFrame, predicate: Predicate | None, *columns: str) -> DataFrame:
    """The columns that a search reads."""
    if not (predicate and predicate.per_query):
        return rows.select("id", *columns)
    if shared_parts(predicate.tree)[1]:
        return rows  # conditions that only Spark reads
    return rows.select(*dict.fromkeys(["id", *columns, *(a for a, _ in compared(predicate.tree))]))


def blockwise(rows: DataFrame, queries: DataFrame, k: int, predicate: Predicate | None, metric: str, vector: str = "embedding", by: str | None = None) -> DataFrame:
    """The k nearest by ``blocks.nearest``, block after block of the queries."""
    return top_k(_union([blocks.nearest(rows, block, k, metric, predicate, vector, by) for block in query_blocks(queries, more=_HELD * k)]), k)


def expression_knn(rows: DataFrame, queries: DataFrame, k: int, predicate: Predicate | None, distance: Distance, vector: str = "embedding") -> DataFrame:
    """The same by expressions alone, for any distance and condition; rows: those that pass a shared predicate."""
    found = []
    for block in query_blocks(queries):
        block = F.broadcast(block.where(F.col("q").isNotNull()))
        pairs = rows.join(block, predicate.column()) if predicate and predicate.per_query else rows.crossJoin(block)
        found.append(top_k(pairs.select("qid", "id", distance(F.col(vector), F.col("q")).alias("dist")), k))
    return _union(found)


def arrow_knn(base: DataFrame, queries: DataFrame, k: int, predicate: Predicate | None = None, metric: str = "l2sq", vector: str = "embedding") -> DataFrame:
    """``filtered_knn`` under its older name."""
    return filtered_knn(base, queries, k, predicate, metric, vector)


def label_knn(base: DataFrame, queries: DataFrame, k: int, label: str, query_label: str, metric: str = "l2sq") -> DataFrame:
    """Rows with the query's label: an equi-join, then as above."""
    pairs = base.where("embedding is not null").join(queries, F.col(label) == F.col(query_label))
    return top_k(pairs.select("qid", "id", DISTANCES[metric](F.col("embedding"), F.col("q")).alias("dist")), k)


def member_knn(base: DataFrame, queries: DataFrame, k: int, members: DataFrame) -> DataFrame:
    """Among the rows whose id is in ``members``, a set that was made once; or, if it has a qid, in the query's own set (qid, id)."""
    if "qid" not in members.columns:
        return filtered_knn(base.join(members.select("id"), "id", "left_semi"), queries, k)
    if blocks.usable(base, queries, None):
        from quarryvec.operators import members as packed

        rows = base.select("id", "embedding")
        return top_k(_union([packed.nearest(rows, block, members, k) for block in query_blocks(queries, more=_HELD * k)]), k)
    pairs = base.where("embedding is not null").join(members.select("qid", "id").distinct(), "id")
    found = [pairs.join(F.broadcast(block.where(F.col("q").isNotNull())), "qid").select("qid", "id", DISTANCES["l2sq"](F.col("embedding"), F.col("q")).alias("dist")) for block in query_blocks(queries)]
    return top_k(_union(found), k)


def without_deleted(base: DataFrame, tombstones: DataFrame) -> DataFrame:
    return base.join(tombstones.select("id"), "id", "left_anti")


def upsert(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of the same id."""
    return without_deleted(base, rows).unionByName(rows)


def postfiltered_knn(base: DataFrame, queries: DataFrame, k: int, efs: int, predicate: Predicate) -> DataFrame:
    """The efs nearest of all, then the predicate, then k; may have under k rows."""
    near = filtered_knn(base, queries, efs)
    passing = near.join(base.where(predicate.column()).select("id"), "id", "left_semi")
    return top_k(passing.select("qid", "id", "dist"), k)


def nearest_documents(base: DataFrame, queries: DataFrame, k: int, document: str, metric: str = "l2sq") -> DataFrame:
    """Several vectors a document: the k documents whose nearest vector is nearest (qid, rank, doc, id, dist).

    Documents that are whole numbers are scored by blocks, of which a task keeps k documents a query; others by expressions."""
    rows = base.where("embedding is not null")
    if blocks.usable(rows, queries, None) and rows.schema[document].dataType.typeName() in blocks._WHOLE:
        dealt = rows.select("id", "embedding", document).repartition("id")
        numbered, others = dealt.where(F.col(document).isNotNull()), dealt.where(F.col(document).isNull())
        some = rows.where(F.col(document).isNull()).limit(1).count()  # rows without a document are one more
        scored = []
        for block in query_blocks(queries, more=2 * _HELD * k):
            scored.append(blocks.nearest(numbered, block, k, metric, None, document=document).withColumnRenamed(document, "doc"))
            if some:
                scored.append(blocks.nearest(others, block, 1, metric, None).withColumn("doc", F.lit(None).cast(rows.schema[document].dataType)))
    else:
        scored = [rows.crossJoin(F.broadcast(block.where(F.col("q").isNotNull()))).select("qid", "id", DISTANCES[metric](F.col("embedding"), F.col("q")).alias("dist"), F.col(document).alias("doc")) for block in query_blocks(queries)]
    best = _union(scored).groupBy("qid", "doc").agg(F.min(F.struct("dist", "id")).alias("b")).select("qid", "doc", "b.dist", "b.id")
    order = Window.partitionBy("qid").orderBy("dist", "doc")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "doc", "id", "dist")


def within(base: DataFrame, queries: DataFrame, epsilon: float, most: int, metric: str = "l2sq") -> DataFrame:
    """Rows no farther than epsilon, the nearest ``most`` of them."""
    rows, asked = base.where("embedding is not null"), queries.withColumn("__bound", F.lit(float(epsilon)))
    if blocks.usable(rows, queries, None):
        dealt = needed(rows, None, "embedding").repartition("id")
        scored = [blocks.nearest(dealt, block, most, metric, None) for block in query_blocks(asked, more=_HELD * most)]
    else:
        scored = [rows.crossJoin(F.broadcast(block.where(F.col("q").isNotNull()))).select("qid", "id", DISTANCES[metric](F.col("embedding"), F.col("q")).alias("dist")) for block in query_blocks(queries)]
    return top_k(_union(scored).where(F.col("dist") <= epsilon), most)
