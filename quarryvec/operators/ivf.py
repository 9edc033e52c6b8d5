"""Clustered search: centroids, assignment, probe lists, waves of clusters.

Centroids are a table (cluster, centroid), trained here or brought along.  A base with its
cluster column is written partitioned by cluster and sorted by an attribute, so that a probe
list prunes partitions and a range prunes row groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryvec.functions.distances import DISTANCES, l2sq, masked_l1
from quarryvec.operators import blocks
from quarryvec.operators.exact import blockwise, needed, query_blocks, top_k
from quarryvec.operators.predicates import Predicate, compared
from quarryvec.sources.tables import written

#: Clusters of a table of centroids that may be broadcast.
MOST_CLUSTERS = 1 << 17


def _small(centroids: DataFrame) -> DataFrame:
    return F.broadcast(centroids) if centroids.limit(MOST_CLUSTERS + 1).count() <= MOST_CLUSTERS else centroids


def train(base: DataFrame, nlist: int, how: str = "kmeans", seed: int = 1, vector: str = "embedding") -> DataFrame:
    """Centroids by k-means (``kmeans``, ``kmeans++``) or bisecting k-means (``bisecting``)."""
    data = base.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if how == "bisecting":
        centres = BisectingKMeans(k=nlist, seed=seed).fit(data).clusterCenters()
    else:
        centres = KMeans(k=nlist, seed=seed, initMode="k-means||" if how == "kmeans++" else "random").fit(data).clusterCenters()
    return base.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cluster int, centroid array<double>")


def _nearest(base: DataFrame, centroids: DataFrame, distance) -> DataFrame:
    """base with cluster and cluster_dist; distance: of a row and a centroid (a struct).

    A table of centroids of bounded size goes to every task as one array, so that nothing is
    shuffled; a larger one is joined, and the minimum taken by id."""
    if centroids.limit(MOST_CLUSTERS + 1).count() <= MOST_CLUSTERS:
        one = centroids.agg(F.collect_list(F.struct(*centroids.columns)).alias("__centroids"))
        best = F.array_min(F.transform("__centroids", lambda c: F.struct(distance(c).alias("dist"), c["cluster"].alias("cluster"))))
        out = base.crossJoin(F.broadcast(one)).withColumn("__best", best)
        return out.select(*base.columns, F.col("__best.cluster").alias("cluster"), F.col("__best.dist").alias("cluster_dist"))
    near = base.crossJoin(centroids.select(F.struct(*centroids.columns).alias("__c"))).select("id", F.struct(distance(F.col("__c")).alias("dist"), F.col("__c.cluster").alias("cluster")).alias("__b"))
    best = near.groupBy("id").agg(F.min("__b").alias("__b"))
    return base.join(best.select("id", F.col("__b.cluster").alias("cluster"), F.col("__b.dist").alias("cluster_dist")), "id")


def assign(base: DataFrame, centroids: DataFrame, metric: str = "l2sq", vector: str = "embedding") -> DataFrame:
    """The table with the nearest cluster of each row (of equal ones the least) and its distance.

    Rows meet a table of centroids of bounded size block by block, with the fold's bits; anything else is left to expressions."""
    rows = base.where(F.col(vector).isNotNull())
    if (near := _block_nearest(centroids, metric)) is None:
        return _nearest(rows, centroids.select("cluster", "centroid"), lambda c: DISTANCES[metric](F.col(vector), c["centroid"]))
    out = rows.withColumn("__best", near(blocks._vector(rows, vector)))
    return out.select(*base.columns, F.col("__best.cluster").alias("cluster"), F.col("__best.dist").alias("cluster_dist"))


#: Distances that a task holds at once.
PAIRS_AT_ONCE = 1 << 20


def _block_nearest(centroids: DataFrame, metric: str):
    """A function of a vector to its nearest centroid (dist, cluster); none if the centroids are too many, or not all of them regular vectors of one length."""
    kind = centroids.schema["cluster"].dataType
    if metric not in DISTANCES or kind.typeName() not in blocks._WHOLE:
        return None
    table = centroids.select(F.col("cluster").cast("long").alias("cluster"), blocks._vector(centroids, "centroid").alias("c")).limit(MOST_CLUSTERS + 1).toArrow().combine_chunks()
    if not 0 < table.num_rows <= MOST_CLUSTERS or table.column("cluster").null_count or table.column("c").null_count:
        return None
    table = table.sort_by("cluster").combine_chunks()
    numbers = table.column("cluster").to_numpy()
    good, centres = blocks._regular(table.column("c").combine_chunks())
    if not good.all():
        return None

    def nearest(vectors: pa.Array) -> pa.Array:
        regular, x = blocks._regular(vectors, centres.shape[1])
        dist, at = np.zeros(len(vectors)), np.zeros(len(vectors), np.int64)
        where, step = np.flatnonzero(regular), max(1, PAIRS_AT_ONCE // len(centres))
        for a in range(0, len(x), step):
            some = x[a : a + step]
            sums = np.zeros((len(some), len(centres)))
            for i in range(x.shape[1]):
                u, v = some[:, i, None], centres[None, :, i]
                sums += u * v if metric == "ip" else np.abs(u - v) if metric == "l1" else (u - v) * (u - v)
            sums = 1.0 - sums if metric == "ip" else sums
            best = sums.argmin(1)  # of equal ones the first, which is the least
            at[where[a : a + step]], dist[where[a : a + step]] = best, sums[np.arange(len(some)), best]
        null = np.zeros(len(vectors), bool)
        for r in np.flatnonzero(~regular).tolist():  # null before all numbers, NaN behind them, as Spark orders
            found = [blocks._plain_fold(metric, vectors[r].as_py(), c) for c in centres.tolist()]
            at[r] = min(range(len(found)), key=lambda i: (found[i] is not None, found[i] != found[i], found[i] if found[i] is not None and found[i] == found[i] else 0.0, i))
            null[r], dist[r] = found[at[r]] is None, found[at[r]] or 0.0
        return pa.StructArray.from_arrays([pa.array(dist, mask=null), pa.array(numbers[at]).cast(pa.from_numpy_dtype(arrow))], ["dist", "cluster"])

    arrow = {"byte": np.int8, "tinyint": np.int8, "short": np.int16, "smallint": np.int16, "integer": np.int32, "int": np.int32}.get(kind.typeName(), np.int64)
    return F.arrow_udf(nearest, f"struct<dist: double, cluster: {kind.simpleString()}>")


def rank_clusters(queries: DataFrame, centroids: DataFrame, nprobe: int | None = None, metric: str = "l2sq") -> DataFrame:
    """qid, cluster, probe_rank, cluster_dist: the clusters of each query, nearest first."""
    scored = queries.crossJoin(_small(centroids)).select("qid", "cluster", DISTANCES[metric](F.col("q"), F.col("centroid")).alias("cluster_dist"))
    ranked = scored.withColumn("probe_rank", F.row_number().over(Window.partitionBy("qid").orderBy("cluster_dist", "cluster")))
    return ranked.where(F.col("probe_rank") <= nprobe) if nprobe else ranked


def add(path: str, rows: DataFrame, centroids: DataFrame, sort_by: str) -> None:
    """Further rows go to their clusters' folders of an index that write_index() made."""
    assign(rows, centroids).repartition("cluster").sortWithinPartitions("cluster", sort_by).write.mode("append").partitionBy("cluster").parquet(path)


def write_index(assigned: DataFrame, path: str, sort_by: str) -> None:
    assigned.repartition("cluster").sortWithinPartitions("cluster", sort_by).write.partitionBy("cluster").parquet(path)


def probe_search(assigned: DataFrame, queries: DataFrame, probes: DataFrame, k: int, predicate: Predicate | None = None, metric: str = "l2sq", in_ranges: bool = False) -> DataFrame:
    """Rows of the probed clusters that pass, k nearest; in_ranges: a task has rows of few clusters."""
    rows = assigned.where(predicate.column()) if predicate and not predicate.per_query else assigned
    if blocks.usable(rows, queries, predicate):
        lists = probes.groupBy("qid").agg(F.collect_list(F.col("cluster").cast("long")).alias("__met"))
        asked = written(queries.join(lists, "qid"), "probes")
        rows = needed(rows, predicate, "embedding", "cluster")
        return blockwise(_ranges(rows, predicate) if in_ranges else rows.repartition("id"), asked, k, predicate, metric, by="cluster")
    met = rows.join(probes.select("qid", "cluster").join(queries, "qid"), "cluster")
    if predicate and predicate.per_query:
        met = met.where(predicate.column())
    return top_k(met.select("qid", "id", DISTANCES[metric](F.col("embedding"), F.col("q")).alias("dist")), k)


def _ranges(rows: DataFrame, predicate: Predicate | None) -> DataFrame:
    """A task has rows of few clusters, near each other and in what queries' conditions compare, so that few queries meet it: it keeps k rows for each that does."""
    compares = sorted({a for a, _ in compared(predicate.tree)} - {"id"}) if predicate and predicate.per_query else []
    return rows.repartitionByRange("cluster", *compares, "id")


def search(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int, predicate: Predicate | None = None, metric: str = "l2sq") -> DataFrame:
    return probe_search(assigned, queries, rank_clusters(queries, centroids, nprobe, metric), k, predicate, metric)


def wave_probes(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, efs: int, predicate: Predicate | None = None, least: int = 1, share: float = 0.0) -> DataFrame:
    """The nearest clusters of each query until they hold ``efs`` passing rows and ``share`` of all that pass, ``least`` clusters at any rate.

    A number of rows alone reads an ever smaller part of a growing base, and recall sinks; a share doesn't.

    One aggregate counts the passing rows of each cluster (and query), one running sum cuts the
    list: the same clusters as taking them one at a time, without a loop, and it always ends.
    """
    ranked = rank_clusters(queries, centroids)
    if predicate and predicate.per_query:
        counts = assigned.join(F.broadcast(queries) if queries.limit(10_001).count() <= 10_000 else queries, predicate.column()).groupBy("qid", "cluster").agg(F.count("*").alias("n"))
        ranked = ranked.join(counts, ["qid", "cluster"], "left")
    else:
        rows = assigned.where(predicate.column()) if predicate else assigned
        ranked = ranked.join(rows.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", "left")
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("qid").orderBy("probe_rank").rowsBetween(Window.unboundedPreceding, -1))
    total = F.coalesce(F.sum("n").over(Window.partitionBy("qid")), F.lit(0))
    ranked = ranked.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", total)
    return ranked.where((F.col("before") < efs) | (F.col("before") < share * F.col("total")) | (F.col("probe_rank") <= least)).select("qid", "cluster", "probe_rank", "cluster_dist")


def wave_search(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, efs: int, predicate: Predicate | None = None, share: float = 0.0) -> DataFrame:
    return probe_search(assigned, queries, wave_probes(assigned, queries, centroids, efs, predicate, share=share), k, predicate)


def with_radii(assigned: DataFrame, centroids: DataFrame, predicate: Predicate | None = None) -> DataFrame:
    """centroids with radius (the farthest row of a cluster that passes a shared predicate, as a distance with its root) and n_rows; clusters without rows have none."""
    rows = assigned.where(predicate.column()) if predicate and not predicate.per_query else assigned
    farthest = rows.groupBy("cluster").agg(F.sqrt(F.max("cluster_dist")).alias("radius"), F.count("*").alias("n_rows"))
    return centroids.select("cluster", "centroid").join(farthest, "cluster")


#: What rounding may have added to a difference of two distances, relative to them.
SLACK = 1e-9


def first_wave(assigned: DataFrame, queries: DataFrame, known: DataFrame, rows: int, predicate: Predicate | None) -> DataFrame:
    """The nearest clusters of each query that hold so many rows; rows are counted once for all queries, so that a condition of each query's own may pass fewer."""
    return written(wave_probes(assigned, queries, known.select("cluster", "centroid"), rows, None if predicate and predicate.per_query else predicate), "first-clusters")


def bounded_probes(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, predicate: Predicate | None = None, first_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What bounded_search() takes first, as its k nearest (qid, rank, id, dist), and the clusters left that may hold nearer rows:
    qid, cluster, gap (the query's distance to the centroid, with its root), bound (how far the k-th nearest is so far, squared)."""
    known = with_radii(assigned, centroids, predicate)
    first = first_wave(assigned, queries, known, first_rows or k, predicate)
    found = written(probe_search(assigned, queries, first, k, predicate, in_ranges=True), "first-wave")
    bound = queries.select("qid").join(found.where(F.col("rank") == k).select("qid", F.col("dist").alias("bound")), "qid", "left")
    bound = bound.select("qid", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    ranked = rank_clusters(queries, known.select("cluster", "centroid")).join(_small(known.select("cluster", "radius")), "cluster").withColumn("gap", F.sqrt("cluster_dist"))
    left = ranked.join(first.select("qid", "cluster"), ["qid", "cluster"], "left_anti").join(bound, "qid")
    nearest = F.greatest(F.lit(0.0), F.col("gap") - F.col("radius") - SLACK * (F.col("gap") + F.col("radius")))
    return found, written(left.where(nearest * nearest <= F.col("bound")).select("qid", "cluster", "gap", "bound"), "clusters-left")


def _near_rows(assigned: DataFrame, left: DataFrame, predicate: Predicate | None) -> DataFrame:
    """Rows of the clusters left that the triangle inequality doesn't rule out."""
    rows = assigned.where(predicate.column()) if predicate and not predicate.per_query else assigned
    own = F.sqrt("cluster_dist")
    apart = F.greatest(F.lit(0.0), F.abs(own - F.col("gap")) - SLACK * (own + F.col("gap")))
    return rows.join(left, "cluster").where(apart * apart <= F.col("bound"))


def bounded_search(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, predicate: Predicate | None = None, first_rows: int | None = None) -> DataFrame:
    """The exact k nearest (squared L2) through clusters, in two passes.

    First the nearest clusters of each query, until they hold ``first_rows`` rows that pass (k by default): the k-th of these is as far as the
    result can reach.  Then, by the triangle inequality, only clusters whose centroid is no farther than this and the
    cluster's radius together, and of these only cells of rows whose bounds reach so far (see ``blocks``).
    Clusters end for each query where none can hold a nearer row; how early depends on how well the rows lie in clusters.
    assigned: with cluster and cluster_dist, as assign() gives."""
    found, left = bounded_probes(assigned, queries, centroids, k, predicate, first_rows)
    if blocks.usable(assigned, queries, predicate):
        rows = assigned.where(predicate.column()) if predicate and not predicate.per_query else assigned
        lists = left.groupBy("qid").agg(F.collect_list(F.col("cluster").cast("long")).alias("__met"), F.first("bound").alias("__bound"))
        asked = written(queries.join(lists, "qid"), "probes")
        dealt = _ranges(needed(rows, predicate, "embedding", "cluster"), predicate)
        more = blockwise(dealt, asked, k, predicate, "l2sq", by="cluster")
        return top_k(found.select("qid", "id", "dist").unionByName(more.select("qid", "id", "dist")), k)
    met = _near_rows(assigned, left, None if predicate and predicate.per_query else predicate).join(queries, "qid")
    if predicate and predicate.per_query:
        met = met.where(predicate.column())
    more = met.select("qid", "id", DISTANCES["l2sq"](F.col("embedding"), F.col("q")).alias("dist"))
    return top_k(found.select("qid", "id", "dist").unionByName(more), k)


def bounded_effort(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, predicate: Predicate | None = None, first_rows: int | None = None) -> DataFrame:
    """qid, clusters (taken, of n_clusters with passing rows), compared (rows that the triangle inequality leaves, of n_rows)."""
    known = with_radii(assigned, centroids, predicate)
    first = first_wave(assigned, queries, known, first_rows or k, predicate).select("qid", "cluster")
    _, left = bounded_probes(assigned, queries, centroids, k, predicate, first_rows)
    rows = assigned.where(predicate.column()) if predicate and not predicate.per_query else assigned
    whole = first.join(_small(known.select("cluster", F.col("n_rows").alias("n"))), "cluster").select("qid", "n")
    one = whole.unionByName(_shell_counts(rows, left))
    taken = first.unionByName(left.select("qid", "cluster")).groupBy("qid").agg(F.count("*").alias("clusters"))
    total = known.agg(F.count("*").alias("n_clusters"), F.sum("n_rows").alias("n_rows"))
    return taken.join(one.groupBy("qid").agg(F.sum("n").alias("compared")), "qid", "left").fillna(0, ["compared"]).crossJoin(F.broadcast(total))


def _shell_counts(rows: DataFrame, left: DataFrame) -> DataFrame:
    """qid, n: of each cluster left, the rows that the triangle inequality doesn't rule out, counted by bisection of the rows' distances to their centroid."""
    as_vector = F.array("gap", "bound", F.col("qid").cast("double"), F.col("cluster").cast("double"))  # by which blocks are measured
    parts = [_shell_block(rows, block.drop("q")) for block in query_blocks(left.withColumn("q", as_vector))]
    return reduce(DataFrame.unionByName, parts)


def _shell_block(rows: DataFrame, block: DataFrame) -> DataFrame:
    held = block.select(F.col("qid").cast("long"), F.col("cluster").cast("long"), "gap", "bound").orderBy("cluster").toArrow().combine_chunks()  # BROADCAST_BYTES at most
    shared = rows.sparkSession.sparkContext.broadcast([np.asarray(held.column(c)) for c in ("qid", "cluster", "gap", "bound")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, asked, gap, bound = shared.value
        held = [(np.asarray(b.column(0), np.int64), np.sqrt(np.asarray(b.column(1), float))) for b in batches if b.num_rows]
        if not held:
            return
        cluster, own = (np.concatenate(c) for c in zip(*held))
        by = np.lexsort((own, cluster))
        cluster, own = cluster[by], own[by]
        for number in np.unique(cluster).tolist():
            some = slice(*np.searchsorted(asked, [number, number + 1]))
            near = own[slice(*np.searchsorted(cluster, [number, number + 1]))]
            reach = np.sqrt(bound[some])
            low, high = (gap[some] * (1 - SLACK) - reach) / (1 + SLACK), (gap[some] * (1 + SLACK) + reach) / (1 - SLACK)
            n = np.searchsorted(near, high, "right") - np.searchsorted(near, low, "left")
            yield pa.RecordBatch.from_arrays([pa.array(qid[some]), pa.array(n.astype(np.int64))], ["qid", "n"])

    return rows.select(F.col("cluster").cast("long"), "cluster_dist").mapInArrow(run, "qid long, n long")


def imi_cells(base: DataFrame, halves: list[DataFrame], dim: int, vector: str = "embedding") -> DataFrame:
    """id, cell: inverted multi-index cell from the nearest centroid in each part of the vector (two or more of equal length)."""
    m = len(halves)
    width = dim // m
    out = base
    for i, centroids in enumerate(halves):
        part = base.select("id", F.slice(F.col(vector), i * width + 1, width).alias("embedding"))
        out = out.join(assign(part, centroids).select("id", F.col("cluster").alias(f"part_{i}")), "id")
    sizes = [h.count() for h in halves]
    cell = F.lit(0).cast("long")
    for i, n in enumerate(sizes):
        cell = cell * n + F.col(f"part_{i}")
    return out.select("id", cell.alias("cell"))


def rank_imi_cells(queries: DataFrame, halves: list[DataFrame], dim: int, nprobe: int) -> DataFrame:
    """The nprobe cells of each query with the least sum of part distances."""
    width = dim // len(halves)
    cells = None
    for i, centroids in enumerate(halves):
        part = rank_clusters(queries.select("qid", F.slice("q", i * width + 1, width).alias("q")), centroids).select("qid", F.col("cluster").alias(f"part_{i}"), F.col("cluster_dist").alias(f"dist_{i}"))
        cells = part if cells is None else cells.join(part, "qid")
    cell, dist = F.lit(0).cast("long"), F.lit(0.0)
    for i, centroids in enumerate(halves):
        cell, dist = cell * centroids.count() + F.col(f"part_{i}"), dist + F.col(f"dist_{i}")
    ranked = cells.select("qid", cell.alias("cluster"), dist.alias("cluster_dist"))
    ranked = ranked.withColumn("probe_rank", F.row_number().over(Window.partitionBy("qid").orderBy("cluster_dist", "cluster")))
    return ranked.where(F.col("probe_rank") <= nprobe)


def proclus_assign(base: DataFrame, medoids: DataFrame, vector: str = "embedding") -> DataFrame:
    """medoids: cluster, centroid, mask.  Nearest by L1 over the cluster's dimensions, divided by their number."""
    def distance(c):
        used = F.aggregate(c["mask"], F.lit(0), lambda s, m: s + (m != 0).cast("int"))
        return masked_l1(c["mask"])(F.col(vector), c["centroid"]) / used

    return _nearest(base.where(F.col(vector).isNotNull()), medoids.select("cluster", "centroid", "mask"), distance).select("id", "cluster", "cluster_dist")


def rerank(base: DataFrame, queries: DataFrame, shortlist: DataFrame, k: int) -> DataFrame:
    """shortlist: qid, id.  The k nearest of it by squared L2."""
    met = shortlist.select("qid", "id").join(queries, "qid").join(base, "id")
    return top_k(met.select("qid", "id", l2sq(F.col("embedding"), F.col("q")).alias("dist")), k)
