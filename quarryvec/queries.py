"""Every operator as a query over the test tables, with the SQL that must agree.

Attributes are derived from the ids by expressions that any engine has; queries are the rows
whose id is divisible by 20; fixed centroids are the first 16 rows.  These vectors lie in no clusters, so that a recall of 0.9
takes most clusters: ``NPROBE`` of 16, or waves that hold ``SHARE`` of the rows that pass.  An index is built and written once for a
folder of tables; the queries read it.

Names that end in ``_full`` walk without a bound, and so must return what exact search does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryvec.functions import quantize
from quarryvec.functions.distances import masked_l1
from quarryvec.operators import clustering, exact, generators, graph, hybrid, ivf, metrics
from quarryvec.operators import predicates as P
from quarryvec.sources import store, vectors
from quarryvec.sources.tables import scratch

K, NPROBE, SHARE = 10, 13, 0.85
ATTRS = "vec_id AS id, embedding, label, label AS attr_0, (vec_id * 7919) % 1000 AS attr_1, (vec_id * 104729) % 997 AS attr_2"
QUERY = "vec_id AS qid, embedding AS q, label AS q_label, (vec_id * 13) % 700 AS l_1, (vec_id * 13) % 700 + 250 AS u_1, (vec_id * 7) % 500 AS l_2, (vec_id * 7) % 500 + 400 AS u_2, (vec_id * 3) % 900 AS v_1, vec_id AS lo, vec_id + 150 AS hi"


def base(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").selectExpr(*[x.strip() for x in ATTRS.split(", ")])


def asked(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 20 = 0").selectExpr(*[x.strip() for x in QUERY.split(", ")])


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).where("id < 16").select(F.col("id").cast("int").alias("cluster"), F.col("embedding").alias("centroid"))


def _fold(term: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(x) + 1), lambda i: {term})), lambda s, v: s + v)"


L2 = "(x[i]::DOUBLE - y[i]::DOUBLE) * (x[i]::DOUBLE - y[i]::DOUBLE)"
CTE = f"WITH base AS (SELECT {ATTRS} FROM embeddings), asked AS (SELECT {QUERY} FROM embeddings WHERE vec_id % 20 = 0), centroids AS (SELECT CAST(id AS INTEGER) AS cluster, embedding AS centroid FROM base WHERE id < 16)"


def _top(scored: str, k: int = K) -> str:
    return f"SELECT qid, rank, id, dist FROM (SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank FROM ({scored})) WHERE rank <= {k}"


def _scored(where: str = "true", term: str = L2, final: str = "d", rows: str = "base") -> str:
    return f"SELECT qid, id, {final} AS dist FROM (SELECT qid, id, {_fold(term)} AS d FROM (SELECT qid, id, embedding AS x, q AS y FROM {rows} JOIN asked ON {where}))"


def _knn(where: str = "true", **more) -> str:
    return f"{CTE} {_top(_scored(where, **more))}"


_NEAR = f"near AS (SELECT id, cluster, {_fold(L2)} AS dist FROM (SELECT id, cluster, embedding AS x, centroid AS y FROM base, centroids))"
_ASSIGNED = "assigned AS (SELECT base.*, a.cluster, a.cluster_dist FROM base JOIN (SELECT id, cluster, dist AS cluster_dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS r FROM near) WHERE r = 1) a USING (id))"
_RANKED = f"ranked AS (SELECT qid, cluster, CAST(row_number() OVER (PARTITION BY qid ORDER BY cluster_dist, cluster) AS INTEGER) AS probe_rank, cluster_dist FROM (SELECT qid, cluster, {_fold(L2)} AS cluster_dist FROM (SELECT qid, cluster, q AS x, centroid AS y FROM asked, centroids)))"
IVF = f"{CTE}, {_NEAR}, {_ASSIGNED}, {_RANKED}"
_TRUTH = f"truth AS ({_top(_scored())})"
_FOUND = f"found AS ({_top(_scored('true', rows='(SELECT * FROM base WHERE id % 3 <> 1)'))})"


def _probe_sql(probes: str, where: str = "true") -> str:
    return _top(f"SELECT qid, id, {_fold(L2)} AS dist FROM (SELECT p.qid, id, embedding AS x, q AS y FROM assigned JOIN ({probes}) p USING (cluster) JOIN asked USING (qid) WHERE {where})")


def _assigned(spark, d):
    return ivf.assign(base(spark, d), centroids(spark, d))


def _ranked(spark, d, n=None):
    return ivf.rank_clusters(asked(spark, d), centroids(spark, d), n)


def _index(spark, d) -> hybrid.Index:
    return store.index_for(spark, d, lambda: hybrid.build(base(spark, d), 16, 4, centroids=centroids(spark, d)))


FULL = 1 << 30


def _tree(spark, d):
    """Walks by turns with the cells of a box layout."""
    index = store.index_for(spark, f"embedding-cells:{d}", lambda: hybrid.build_cells(base(spark, d), ["attr_0", "attr_1"], shards=4))
    return hybrid.search(index, asked(spark, d), hybrid.SearchOptions("tree", efs=FULL, walk=graph.GraphOptions("plain")), _BOX2)


def _removed(spark, d, again: bool = False):
    """The graphs after a third of the rows is removed and, then, put in again."""
    index = _index(spark, d)
    gone = base(spark, d).where("id % 3 = 1")
    shards = graph.remove_rows(index.shards, gone)
    shards = graph.insert_rows(shards, gone) if again else shards
    return graph.search(None, shards, asked(spark, d), K, None, graph.GraphOptions("plain", ef=FULL))


def _graph(spark, d, how, predicate=P.between("attr_0", 2, 6), ef=64):
    index = _index(spark, d)
    return graph.search(index.assigned, index.shards, asked(spark, d), K, predicate, graph.GraphOptions(how=how, ef=ef))


def _simple(predicate: P.Predicate, **more):
    return lambda s, d: exact.filtered_knn(base(s, d), asked(s, d), K, predicate, **more)


def _hybrid(strategy: str, predicate=P.between("attr_0", 2, 6), efs=100, members=None, **more):
    def run(s, d):
        walk = graph.GraphOptions(how="plain" if efs == FULL else "two_hop", **more)
        options = hybrid.SearchOptions(strategy=strategy, efs=efs, share=SHARE, walk=walk)
        return hybrid.search(_index(s, d), asked(s, d), options, None if members else predicate, members(s, d) if members else None)

    return run


def _members(s, d):
    """For each query the rows whose number and the query's add up to a multiple of 3."""
    return asked(s, d).select("qid").join(base(s, d).select("id"), (F.col("qid") + F.col("id")) % 3 == 0)


def _effort(s, d):
    return metrics.proposals(graph.comparisons(hybrid.walked(_index(s, d), asked(s, d), hybrid.SearchOptions("cooperative"), P.between("attr_0", 2, 6))))


def _stored(kind: str, whole: bool = False):
    """The table written as vector files, part by part, and read again: an element a row."""
    def run(s, d):
        at = scratch(s, "vectors")
        b = base(s, d).withColumn("embedding", F.array("label", "attr_1", "attr_2")) if whole else base(s, d)
        vectors.write_parts(b, at, kind)
        return vectors.read_vectors(s, at, kind, **({"dim": 64} if kind == "raw" else {})).select("id", F.posexplode("embedding").alias("i", "v"))

    return run


def _bounds(s, d):
    at = scratch(s, "bounds")
    rows = asked(s, d).select(F.col("qid"), F.col("l_1").alias("l_0"), F.col("u_1").alias("u_0"))
    vectors.write_ranges(rows, at, 1)
    numbered = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("qid")) - 1
    names = rows.select("qid", numbered.cast("long").alias("row"))
    read = vectors.bounds_rows(s, at, rows.count(), 1).withColumnRenamed("qid", "row")
    return names.join(read, "row").select("qid", "l_0", "u_0")


def _runs(s, d):
    """Parts of orders stand in for a log of runs."""
    o = s.read.parquet(f"{d}/lineitem.parquet")
    return o.select(F.col("l_returnflag").alias("method"), F.col("l_shipmode" if "l_shipmode" in o.columns else "l_linestatus").alias("workload"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ts"), F.col("l_extendedprice").alias("qps"), (F.col("l_discount") * 10).alias("recall"), F.col("l_quantity").alias("ncomp"))


_BOX2 = P.box({"attr_0": (2, 7), "attr_1": (100, 800)})
_ROW_BOX = P.query_box({"attr_1": ("l_1", "u_1")})
_ROW_SQL = "attr_1 >= l_1 AND attr_1 <= u_1"


def _halves(s, d):
    c = centroids(s, d).where("cluster < 4")
    return [c.select("cluster", F.slice("centroid", 1, 32).alias("centroid")), c.select("cluster", F.slice("centroid", 33, 32).alias("centroid"))]


def _imi_sql() -> str:
    part = "near{i} AS (SELECT id, cluster, {f} AS dist FROM (SELECT id, cluster, embedding[{a}:{b}] AS x, centroid[{a}:{b}] AS y FROM base, centroids WHERE cluster < 4)), part{i} AS (SELECT id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS r FROM near{i}) WHERE r = 1)"
    parts = ", ".join(part.format(i=i, f=_fold(L2), a=32 * i + 1, b=32 * i + 32) for i in range(2))
    return f"{CTE}, {parts} SELECT id, CAST(part0.cluster AS BIGINT) * 4 + part1.cluster AS cell FROM part0 JOIN part1 USING (id)"


def _masked(s, d):
    mask = F.array(*[F.lit(1 if i % 3 == 0 else 0) for i in range(64)])
    return exact.filtered_knn(base(s, d), asked(s, d), K, P.between("attr_0", 2, 6), metric=masked_l1(mask))


def _proclus(s, d):
    mask = F.array(*[F.lit(1 if i % 2 == 0 else 0) for i in range(64)])
    return ivf.proclus_assign(base(s, d), centroids(s, d).withColumn("mask", mask))


def _sq8(s, d):
    """Codes between -1 and 1, the range of unit vectors."""
    b = base(s, d).withColumn("embedding", quantize.encode_sq8(F.col("embedding"), -1.0, 1.0))
    q = asked(s, d).withColumn("q", quantize.encode_sq8(F.col("q"), -1.0, 1.0))
    return exact.filtered_knn(b, q, K, P.between("attr_0", 2, 6))


def _wave_sq8(s, d):
    """Clusters and rows by their codes."""
    b = base(s, d).withColumn("embedding", quantize.encode_sq8(F.col("embedding"), -1.0, 1.0))
    q = asked(s, d).withColumn("q", quantize.encode_sq8(F.col("q"), -1.0, 1.0))
    c = centroids(s, d).withColumn("centroid", quantize.encode_sq8(F.col("centroid"), -1.0, 1.0))
    return ivf.wave_search(ivf.assign(b, c), q, c, K, 60, P.between("attr_0", 2, 6), SHARE)


def _code(x: str) -> str:
    return f"list_transform({x}, lambda v: least(255, greatest(0, CAST(floor((v::DOUBLE - (-1.0::DOUBLE)) / {2.0 / 255!r}::DOUBLE) AS INTEGER))))"


def _pca(s, d, parts: int = 32, first: int = 20 * K):
    """The nearest in the space of some components, ranked again by the vectors themselves."""
    b = base(s, d)
    project = quantize.pca(b, parts)
    q = project(asked(s, d), "q", "p").drop("q").withColumnRenamed("p", "q")
    return ivf.rerank(b, asked(s, d), exact.filtered_knn(project(b), q, first, vector="projected"), K)


def _cells(s, d):
    return ivf.imi_cells(base(s, d), _halves(s, d), 64).withColumnRenamed("cell", "cluster")


def _pca_search(s, d):
    b = base(s, d)
    project = quantize.pca(b, 8)
    pb = project(b).withColumnRenamed("embedding", "whole").withColumnRenamed("projected", "embedding")
    pq = project(asked(s, d), "q", "p").drop("q").withColumnRenamed("p", "q")
    c = ivf.train(pb, 8)
    probes = ivf.rank_clusters(pq, c, 7)
    near = ivf.assign(pb, c).drop("embedding").withColumnRenamed("whole", "embedding")
    return ivf.probe_search(near, asked(s, d), probes, K)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "knn_unfiltered": lambda s, d: exact.filtered_knn(base(s, d), asked(s, d), K),
        "knn_unfiltered_arrow": lambda s, d: exact.arrow_knn(base(s, d), asked(s, d), K),
        "knn_shared_range": lambda s, d: exact.arrow_knn(base(s, d), asked(s, d), K, P.between("attr_0", 2, 6)),
        "knn_range_1d": _simple(P.between("attr_0", 2, 6)),
        "knn_range_2d": _simple(_BOX2),
        "knn_range_3d": _simple(P.box({"attr_0": (1, 8), "attr_1": (100, 900), "attr_2": (50, 900)})),
        "knn_per_query_range": _simple(_ROW_BOX),
        "knn_per_query_box": _simple(P.query_box({"attr_1": ("l_1", "u_1"), "attr_2": ("l_2", "u_2")})),
        "knn_onesided": _simple(P.query_compare("attr_1", ">=", "v_1")),
        "knn_point": _simple(P.query_compare("attr_0", "=", "q_label")),
        "knn_negation": _simple(P.query_compare("attr_0", "!=", "q_label")),
        "knn_packed_range": _simple(P.packed("lo", "hi", P.between("attr_1", 0, 800))),
        "knn_label_equal": lambda s, d: exact.label_knn(base(s, d), asked(s, d), K, "label", "q_label"),
        "knn_disjunction": _simple(P.any_of(P.between("attr_1", 0, 100), P.between("attr_1", 500, 550), P.between("attr_2", 900, 950))),
        "knn_expression": _simple(P.sql("attr_0 >= 2 and attr_0 <= 6 and not attr_1 = 7")),
        "knn_bitset_semi": lambda s, d: exact.member_knn(base(s, d), asked(s, d), K, base(s, d).where("attr_1 between 200 and 700 and attr_0 <> 3")),
        "knn_tombstone": lambda s, d: exact.filtered_knn(exact.without_deleted(base(s, d), base(s, d).where("id % 3 = 1")), asked(s, d), K),
        "knn_upsert": lambda s, d: exact.filtered_knn(exact.upsert(base(s, d), base(s, d).where("id % 7 = 2").withColumn("embedding", F.transform("embedding", lambda v: -v))), asked(s, d), K),
        "knn_inner_product": _simple(P.between("attr_0", 2, 6), metric="ip"),
        "knn_l1": _simple(P.between("attr_0", 2, 6), metric="l1"),
        "knn_masked_l1": _masked,
        "knn_sq8": _sq8,
        "knn_pca": _pca,
        "knn_pca_full": lambda s, d: _pca(s, d, 64, 2 * K),
        "knn_multivector_docs": lambda s, d: exact.nearest_documents(base(s, d).withColumn("doc", F.col("id") % 40), asked(s, d), K, "doc"),
        "knn_epsilon": lambda s, d: exact.within(base(s, d), asked(s, d), 1.2, 50),
        "postfilter": lambda s, d: exact.postfiltered_knn(base(s, d), asked(s, d), K, 60, P.between("attr_0", 2, 6)),
        "selectivity_shared": lambda s, d: P.selectivity(base(s, d), _BOX2),
        "selectivity_per_query": lambda s, d: P.selectivity_by_query(base(s, d), asked(s, d), _ROW_BOX),
        "assign_clusters": lambda s, d: _assigned(s, d).select("id", "cluster", "cluster_dist"),
        "rank_clusters": _ranked,
        "ivf_range": lambda s, d: ivf.probe_search(_assigned(s, d), asked(s, d), _ranked(s, d, NPROBE), K, P.between("attr_0", 2, 6)),
        "ivf_box_2d": lambda s, d: ivf.probe_search(_assigned(s, d), asked(s, d), _ranked(s, d, NPROBE), K, _BOX2),
        "ivf_per_query_range": lambda s, d: ivf.probe_search(_assigned(s, d), asked(s, d), _ranked(s, d, NPROBE), K, _ROW_BOX),
        "ivf_exhaustive": lambda s, d: ivf.search(_assigned(s, d), asked(s, d), centroids(s, d), K, 16, P.between("attr_0", 2, 6)),
        "ivf_wave": lambda s, d: ivf.wave_search(_assigned(s, d), asked(s, d), centroids(s, d), K, 60, P.between("attr_0", 2, 6), SHARE),
        "ivf_wave_per_query": lambda s, d: ivf.wave_search(_assigned(s, d), asked(s, d), centroids(s, d), K, 40, _ROW_BOX, SHARE),
        "ivf_wave_sq8": _wave_sq8,
        "ivf_pca": _pca_search,
        "imi_cells": lambda s, d: ivf.imi_cells(base(s, d), _halves(s, d), 64),
        "imi_search": lambda s, d: ivf.probe_search(base(s, d).join(_cells(s, d), "id"), asked(s, d), ivf.rank_imi_cells(asked(s, d), _halves(s, d), 64, 13), K, P.between("attr_0", 2, 6)),
        "proclus_assign": _proclus,
        "cluster_histogram": lambda s, d: metrics.cluster_histogram(_assigned(s, d), centroids(s, d)),
        "cluster_imbalance": lambda s, d: metrics.imbalance(metrics.cluster_histogram(_assigned(s, d), centroids(s, d))),
        "topk_cluster_rank_hist": lambda s, d: metrics.rank_histogram(exact.filtered_knn(base(s, d), asked(s, d), K), _assigned(s, d), _ranked(s, d)),
        "cluster_rank_cumulative": lambda s, d: metrics.cumulative(metrics.rank_histogram(exact.filtered_knn(base(s, d), asked(s, d), K), _assigned(s, d), _ranked(s, d))),
        "recall_tie_tolerant": lambda s, d: metrics.recall(exact.filtered_knn(base(s, d).where("id % 3 <> 1"), asked(s, d), K), exact.filtered_knn(base(s, d), asked(s, d), K), K),
        "recall_strict": lambda s, d: metrics.recall(exact.filtered_knn(base(s, d).where("id % 3 <> 1"), asked(s, d), K), exact.filtered_knn(base(s, d), asked(s, d), K), K, ties=False),
        "duplicate_vectors": lambda s, d: metrics.duplicate_vectors(base(s, d).unionByName(base(s, d).where("id % 5 = 0").withColumn("id", F.col("id") + 1_000_000))),
        "kmedoid_step": lambda s, d: clustering.medoid_step(_assigned(s, d)),
        "subspace_variance": lambda s, d: clustering.subspace_variance(_assigned(s, d)).select("cluster", "dim", F.round("variance", 9).alias("variance")),
        "range_quantiles": lambda s, d: metrics.quantile_summary(base(s, d), "attr_1", 0.9).withColumnRenamed("p", "p90"),
        "attr_correlation": lambda s, d: base(s, d).agg(F.round(F.corr("attr_1", "attr_2"), 9).alias("rho")),
        "best_qps_at_recall": lambda s, d: metrics.best_at_recall(_runs(s, d), 0.5, ["method"]),
        "last3_runs": lambda s, d: metrics.last_runs(_runs(s, d), ["method", "workload"]).select("method", "workload", "max_qps", F.round("mean_qps", 6).alias("mean_qps")),
        "kmeans_train": lambda s, d: ivf.train(base(s, d), 8),
        "bikmeans_train": lambda s, d: ivf.train(base(s, d), 8, "bisecting"),
        "kmedoids_train": lambda s, d: clustering.kmedoids(base(s, d), 8, 2),
        "proclus_train": lambda s, d: clustering.proclus(base(s, d), 8, 16)[1],
        "graph_build": lambda s, d: graph.build_graph(base(s, d), 4),
        "graph_relative": lambda s, d: graph.build_graph(base(s, d), 4, kind="relative"),
        "graph_dense": lambda s, d: graph.build_graph(base(s, d), 4, m=8, kind="dense"),
        "graph_search": lambda s, d: _graph(s, d, "plain"),
        "graph_two_hop": lambda s, d: _graph(s, d, "two_hop"),
        "graph_directed": lambda s, d: _graph(s, d, "directed"),
        "graph_subgraph": lambda s, d: _graph(s, d, "subgraph"),
        "graph_one_hop": lambda s, d: _graph(s, d, "one_hop"),
        "graph_in_place": lambda s, d: _graph(s, d, "in_place"),
        "graph_improving": lambda s, d: _graph(s, d, "improving"),
        "graph_exhaustive": lambda s, d: _graph(s, d, "plain", ef=FULL),
        "graph_per_query_range": lambda s, d: _graph(s, d, "two_hop", _ROW_BOX, 128),
        "graph_negation_full": lambda s, d: _graph(s, d, "plain", P.query_compare("attr_0", "!=", "q_label"), FULL),
        "degree_histogram": lambda s, d: graph.degree_histogram(graph.edges_of(_index(s, d).shards)),
        "inbound_degree": lambda s, d: graph.inbound_degree(graph.edges_of(_index(s, d).shards)),
        "hybrid_search": _hybrid("cooperative"),
        "hybrid_clusters": _hybrid("clusters"),
        "hybrid_planned": _hybrid("auto"),
        "hybrid_per_query": _hybrid("cooperative", _ROW_BOX),
        "hybrid_negation": _hybrid("cooperative", P.query_compare("attr_0", "!=", "q_label")),
        "hybrid_packed": _hybrid("cooperative", P.packed("lo", "hi", P.between("attr_1", 0, 800))),
        "hybrid_members": _hybrid("cooperative", members=_members),
        "hybrid_directed": lambda s, d: hybrid.search(_index(s, d), asked(s, d), hybrid.SearchOptions("cooperative", walk=graph.GraphOptions("directed")), P.between("attr_0", 2, 6)),
        "hybrid_alternate": _hybrid("alternate"),
        "hybrid_race": _hybrid("race"),
        "hybrid_graph_first": _hybrid("graph_first"),
        "hybrid_frontier": _hybrid("frontier"),
        "hybrid_relational": _hybrid("relational", efs=400),
        "hybrid_ranked_by_graph": _hybrid("cooperative", rank="graph"),
        "hybrid_search_full": _hybrid("cooperative", efs=FULL),
        "hybrid_per_query_full": _hybrid("cooperative", _ROW_BOX, FULL),
        "hybrid_negation_full": _hybrid("alternate", P.query_compare("attr_0", "!=", "q_label"), FULL),
        "hybrid_point_full": _hybrid("race", P.query_compare("attr_0", "=", "q_label"), FULL),
        "hybrid_onesided_full": _hybrid("graph_first", P.query_compare("attr_1", ">=", "v_1"), FULL),
        "hybrid_packed_full": _hybrid("frontier", P.packed("lo", "hi", P.between("attr_1", 0, 800)), FULL),
        "hybrid_members_full": _hybrid("cooperative", efs=FULL, members=_members),
        "hybrid_relational_full": _hybrid("relational", P.any_of(P.between("attr_1", 0, 100), P.between("attr_1", 500, 550), P.between("attr_2", 900, 950)), FULL),
        "hybrid_tree_full": _tree,
        "graph_removed_full": _removed,
        "graph_reinserted_full": lambda s, d: _removed(s, d, True),
        "hybrid_effort": _effort,
        "knn_member_per_query": lambda s, d: exact.member_knn(base(s, d), asked(s, d), K, _members(s, d)),
        "knn_regex": lambda s, d: exact.filtered_knn(base(s, d).withColumn("name", F.concat(F.lit("v"), F.col("attr_1").cast("string"))), asked(s, d), K, P.matches("name", "^v[1-3]?[0-9]?[05]$")),
        "transplanted_clusters": lambda s, d: clustering.transplant(_assigned(s, d), base(s, d).where("id between 16 and 39").select((F.col("id") - 16).cast("int").alias("cluster"), F.col("embedding").alias("centroid"))).select("id", "cluster", "cluster_dist"),
        "cluster_sizes_sorted": lambda s, d: metrics.sorted_histogram(metrics.cluster_histogram(_assigned(s, d), centroids(s, d))),
        "recall_by_k": lambda s, d: metrics.recall_at(exact.filtered_knn(base(s, d).where("id % 3 <> 1"), asked(s, d), K), exact.filtered_knn(base(s, d), asked(s, d), K), [1, 5, 10], ties=False).select("k", "queries", F.round("recall", 9).alias("recall")),
        "runs_by_recall": lambda s, d: metrics.by_recall(_runs(s, d), ["method"]).select("method", "place", "ts"),
        "sq8_range": lambda s, d: s.createDataFrame([quantize.train_sq8(base(s, d))], "low double, high double"),
        "vectors_fvecs": _stored("fvecs"),
        "vectors_fbin": _stored("fbin"),
        "vectors_raw": _stored("raw"),
        "vectors_ivecs": _stored("ivecs", True),
        "vectors_ibin": _stored("ibin", True),
        "vectors_bounds": _bounds,
        "workload_attributes": lambda s, d: generators.correlated(generators.zipf(generators.uniform(base(s, d).select("id"), 2))).select("id", "attr_0", "attr_1", "skewed", "correlated1", "correlated2"),
        "workload_ranges": lambda s, d: generators.ranges(asked(s, d).select("qid"), base(s, d), "attr_1"),
        "workload_values": lambda s, d: generators.values(asked(s, d).select("qid"), base(s, d), "attr_1"),
    }


def oracle_sql() -> dict[str, str]:
    two_to_six = _knn("attr_0 BETWEEN 2 AND 6")
    probes = "SELECT qid, cluster FROM ranked WHERE probe_rank <= {n}"
    wave = "SELECT qid, cluster FROM (SELECT r.qid, r.cluster, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY r.qid ORDER BY probe_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(sum(n) OVER (PARTITION BY r.qid), 0) AS total, probe_rank FROM ranked r LEFT JOIN ({counts}) c ON {on}) WHERE before < {efs} OR before < 0.85 * total OR probe_rank <= 1"
    recall = "SELECT t.qid, count_if({hit})::BIGINT AS tp, max(t.n_truth) AS n_truth, count(f.id) AS n_result, count_if({hit}) / max(t.n_truth) AS recall, count_if({hit}) / nullif(count(f.id), 0) AS precision FROM (SELECT qid, count(*) AS n_truth, max(dist) AS farthest FROM truth GROUP BY qid) t LEFT JOIN (SELECT f.*, truth.id IS NOT NULL AS hit FROM found f LEFT JOIN truth USING (qid, id)) f ON f.qid = t.qid GROUP BY t.qid"
    hist = f"{IVF}, {_TRUTH}, hist AS (SELECT probe_rank, count(*) AS n FROM truth JOIN assigned USING (id) JOIN ranked USING (qid, cluster) GROUP BY probe_rank)"
    runs = "SELECT l_returnflag AS method, l_linestatus AS workload, l_orderkey * 10 + l_linenumber AS ts, l_extendedprice AS qps, l_discount * 10 AS recall, l_quantity AS ncomp FROM lineitem"
    def coded(text: str) -> str:
        """The same over codes."""
        return text.replace(f"SELECT {ATTRS} FROM embeddings", f"SELECT {ATTRS} FROM (SELECT * REPLACE ({_code('embedding')} AS embedding) FROM embeddings)").replace(f"SELECT {QUERY} FROM embeddings", f"SELECT {QUERY} FROM (SELECT * REPLACE ({_code('embedding')} AS embedding) FROM embeddings)")

    masked = "abs(x[i]::DOUBLE - y[i]::DOUBLE) * CASE WHEN (i - 1) % {m} = 0 THEN 1 ELSE 0 END"
    return {
        "knn_unfiltered": _knn(),
        "knn_unfiltered_arrow": _knn(),
        "knn_shared_range": two_to_six,
        "knn_range_1d": two_to_six,
        "knn_range_2d": _knn("attr_0 BETWEEN 2 AND 7 AND attr_1 BETWEEN 100 AND 800"),
        "knn_range_3d": _knn("attr_0 BETWEEN 1 AND 8 AND attr_1 BETWEEN 100 AND 900 AND attr_2 BETWEEN 50 AND 900"),
        "knn_per_query_range": _knn(_ROW_SQL),
        "knn_per_query_box": _knn(f"{_ROW_SQL} AND attr_2 >= l_2 AND attr_2 <= u_2"),
        "knn_onesided": _knn("attr_1 >= v_1"),
        "knn_point": _knn("attr_0 = q_label"),
        "knn_negation": _knn("attr_0 <> q_label"),
        "knn_packed_range": _knn("id >= lo AND id <= hi AND attr_1 BETWEEN 0 AND 800"),
        "knn_label_equal": _knn("label = q_label"),
        "knn_disjunction": _knn("attr_1 BETWEEN 0 AND 100 OR attr_1 BETWEEN 500 AND 550 OR attr_2 BETWEEN 900 AND 950"),
        "knn_expression": _knn("attr_0 >= 2 AND attr_0 <= 6 AND attr_1 <> 7"),
        "knn_bitset_semi": _knn("attr_1 BETWEEN 200 AND 700 AND attr_0 <> 3"),
        "knn_tombstone": _knn("id % 3 <> 1"),
        "hybrid_tree_full": _knn("attr_0 BETWEEN 2 AND 7 AND attr_1 BETWEEN 100 AND 800"),
        "graph_removed_full": _knn("id % 3 <> 1"),
        "graph_reinserted_full": _knn(),
        "knn_upsert": _knn(rows="(SELECT id, CASE WHEN id % 7 = 2 THEN list_transform(embedding, lambda v: -v) ELSE embedding END AS embedding FROM base)"),
        "knn_inner_product": _knn("attr_0 BETWEEN 2 AND 6", term="x[i]::DOUBLE * y[i]::DOUBLE", final="1.0::DOUBLE - d"),
        "knn_l1": _knn("attr_0 BETWEEN 2 AND 6", term="abs(x[i]::DOUBLE - y[i]::DOUBLE)"),
        "knn_masked_l1": _knn("attr_0 BETWEEN 2 AND 6", term=masked.format(m=3)),
        "knn_sq8": f"{CTE}, b8 AS (SELECT id, attr_0, {_code('embedding')} AS embedding FROM base), q8 AS (SELECT qid, {_code('q')} AS q FROM asked) " + _top(f"SELECT qid, id, {_fold(L2)} AS dist FROM (SELECT qid, id, embedding AS x, q AS y FROM b8 JOIN q8 ON attr_0 BETWEEN 2 AND 6)"),
        "knn_multivector_docs": f"{CTE}, scored AS ({_scored()}), best AS (SELECT qid, id % 40 AS doc, dist, id, row_number() OVER (PARTITION BY qid, id % 40 ORDER BY dist, id) AS r FROM scored) SELECT qid, rank, doc, id, dist FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, doc) AS INTEGER) AS rank, doc, id, dist FROM best WHERE r = 1) WHERE rank <= {K}",
        "knn_epsilon": f"{CTE}, scored AS ({_scored()}) {_top('SELECT * FROM scored WHERE dist <= 1.2', 50)}",
        "postfilter": f"{CTE}, near AS ({_top(_scored(), 60)}) {_top('SELECT qid, id, dist FROM near JOIN base USING (id) WHERE attr_0 BETWEEN 2 AND 6')}",
        "selectivity_shared": f"{CTE} SELECT count(*) AS n, count_if(attr_0 BETWEEN 2 AND 7 AND attr_1 BETWEEN 100 AND 800)::BIGINT AS n_pass, count_if(attr_0 BETWEEN 2 AND 7 AND attr_1 BETWEEN 100 AND 800) / count(*) AS selectivity FROM base",
        "selectivity_per_query": f"{CTE} SELECT qid, count(id) AS n_pass FROM asked LEFT JOIN base ON {_ROW_SQL} GROUP BY qid",
        "assign_clusters": f"{IVF} SELECT id, cluster, cluster_dist FROM assigned",
        "rank_clusters": f"{IVF} SELECT qid, cluster, probe_rank, cluster_dist FROM ranked",
        "ivf_range": f"{IVF} {_probe_sql(probes.format(n=NPROBE), 'attr_0 BETWEEN 2 AND 6')}",
        "ivf_box_2d": f"{IVF} {_probe_sql(probes.format(n=NPROBE), 'attr_0 BETWEEN 2 AND 7 AND attr_1 BETWEEN 100 AND 800')}",
        "ivf_per_query_range": f"{IVF} {_probe_sql(probes.format(n=NPROBE), _ROW_SQL)}",
        "ivf_exhaustive": two_to_six,
        "ivf_wave": f"{IVF} {_probe_sql(wave.format(counts='SELECT cluster, count(*) AS n FROM assigned WHERE attr_0 BETWEEN 2 AND 6 GROUP BY cluster', on='r.cluster = c.cluster', efs=60), 'attr_0 BETWEEN 2 AND 6')}",
        "ivf_wave_per_query": f"{IVF} {_probe_sql(wave.format(counts=f'SELECT qid, cluster, count(*) AS n FROM assigned JOIN asked ON {_ROW_SQL} GROUP BY qid, cluster', on='r.cluster = c.cluster AND r.qid = c.qid', efs=40), _ROW_SQL)}",
        "ivf_wave_sq8": coded(f"{IVF} {_probe_sql(wave.format(counts='SELECT cluster, count(*) AS n FROM assigned WHERE attr_0 BETWEEN 2 AND 6 GROUP BY cluster', on='r.cluster = c.cluster', efs=60), 'attr_0 BETWEEN 2 AND 6')}"),
        "imi_cells": _imi_sql(),
        "proclus_assign": f"{CTE}, near AS (SELECT id, cluster, {_fold(masked.format(m=2))} / 32 AS dist FROM (SELECT id, cluster, embedding AS x, centroid AS y FROM base, centroids)) SELECT id, cluster, dist AS cluster_dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS r FROM near) WHERE r = 1",
        "cluster_histogram": f"{IVF} SELECT cluster, count(assigned.id) AS n FROM centroids LEFT JOIN assigned USING (cluster) GROUP BY cluster",
        "cluster_imbalance": f"{IVF}, h AS (SELECT cluster, count(assigned.id) AS n FROM centroids LEFT JOIN assigned USING (cluster) GROUP BY cluster) SELECT count(*) * sum(n * n) / (sum(n) * sum(n)) AS imbalance FROM h",
        "topk_cluster_rank_hist": f"{hist} SELECT probe_rank, n FROM hist",
        "cluster_rank_cumulative": f"{hist} SELECT probe_rank, n, sum(n) OVER (ORDER BY probe_rank) / (SELECT sum(n) FROM hist) AS share FROM hist",
        "recall_tie_tolerant": f"{CTE}, {_TRUTH}, {_FOUND} " + recall.format(hit="f.hit OR f.dist <= t.farthest + 0.001"),
        "recall_strict": f"{CTE}, {_TRUTH}, {_FOUND} " + recall.format(hit="f.hit"),
        "duplicate_vectors": f"{CTE} SELECT min(id) AS first_id, count(*) AS n FROM (SELECT id, embedding FROM base UNION ALL SELECT id + 1000000, embedding FROM base WHERE id % 5 = 0) GROUP BY embedding HAVING count(*) > 1",
        "kmedoid_step": f"{IVF}, pairs AS (SELECT a.cluster, a.id, {_fold(L2).replace('x', 'a.embedding').replace('y[', 'b.embedding[')} AS d FROM assigned a JOIN assigned b ON a.cluster = b.cluster), cost AS (SELECT cluster, id, round(sum(d), 6) AS cost FROM pairs GROUP BY cluster, id) SELECT cluster, id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cost, id) AS r FROM cost) WHERE r = 1",
        "subspace_variance": f"{IVF} SELECT cluster, dim, round(var_pop(v), 9) AS variance FROM (SELECT cluster, CAST(unnest(range(0, 64)) AS INTEGER) AS dim, unnest(embedding)::DOUBLE AS v FROM assigned) GROUP BY cluster, dim",
        "range_quantiles": f"{CTE} SELECT quantile_cont(attr_1, 0.9) AS p90, min(attr_1) AS low, max(attr_1) AS high FROM base",
        "attr_correlation": f"{CTE} SELECT round(corr(attr_1, attr_2), 9) AS rho FROM base",
        "best_qps_at_recall": f"SELECT method, max(qps) AS best_qps, min(ncomp) AS least_ncomp FROM ({runs}) WHERE recall >= 0.5 GROUP BY method",
        "last3_runs": f"SELECT method, workload, max(qps) AS max_qps, round(avg(qps), 6) AS mean_qps FROM (SELECT *, row_number() OVER (PARTITION BY method, workload ORDER BY ts DESC) AS age FROM ({runs})) WHERE age <= 3 GROUP BY method, workload",
        "graph_exhaustive": two_to_six,
        "graph_negation_full": _knn("attr_0 <> q_label"),
        "hybrid_planned": two_to_six,
        "hybrid_search_full": two_to_six,
        "hybrid_per_query_full": _knn(_ROW_SQL),
        "hybrid_negation_full": _knn("attr_0 <> q_label"),
        "hybrid_point_full": _knn("attr_0 = q_label"),
        "hybrid_onesided_full": _knn("attr_1 >= v_1"),
        "hybrid_packed_full": _knn("id >= lo AND id <= hi AND attr_1 BETWEEN 0 AND 800"),
        "hybrid_members_full": _knn("(qid + id) % 3 = 0"),
        "hybrid_relational_full": _knn("attr_1 BETWEEN 0 AND 100 OR attr_1 BETWEEN 500 AND 550 OR attr_2 BETWEEN 900 AND 950"),
        "knn_pca_full": _knn(),
        "knn_member_per_query": _knn("(qid + id) % 3 = 0"),
        "knn_regex": _knn("regexp_matches('v' || attr_1::VARCHAR, '^v[1-3]?[0-9]?[05]$')"),
        "transplanted_clusters": f"{IVF.replace('embedding AS centroid FROM base WHERE id < 16', 'embedding AS centroid FROM base WHERE id BETWEEN 16 AND 39').replace('CAST(id AS INTEGER) AS cluster', 'CAST(id - 16 AS INTEGER) AS cluster')} SELECT id, cluster, cluster_dist FROM assigned",
        "cluster_sizes_sorted": f"{IVF}, h AS (SELECT cluster, count(assigned.id) AS n FROM centroids LEFT JOIN assigned USING (cluster) GROUP BY cluster) SELECT CAST(row_number() OVER (ORDER BY n DESC, cluster) AS INTEGER) AS place, cluster, n FROM h",
        "recall_by_k": f"{CTE}, {_TRUTH}, {_FOUND} " + " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS queries, round(avg(r), 9) AS recall FROM (SELECT t.qid, count(f.id) / count(*) AS r FROM truth t LEFT JOIN (SELECT qid, id FROM found WHERE rank <= {k}) f ON f.qid = t.qid AND f.id = t.id WHERE t.rank <= {k} GROUP BY t.qid)" for k in (1, 5, 10)),
        "runs_by_recall": f"SELECT method, CAST(row_number() OVER (PARTITION BY method ORDER BY recall, qps DESC, ts) AS INTEGER) AS place, ts FROM ({runs})",
        "sq8_range": "SELECT min(list_min(embedding))::DOUBLE AS low, max(list_max(embedding))::DOUBLE AS high FROM embeddings",
        "vectors_fvecs": "SELECT vec_id AS id, unnest(range(0, len(embedding)))::INTEGER AS i, unnest(embedding) AS v FROM embeddings",
        "vectors_fbin": "SELECT vec_id AS id, unnest(range(0, len(embedding)))::INTEGER AS i, unnest(embedding) AS v FROM embeddings",
        "vectors_raw": "SELECT vec_id AS id, unnest(range(0, len(embedding)))::INTEGER AS i, unnest(embedding) AS v FROM embeddings",
        "vectors_ivecs": f"{CTE} SELECT id, unnest([0, 1, 2])::INTEGER AS i, unnest([label::BIGINT, attr_1, attr_2]) AS v FROM base",
        "vectors_ibin": f"{CTE} SELECT id, unnest([0, 1, 2])::INTEGER AS i, unnest([label::BIGINT, attr_1, attr_2]) AS v FROM base",
        "vectors_bounds": f"{CTE} SELECT qid, l_1::FLOAT AS l_0, u_1::FLOAT AS u_0 FROM asked",
    }
