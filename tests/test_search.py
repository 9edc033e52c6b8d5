"""Filtered search on hand-made rows, and the walk of a graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryvec.operators import clustering, exact, generators, graph, hybrid, ivf, metrics
from quarryvec.operators import predicates as P

SCHEMA = "id long, embedding array<float>, a int, b int"


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(7, [1.0, 0.0], 5, 1), (2, [0.0, 1.0], 5, 2), (5, [-1.0, 0.0], 10, 3), (9, [3.0, 0.0], -1, 4), (11, [4.0, 0.0], None, 5), (12, None, 5, 6)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def origin(spark):
    return spark.createDataFrame([(1, [0.0, 0.0])], "qid long, q array<float>")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist(), i % 10, i * 37 % 100) for i, v in enumerate(x)], SCHEMA).cache()


@pytest.fixture(scope="module")
def asked(cloud):
    return cloud.where("id % 60 = 0").selectExpr("id qid", "embedding q", "b - 20 low", "b + 20 high")


def ids(df):
    return [r["id"] for r in df.orderBy("qid", "rank").collect()]


def test_ties_by_id_and_short_results(tiny, origin):
    assert ids(exact.filtered_knn(tiny, origin, 2)) == [2, 5]
    assert ids(exact.filtered_knn(tiny, origin, 99)) == [2, 5, 7, 9, 11]  # the null vector takes no part
    assert ids(exact.arrow_knn(tiny, origin, 3)) == [2, 5, 7]
    assert ids(exact.filtered_knn(tiny, origin, 3, P.equals("a", 77))) == []
    assert ids(exact.filtered_knn(tiny.limit(0), origin, 3)) == [] == ids(exact.arrow_knn(tiny.limit(0), origin, 3))


def test_bounds_are_closed_and_nulls_fail(tiny, origin):
    assert ids(exact.filtered_knn(tiny, origin, 9, P.between("a", 5, 10))) == [2, 5, 7]
    assert ids(exact.filtered_knn(tiny, origin, 9, P.differs("a", 5))) == [5, 9]  # below zero too; not the null
    assert ids(exact.filtered_knn(tiny, origin, 9, ~P.equals("a", 5))) == [5, 9]
    assert ids(exact.filtered_knn(tiny, origin, 9, P.at_least("a", 10) | P.equals("b", 4))) == [5, 9]
    assert P.selectivity(tiny, P.between("a", 5, 10)).first()["n_pass"] == 4


def test_membership_is_exact(tiny, origin, spark):
    members = spark.createDataFrame([(2,), (5,)], "id long")
    assert ids(exact.member_knn(tiny, origin, 9, members)) == [2, 5]
    assert ids(exact.filtered_knn(exact.without_deleted(tiny, members), origin, 9)) == [7, 9, 11]


def test_blocks_of_queries_give_the_same(cloud, asked, monkeypatch):
    whole = exact.filtered_knn(cloud, asked, 5).orderBy("qid", "rank").collect()
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 200)
    assert exact.filtered_knn(cloud, asked, 5).orderBy("qid", "rank").collect() == whole
    assert exact.arrow_knn(cloud, asked, 5).orderBy("qid", "rank").collect() == whole


def test_plan_keeps_k_rows_before_the_shuffle(cloud, asked):
    plan = exact.filtered_knn(cloud, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_clusters_probe_all_equal_exact(cloud, asked):
    centroids = cloud.where("id < 8").selectExpr("cast(id as int) cluster", "embedding centroid")
    assigned = ivf.assign(cloud, centroids)
    want = ids(exact.filtered_knn(cloud, asked, 10, P.between("a", 2, 6)))
    assert ids(ivf.search(assigned, asked, centroids, 10, 8, P.between("a", 2, 6))) == want
    assert ids(ivf.wave_search(assigned, asked, centroids, 10, 10**6, P.between("a", 2, 6))) == want
    assert ids(ivf.wave_search(assigned, asked, centroids, 10, 5, P.equals("a", 99))) == []  # it ends though nothing passes
    assert metrics.cluster_histogram(assigned, centroids).agg(F.sum("n")).first()[0] == 600


HOWS = ["plain", "two_hop", "directed", "one_hop", "subgraph", "in_place"]


@pytest.fixture(scope="module")
def shards(cloud, centroids):
    return graph.build_shards(ivf.assign(cloud, centroids), 2).cache()


@pytest.fixture(scope="module")
def centroids(cloud):
    return cloud.where("id < 8").selectExpr("cast(id as int) cluster", "embedding centroid")


@pytest.mark.parametrize("how", HOWS)
def test_graph_recall(cloud, shards, asked, how):
    predicate = P.between("a", 2, 6)
    found = graph.search(cloud, shards, asked, 10, predicate, graph.GraphOptions(how=how, ef=100)).cache()
    truth = exact.filtered_knn(cloud, asked, 10, predicate)
    assert metrics.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9
    assert found.join(cloud.where(predicate.column()), "id", "left_anti").count() == 0
    assert found.groupBy("qid", "id").count().where("count > 1").count() == 0
    assert graph.search(cloud, shards, asked, 10, P.equals("a", 99), graph.GraphOptions(how=how)).count() == 0


def test_graph_with_deleted_rows_and_query_ranges(cloud, shards, asked):
    left = cloud.where("id % 7 <> 1")
    predicate = P.query_box({"b": ("low", "high")})
    found = graph.search(left, shards, asked, 5, predicate, graph.GraphOptions("plain", ef=600))
    want = exact.filtered_knn(left, asked, 5, predicate)
    assert ids(found) == ids(want)
    assert graph.inbound_degree(graph.edges_of(shards)).agg(F.min("n_in")).first()[0] >= 0


@pytest.mark.parametrize("kind", ["layered", "relative", "dense"])
def test_kinds_of_graphs(cloud, asked, kind):
    shards = graph.build_shards(cloud, 2, m=8, kind=kind)
    edges = graph.edges_of(shards)
    assert edges.where("level = 0").count() == 600 and (edges.agg(F.max("level")).first()[0] > 0) == (kind != "relative")
    found = graph.search(None, shards, asked, 10, None, graph.GraphOptions("plain", ef=150))
    assert metrics.recall(found, exact.filtered_knn(cloud, asked, 10), 10).agg(F.avg("recall")).first()[0] >= 0.9
    if kind == "relative":  # against the definition, in one small shard
        x = np.random.default_rng(8).normal(size=(40, 3)).astype(np.float32)
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        g = graph.ShardGraph.build(np.arange(40), x, ef=64, kind=kind)
        for i in range(40):
            want = {j for j in range(40) if j != i and not any(d[i, c] < d[i, j] - 1e-6 and d[j, c] < d[i, j] - 1e-6 for c in range(40) if c not in (i, j))}
            assert set(g.levels[0].near(i).tolist()) == want


def test_inserted_rows_are_found(cloud, asked, spark):
    shards = graph.build_shards(cloud.where("id < 400"), 2)
    changed = cloud.where("id >= 400").unionByName(cloud.where("id in (60, 7)").withColumn("embedding", F.transform("embedding", lambda v: v + 1)))
    grown = graph.insert_rows(shards, changed)
    now = exact.upsert(cloud.where("id < 400"), changed)
    found = graph.search(None, grown, asked, 10, None, graph.GraphOptions("plain", ef=100))
    assert metrics.recall(found, exact.filtered_knn(now, asked, 10), 10).agg(F.avg("recall")).first()[0] >= 0.9
    assert ids(graph.search(None, grown, asked, 10, None, graph.GraphOptions("plain", ef=10**6))) == ids(exact.filtered_knn(now, asked, 10))


PREDICATES = {
    "range": P.between("a", 2, 6), "rare": P.equals("b", 3), "query range": P.query_box({"b": ("low", "high")}), "negation": P.query_compare("a", "!=", "own"),
    "point": P.query_compare("a", "=", "own"), "one-sided": P.query_compare("b", ">=", "own"), "packed": P.packed("first", "last", P.between("a", 0, 7)), "any": P.any_of(P.between("b", 0, 10), P.equals("a", 9)),
}


@pytest.mark.parametrize("strategy", sorted(hybrid.PULL))
def test_only_passing_rows_by_all_strategies(cloud, asked, shards, centroids, strategy):
    index = hybrid.Index(cloud, centroids, shards)
    queries = asked.selectExpr("*", "pmod(qid, 10) own", "qid - 100 first", "qid + 100 last")
    for name, predicate in PREDICATES.items():
        truth = exact.filtered_knn(cloud, queries, 10, predicate).cache()
        found = hybrid.search(index, queries, hybrid.SearchOptions(strategy, efs=200), predicate).cache()
        met = found.join(cloud.withColumnRenamed("embedding", "x"), "id").join(queries, "qid")
        assert met.where(~predicate.column()).count() == 0, name
        assert metrics.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9, name
        if name in ("negation", "rare"):
            # two hops may miss what no passing row leads to; clusters find that, a walk alone must look at all neighbours
            walk = graph.GraphOptions("plain" if strategy == "graph" else "two_hop")
            whole = hybrid.search(index, queries, hybrid.SearchOptions(strategy, efs=10**6, walk=walk), predicate)
            assert ids(whole) == ids(truth), name
    effort = graph.comparisons(hybrid.walked(index, queries, hybrid.SearchOptions(strategy), PREDICATES["range"])).collect()
    assert len(effort) == asked.count() and all(e["walked"] + e["scanned"] > 0 and e["shards"] == 2 for e in effort)
    assert strategy != "relational" or all(e["walked"] == 0 for e in effort)


def test_members_and_ranking_by_a_graph(cloud, asked, shards, centroids):
    index = hybrid.Index(cloud, centroids, shards)
    members = asked.select("qid").join(cloud.select("id"), F.pmod(F.xxhash64("qid", "id"), F.lit(3)) == 0)
    truth = exact.top_k(members.join(cloud, "id").join(asked, "qid").select("qid", "id", exact.DISTANCES["l2sq"](F.col("embedding"), F.col("q")).alias("dist")), 10)
    walk = graph.GraphOptions(rank="graph")
    assert ids(hybrid.search(index, asked, hybrid.SearchOptions("cooperative", efs=10**6, walk=walk), members=members)) == ids(truth)
    assert ids(exact.member_knn(cloud, asked, 10, members)) == ids(truth)


def test_cursor_hands_out_all_rows_nearest_first():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)).astype(np.float32)
    g = graph.ShardGraph.build(np.arange(200), x)
    passing = np.arange(200) % 3 == 0
    cursor = graph.Cursor(g, x[0], passing, graph.GraphOptions("plain", ef=8, step=8)).open()
    first = [cursor.next() for _ in range(5)]
    assert first == sorted(first) and first[0] == (0.0, 0)
    rest = list(graph.Cursor(g, x[0], passing, graph.GraphOptions("plain", ef=8, step=8)).open())
    assert {i for _, i in rest} == set(np.flatnonzero(passing).tolist())
    cursor.close()
    assert cursor.next_batch() == []


def test_hybrid_strategies_and_saved_index(cloud, asked, spark, tmp_path):
    centroids = cloud.where("id < 8").selectExpr("cast(id as int) cluster", "embedding centroid")
    index = hybrid.build(cloud, 8, 2, centroids=centroids)
    hybrid.save(index, str(tmp_path / "index"), "a")
    index = hybrid.load(spark, str(tmp_path / "index"))
    predicate = P.between("a", 2, 6)
    truth = exact.filtered_knn(cloud, asked, 10, predicate)
    for strategy in ("auto", "exact", "clusters", *hybrid.PULL):
        found = hybrid.search(index, asked, hybrid.SearchOptions(strategy, efs=200, share=0.85), predicate)
        assert metrics.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9, strategy
    assert hybrid.choose(cloud, predicate, hybrid.SearchOptions(exact_rows=10)) == "cooperative"
    assert hybrid.choose(cloud, P.equals("b", 3), hybrid.SearchOptions(exact_rows=1)) == "clusters"


def test_the_planner_is_exact_at_every_size(spark):
    assert hybrid.choose(spark.range(1_500_000), None, hybrid.SearchOptions()) == "exact"


def test_medoid_is_the_central_row(cloud):
    centroids = cloud.where("id < 4").selectExpr("cast(id as int) cluster", "embedding centroid")
    assigned = ivf.assign(cloud, centroids).cache()
    rows = assigned.select("cluster", "id", "embedding").toPandas()
    for cluster, got in [(r["cluster"], r["id"]) for r in clustering.medoid_step(assigned).collect()]:
        own = rows[rows.cluster == cluster]
        x = np.stack(own.embedding).astype(float)
        cost = ((x[:, None] - x[None]) ** 2).sum((1, 2))
        assert got == own.id.to_numpy()[cost.argmin()]
    assert clustering.kmedoids(cloud, 4, 2).count() == 4
    assert clustering.subspaces(assigned, 3).first()["mask"].count(1) == 3


def test_workloads(cloud, asked):
    wide = generators.ranges(asked.select("qid"), cloud, "b", 100)
    assert P.selectivity_by_query(cloud, wide, P.query_box({"b": ("low", "high")})).agg(F.min("n_pass")).first()[0] >= 100
    many = cloud.sparkSession.range(20_000)
    rho = generators.correlated(many, -0.5).agg(F.corr("correlated1", "correlated2")).first()[0]
    assert -0.55 < rho < -0.45
    assert generators.zipf(many).where("skewed = 1").count() > 10_000
    assert generators.values(asked.select("qid"), cloud, "b").count() == asked.count()
    packed = generators.packed_ranges(asked.select("qid"), 600, 10)
    assert packed.where("hi - lo = 59 and lo >= 0 and hi < 600").count() == asked.count()
