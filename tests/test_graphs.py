"""Building, growing and mending the graph of one shard, and the planner's choice."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryvec.operators import exact, graph, hybrid, metrics
from quarryvec.operators import predicates as P

DIM = 24


def lumps(n, seed=0):
    """Rows in 60 lumps that lie well apart."""
    r = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(60, DIM)) * 2
    return (centres[r.integers(0, 60, n)] + r.normal(size=(n, DIM))).astype(np.float32)


def recall(g, x, ids, asked, ef=64, k=10):
    hit = 0
    for q in asked:
        cursor = graph.Cursor(g, q, np.ones(len(g.ids), bool), graph.GraphOptions("plain", ef=ef)).open()
        found = {i for _, i, _ in sorted(cursor.found)[:k]}
        truth = ids[np.argsort(((x - q) ** 2).sum(1), kind="stable")[:k]]
        hit += len(found & set(truth.tolist()))
    return hit / len(asked) / k


def reachable(g):
    seen, todo = {0}, [0]
    while todo:
        for b in g.levels[0].near(todo.pop()).tolist():
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return len(seen)


@pytest.fixture(scope="module")
def asked_points():
    return lumps(40, 5)


@pytest.fixture(scope="module")
def large(asked_points):
    x = lumps(6000)
    return x, np.arange(6000) * 5 + 2, graph.ShardGraph.build(np.arange(6000) * 5 + 2, x)


def test_neighbours_found_by_descent():
    x = lumps(5000).astype(float)
    near, gap = graph.neighbours(x, 32)
    want, least = graph.nearest_of(x, 32)
    assert np.mean([len(set(a) & set(b)) / 32 for a, b in zip(near.tolist(), want.tolist())]) > 0.95
    assert (np.diff(gap, axis=1) >= 0).all() and (near != np.arange(5000)[:, None]).all()
    assert all(len(set(row)) == 32 for row in near.tolist())
    same = graph.neighbours(np.ones((5000, 3)), 8)[0]  # rows that are all equal
    assert same.shape == (5000, 8) and (same >= 0).all()


def test_a_large_shard_is_found_and_connected(large, asked_points):
    x, ids, g = large
    assert recall(g, x, ids, asked_points) >= 0.95 and reachable(g) == len(ids)
    assert len(g.levels) >= 3


def test_time_of_a_build_grows_as_the_rows():
    took = []
    for n in (4500, 18000):
        x, began = lumps(n), time.process_time()
        graph.ShardGraph.build(np.arange(n), x)
        took.append(time.process_time() - began)
    assert took[1] < 6 * took[0]


def test_a_mended_graph_is_as_good_as_a_fresh_one(large, asked_points):
    x, ids, g = large
    r = np.random.default_rng(1)
    gone = ids[r.permutation(len(ids))[: len(ids) // 3]]
    whole_lump = ids[((x - asked_points[0]) ** 2).sum(1).argsort()[:80]]  # and all rows around a query
    gone = np.union1d(gone, whole_lump)
    keep = ~np.isin(ids, gone)
    mended, fresh = g.remove(gone), graph.ShardGraph.build(ids[keep], x[keep])
    assert mended.ids.tolist() == ids[keep].tolist() and np.array_equal(mended.vectors, x[keep])
    assert recall(mended, x[keep], ids[keep], asked_points) >= recall(fresh, x[keep], ids[keep], asked_points) - 0.01
    assert reachable(mended) == keep.sum()
    assert max(len(lv.near(int(a))) for lv in mended.levels for a in lv.nodes) <= 40
    assert g.remove(np.array([-1])) is g
    assert len(g.remove(ids).ids) == 0 and g.remove(ids[1:]).ids.tolist() == [2]


def test_inserted_rows_join_all_levels(large, asked_points):
    x, ids, g = large
    first = 5000
    grown = graph.ShardGraph.build(ids[:first], x[:first]).insert(ids[first:], x[first:])
    assert sorted(grown.ids.tolist()) == ids.tolist()
    at = np.argsort(grown.ids)
    assert np.array_equal(grown.vectors[at], x) and reachable(grown) == len(ids)
    assert recall(grown, x, ids, asked_points) >= 0.95
    added = [int((lv.nodes >= first).sum()) for lv in grown.levels]
    assert added[0] == 1000 and 30 <= added[1] <= 110
    # rows of ids that are there are replaced, their places used again
    moved = grown.insert(ids[:50], x[:50] + 3)
    assert len(moved.ids) == len(ids)
    y = np.concatenate([x[:50] + 3, x[50:]])
    assert recall(moved, y, ids, np.concatenate([asked_points, y[:10]])) >= 0.95


def test_growing_from_little():
    x = lumps(700)
    g = graph.ShardGraph.build(np.array([5]), x[:1]).insert(np.arange(10, 709), x[1:])
    assert len(g.ids) == 700 and reachable(g) == 700
    empty = g.remove(g.ids)
    assert graph.Cursor(empty, x[0], np.zeros(0, bool), graph.GraphOptions()).open().next_batch() == []
    assert len(empty.insert(np.arange(20), x[:20]).ids) == 20


@pytest.fixture(scope="module")
def indexed(spark):
    x = lumps(8000)
    rows = [(i, v.tolist(), i % 1000) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "id long, embedding array<float>, a int").repartition(8)
    centroids = table.where("id < 40").selectExpr("cast(id as int) cluster", "embedding centroid")
    index = hybrid.build(table.cache(), 40, 2, centroids=centroids)
    queries = spark.createDataFrame([(i, v.tolist(), 0, i % 4 * 300) for i, v in enumerate(lumps(24, 5))], "qid long, q array<float>, low int, high int")
    return hybrid.Index(index.assigned.cache(), index.centroids, index.shards.cache()), queries


def test_rows_removed_from_and_put_into_shards(indexed):
    index, queries = indexed
    gone = index.assigned.where("id % 3 = 1 or id > 100000")
    left = graph.remove_rows(index.shards, gone)
    assert left.agg(F.sum("n")).first()[0] == index.assigned.where("id % 3 <> 1").count()
    found = graph.search(None, left, queries, 10, None, graph.GraphOptions("plain"))
    assert metrics.recall(found, exact.filtered_knn(index.assigned.where("id % 3 <> 1"), queries, 10), 10).agg(F.avg("recall")).first()[0] >= 0.95


def test_the_planner_chooses_by_the_share_that_passes(indexed):
    index, queries = indexed
    chosen = {}
    for name, predicate in (("few", P.between("a", 0, 1)), ("all", None)):
        options = hybrid.SearchOptions("planned", 10)
        plan = hybrid.plan(index, queries, options, predicate)
        chosen[name] = plan.strategy
        rows = index.assigned.where(predicate.column()).count() if predicate else 8000
        assert abs(plan.share - rows / 8000) <= plan.error
        # among what reaches the recall, measured over all shards and queries, no strategy needs much less
        truth = exact.filtered_knn(index.assigned, queries, 10, predicate).cache()
        costs = {"exact": rows}
        for how in hybrid.TRIED:
            found = hybrid.walked(index, queries, hybrid.SearchOptions(how), predicate).cache()
            if metrics.recall(graph.nearest(found, 10), truth, 10).agg(F.avg("recall")).first()[0] >= 0.9:
                costs[how] = graph.comparisons(found).agg(F.avg(F.col("walked") + F.col("scanned"))).first()[0]
        assert costs[plan.strategy] <= 1.5 * min(costs.values()), (name, plan, costs)
        found = hybrid.search(index, queries, options, predicate)
        assert metrics.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9
    assert len(set(chosen.values())) > 1
    own = hybrid.plan(index, queries, hybrid.SearchOptions("planned"), P.query_box({"a": ("low", "high")}))
    assert own.recalls[own.strategy] >= 0.9 and own.costs[own.strategy] <= own.costs["exact"]
    assert hybrid.plan(index, queries, hybrid.SearchOptions("planned"), P.between("a", 5000, 6000)).share == 0


def test_ranks_and_quantiles_against_sorting(spark):
    r = np.random.default_rng(3)
    rows = [(int(k) if k else None, float(v), i) for i, (k, v) in enumerate(zip(r.choice([0, 1, 1, 1, 1, 1, 2], 4000), r.integers(0, 50, 4000)))]
    table = spark.createDataFrame(rows, "k long, v double, i long")
    got = {x["i"]: x["place"] for x in metrics.ranked(table, ["k"], [F.col("v").desc(), F.col("i").asc()]).collect()}
    for key in (None, 1, 2):
        own = sorted((x for x in rows if x[0] == key), key=lambda x: (-x[1], x[2]))
        assert [got[x[2]] for x in own] == list(range(1, len(own) + 1))
    for share in (0.0, 0.1, 0.5, 0.9, 0.99, 1.0):
        assert metrics.exact_quantile(table, "v", share) == pytest.approx(np.quantile([x[1] for x in rows], share))
    assert metrics.exact_quantile(table.where("k = 9"), "v", 0.5) is None


def test_quantiles_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(metrics, "VALUES_SORTED", 2000)
    table = spark.range(40_000).select(((F.col("id") * 7919) % 40_000 + F.col("id") % 2 * 0.25).alias("v"))
    values = np.array([(i * 7919) % 40_000 + i % 2 * 0.25 for i in range(40_000)])
    for share in (0.001, 0.5, 0.9, 0.9999):
        assert metrics.exact_quantile(table, "v", share) == pytest.approx(np.quantile(values, share))
