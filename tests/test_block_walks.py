"""Walks of many queries at once do what single ones do; walks by turns with clusters end where scoring all that passes costs no more."""

import heapq

import numpy as np
import pytest

from quarryvec.operators import exact, graph, hybrid, walks
from quarryvec.operators import predicates as P


@pytest.mark.parametrize("how", ["plain", "two_hop"])
@pytest.mark.parametrize("pull", ["never", "sparse", "race", "late", "dead_end"])
@pytest.mark.parametrize("share", [0.02, 0.5])
def test_as_single_walks(how, pull, share):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    g = graph.ShardGraph.build(np.arange(1500), x, clusters=rng.integers(0, 8, 1500).astype(np.int32))
    q = rng.normal(size=(30, 16)).astype(np.float32)
    masks = rng.random((30, 1500)) < share
    o = graph.GraphOptions(how=how, pull=pull, efs=20, ef=16)
    ranked = lambda i: iter([(float(c), c) for c in range(8)])
    many = walks.cooperate_all(g, walks.padded(g.levels[0]), q, masks, 10, o, ranked)
    same = 0
    for i, (nodes, effort) in enumerate(many):
        found, _ = graph.cooperate(g, q[i], masks[i], 10, o, ranked(i))
        same += nodes[:10].tolist() == [n for *_, n in heapq.nsmallest(10, found)]
        assert masks[i][nodes].all() and len(set(nodes.tolist())) == len(nodes) and effort.rounds
    assert same >= 27  # a descent may begin elsewhere


def test_alternate_costs_no_more_than_twice_what_scoring_does(spark):
    rng = np.random.default_rng(11)
    base = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(rng.normal(size=(4000, 32)))], "id long, embedding array<float>, a int")
    queries = base.where("id % 5 = 0").selectExpr("id qid", "embedding q")  # more than one task's share
    index = hybrid.build(base, 8, 2)
    index = hybrid.Index(index.assigned.cache(), index.centroids, index.shards.cache())
    truth = {(r["qid"], r["rank"], r["id"]) for r in exact.filtered_knn(base, queries, 10, P.between("a", 1, 1)).collect()}
    found = hybrid.walked(index, queries, hybrid.SearchOptions("alternate"), P.between("a", 1, 1)).cache()
    mine = {(r["qid"], r["rank"], r["id"]) for r in graph.nearest(found, 10).collect()}
    assert len(mine) == 8000 and len(mine & truth) >= 7900
    effort = graph.comparisons(found).collect()
    assert len(effort) == 800 and all(e["shards"] == 2 for e in effort)
    cost = [walks.WALK_COST * e["walked"] + e["scanned"] for e in effort]
    assert np.mean(cost) <= 2 * 2000 + 2 * walks.WALK_COST * 64, np.mean(cost)  # and what one step in each shard adds
