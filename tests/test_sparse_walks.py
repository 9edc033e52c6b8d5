"""Walks where few rows pass cost no more than twice what scoring these rows does."""

import numpy as np
import pytest

from quarryvec.operators import exact, graph, hybrid
from quarryvec.operators import predicates as P


@pytest.mark.parametrize("pull", ["never", "sparse", "always", "race", "late", "dead_end", "only"])
@pytest.mark.parametrize("passes", [20, 400])
def test_few_rows_pass(pull, passes):
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(3000, 4)).astype(np.float32), np.zeros(4, np.float32)
    clusters = rng.integers(0, 8, 3000).astype(np.int32)
    g = graph.ShardGraph.build(np.arange(3000), x, clusters=clusters)
    mask = np.argsort(np.argsort(-(x**2).sum(1))) < passes  # far from the query, so that a walk goes through all that lies before
    found, effort = graph.cooperate(g, q, mask, 10, graph.GraphOptions(pull=pull, efs=100), iter([(float(c), c) for c in range(8)]))
    want = np.flatnonzero(mask)[np.argsort((x[mask] ** 2).sum(1), kind="stable")][:10]
    assert passes > 100 and pull != "never" or [n for *_, n in sorted(found)[:10]] == want.tolist()
    assert effort.walked + effort.scanned <= 2 * passes + 400, effort  # and what one step adds
    if passes <= 100:
        assert effort.walked + effort.scanned == passes and (pull != "only" or not effort.walked)


def test_a_search_of_what_few_rows_pass_is_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist(), i % 100) for i, v in enumerate(rng.normal(size=(2000, 4)))]
    base = spark.createDataFrame(rows, "id long, embedding array<float>, a int")
    queries = base.where("id % 20 = 0").selectExpr("id qid", "embedding q")
    index = hybrid.build(base, 8, 2)
    index = hybrid.Index(index.assigned.cache(), index.centroids, index.shards.cache())
    truth = sorted(map(tuple, exact.filtered_knn(base, queries, 10, P.between("a", 3, 4)).collect()))
    for how in ("graph", "relational", "alternate"):
        found = hybrid.walked(index, queries, hybrid.SearchOptions(how), P.between("a", 3, 4)).cache()
        assert sorted(map(tuple, graph.nearest(found, 10).collect())) == truth
        effort = graph.comparisons(found).collect()
        assert len(effort) == 100 and all(e["walked"] + e["scanned"] == 40 and e["shards"] == 2 for e in effort)
