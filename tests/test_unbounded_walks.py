"""Walks without a bound score a shard once for all queries."""

import numpy as np
import pytest

from quarryvec.operators import exact, graph
from quarryvec.operators import predicates as P


def test_walks_without_a_bound_take_no_steps(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist(), int(i % 9), None if i % 13 == 0 else int(i * 37 % 100)) for i, v in enumerate(rng.normal(size=(400, 6)))]
    base = spark.createDataFrame(rows, "id long, embedding array<float>, a int, b int").cache()
    asked = base.where("id % 20 = 0").selectExpr("id qid", "embedding q", "b - 20 low", "b + 20 high", "a other").cache()
    shards = graph.build_shards(base, 2).cache()
    for g in (graph.unpacked(r["n"], r["ids"], r["vectors"], r["clusters"], r["levels"]) for r in shards.collect()):
        assert graph.finds_all(g, graph.GraphOptions("plain", ef=1 << 30), np.zeros(0))
        assert not graph.finds_all(g, graph.GraphOptions("plain", ef=8), np.zeros(0))
    for p in (P.between("a", 2, 6), P.query_box({"b": ("low", "high")}), P.query_compare("a", "!=", "other") & P.between("b", 5, 90)):
        walked = graph.search(base.where("id % 7 <> 1"), shards, asked, 5, p, graph.GraphOptions("plain", ef=1 << 30))
        want = exact.filtered_knn(base.where("id % 7 <> 1"), asked, 5, p)
        key = lambda f: sorted(map(tuple, f.select("qid", "rank", "id", "dist").collect()))
        assert key(walked) == key(want)
        bounded = graph.search(base.where("id % 7 <> 1"), shards, asked, 5, p, graph.GraphOptions("plain", ef=150))
        assert bounded.join(want, ["qid", "id"]).count() >= 0.95 * want.count()
