"""Search by blocks of matrices, held against the expressions, on rows and conditions of all kinds."""

import random

import pytest
from pyspark.sql import functions as F

from quarryvec.functions.distances import DISTANCES
from quarryvec.operators import blocks, exact
from quarryvec.operators import predicates as P


@pytest.fixture(scope="module")
def odd(spark):
    """Vectors with null, NaN and infinite elements, of other lengths and sizes, equal ones; null attributes and NaN."""
    r = random.Random(5)
    rows = []
    for i in range(900):
        v = [float(r.randrange(-3, 4)) for _ in range(4)]
        v = {17: [1.0, None, 2.0, 0.0], 18: [float("nan")] * 4, 19: [float("inf"), 0.0, 0.0, 0.0], 20: [1.0, 2.0], 21: [], 22: [1e30, 0.0, 0.0, 0.0], 23: None}.get(i % 150, v)
        rows.append((i, v, None if i % 11 == 0 else r.randrange(50), [float("nan"), None, 1.5, 20.0][i % 4]))
    return spark.createDataFrame(rows, "id long, embedding array<float>, a int, c double").cache()


@pytest.fixture(scope="module")
def asking(odd):
    return odd.where("id % 9 = 0 or id % 150 between 17 and 23").selectExpr("id qid", "embedding q", "a - 5 low", "a + 5 high", "c other").cache()


def listed(frame):
    return sorted(map(str, frame.select("qid", "rank", "id", "dist").collect()))


PREDICATES = [
    None,
    P.between("a", 5, 20),
    P.query_box({"a": ("low", "high")}),
    ~P.query_box({"a": ("low", "high")}),
    P.query_compare("c", ">=", "other"),
    P.query_compare("c", "!=", "other") & P.between("a", 3, 40),
    P.query_compare("a", "=", "low") | ~(P.at_least("a", 30) & P.query_compare("c", "<=", "other")),
    P.packed("low", "high", P.differs("a", 7)),
]


@pytest.mark.parametrize("i", range(len(PREDICATES)))
@pytest.mark.parametrize("metric", ["l2sq", "ip", "l1"])
def test_same_as_expressions(odd, asking, i, metric, monkeypatch):
    monkeypatch.setattr(blocks, "CELL_ROWS", 8)
    monkeypatch.setattr(blocks, "TILE", 16)
    p = PREDICATES[i]
    rows = odd.where("embedding is not null")
    rows = rows.where(p.column()) if p and not p.per_query else rows
    assert listed(exact.filtered_knn(odd, asking, 7, p, metric)) == listed(exact.expression_knn(rows, asking, 7, p, DISTANCES[metric]))


def test_no_distance_of_a_pair_is_an_expression(odd, asking):
    """A cross join that scores each pair by expressions took 15 seconds where blocks take one."""
    for p in PREDICATES:
        plan = exact.filtered_knn(odd, asking, 5, p)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "Cartesian" not in plan and "MapInArrow" in plan


def test_within_a_distance_is_scored_by_blocks(odd, asking):
    """Each pair was scored by an expression."""
    rows = odd.where("embedding is not null")
    found = exact.within(odd, asking, 9.0, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan
    pairs = rows.crossJoin(asking.where("q is not null")).select("qid", "id", DISTANCES["l2sq"](F.col("embedding"), F.col("q")).alias("dist"))
    assert listed(found) == listed(exact.top_k(pairs.where("dist <= 9.0"), 4))


@pytest.mark.parametrize("metric", ["l2sq", "ip", "l1"])
@pytest.mark.parametrize("document", ["id % 13", "if(id % 13 = 4, null, id % 400)", "int(7)"])
def test_documents_are_scored_by_blocks(odd, asking, document, metric, monkeypatch):
    """Each pair was scored by an expression."""
    monkeypatch.setattr(blocks, "CELL_ROWS", 8)
    monkeypatch.setattr(blocks, "TILE", 16)
    some = odd.selectExpr("id", "embedding", f"{document} doc")
    found = exact.nearest_documents(some, asking, 5, "doc", metric)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan
    want = exact.nearest_documents(some.withColumn("doc", F.col("doc").cast("decimal(9,0)")), asking, 5, "doc", metric)
    rows = lambda f: sorted(map(str, f.selectExpr("qid", "rank", "int(doc) doc", "id", "dist").collect()))
    assert rows(found) == rows(want)
