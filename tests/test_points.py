"""Box layouts, bounded clusters and planned searches over points of the orders, against SQL and brute force."""

import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryvec import point_queries
from quarryvec.operators import exact, ivf, layout
from quarryvec.operators import predicates as P

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(point_queries.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    got, want = point_queries.queries()[name](spark, DATA).toPandas(), duck.execute(point_queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


@pytest.fixture(scope="module")
def boxed(spark):
    """Rows in lumps, with attributes that are skewed, tied and null."""
    r = random.Random(3)
    rows = []
    for i in range(3000):
        lump = r.randrange(12)
        v = [10.0 * lump + r.gauss(0, 1), 5.0 * (lump % 4) + r.gauss(0, 1), r.gauss(0, 1)]
        rows.append((i, v if i % 50 else None, r.randrange(1000), 7 if i % 3 else r.randrange(100), None if i % 40 == 0 else float(i % 17)))
    return spark.createDataFrame(rows, "id long, embedding array<float>, a int, b int, c double").cache()


@pytest.fixture(scope="module")
def boxes(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(0, 120), r.uniform(0, 20), 0.0], a := r.randrange(1000), a + r.choice([5, 100, 1000]), 0, r.choice([6, 7, 100])) for i in range(40)]
    rows += [(100, [0.0, 0.0, 0.0], 5, 1, 0, 9), (101, None, 0, 1000, 0, 100), (102, [1.0, 1.0, 1.0], 2000, 3000, 0, 100)]
    return spark.createDataFrame(rows, "qid long, q array<float>, l_a int, u_a int, l_b int, u_b int")


OWN = {"a": ("l_a", "u_a"), "b": ("l_b", "u_b")}


def rows(frame):
    return sorted(map(tuple, frame.select("qid", "rank", "id", "dist").collect()))


@pytest.mark.parametrize("order", ["curve", "lexicographic"])
def test_layouts_find_what_a_whole_search_does(boxed, boxes, tmp_path, order):
    made = layout.write(boxed, str(tmp_path / "l"), ["a", "b", "c"], order, block_rows=200)
    made = layout.load(boxed.sparkSession, str(tmp_path / "l"))
    assert made.attrs == ["a", "b", "c"] and made.blocks.count() >= 12
    assert rows(layout.query_box_knn(made, boxes, 5, OWN)) == rows(exact.filtered_knn(boxed, boxes, 5, P.query_box(OWN)))
    for bounds in ({"a": (100, 180), "b": (0, 50)}, {"c": (3, 4)}, {"a": (0, 2000)}, {"a": (5000, 6000)}, {"a": (7, 3)}):
        assert rows(layout.box_knn(made, boxes, 5, bounds)) == rows(exact.filtered_knn(boxed, boxes, 5, P.box(bounds)))
    # what it reads is what it needs
    effort = {r["qid"]: r for r in layout.box_effort(made, boxes, OWN).collect()}
    passing = {r["qid"]: r["n_pass"] for r in P.selectivity_by_query(boxed, boxes, P.query_box(OWN)).collect()}
    assert {q: r["n_pass"] for q, r in effort.items()} == passing
    assert all(r["n_pass"] <= r["rows_read"] <= r["n_rows"] == 3000 for r in effort.values())
    assert effort[100]["rows_read"] == effort[102]["rows_read"] == 0


def test_files_read_shrink_with_the_box(boxed, tmp_path):
    made = layout.write(boxed, str(tmp_path / "l"), ["a", "c"], block_rows=100)
    whole = made.blocks.count()
    counts = [len(layout.box_rows(made, {"a": (300, 300 + w), "c": (2, 2 + w / 60)}).inputFiles()) for w in (10, 100, 700)]
    assert counts[0] < counts[1] < counts[2] <= whole and counts[0] <= whole / 4
    # in Z order a box on the second attribute alone prunes too; sorted by the first one it doesn't
    sorted_by = layout.write(boxed, str(tmp_path / "s"), ["a", "c"], "lexicographic", block_rows=100)
    second = {"c": (3.0, 3.5)}
    assert len(layout.box_rows(made, second).inputFiles()) < 0.7 * len(layout.box_rows(sorted_by, second).inputFiles())


def test_interleaved_bits(spark):
    got = spark.createDataFrame([(3, 0), (0, 3), (2, 1), (5, 6)], "x long, y long").select(layout.interleaved([F.col("x"), F.col("y")], 3).alias("z")).collect()
    assert [r["z"] for r in got] == [0b001010, 0b000101, 0b001001, 0b110110]


def test_a_frequent_value_is_more_than_one_block(spark, tmp_path):
    same = spark.range(1000).select("id", F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), F.lit(5).alias("a"))
    made = layout.write(same, str(tmp_path / "l"), ["a"], block_rows=100)
    assert made.blocks.count() >= 8 and made.blocks.agg(F.max("rows")).first()[0] <= 250
    empty = layout.write(same.limit(0), str(tmp_path / "e"), ["a"])
    assert layout.box_rows(empty, {"a": (0, 9)}).count() == 0


@pytest.fixture(scope="module")
def in_clusters(boxed):
    centroids = ivf.train(boxed, 16).cache()
    return ivf.assign(boxed, centroids).cache(), centroids


@pytest.mark.parametrize("predicate, k", [(None, 1), (None, 400), (P.between("a", 100, 300), 5), (P.between("a", 5000, 6000), 5), (P.query_box(OWN), 5)], ids=["one", "many", "range", "none", "own"])
def test_bounded_clusters_are_exact(boxed, boxes, in_clusters, predicate, k):
    asked = boxes.where("q is not null")
    assert rows(ivf.bounded_search(in_clusters[0], asked, in_clusters[1], k, predicate)) == rows(exact.filtered_knn(boxed, asked, k, predicate))


def test_bounded_clusters_end_early_where_rows_lie_in_clusters(boxes, in_clusters):
    effort = ivf.bounded_effort(in_clusters[0], boxes.where("qid < 100"), in_clusters[1], 5).collect()
    assert np.mean([r["clusters"] / r["n_clusters"] for r in effort]) < 0.4
    assert np.mean([r["compared"] / r["n_rows"] for r in effort]) < 0.25
