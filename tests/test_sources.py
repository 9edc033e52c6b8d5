"""Vector files, written and read again."""

import numpy as np
import pytest

from quarryvec.sources import catalog, vectors


@pytest.mark.parametrize("kind", ["fvecs", "fbin", "raw"])
def test_round_trip(spark, tmp_path, kind):
    x = np.random.default_rng(1).normal(size=(50, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    path = str(tmp_path / f"x.{kind}")
    assert vectors.write_vectors(df, path, kind) == 50
    got = vectors.read_vectors(spark, path, kind, rows_per_task=7, **({"dim": 6} if kind == "raw" else {})).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(50))
    assert np.array_equal(np.array([r["embedding"] for r in got], np.float32), x)
    part = vectors.read_vectors(spark, path, kind, start=10, count=5, **({"dim": 6} if kind == "raw" else {}))
    assert sorted(r["id"] for r in part.collect()) == [10, 11, 12, 13, 14]


@pytest.mark.parametrize("kind", ["fvecs", "fbin", "raw", "ivecs"])
def test_part_files(spark, tmp_path, kind):
    x = np.random.default_rng(1).integers(0, 2**32 - 1, size=(50, 3)) if kind == "ivecs" else np.random.default_rng(1).normal(size=(50, 3)).astype(np.float32)
    df = spark.createDataFrame([(2 * i, v.tolist()) for i, v in enumerate(x)], f"id long, embedding array<{'long' if kind == 'ivecs' else 'float'}>").repartition(5)
    for path in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        assert vectors.write_parts(df, path, kind) == 50
        got = vectors.read_vectors(spark, path, kind, rows_per_task=7, **({"dim": 3} if kind == "raw" else {})).orderBy("id").collect()
        assert [r["id"] for r in got] == list(range(50)) and [list(r["embedding"]) for r in got] == x.tolist()
        part = vectors.read_vectors(spark, path, kind, start=10, count=25, **({"dim": 3} if kind == "raw" else {}))
        assert sorted(r["id"] for r in part.collect()) == list(range(10, 35))
    assert vectors.write_parts(df.limit(0), str(tmp_path / "none"), kind) == 0


def test_labels_ranges_and_names(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "id long, embedding array<float>")
    labels = spark.createDataFrame([(i, [i % 2]) for i in range(4)], "id long, embedding array<int>")
    for name in ("base", "queries"):
        vectors.write_vectors(df, str(tmp_path / name), "fvecs")
        vectors.write_vectors(labels, str(tmp_path / f"{name}.labels"), "ivecs")
    d = catalog.Dataset("d", str(tmp_path / "base"), str(tmp_path / "queries"), labels=str(tmp_path / "base.labels"), query_labels=str(tmp_path / "queries.labels"))
    base, queries = d.load_labels(spark)
    assert [r["label"] for r in base.orderBy("id").collect()] == [r["q_label"] for r in queries.orderBy("qid").collect()] == [0, 1, 0, 1]
    packed = spark.createDataFrame([(0, 5, 9), (1, 2, 3)], "qid long, lo long, hi long")
    vectors.write_ranges(packed, str(tmp_path / "packed"), 1, integer=True)
    assert [tuple(r) for r in vectors.bounds_rows(spark, str(tmp_path / "packed"), 2, 1, integer=True).orderBy("qid").collect()] == [(0, 5, 9), (1, 2, 3)]
    assert catalog.known("/data", "crawl", 2).attrs == "/data/crawl/crawl_attributes_2.raw" and len(catalog.SETS) == 10
    with pytest.raises(KeyError):
        catalog.known("/data", "none")


def test_truth_bounds_and_texts(spark, tmp_path):
    df = spark.createDataFrame([(0, [5, 3]), (1, [9, 1])], "id long, embedding array<int>")
    vectors.write_vectors(df, str(tmp_path / "t.ivecs"), "ivecs")
    truth = vectors.truth_rows(vectors.read_vectors(spark, str(tmp_path / "t.ivecs"), "ivecs"))
    assert sorted(map(tuple, truth.collect())) == [(0, 1, 5), (0, 2, 3), (1, 1, 9), (1, 2, 1)]
    np.array([[1, 2], [3, 4], [10, 20], [30, 40]], "<f4").tofile(tmp_path / "b.bin")
    bounds = vectors.bounds_rows(spark, str(tmp_path / "b.bin"), 2, 2).orderBy("qid")
    assert [tuple(r) for r in bounds.collect()] == [(0, 1.0, 2.0, 10.0, 20.0), (1, 3.0, 4.0, 30.0, 40.0)]
    assert vectors.query_texts(bounds, ["a"]).orderBy("qid").first()["predicate"] == "a >= 1.0 AND a <= 10.0"


def test_dataset_and_grid(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "id long, embedding array<float>")
    for name in ("base", "queries"):
        vectors.write_vectors(df, str(tmp_path / name), "fvecs")
    np.arange(8, dtype="<f4").tofile(tmp_path / "attrs")
    base, queries, truth = catalog.Dataset("d", str(tmp_path / "base"), str(tmp_path / "queries"), attrs=str(tmp_path / "attrs"), attr_dims=2).load(spark)
    assert base.orderBy("id").first().asDict() == {"id": 0, "embedding": [0.0, 0.0], "attr_0": 0.0, "attr_1": 1.0}
    assert queries.columns == ["qid", "q"] and truth is None
    assert len(catalog.grid(k=[1, 2], efs=[3, 4, 5])) == 6
