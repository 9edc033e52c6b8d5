"""Queries as a stream."""

from quarryvec.operators.exact import filtered_knn
from quarryvec.streaming.search import search_stream


def test_micro_batches_give_the_batch_result(spark, tmp_path):
    base = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(100 + i, [float(i), 0.0]) for i in range(4)], "qid long, q array<float>")
    queries.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    search_stream(stream, base, 3, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("qid", "rank", "id", "dist")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, filtered_knn(base, queries, 3).collect()))
