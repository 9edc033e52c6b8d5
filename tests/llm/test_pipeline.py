"""The stages on a small corpus, one after the other."""

import numpy as np

import __spark_entry__
import corpus_pipeline
from llm import suffix_dedup

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    import random

    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    texts = [prose(120) for _ in range(150)]
    passage = prose(60)
    texts[10], texts[11] = texts[10] + " " + passage, passage + " é " + texts[11]
    texts[20] = texts[21] + " one more word"
    texts[30] = prose(60) + " 4111 1111 1111 1111 " + prose(60)
    texts += [prose(10), None, "", "spam### " * 90, texts[40]]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", corpus_pipeline.F.lit(1))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {x["doc_id"]: x for x in docs.collect()}
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert set(seen["quality"]) == {*range(150), 154}
    assert set(seen["near_duplicates"]) == set(range(150)) - {21}
    kept = seen["repeated_passages"]
    assert set(kept) == set(seen["near_duplicates"])
    assert passage in kept[10]["text"] and passage[:200] not in kept[11]["text"] and "é" in kept[11]["text"]
    assert all(x["n_chars"] == len(x["text"]) for x in kept.values())
    hidden = seen["personal_data"]
    assert "4111" not in hidden[30]["text"] and hidden[31]["text"] == kept[31]["text"]
    assert set(seen["packing"]) == set(hidden)


def test_each_row_is_judged_by_its_own_text(spark, tmp_path):
    import random

    r = random.Random(17)
    a, b, c = (" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(90)) for _ in range(3))
    rows = [(1, a), (1, "too short"), (2, a + " more"), (2, b), (None, c), (None, c + " more"), (None, c), (3, c.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    good = corpus_pipeline.keep_good(spark, docs, str(tmp_path))
    assert sorted(x["text"] for x in good.collect()) == sorted(t for _, t in rows if t != "too short")
    one = corpus_pipeline.keep_one_of_near(spark, good, str(tmp_path))
    assert sorted((x["doc_id"], x["text"]) for x in one.collect()) == sorted([(1, a), (2, b), (3, c.upper())])
    nulls = corpus_pipeline.keep_one_of_near(spark, good.where("doc_id is null or doc_id = 1"), str(tmp_path)).collect()
    assert len(nulls) == 2 and {x["doc_id"] for x in nulls} == {1, None}


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_run_is_the_stages(spark):
    out = __spark_entry__.queries()["pipeline"](spark, DATA)
    pieces = out.toPandas()
    assert len(pieces) and (pieces.groupby("sequence_id").length.sum() <= 2048).all()
    assert all(len(i) == 4 * n for i, n in zip(pieces.ids, pieces.length))
    for _, own in pieces.groupby("doc_id"):
        assert own.sort_values("start").start.tolist() == [0, *np.cumsum(own.sort_values("start").length)[:-1]]
    assert suffix_dedup.GRAM < 100


def test_ten_queries_and_the_pipeline_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and "pipeline" in __spark_entry__.queries()
