"""The corpus pipeline: from the table of documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.

1. quality: texts that fail the base rules or are outliers go (operator 4).
2. near duplicates: of the documents linked by n-gram Jaccard similarity the one with the
   smallest id stays (operator 8: five words, 80 percent).
3. repeated passages: byte strings of 100 or more that start earlier too are cut out, whole
   characters only; a document with nothing left goes (operator 10).
4. personal data: validated numbers, dates and addresses become pseudonyms (operator 5).
5. packing into sequences of 2048 tokens (operator 1).

Rows with the same id and text are one document from stage 2 on; rows with the same id and other texts are judged by their own
text.  A null id, language or source is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import ngram_join, packing, pii, quality, suffix_dedup
from llm.queries import PII_KEY, TOKENIZER
from llm.tables import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = quality.judge(docs, detail=True).where("kept").select(F.col("doc_id").alias("kept_id"), "row").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs["text"]) == kept["row"]), "left_semi").select(*COLUMNS)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.jaccard_components(docs, n=5, percent=80, detail=True)
    first = groups.where("doc_id <=> component_id").groupBy("component").agg(F.min("row").alias("row")).select("row")
    return docs.join(first, ngram_join.row_hash("doc_id", "text") == first["row"], "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(docs, whole_characters=True)
    out = out.select("doc_id", F.decode("text", "UTF-8").alias("text"), "n_removed", "rest.*").where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return _with_length(out.drop("n_chars", "n_removed"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(pii.pseudonymise(docs, PII_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_near), ("repeated_passages", cut_repeats), ("personal_data", hide_personal_data), ("packing", pack)]
#: Tokens, estimates and permutations can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
