"""The queries op1_ to op13_ and their SQL.  Each applies an operator of this package to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, fingerprints, html_text, language_id, licenses, ngram_join, packing, pii, quality, sharding, suffix_dedup, token_alignment, whitening

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: For these queries only; a deployment hands its own secret to the operator.
PII_KEY = "public test key"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return language_id.identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).select("doc_id", *quality.NAMES, "base_failed", "kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), PII_KEY, count_col="n_replaced").select("doc_id", "text", "n_replaced")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))
    spelt = fingerprints.spelt
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelt(F.col("fingerprint")).alias("fingerprint"), spelt(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode_decode(read(spark, sf_dir, "documents"), TOKENIZER)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.counted(read(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_html": op2_html, "op3_language": op3_language, "op4_quality": op4_quality, "op5_pii": op5_pii, "op6_winnowing": op6_winnowing, "op7_bpe": op7_bpe, "op8_ngram_join": op8_ngram_join, "op9_licenses": op9_licenses, "op10_suffix_dedup": op10_suffix_dedup, "op11_sharding": op11_sharding, "op12_token_alignment": op12_token_alignment, "op13_whitening": op13_whitening}


SQL_8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

SQL_10 = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS k FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT) - 99)) AS s FROM texts WHERE length(x) >= 200)
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1
), runs AS (
  SELECT doc_id, s, count_if(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS fresh FROM again)
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS e FROM runs GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
), cut AS (
  SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS front
  FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The others need tokens, trees, models, permutations or hashes that SQL doesn't have; tests hold them against brute force."""
    return {"op8_ngram_join": SQL_8, "op10_suffix_dedup": SQL_10}
