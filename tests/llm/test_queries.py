"""The registered queries on the smallest tables: columns, rows, and SQL where there is some."""

import os

import pytest

import __spark_entry__
from llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_html": "page_id url text n_chars",
    "op3_language": "doc_id held_out lang_pred score",
    "op4_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_pii": "doc_id text n_replaced",
    "op6_winnowing": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_ngram_join": "doc_id n_shingles component_id",
    "op9_licenses": "doc_id license start stop coverage",
    "op10_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op12_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_whitening": "vec_id component n deviation whitened explained identity_error",
}
TABLES = {"op2_html": "pages", "op13_whitening": "embeddings"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    import duckdb

    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    assert got.columns.tolist() == COLUMNS[name].split()
    table = spark.read.parquet(f"{DATA}/{TABLES.get(name, 'documents')}.parquet")
    if name == "op13_whitening":
        assert len(got) == 4 * table.count()
    elif name not in ("op1_packing", "op9_licenses"):
        assert len(got) == table.count()
    elif name == "op1_packing":
        assert got.doc_id.nunique() == table.count()
    if name in queries.oracle_sql():
        duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        want = duckdb.sql(queries.oracle_sql()[name]).df()[got.columns]
        assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
