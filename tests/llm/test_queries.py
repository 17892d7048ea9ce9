"""The registered queries: SQL where there is any, whole tables, and the names of their columns."""

import pytest

import __spark_entry__ as entry
from glyphlake.llm.queries import ORACLE, QUERIES
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": "doc_id held_out score predicted",
    "op2_neardup": "doc_id n_shingles component_id kept",
    "op3_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op5_ann": "query_id rank vec_id score",
    "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_substrings": "doc_id n_words n_removed kept_sha256",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_licenses": "doc_id n_blocks licenses spans best_reduction n_differences",
}


def test_all_are_registered():
    assert QUERIES.keys() == COLUMNS.keys() and QUERIES.keys() | {"pipeline"} <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR).toPandas(), connect(SF_DIR).sql(ORACLE[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_covers_the_table(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    ids = {r[0] for r in found.select("query_id" if name == "op5_ann" else "doc_id").distinct().collect()}
    assert len(ids) == (25 if name == "op5_ann" else 200)
