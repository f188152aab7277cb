"""Every registered corpus query on the smallest tables: against its SQL twin, or for its contract's columns."""

import os

import duckdb
import pytest

from parcelflow.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op6_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op7_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
