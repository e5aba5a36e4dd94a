"""The registered queries at the smallest scale: contracts' columns, and SQL where there is any."""

import os

import duckdb
import pytest

from planframe.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

CONTRACTS = {
    "op1_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_quality": {"doc_id": "bigint", "score": "double", "kept": "boolean"},
    "op3_line_dedup": {"doc_id": "bigint", "text": "string", "n_lines": "bigint", "n_removed": "bigint"},
    "op4_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op8_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op9_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}


def cells(rows):
    return sorted((tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def test_all_ten():
    assert list(QUERIES) == list(CONTRACTS)


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    assert CONTRACTS[name].items() <= dict(df.dtypes).items()
    columns = sorted(df.columns)
    got = cells(map(tuple, df.select(*columns).collect()))
    source = "pages" if name == "op6_url_filter" else "documents"
    assert len(got) == spark.read.parquet(f"{DATA}/{source}.parquet").count()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        assert got == cells(con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())
