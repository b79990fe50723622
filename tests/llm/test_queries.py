from __future__ import annotations

import duckdb

import __spark_entry__ as entry
from tallyweave.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and "pipeline" not in entry.oracle_sql()


def test_raked_mixing_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op7_raked_mixing"])
    names = [c[0] for c in want.description]
    df = QUERIES["op7_raked_mixing"](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}
    assert got == {r[0]: tuple(r) for r in want.fetchall()}


def test_contract_columns(spark):
    for name, columns in {
        "op3_compression_bands": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op8_credential_linking": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op2_dimension_scan": ["query_id", "rank", "vec_id", "score"],
    }.items():
        assert set(columns) <= set(QUERIES[name](spark, SF).columns)
