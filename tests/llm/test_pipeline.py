from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tests.llm.test_line_templates import plain as plain_lines
from tests.llm.test_ngram_join import plain as plain_links
from tests.llm.test_quality_bands import plain as plain_base

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402
from tallyweave.llm import line_templates, nbest  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of every stage, as a driver would write and read them."""
    base = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{base}/{name}")
        after = spark.read.parquet(f"file://{base}/{name}")
        out[name] = docs, after
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    for name, (before, after) in steps.items():
        if name != "encode_pieces":
            assert after.columns == before.columns and before.count() >= after.count() > 0


def test_quality(steps):
    before, after = map(texts, steps["quality_rules"])
    assert all(not plain_base(t)[-1] for t in after.values())
    assert len(after) > 0.7 * len(before)


def test_lines(steps):
    before, after = map(texts, steps["line_dedup"])
    gone = plain_lines(list(before.items()), line_templates.Tree())
    assert set(before) == set(after)
    for i, t in before.items():
        assert after[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))
    assert all(r.n_chars == len(r.text) for r in steps["line_dedup"][1].collect())


def test_near_duplicates(steps):
    before, after = map(texts, steps["near_duplicates"])
    group = {int(i): int(g) for i, _, _, g in plain_links(list(before.items()))}
    wordless = {i for i, t in before.items() if not t.split()}
    assert set(after) == set(group.values()) | wordless


def test_mixing(spark, steps):
    before, after = steps["mix_sources"]
    before.createOrReplaceTempView("mix_before")
    import duckdb

    con = duckdb.connect()
    con.register("documents", before.toPandas())
    from tallyweave.llm import mixing

    want = {r[0] for r in con.execute(mixing.oracle(cp.MIX)).fetchall() if r[-1]}
    assert set(texts(after)) == want


def test_pieces(steps):
    before, after = steps["encode_pieces"]
    s, t = nbest.Segmenter(nbest.load_pieces(), 4), texts(before)
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(t)
    assert all(s.decode(r.ids) == t[r.doc_id] and r.round_trip for r in rows)


def test_odd_rows_and_empty_tables_pass_every_stage(spark, odd, none, documents):
    extra = odd.unionByName(documents.limit(30)).withColumn("rk", F.lit(1)).withColumn("mix", F.lit("m")).withColumn("__q", F.lit(None).cast("string"))
    for name, stage in cp.STAGES:
        out = stage(spark, extra, SF)
        if name != "encode_pieces":
            assert out.columns == extra.columns
        assert out.count() > 0
        assert stage(spark, none, SF).count() == 0


def test_run_is_the_stages(spark, steps):
    got = cp.run(spark, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in steps["encode_pieces"][1].collect())
