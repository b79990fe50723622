from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import mixing
from tests.llm.conftest import SF


def by_id(df):
    return {(r.doc_id, r.mix.n_tokens): r.mix for r in df.collect()}


@pytest.mark.parametrize("mix", [
    mixing.Mix(cycles=4), mixing.Mix(cycles=6, keep_share=0.95, temperature=0.2),
    mixing.Mix(cycles=6, targets=(("lang", "en", 0.1), ("lang", "fr", 0.9), ("lang", "de", 0.1), ("lang", "es", 0.1))),
])
def test_against_sql(spark, documents, mix):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: r[3:] for r in con.execute(mixing.oracle(mix)).fetchall()}
    got = {r.doc_id: r.mix for r in mixing.mix_documents(documents, mix=mix).collect()}
    assert len(got) == len(want)
    for i, m in got.items():
        topic, n, w, p, s = want[i]
        assert (m.topic, m.n_tokens, m.sampled) == (topic, n, s)
        assert abs(m.weight - w) < 2e-6 * max(1, w) and abs(m.probability - p) < 2e-6


def crossed(spark):
    """Every source has every language in both topics, so any targets can be met."""
    rows = []
    for i in range(240):
        source, lang = "abc"[i % 3], ("en", "fr")[i // 3 % 2]
        words = (f"w{i} ") * (5 + i % 7 * (1 + i % 3))
        rows.append((i, words + ("licence" if i // 6 % 2 else "prose"), lang, source, len(words)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_margins_and_budget(spark):
    mix = mixing.Mix(cycles=12, temperature=0.0, keep_share=0.4)
    out = mixing.mix_documents(crossed(spark), mix=mix).cache()
    met = mixing.margins(out, mix=mix).collect()
    assert {(r.margin, r.value) for r in met} >= {("source", "a"), ("lang", "fr"), ("topic", "licensing"), ("topic", "prose")}
    assert all(abs(r.weighted - r.share) < 1e-4 for r in met)
    rows = [r.mix for r in out.collect()]
    # No probability is capped here, so the sample is expected to meet the targets as well.
    assert max(m.probability for m in rows) < 1 and all(abs(r.expected - r.share) < 1e-4 for r in met)
    total = sum(m.n_tokens for m in rows)
    assert abs(sum(m.n_tokens * m.probability for m in rows) / total - 0.4) < 1e-4
    assert abs(sum(m.n_tokens for m in rows if m.sampled) / total - 0.4) < 0.15


def test_targets_out_of_reach_are_told(documents):
    """The cells of a few documents admit no weights for equal margins: the margin fitted last is met, the others are not, and that shows."""
    mix = mixing.Mix(cycles=12, temperature=0.0, keep_share=0.4)
    met = mixing.margins(mixing.mix_documents(documents, mix=mix), mix=mix).collect()
    assert all(abs(r.weighted - r.share) < 1e-3 for r in met if r.margin == "topic")
    assert max(abs(r.weighted - r.share) for r in met) > 0.1


def test_all_kept_if_the_share_is_one(documents):
    assert mixing.mix_documents(documents, mix=mixing.Mix(cycles=2, keep_share=1.0)).filter("mix.probability < 0.999999").count() == 0


def test_edges(odd, none):
    mix = mixing.Mix(cycles=2)
    assert mixing.mix_documents(none, mix=mix).count() == 0 and mixing.sample(none, mix=mix).count() == 0
    clash = odd.withColumn("mix", F.lit(0)).withColumn("topic", F.lit("t")).withColumn("weight", F.lit(1))
    out = mixing.mix_documents(clash, mix=mix)
    assert out.count() == odd.count() and out.columns.count("mix") == 1
    blank = [r.mix for r in out.filter("text is null or trim(text) = '' or doc_id = 3").collect()]
    assert len(blank) == 4 and all((m.n_tokens, m.weight, m.probability, m.sampled) == (0, 0.0, 0.0, False) for m in blank)
    # Repeated rows share their fate.
    assert len({r.mix for r in out.filter("text = 'the same text twice here'").collect()}) == 1
