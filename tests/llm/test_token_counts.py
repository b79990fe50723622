from __future__ import annotations

import base64
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyweave.llm import token_counts as tc
from tallyweave.llm.queries import QUERIES
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def library():
    sp = sentencepiece.SentencePieceProcessor(model_file=tc.MODEL)
    return lambda text: len(sp.encode(text)) if text else 0


@pytest.fixture(scope="module")
def merges():
    return tc.load_merges()


def test_query_against_the_library(spark, documents, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op13_merged_token_counts"](spark, SF).collect()}
    for r in documents.collect():
        n = library(r.text)
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 4096)


def test_odd_texts_against_the_library(merges, library):
    rng = random.Random(5)
    texts = [" " * k for k in range(1, 70)] + ["a" + " " * k + "b" for k in range(70)]
    texts += ["▁" * 5 + "x ▁ y", "<s></s><unk><0x0A>", "\n\n\t\x00", "日本語のテキスト、長い文章。" * 50, "é" * 30, "aaaa" * 500, "\r\n  x　y z😀😀"]
    for _ in range(2000):
        letters = rng.choice(["ab", "the ing", "abcdefghijklmnopqrstuvwxyz ", "eating  \n▁", "éàü ñ😀日", "0123456789abcdef", "=-_#*/ "])
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(1, 200))))
    want = [library(t) for t in texts]
    assert tc.Counter(merges).texts(texts) == want
    # Cutting texts into parts changes nothing.
    assert tc.Counter(merges).texts(texts, chunk=50) == want


@pytest.mark.parametrize("text", [
    base64.b64encode(random.Random(1).randbytes(150_000)).decode(), "a" * 200_000, " " * 200_000, "=" * 200_000, "word " * 100_000,
])
def test_long_texts_against_the_library(merges, library, text):
    assert tc.Counter(merges).texts([text]) == [library(text)]


def one_by_one(text, score):
    """Merge the best pair, the leftmost of equals, until none is left."""
    s = list(text.replace(" ", tc.SPACE))
    while True:
        best = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in score), default=None)
        if best is None:
            return len(s)
        k = -best[1]
        s[k : k + 2] = [s[k] + s[k + 1]]


def test_merges_that_reopen_better_ones():
    """Models in which a merge brings up better pairs, and pieces of equal score."""
    rng = random.Random(7)
    for _ in range(60):
        pieces = sorted({"a", "b", "c", tc.SPACE} | {"".join(rng.choices("abc", k=rng.randint(2, 5))) for _ in range(14)})
        scores = [float(-rng.randint(1, 8)) for _ in pieces]
        counter = tc.Counter(tc.build_merges(pieces, scores))
        texts = ["".join(rng.choices("abc", k=rng.randint(1, 40))) for _ in range(20)]
        assert counter.texts(texts) == [one_by_one(" " + t, dict(zip(pieces, scores, strict=True))) for t in texts]


def test_edges(spark, odd, none, merges, library):
    assert tc.count_tokens(none, merges=merges).count() == 0
    clash = odd.withColumn("n_tokens", F.lit("old")).withColumn("tokens", F.lit(1))
    out = tc.count_tokens(clash, merges=merges)
    assert sorted(out.columns) == sorted(clash.columns)
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.n_tokens == library(r.text) and r.tokens == 1 for r in rows)
