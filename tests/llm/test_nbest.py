from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import nbest
from tallyweave.llm.nbest import SPACE, Pieces, Segmenter, apply_spans, load_pieces


def small(prefix=True):
    """A vocabulary with many ways to cut a text, bytes 1 to 256, fractional scores."""
    rng = random.Random(4)
    own = ["a", "b", "c", "ab", "bc", "ca", "abc", "cab", "bca", SPACE, f"{SPACE}a", f"{SPACE}ab", "aa", ".", "c."]
    pieces = ["<unk>", *[f"<0x{i:02X}>" for i in range(256)], *own]
    scores = [0.0] * 257 + [-rng.randrange(1, 40) / 4 for _ in own]
    return Pieces(tuple(pieces), tuple(scores), 1, 0, tuple([False] * 257 + [True] * len(own)), prefix)


def every(vocab, text, unk):
    """Scores of all segmentations, best first, by recursion."""
    index = {p: (i, s) for i, (p, s) in enumerate(zip(vocab.pieces, vocab.scores)) if vocab.usable[i]}
    found = []

    def go(at, ids, score):
        if at == len(text):
            found.append((score, tuple(ids)))
            return
        for j in range(at + 1, len(text) + 1):
            if text[at:j] in index:
                i, s = index[text[at:j]]
                go(j, [*ids, i], score + s)
        if text[at] not in index:
            go(at + 1, [*ids, *(1 + b for b in text[at].encode())], score + unk)

    go(0, [], 0.0)
    return sorted(found, key=lambda x: (-x[0], x[1][::-1]))


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_against_all_segmentations(n):
    rng, vocab = random.Random(n), small()
    s = Segmenter(vocab, n)
    for _ in range(150):
        text = "".join(rng.choices("abc .é", weights=[6, 6, 6, 2, 1, 1], k=rng.randrange(1, 11)))
        want = every(vocab, SPACE + text.replace(" ", SPACE), s.unk_score)
        ids, score, more = s.encode(text)
        assert s.search(SPACE + text.replace(" ", SPACE), n) == want[:n]
        assert (score, tuple(ids)) == (want[0][0], tuple(ids)) and tuple(ids) == want[0][1]
        assert [score, *[x for x, _ in more]] == pytest.approx([x for x, _ in want[:n]])
        every_ids = {i for _, i in want}
        alternatives = [tuple(apply_spans(list(ids), spans)) for _, spans in more]
        assert len({tuple(ids), *alternatives}) == len(alternatives) + 1 and set(alternatives) <= every_ids
        for x in (ids, *alternatives):
            assert s.decode(x) == text


def test_ties_against_all_segmentations():
    """Pieces of one score each: many segmentations are equally good, and ids alone decide."""
    base = small()
    vocab = Pieces(base.pieces, (0.0,) * 257 + (-1.0,) * (len(base.pieces) - 257), 1, 0, base.usable)
    s, rng = Segmenter(vocab, 6), random.Random(8)
    for _ in range(100):
        text = SPACE + "".join(rng.choices("abcé", weights=[5, 5, 5, 1], k=rng.randrange(1, 11)))
        assert s.search(text, 6) == every(vocab, text, s.unk_score)[:6]


def test_a_very_long_word():
    s, word = Segmenter(load_pieces(), 4), "ab" * 100_000
    ids, score, more = s.encode(word)
    assert len(more) == 3 and s.decode(ids) == word
    assert all(s.decode(apply_spans(list(ids), spans)) == word for _, spans in more)
    # Alternatives hold what differs, not the whole word again.
    assert all(len(new) < 100 for _, spans in more for _, _, new in spans)
    assert np.all(np.diff([score, *[x for x, _ in more]]) <= 0)


def test_memory_of_a_long_run():
    s = Segmenter(load_pieces(), 4)
    tracemalloc.start()
    s.encode("-" * 8_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15e6


def test_against_the_library_as_unigram_model():
    sp = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(nbest.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    other = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    vocab = load_pieces()
    s = Segmenter(vocab, 4)
    score = lambda ids: sum(vocab.scores[i] for i in ids)
    for text in ("is and retitioning", "hello world", "thereupon another segmentation, and then"):
        ids, best, more = s.encode(text)
        assert [best, *[x for x, _ in more]] == [score(i) for i in other.nbest_encode_as_ids(text, 4)]


def test_round_trip_of_the_real_vocabulary(documents):
    s = Segmenter(load_pieces(), 3)
    texts = [r.text for r in documents.select("text").limit(40).collect()]
    for text in [*texts, "", " ", "  two  spaces ", "日本語\t\r\n🙂\x00", "▁ itself is a piece"]:
        ids, _, more = s.encode(text)
        if SPACE not in text:
            assert s.decode(ids) == text and all(s.decode(apply_spans(list(ids), x)) == text for _, x in more)
    with pytest.raises(ValueError):
        s.decode([10**7])


def test_columns_and_edges(spark, odd, none):
    assert nbest.encode(none).count() == 0
    clash = odd.withColumn("pieces", F.lit("x")).withColumn("ids", F.lit(1))
    out = nbest.encode(clash)
    assert out.columns.count("pieces") == 1
    back = out.withColumn("back", nbest.decode_column(spark, F.col("pieces.ids"))).collect()
    assert len(back) == odd.count()
    for r in back:
        assert (r.text is None and r.pieces is None and r.back is None) or (r.back == r.text and r.pieces.round_trip)
        if r.text == "":
            assert r.pieces.n_tokens == 0 and r.pieces.score == 0 and r.pieces.alternatives == []
        if r.text:
            assert np.all(np.diff([r.pieces.score, *[a.score for a in r.pieces.alternatives]]) <= 0)
