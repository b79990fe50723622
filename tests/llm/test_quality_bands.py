from __future__ import annotations

import random
import re
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from tallyweave.llm import quality_bands as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base columns by the letter of their definition."""
    text = text or ""
    w = WORD.findall(text)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, dup, len(inside), failed


def chunks(text):
    """Chunks of a text that cover every byte, and how many lie outside their band; a text of one chunk is judged as a whole only."""
    raw, b = text.encode(), q.Bands()
    parts = [raw[i : i + b.chunk_bytes] for i in range(0, len(raw), b.chunk_bytes)]
    if len(raw) > b.chunk_bytes and len(parts[-1]) < b.chunk_bytes / 4:
        parts[-1] = raw[len(raw) - b.chunk_bytes :]
    if len(parts) == 1:
        return 1, 0
    ratios = [len(zstandard.ZstdCompressor(level=b.level, write_checksum=False).compress(p)) / len(p) for p in parts]
    return len(parts), sum(not b.chunk_low <= x <= b.chunk_high for x in ratios)


def rows(df):
    return [(r.doc_id, r.text, r.q) for r in q.assess(df, into="q").select("doc_id", "text", "q").collect()]


def test_base_and_verdict_against_plain(documents, odd):
    zstd = zstandard.ZstdCompressor(level=3)
    for _, text, r in rows(documents) + rows(odd):
        want = plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and r.base_failed)
        if text:
            ratio = len(zstd.compress(text.encode())) / len(text.encode())
            low, high = q.Bands().band(len(text.encode()))
            assert abs(r.ratio - ratio) < 1e-2
            n, bad = chunks(text)
            assert (r.n_chunks, r.low_chunks + r.high_chunks) == (n, bad)
            fits = low <= r.ratio <= high and bad <= q.Bands().share(n) * n
            assert r.kept == (not r.base_failed and fits)
        else:
            assert r.ratio is None and not r.kept


def test_repetitive_and_random_texts_go_prose_stays(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choices(vocabulary, k=1500))
    # No three words recur, yet the text is a counter in a fixed frame.
    frame = " ".join(f"item-{i:06d} of-the-list-of-items-of-the-list" for i in range(400))
    noise = " ".join("".join(rng.choices([chr(c) for c in range(33, 127)], k=60)) for _ in range(200))
    half = prose[: len(prose) // 2] + " " + noise
    df = spark.createDataFrame([(1, prose), (2, frame), (3, noise), (4, half)], "doc_id long, text string")
    got = {i: r for i, _, r in rows(df)}
    assert got[1].kept and not got[1].base_failed
    assert not got[2].base_failed and not got[2].kept
    assert not got[3].base_failed and not got[3].kept
    assert not got[4].kept and got[4].high_chunks > 0


def test_edges(odd, none):
    assert q.assess(none).count() == 0
    clash = odd.withColumn("quality_rules", F.lit("old")).withColumn("n_words", F.lit(-1))
    out = q.assess(clash)
    assert out.columns.count("quality_rules") == 1 and out.filter("n_words = -1").count() == odd.count()
    kept = q.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == 1


def test_noise_in_the_tail_is_read(spark):
    """A tail shorter than half a chunk is in a tested chunk, also where it is the second one."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choices(vocabulary, k=3000)).encode()
    noise = bytes(rng.choices(range(33, 127), k=1000))
    texts = [(prose[:6144] + noise).decode(), (prose[:2048] + noise).decode(), prose[:7144].decode()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: r for i, _, r in rows(df)}
    assert [got[i].n_chunks for i in range(3)] == [4, 2, 4]
    assert got[0].high_chunks == 1 and got[1].high_chunks == 1
    assert [got[i].kept for i in range(3)] == [False, False, True] and not any(r.base_failed for r in got.values())
