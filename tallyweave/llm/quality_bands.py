"""Quality rules by compression bands.

Repetitive text compresses far too well and noise hardly at all. A document is
compressed with zstandard as a whole and in fixed chunks. Both ratios (bytes out
by bytes in) must lie in a band that depends on the length: short texts carry
the frame's overhead and little to refer back to, so their band lies higher.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import SPACES, as_text

SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "ratio double, n_chunks long, low_chunks long, high_chunks long"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the rules.

    ``whole``: (up to so many bytes, least ratio, greatest ratio), in order of
    length; the last one has no end. ``chunk_low`` and ``chunk_high`` hold for
    chunks of ``chunk_bytes``; a last one below a quarter of that size is read
    with the bytes before it. A text that fits one chunk is judged as a whole only.
    ``chunk_share``: (up to so many chunks, share of chunks that may lie outside).
    """

    level: int = 3
    min_words: int = 50
    repeat_percent: int = 50
    whole: tuple[tuple[float, float, float], ...] = (
        (256, 0.35, 1.30), (1024, 0.30, 0.90), (4096, 0.25, 0.78), (16384, 0.22, 0.72), (float("inf"), 0.20, 0.68),
    )
    chunk_bytes: int = 2048
    chunk_low: float = 0.22
    chunk_high: float = 0.80
    chunk_share: tuple[tuple[float, float], ...] = ((4, 0.20), (float("inf"), 0.25))

    def band(self, n: int) -> tuple[float, float]:
        return next((low, high) for most, low, high in self.whole if n < most)

    def share(self, n: int) -> float:
        return next(share for most, share in self.chunk_share if n <= most)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blank = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return n, len(text) - blank, symbols, dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    # The pair's rank keeps the key below n * n, whatever the vocabulary.
    pair = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)[1]
    _, back, times = np.unique(pair[:-1].astype(np.int64) * len(ids) + at[2:], return_inverse=True, return_counts=True)
    hit = times[back] > 1
    inside = np.zeros(n, dtype=bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= hit
    return int(inside.sum())


def _assess(text: str | None, bands: Bands, zstd: zstandard.ZstdCompressor) -> tuple:
    n, chars, symbols, dup, repeat = base_counts(text)
    failed = n < bands.min_words or 100 * repeat > bands.repeat_percent * n
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return n, chars, symbols, dup, repeat, failed, False, None, 0, 0, 0
    ratio = len(zstd.compress(raw)) / len(raw)
    size = bands.chunk_bytes
    chunks = [raw[i : i + size] for i in range(0, len(raw), size)]
    if len(chunks) > 1 and len(chunks[-1]) * 4 < size:
        # Too short a tail for a ratio of its own; it is read with what stands before it.
        chunks[-1] = raw[-size:]
    if len(chunks) == 1:
        # The only chunk is the document, which the whole band judges.
        low = high = 0
    else:
        out = [len(zstd.compress(c)) / len(c) for c in chunks]
        low, high = sum(r < bands.chunk_low for r in out), sum(r > bands.chunk_high for r in out)
    least, most = bands.band(len(raw))
    kept = not failed and least <= ratio <= most and low + high <= bands.share(len(chunks)) * len(chunks)
    return n, chars, symbols, dup, repeat, failed, kept, ratio, len(chunks), low, high


def verdict(text: Column, bands: Bands = Bands()) -> Column:
    """A struct of ``SCHEMA`` for each whole text.

    Null and empty texts have no words, so the base fails them; their ratio is
    null. Of a very long text every byte lies in a tested chunk. Every row is judged by its own text alone: repeated rows get equal
    results, an empty table an empty one.
    """

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        zstd = zstandard.ZstdCompressor(level=bands.level, write_checksum=False)
        rows = [_assess(as_text(t), bands, zstd) for t in texts]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        return out.astype({"base_failed": bool, "kept": bool, "ratio": float})

    return run(text)


def assess(docs: DataFrame, *, text: str = "text", into: str = "quality_rules", bands: Bands = Bands()) -> DataFrame:
    """``docs`` with a struct column ``into``; a column of that name is replaced, all others stay, whatever their names."""
    return docs.withColumn(into, verdict(F.col(f"`{text}`"), bands))


def keep_good(docs: DataFrame, *, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows whose text is kept, with their own columns only."""
    mark = "__quality_rules"
    return assess(docs, text=text, into=mark, bands=bands).filter(F.col(mark)["kept"]).drop(mark)
