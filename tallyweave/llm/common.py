"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# One pattern for a word everywhere: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(df: DataFrame, *names: str, keep: Iterable[str] = ()) -> list[str]:
    """A helper column's name for each of ``names`` that neither ``df`` nor ``keep`` has, in whatever case."""
    taken, out = {c.lower() for c in (*df.columns, *keep)}, []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def words_of(text: str | None) -> list[bytes]:
    """The words of ``text`` in UTF-8. ``bytes.split`` cuts at the same six characters as ``WORD``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a text; equal texts have equal keys. A null text has none."""
    return F.unhex(F.md5(text))


def row_key(doc_id: Column, text: Column) -> Column:
    """Sixteen bytes that stand for a row by its id and text, nulls told apart from blanks."""
    parts = F.concat(
        F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")), F.lit("\n"),
        F.coalesce(F.concat(F.lit("t"), text), F.lit("n")),
    )
    return F.unhex(F.md5(parts))


def signed(h: int) -> int:
    """An unsigned 64-bit hash as Spark's long."""
    return h - (1 << 64) if h >= 1 << 63 else h


def as_text(v) -> str | None:
    """A cell of a pandas column as text; nulls of any kind as None."""
    return v if isinstance(v, str) else None


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (the last one is the bias) of a small dense logistic regression, by Newton's method."""
    a = np.column_stack([x, np.ones(len(y))])
    each = np.full(len(y), 1 / len(y)) if weights is None else weights / weights.sum()
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        grad = a.T @ ((p - y) * each) + ridge * w
        hess = (a * (p * (1 - p) * each)[:, None]).T @ a + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def lowest(rows: DataFrame, hash64: Column, limit: int, total: int) -> DataFrame:
    """Rows that can be among the ``limit`` with the lowest ``hash64``, a long that is spread evenly.

    Of ``total`` rows some four times the limit pass, so that sorting them asks
    little of one task however many tasks there are. Repetitions of one hash pass together.
    """
    share = (4 * limit + 1000) / max(total, 1)
    return rows if share >= 1 else rows.filter(hash64 <= F.lit(int(-(2**63) + share * 2**64)))


@dataclass(frozen=True)
class Sample:
    """Labelled texts, and how many rows of either label they stand for."""

    rows: tuple[tuple[str, int], ...]
    counts: tuple[int, int]

    def texts(self, y: int) -> list[str]:
        return [t for t, label in self.rows if label == y]

    def weight(self, y: int) -> float:
        """What one sampled text of label ``y`` counts, so that the labels weigh as in all rows."""
        n = sum(label == y for _, label in self.rows)
        return self.counts[y] / n if n else 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: int, max_chars: int) -> Sample:
    """At most ``per_class`` training texts of either label, the same ones on each run.

    ``fold`` is true for the rows that may be learned from. Rows are taken by a
    hash of their id, so the choice has nothing to do with the order of the files;
    ids with contradicting labels are left out. The sample is what the driver
    holds: at most ``2 * per_class`` ids and ``4 * per_class`` rows, of a window
    of ``max_chars`` characters each, at a place that depends on the id.
    """
    l = labels.select(F.col("doc_id"), F.col(label).alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & fold)
    l = l.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("y").alias("low")).filter("y = low").drop("low")
    counts = {r.y: r["count"] for r in l.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        h = F.xxhash64(F.col("doc_id").cast("string"))
        one = lowest(l.filter(F.col("y") == y), h, per_class, counts.get(y, 0)).orderBy(h, "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    room = F.greatest(F.length("text") - max_chars, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id"), room.cast("long")).cast("int") + 1
    # Few ids against all documents: the ids go to the documents, which stay where they are.
    rows = (
        docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
        .select("doc_id", F.substring(F.col("text"), start, F.lit(max_chars)).alias("text"), "y")
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "text").limit(4 * per_class).collect()
    )
    return Sample(tuple((r.text, int(r.y)) for r in rows), (counts.get(0, 0), counts.get(1, 0)))


class WordHashes(dict):
    """64-bit hashes of words, looked up while they recur; emptied when it has grown large."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words.

    A text of fewer words is one shingle by itself, so short texts are similar
    only if they are equal. No words, no shingles.
    """
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(size, len(w))
    h = np.full(len(w) - span + 1, span, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - span + 1 + k]
            h ^= h >> np.uint64(29)
    return np.unique(h)


def bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bytes with the bit of each long's low ``bits`` bits set; 2 ** bits / 8 of them, however many values there are."""
    page = 15  # Spark's bitmaps hold 2 ** 15 bits each
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    pages = values.select(F.shiftright(slot, page).alias("page"), slot.bitwiseAND((1 << page) - 1).alias("bit"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("b")).collect():
        out[r.page << (page - 3) : (r.page + 1) << (page - 3)] = np.frombuffer(r.b, dtype=np.uint8)
    return out


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of a partition sorted by ``keys``, cut anew so that no group is split. A group must fit in memory."""
    rest: pd.DataFrame | None = None
    for f in frames:
        if not len(f):
            continue
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        same = np.ones(len(f), dtype=bool)
        for k in keys:
            same &= (f[k] == f[k].iloc[-1]).to_numpy()
        first = len(f) - int(np.argmin(same[::-1])) if not same.all() else 0
        if first:
            yield f.iloc[:first].reset_index(drop=True)
        rest = f.iloc[first:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest
