"""Similarity join on word shingles with Bayesian pruning of candidates.

Two texts are linked if the Jaccard similarity of their five-word shingles is
at least 0.8. Texts with equal shingle sets form a class and are compared once.
Classes that agree in a band of MinHash values are candidates. Their values are
compared block by block; a pair is dropped as soon as the posterior probability
of a similarity at or over the threshold, given the matches so far, falls below
the tolerance. What is left is verified on the shingles themselves.

Pairs never become rows. A bucket of candidates is dealt into cells of at most
two parts of about ``part`` classes, so a bucket of any size is spread over many
tasks. A cell hands on the classes that have a surviving pair with the places of
their partners, and after verification a count of links and a spanning forest.
A pair that meets in several bands counts in the first one only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import WordHashes, as_text, bitmap, shingles, text_key, whole_groups, words_of
from tallyweave.llm.components import components
from tallyweave.session import settle

CELL = ["band", "bucket", "lo", "hi"]


@dataclass(frozen=True)
class Join:
    """``bands`` x ``rows`` MinHash values of 16 bits. At a similarity of exactly 0.8 a pair
    agrees in none of the 24 bands with probability 3e-6, at 0.85 with 1e-8."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 4
    block: int = 16
    tolerance: float = 1e-6
    part: int = 128
    bits: int = 25

    @property
    def size(self) -> int:
        return self.bands * self.rows


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among ``n`` values that leave a pair in the race.

    With a uniform prior, P(similarity >= t | m of n match) is the chance of at
    most m successes in n + 1 draws of probability t.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _multipliers(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    draw = lambda: rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def signature(s: np.ndarray, size: int) -> np.ndarray:
    """``size`` MinHash values of 16 bits of a non-empty shingle set."""
    a, b = _multipliers(size)
    low = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 1024):
            low = np.minimum(low, (s[i : i + 1024, None] * a + b).min(axis=0))
    # The top bits of a minimum are mostly zero, the lowest ones of a product weak.
    return ((low >> np.uint64(24)) & np.uint64(0xFFFF)).astype("<u2")


def _sign(docs: DataFrame, join: Join) -> DataFrame:
    """``id, tk, sk, sig`` of each row; ``sk`` stands for the shingle set, null without words."""

    @F.pandas_udf("struct<sk: binary, sig: binary>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        hashes, keys, sigs = WordHashes(), [], []
        for t in texts:
            s = shingles(words_of(as_text(t)), hashes, join.words)
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s, join.size).tobytes() if len(s) else None)
        return pd.DataFrame({"sk": keys, "sig": sigs})

    return docs.select("id", "tk", sign("t").alias("s")).select("id", "tk", "s.sk", "s.sig")


def _cells(classes: DataFrame, join: Join) -> DataFrame:
    """Rows of ``CELL`` with ``cid, side, sig``: each candidate class in each cell of its buckets."""
    width = 2 * join.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(join.bands - 1)), lambda b: F.substring(F.col("sig"), b * width + 1, F.lit(width)))
    each = classes.select("cid", F.posexplode(keys).alias("band", "bucket"))
    sizes = each.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = each.join(sizes, ["band", "bucket"]).join(classes.select("cid", "sig"), "cid")
    parts = F.ceil(F.col("n") / join.part).cast("int")
    side = F.pmod(F.xxhash64("cid"), parts).cast("int")
    dealt = members.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.select("band", "bucket", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "cid", "side", "sig")


def _starts(f: pd.DataFrame) -> np.ndarray:
    """Where groups of ``CELL`` begin in a sorted frame, and its length."""
    new = np.zeros(len(f), dtype=bool)
    new[0] = True
    for k in CELL:
        v = f[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(f))


def _pairs(f: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that the cells of ``f`` have to compare, a bounded number at a time."""
    lo, hi, side = (f[c].to_numpy() for c in ("lo", "hi", "side"))
    sizes = np.diff(starts)
    for m in np.unique(sizes[sizes > 1]):
        at = starts[:-1][sizes == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, 200_000 // len(i))
        for k in range(0, len(at), step):
            a, b = ((at[k : k + step, None] + x).ravel() for x in (i, j))
            ok = (lo[a] == hi[a]) | (side[a] != side[b])
            yield a[ok], b[ok]


def _survivors(cells: DataFrame, join: Join) -> DataFrame:
    """``CELL, cid, place, partners``: classes with a pair that no block of values ruled out.

    ``place`` numbers the classes of a cell, ``partners`` has the places of later ones.
    """
    steps = list(range(join.block, join.size + 1, join.block))
    least = {n: least_matches(n, join.threshold, join.tolerance) for n in steps}

    def alive(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray) -> np.ndarray:
        met = np.zeros(len(a), dtype=np.int32)
        at = np.arange(len(a))
        for n in steps:
            cols = slice(n - join.block, n)
            met[at] += (sig[a[at], cols] == sig[b[at], cols]).sum(axis=1, dtype=np.int32)
            at = at[met[at] >= least[n]]
        same = (sig[a[at]] == sig[b[at]]).reshape(len(at), join.bands, join.rows).all(axis=2)
        return at[same.argmax(axis=1) == band[a[at]]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, CELL):
            starts = _starts(f)
            sig = np.frombuffer(b"".join(f["sig"]), dtype="<u2").reshape(len(f), join.size)
            band = f["band"].to_numpy()
            got = [(a[k], b[k]) for a, b in _pairs(f, starts) for k in [alive(sig, a, b, band)]]
            a, b = (np.concatenate([g[x] for g in got]) if got else np.empty(0, dtype=np.int64) for x in (0, 1))
            used = np.unique(np.concatenate([a, b]))
            if not len(used):
                continue
            group = np.searchsorted(starts, used, side="right")
            first = np.searchsorted(group, group)
            place = np.zeros(len(f), dtype=np.int32)
            place[used] = np.arange(len(used)) - first
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            cut = np.searchsorted(a, used)
            partners = [place[b[i:j]] for i, j in zip(cut, np.append(cut[1:], len(a)))]
            out = f.iloc[used][[*CELL, "cid"]].copy()
            out["place"], out["partners"] = place[used], partners
            yield out

    dealt = cells.repartition(*CELL).sortWithinPartitions(*CELL, "cid")
    return dealt.mapInPandas(run, "band int, bucket binary, lo int, hi int, cid long, place int, partners array<int>")


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles the sets have in common, pair by pair."""
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    width = int(ids.max()) + 1
    if len(a) * 8 < len(sets) ** 2 or len(sets) * width > 32_000_000:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], dtype=np.int64)
    m = np.zeros((len(sets), width), dtype=np.float32)
    m[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), ids] = 1
    return np.rint((m @ m.T)[a, b]).astype(np.int64)


def _verify(rows: DataFrame, join: Join) -> DataFrame:
    """``cid, docs, classes, root`` for each class and cell with a true link: linked rows, linked classes, forest."""
    t = Fraction(str(join.threshold))

    def one(f: pd.DataFrame, hashes: WordHashes) -> list[tuple]:
        f = f.drop_duplicates("place")
        at = {p: k for k, p in enumerate(f["place"])}
        lists = [p for p in f["partners"]]
        a = np.repeat(np.arange(len(f)), [len(p) for p in lists])
        b = np.array([at[p] for ps in lists for p in ps], dtype=np.int64)
        sets = [shingles(words_of(x), hashes, join.words) for x in f["text"]]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        both = _common(sets, a, b)
        ok = both * t.denominator >= t.numerator * (n[a] + n[b] - both)
        a, b = a[ok], b[ok]
        if not len(a):
            return []
        cid, size = f["cid"].to_numpy(), f["size"].to_numpy()
        docs = np.bincount(a, size[b], len(f)) + np.bincount(b, size[a], len(f))
        linked = np.bincount(a, minlength=len(f)) + np.bincount(b, minlength=len(f))
        root = cid.copy()
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            if (low == root).all():
                break
            root = low
        return [(int(cid[k]), int(docs[k]), int(linked[k]), int(root[k])) for k in np.flatnonzero(linked)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for f in whole_groups(frames, CELL):
            starts = _starts(f)
            got = [r for i, j in zip(starts[:-1], starts[1:]) for r in one(f.iloc[i:j], hashes)]
            yield pd.DataFrame(got, columns=["cid", "docs", "classes", "root"])

    dealt = rows.repartition(*CELL).sortWithinPartitions(*CELL, "place")
    return dealt.mapInPandas(run, "cid long, docs long, classes long, root long")


def link(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """``id, tk, rep_id, group_id, n_links, n_class_links, rk`` for each row of ``docs``.

    ``rep_id``: smallest id with the same shingle set. ``group_id``: smallest id
    that is reached over links. ``n_links``: other rows linked to this one, copies
    included; ``n_class_links``: other classes. ``gid`` numbers the groups in this
    run. Rows without words (null, empty, blank) link to nothing and have no
    ``gid``. Null ids are allowed; a group of such rows alone has a null
    ``group_id``. Repeated rows are copies of each other.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).withColumn("tk", text_key(F.col("t")))
    rows = settle(_sign(base, join))
    order = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("tk").alias("tk"))
    classes = rows.filter("sk is not null").groupBy("sk").agg(F.count("*").alias("size"), F.min(order).alias("rep"), F.first("sig").alias("sig"))
    # Numbered once and written, so a number stays the same wherever it is read.
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()))
    left = settle(_survivors(_cells(classes, join), join))
    need = classes.select("cid", "size", F.col("rep.id").alias("id"), F.col("rep.tk").alias("tk")).join(left.select("cid").distinct(), "cid", "left_semi")
    need = settle(need.withColumn("h", F.xxhash64("tk")))
    bits = spark.sparkContext.broadcast(bitmap(need, "h", join.bits))

    @F.pandas_udf("boolean")
    def listed(h: pd.Series) -> pd.Series:
        slot = h.to_numpy(dtype=np.int64) & ((1 << join.bits) - 1)
        return pd.Series(bits.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    texts = base.filter(F.col("t").isNotNull()).filter(listed(F.xxhash64("tk"))).select(F.col("id").alias("id2"), F.col("tk").alias("tk2"), "t")
    found = need.join(texts, (F.col("tk") == F.col("tk2")) & F.col("id").eqNullSafe(F.col("id2"))).select("cid", "size", F.col("t").alias("text"))
    links = settle(_verify(left.join(found, "cid"), join))
    comp = components(links.filter("cid != root"), "cid", "root").withColumnRenamed("v", "cid")
    per_class = (
        classes.select("cid", "sk", "size", F.col("rep.id").alias("rep_id"))
        .join(links.groupBy("cid").agg(F.sum("docs").alias("docs"), F.sum("classes").alias("classes")), "cid", "left")
        .join(comp, "cid", "left").withColumn("gid", F.coalesce("label", "cid"))
    )
    per_class = settle(per_class)
    lowest = per_class.groupBy("gid").agg(F.min("rep_id").alias("group_id"))
    known = per_class.join(lowest, "gid").select(
        "sk", "gid", "rep_id", "group_id", (F.col("size") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("classes", F.lit(0)).alias("n_class_links")
    )
    none = F.col("gid").isNull()
    return rows.drop("sig").join(known, "sk", "left").select(
        "id", "tk", "gid", F.when(none, F.col("id")).otherwise(F.col("rep_id")).alias("rep_id"),
        F.when(none, F.col("id")).otherwise(F.col("group_id")).alias("group_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_class_links", F.lit(0)).alias("n_class_links"),
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """The rows of ``docs`` with one of each group: the smallest (id, text key), nulls last.

    Rows without words belong to no group and stay. Of repeated rows one stays.
    """
    rows = settle(link(docs, doc_id=doc_id, text=text, join=join))
    order = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("tk").alias("tk"))
    first = rows.filter("gid is not null").groupBy("gid").agg(F.min(order).alias("f"))
    times = rows.filter("gid is not null").groupBy("id", "tk").agg(F.count("*").alias("__times"))
    kept = first.select(F.col("f.id").alias("id"), F.col("f.tk").alias("tk"))
    kept = kept.join(times.withColumnsRenamed({"id": "id3", "tk": "tk3"}), F.col("id").eqNullSafe(F.col("id3")) & (F.col("tk") == F.col("tk3")))
    kept = kept.select(F.col("id").alias("__id"), F.col("tk").alias("__tk"), "__times")
    t = F.col(f"`{text}`")
    wordless = t.isNull() | ~t.rlike(r"[^\x20\x09-\x0D]")
    joined = (
        docs.filter(~wordless).withColumn("__key", text_key(t))
        .join(kept, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__tk")))
    )
    mine = ["__key", "__id", "__tk", "__times"]
    single = joined.filter("__times = 1").drop(*mine)
    repeated = joined.filter("__times > 1").dropDuplicates([doc_id, "__key"]).drop(*mine)
    return single.unionByName(repeated).unionByName(docs.filter(wordless))
