"""Transaction matching: one-to-one, by equal or contained text.

The outcome is that of serving reported rows in input order, each taking the
earliest free independent row with equal text, else the earliest free one whose
text contains or is contained in its own. Since every independent row prefers
the lowest reported order, this is the one stable assignment, and proposing in
rounds finds it with joins alone: no row order is walked and no group gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyweave.functions.text import normalize_value
from tallyweave.operators.ordered import HOT_ROWS, exclusive_prefix
from tallyweave.session import settle, sweep

#: The bitmaps of a search have at most 2 ** FILTER_BITS bits each: 16 MB, which is all that is sent to tasks.
FILTER_BITS = 27
#: Characters that a task hashes at once.
AT_ONCE = 1 << 20


def cut(df: DataFrame) -> DataFrame:
    """A table of the rounds, compressed and column-pruned, without its lineage."""
    return settle(df)


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of two."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C159E3779B9))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _levels(codes: np.ndarray, sizes: Sequence[int]):
    """``size, h`` for powers of two: ``h[p]`` is the hash of ``size`` characters from ``p``, made of two halves."""
    h, size = _mixed(codes.astype(np.uint64), 1), 1
    for wanted in sorted(sizes):
        while size < wanted:
            h, size = _mixed(h[:-size], h[size:]), 2 * size
        yield size, h


def _codes(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, its characters, and where each text begins and ends."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    whole = "".join(texts)
    return whole, np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _batches(texts: Sequence[str]):
    """Runs of texts of about ``AT_ONCE`` characters."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > AT_ONCE:
            yield texts[at:k]
            at, held = k, 0
        held += len(t)
    if at < len(texts):
        yield texts[at:]


def _size_of(length: int) -> int:
    """The largest power of two within a length: a text of that length is told by its first and its last so many characters."""
    return 1 << (length.bit_length() - 1)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType())])))
def _marks(needles: pd.Series) -> pd.Series:
    """Of a text that is not empty: the hash of its beginning (kind 0) and of the whole of it (kind 1)."""
    out = []
    for some in _batches([str(n) for n in needles]):
        _, codes, starts, ends = _codes(some)
        length = ends - starts
        size = np.array([_size_of(int(n)) for n in length], dtype=np.int64)
        marks = np.zeros((len(some), 2), dtype=np.uint64)
        for k, h in _levels(codes, np.unique(size).tolist()):
            own = np.flatnonzero(size == k)
            first, last = h[starts[own]], h[ends[own] - k]
            marks[own, 0] = _mixed(first, k)
            marks[own, 1] = _mixed(_mixed(first, last), length[own].astype(np.uint64))
        out += [[(0, a), (1, b)] for a, b in marks.view(np.int64).tolist()]
    return pd.Series(out, dtype=object)


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the bitmap; none that is in it is missed."""
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _found(texts: Sequence[str], lengths: dict[int, list[int]], begins: np.ndarray, wholes: np.ndarray) -> list[list[str]]:
    """Distinct stretches of each text, shorter than it, that may be a needle."""
    whole, codes, starts, ends = _codes(texts)
    row = np.repeat(np.arange(len(texts)), ends - starts)
    end, length = ends[row], (ends - starts)[row]
    found: list[set[str]] = [set() for _ in texts]
    for k, h in _levels(codes, [k for k in lengths if k <= len(codes)]):
        # Most places end here: no needle begins so.
        at = np.flatnonzero(_held(begins, _mixed(h, k)))
        at = at[at + k <= end[at]]
        for n in lengths[k]:
            p = at[(at + n <= end[at]) & (length[at] > n)]
            p = p[_held(wholes, _mixed(_mixed(h[p], h[p + n - k]), np.uint64(n)))]
            for r, q in zip(row[p].tolist(), p.tolist()):
                found[r].add(whole[q : q + n])
    return [list(f) for f in found]


def _finder(needles: DataFrame, column: str):
    """A function of a text column: the distinct stretches, shorter than the text, that may be one of ``needles``.

    No needle in the text is missed; a few stretches are none, so callers join
    what is found to the needles by equality. ``needles`` is scanned twice.
    """
    spark, text = needles.sparkSession, needles.select(F.col(column).alias("t")).filter(F.col("t") != "")
    counts = {r.n: r.c for r in text.groupBy(F.length("t").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    bits = min(FILTER_BITS, max(16, (16 * sum(counts.values())).bit_length()))
    page = 15  # Spark's bitmaps hold 2 ** 15 bits each
    maps = np.zeros((2, (1 << bits) // 8), dtype=np.uint8)
    slot = F.col("m.key").bitwiseAND((1 << bits) - 1)
    marks = text.select(F.explode(_marks("t")).alias("m")).select(
        "m.kind", F.shiftright(slot, page).alias("page"), slot.bitwiseAND((1 << page) - 1).alias("bit")
    )
    for r in marks.groupBy("kind", "page").agg(F.bitmap_construct_agg("bit").alias("b")).toLocalIterator():
        maps[r.kind, r.page << (page - 3) : (r.page + 1) << (page - 3)] = np.frombuffer(r.b, dtype=np.uint8)
    lengths: dict[int, list[int]] = {}
    for n in sorted(counts):
        lengths.setdefault(_size_of(n), []).append(n)
    sent = spark.sparkContext.broadcast(maps)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def stretches(texts: pd.Series) -> pd.Series:
        out: list[list[str]] = []
        for some in _batches([t if isinstance(t, str) else "" for t in texts]):
            out += _found(some, lengths, *sent.value)
        return pd.Series(out, dtype=object)

    return stretches


def contained_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """``needle, hay_id`` for every distinct ``needle`` inside a longer text of ``hays`` (``hay_id, hay``).

    Texts are scanned where they lie: a place goes on only where some needle begins
    so, and is then looked up whole, once per length of such needles, in bitmaps of a fixed size. What is found
    meets the needles by equality. The work is the length of the texts, and per place where needles begin their
    lengths; what is shuffled is the pairs themselves. ``hay_id`` is unique; of texts that share one, each gives the pair as often.
    """
    n = settle(needles.select("needle").filter(F.col("needle") != "").distinct())
    found = hays.filter(F.col("hay_id").isNotNull()).select("hay_id", F.explode(_finder(n, "needle")("hay")).alias("needle"))
    pairs = found.join(n, "needle", "left_semi")
    # Texts that share an id meet each other, as in a join by id.
    copies = F.count(F.lit(1)).over(Window.partitionBy("hay_id", "needle")).cast("int")
    return pairs.withColumn("_copies", F.array_repeat(F.lit(1), copies)).select("needle", "hay_id", F.explode("_copies")).drop("col")


def _pair_by_rank(left: DataFrame, right: DataFrame, hot_rows: int) -> DataFrame:
    """k-th left row of a value with its k-th right row."""
    l = exclusive_prefix(left, ["v"], [F.col("r")], hot_rows=hot_rows)
    r = exclusive_prefix(right, ["v"], [F.col("i")], hot_rows=hot_rows)
    return l.join(r, ["v", "rows_before"]).select("r", "i")


def match(
    reported: DataFrame,
    independent: DataFrame,
    *,
    reported_col: str = "description",
    independent_col: str = "description",
    order: str = "seq",
    partial: bool = True,
    hot_rows: int = HOT_ROWS,
    **leniency: bool,
) -> DataFrame:
    """Matched pairs: ``reported_seq, independent_seq, match_key, match_type``.

    ``order`` is a unique input order on each side. ``partial=False`` pairs equal
    texts only. ``leniency`` goes to the text normaliser.
    """

    def side(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(F.col(order).alias(name), normalize_value(F.col(f"`{column}`"), **leniency).alias("v")).filter(F.col("v") != "")

    left, right = side(reported, reported_col, "r"), side(independent, independent_col, "i")
    if not partial:
        pairs = _pair_by_rank(left, right, hot_rows)
    else:
        left, right = cut(left), cut(right)
        sweep(left.sparkSession)
        pairs = _stable_pairs(left, right, hot_rows)
    named = pairs.join(left.withColumnRenamed("v", "rv"), "r").join(right.withColumnRenamed("v", "iv"), "i")
    equal = F.col("rv") == F.col("iv")
    return named.select(
        F.col("r").alias("reported_seq"), F.col("i").alias("independent_seq"),
        F.when(equal, F.col("rv")).otherwise(F.concat_ws(" ~ ", "rv", "iv")).alias("match_key"),
        F.when(equal, F.lit("exact")).otherwise(F.lit("partial")).alias("match_type"),
    )


def candidate_slots(texts: DataFrame, right: DataFrame) -> DataFrame:
    """Independent rows (``i, v``) that a reported text (``id, v``) may take: ``id, i, is_exact``."""
    # Reported texts within independent ones, which are scanned row by row: each row is a slot of its own.
    inner = right.select("i", F.explode(_finder(texts, "v")("v")).alias("v")).join(texts, "v").select("id", "i", F.lit(False).alias("is_exact"))
    # Equal texts, and independent ones within reported ones.
    outer = texts.select("id", F.explode(_finder(right, "v")("v")).alias("v"), F.lit(False).alias("is_exact"))
    asked = outer.unionByName(texts.withColumn("is_exact", F.lit(True)))
    return inner.unionByName(asked.join(right, "v").select("id", "i", "is_exact"))


def _shared_lists(slots: DataFrame) -> DataFrame:
    """``id, g, _n``: texts whose lists of slots are equal share the smallest of their ids as ``g``; ``_n`` slots are listed.

    Lists are compared by length and by independent sums of hashes, so none is gathered.
    """
    h, low = F.xxhash64("i", "is_exact"), (1 << 32) - 1
    lists = slots.groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(h.bitwiseAND(low)).alias("_s"), F.sum(F.shiftrightunsigned(h, 32)).alias("_t"),
        F.bit_xor(F.xxhash64(h, F.lit(7))).alias("_x"),
    )
    same = ["_n", "_s", "_t", "_x"]
    return lists.join(lists.groupBy(*same).agg(F.min("id").alias("g")), same).select("id", "g", "_n")


def _ranked(df: DataFrame, order: list[Column], most: int, hot_rows: int) -> DataFrame:
    """Rows of each list by order, with ``rows_before``; ``most`` bounds a list's rows, so they need not be counted every round."""
    if most > hot_rows:
        return exclusive_prefix(df, ["g"], order, hot_rows=hot_rows)
    return df.withColumn("rows_before", F.row_number().over(Window.partitionBy("g").orderBy(*order)) - F.lit(1))


def _stable_pairs(left: DataFrame, right: DataFrame, hot_rows: int) -> DataFrame:
    """Rounds of proposals. Rows whose texts have equal lists of slots share a preference list, so the k-th
    free row goes straight to the k-th slot still open to that list: the slots it
    skips are held by earlier rows and would refuse it. However many rows and
    texts want the same slots, they are served in one round; only lists that
    overlap in part take turns. A slot whose holder comes before every row of a list
    is closed to it for good, since holders only get earlier, and leaves it; tables of a round that is over go."""
    spark = left.sparkSession
    # Fixed once, so the generated ids stay the same wherever they are read.
    texts = cut(left.select("v").distinct().withColumn("id", F.monotonically_increasing_id()))
    all_slots = cut(candidate_slots(texts, right))
    sweep(spark)
    shared = cut(_shared_lists(all_slots))
    free = cut(left.join(texts, "v").join(shared.select("id", "g"), "id").select("r", "g"))
    most_slots = shared.agg(F.max("_n")).first()[0] or 0
    most_rows = free.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    begin = free.groupBy("g").agg(F.min("r").alias("begin"))
    slots = cut(
        all_slots.join(shared.filter("id = g").select("id", "g"), "id").join(begin, "g")
        .select("g", "i", "is_exact", "begin", F.lit(None).cast(left.schema["r"].dataType).alias("holder"))
    )
    sweep(spark, all_slots, shared, texts)
    held: DataFrame | None = None
    while True:
        first = free.groupBy("g").agg(F.min("r").alias("first_free"), F.count(F.lit(1)).alias("rows"))
        open_slots = slots.join(first, "g").filter(F.col("holder").isNull() | (F.col("holder") > F.col("first_free")))
        listed = _ranked(open_slots.select("g", "i", "is_exact", "rows"), [F.desc("is_exact"), F.col("i")], most_slots, hot_rows)
        listed = listed.filter(F.col("rows_before") < F.col("rows")).select("g", "i", "rows_before")
        waiting = _ranked(free, [F.col("r")], most_rows, hot_rows)
        offers = cut(waiting.join(listed, ["g", "rows_before"]).select("i", "r", "g"))
        contest = offers if held is None else offers.unionByName(held)
        now = cut(contest.groupBy("i").agg(F.min_by(F.struct("r", "g"), F.col("r")).alias("w")).select("i", "w.r", "w.g"))
        # Refused and displaced rows try again; a row that found no slot is out for good.
        again = cut(contest.select("r", "g").distinct().join(now.select("r"), "r", "left_anti"))
        over = [offers, free, *([held] if held is not None else [])]
        free, held = again, now
        if free.isEmpty():
            sweep(spark, slots, free, *over)
            return held.select("r", "i")
        taken = held.select("i", F.col("r").alias("holder"))
        left_open = cut(
            slots.drop("holder").join(taken, "i", "left").filter(F.col("holder").isNull() | (F.col("holder") >= F.col("begin")))
            .select("g", "i", "is_exact", "begin", "holder")
        )
        over.append(slots)
        slots = left_open
        del first, open_slots, listed, waiting, offers, contest, now, again, taken, left_open
        sweep(spark, *over)


def unmatched(df: DataFrame, pairs: DataFrame, side: str, order: str = "seq") -> DataFrame:
    """Rows of one side ('reported' or 'independent') without a partner; blank texts are among them."""
    return df.join(pairs.select(F.col(f"{side}_seq").alias(order)), order, "left_anti")


def report(reported: DataFrame, independent: DataFrame, pairs: DataFrame, order: str = "seq") -> DataFrame:
    """Every row of both sides once, with all its columns, a status and the match key."""

    def prefixed(df: DataFrame, label: str, key: str) -> DataFrame:
        return df.select(F.col(order).alias(key), *[F.col(f"`{c}`").alias(f"{label}: {c}") for c in df.columns])

    r, i = prefixed(reported, "Reported", "reported_seq"), prefixed(independent, "Independent", "independent_seq")
    status: Column = (
        F.when(F.col("match_type") == "exact", "Matched").when(F.col("match_type") == "partial", "Partial match")
        .otherwise("In reported only")
    )
    left = (
        r.join(pairs, "reported_seq", "left").join(i, "independent_seq", "left")
        .withColumn("Status", status).withColumn("Match key", F.coalesce(F.col("match_key"), F.lit("")))
        .drop("reported_seq", "independent_seq", "match_key", "match_type")
    )
    right = (
        i.join(pairs.select("independent_seq"), "independent_seq", "left_anti")
        .withColumn("Status", F.lit("In independent only")).withColumn("Match key", F.lit(""))
        .drop("independent_seq")
    )
    return left.unionByName(right, allowMissingColumns=True)
