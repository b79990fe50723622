"""Hard negatives by coordinate pruning.

Rows lie on shelves of bounded size, by length and then by a hash. Within a
shelf, buckets hold rows of similar length; a bucket has one sorted list per
coordinate of its unit vectors. An anchor that wants scores of at least ``t``
needs, in a bucket whose longest row is ``l``, a cosine of at least
``t / (|anchor| l)``: a bucket in which that is above one is passed over, and
each focus coordinate of the anchor (its largest ones) leaves a range of
feasible values, a slice of the sorted list. The slices are intersected; what is left
is scored exactly, in integers.

The positives of an anchor come first, then the negatives within the windows
that the positives' scores set. A bounded sample of rows tells beforehand how
large a score has to be at least, so that shelves and buckets are passed over from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.llm.common import lowest
from tallyweave.session import settle

LEAST, MOST = -(2**63) + 1, 2**63 - 1
#: What rounding may do to a cosine.
SLACK = 1e-9
DEALT = "shelf int, asks boolean, row long, id long, label long, v array<long>, norm double, low array<long>, high array<long>"
FOUND = "anchor long, want int, score long, id long, row long"


@dataclass(frozen=True)
class Mining:
    """``low`` and ``high``: per cent of the positive's score between which a negative's lies. ``sample``: rows that the driver holds."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    shelf: int = 8192
    bucket: int = 1024
    focus: int = 4
    bands: int = 64
    sample: int = 4096


class Shelf:
    """Rows in memory, cut into buckets by length."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, v: np.ndarray, s: Mining):
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((row, -norm))
        self.s, self.row, self.ids, self.label, self.v, norm = s, row[order], ids[order], label[order], v[order], norm[order]
        self.most = int(np.abs(self.v).max(initial=0))
        self.exact = self.v.astype(np.float64)
        self.buckets = []
        for a in range(0, len(norm), s.bucket):
            b = min(a + s.bucket, len(norm))
            unit = self.exact[a:b] / np.maximum(norm[a:b], 1e-300)[:, None]
            lists = np.argsort(unit, axis=0, kind="stable").astype(np.int32)
            self.buckets.append((a, b, norm[a], norm[b - 1], unit, lists.T.copy(), np.take_along_axis(unit, lists, axis=0).T.copy()))

    def candidates(self, bucket: tuple, unit: np.ndarray, focus: np.ndarray, least: float) -> np.ndarray | None:
        """Places in the shelf whose rows can reach ``least``, a score divided by the anchor's length; None for all of the bucket."""
        a, b, longest, shortest, units, lists, values = bucket
        reach = longest if least > 0 else shortest
        t = (least / reach if reach > 0 else (np.inf if least > 0 else -np.inf)) - SLACK
        if t > 1:
            return np.empty(0, dtype=np.int64)
        if t <= -1:
            return None
        own, most = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(t)
        low, high = np.cos(np.minimum(np.pi, own + most)) - SLACK, np.cos(np.maximum(0, own - most)) + SLACK
        cuts = [(np.searchsorted(values[f], x), np.searchsorted(values[f], y, "right")) for f, x, y in zip(focus, low, high, strict=True)]
        sizes = [y - x for x, y in cuts]
        k = int(np.argmin(sizes))
        if sizes[k] == b - a:
            return None
        rest = lists[focus[k]][cuts[k][0] : cuts[k][1]]
        for j in np.argsort(sizes)[1:]:
            if sizes[j] == b - a or not len(rest):
                break
            value = units[rest, focus[j]]
            rest = rest[(value >= low[j]) & (value <= high[j])]
        return rest.astype(np.int64) + a

    def scores(self, places: np.ndarray | slice, v: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles as long as no sum can leave their whole numbers."""
        if self.most * int(np.abs(v).max(initial=0)) * max(len(v), 1) < 2**53:
            return (self.exact[places] @ v.astype(np.float64)).astype(np.int64)
        return self.v[places] @ v

    def best(self, row: int, label: int, v: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> list[tuple[int, int, int, int]]:
        """``want, score, id, row``: for each window of scores the first ``k`` rows of the same or of other labels."""
        low = [int(x) for x in low]
        norm = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
        unit = v / max(norm, 1e-300)
        focus = np.argsort(-np.abs(unit), kind="stable")[: self.s.focus]
        found: list[list[tuple[int, int, int]]] = [[] for _ in low]
        for bucket in self.buckets:
            least = min(low)
            at = self.candidates(bucket, unit, focus, least / norm) if norm > 0 else None
            places = slice(bucket[0], bucket[1]) if at is None else at
            if at is not None and not len(at):
                continue
            s = self.scores(places, v)
            right = (self.label[places] == label) == same
            right &= s >= least
            if same:
                right &= self.row[places] != row
            if not right.any():
                continue
            s, ids, rows = s[right], self.ids[places][right], self.row[places][right]
            for w in range(len(low)):
                fits = np.flatnonzero((s >= low[w]) & (s <= high[w]))
                if len(fits):
                    fits = fits[np.lexsort((rows[fits], ids[fits], -s[fits]))[:k]]
                    found[w] = sorted(found[w] + list(zip((-s[fits]).tolist(), ids[fits].tolist(), rows[fits].tolist(), strict=True)))[:k]
                    if len(found[w]) == k:
                        low[w] = max(low[w], -found[w][-1][0])
        return [(w, -x, i, r) for w, rows in enumerate(found) for x, i, r in rows]


def _stack(vs: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.int64) for x in vs])


def _shelf(f: pd.DataFrame, s: Mining) -> Shelf:
    return Shelf(f["row"].to_numpy(np.int64), f["id"].to_numpy(np.int64), f["label"].to_numpy(np.int64), _stack(f["v"]), s)


def _asked(shelf: Shelf, asks: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    out = [
        (row, *hit)
        for row, label, v, low, high in zip(asks["row"], asks["label"], asks["v"], asks["low"], asks["high"], strict=True)
        for hit in shelf.best(row, label, np.asarray(v, dtype=np.int64), low, high, k, same)
    ]
    return pd.DataFrame(out, columns=["anchor", "want", "score", "id", "row"]).astype({"anchor": "int64", "want": "int32", "score": "int64", "id": "int64", "row": "int64"})


def _scan(s: Mining, k: int, same: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over a partition sorted by shelf, its rows before the anchors: the shelf is held, anchors stream by."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, shelf = None, [], None
        for f in frames:
            for key, g in f.groupby("shelf", sort=True):
                if key != now:
                    now, held, shelf = key, [], None
                rows, asks = g[~g["asks"]], g[g["asks"]]
                if len(rows):
                    held.append(rows)
                if len(asks) and held:
                    shelf, held = _shelf(pd.concat(held), s), []
                if len(asks) and shelf is not None:
                    yield _asked(shelf, asks, k, same)

    return run


def _valid(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()), F.lit(False))


def mine(
    rows: DataFrame, *, anchors: Column | None = None, row_id: str = "vec_id", label: str = "label", vector: str = "vector", settings: Mining = Mining()
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vector``: an array of whole numbers, whose inner products fit a long.
    ``anchors``: a condition on ``rows`` (default: ids divisible by 100). Of an
    anchor, the positives are the first rows of its label, itself apart; for
    each, the negatives are the first rows of other labels with
    ``low * positive <= 100 * negative <= high * positive``. Larger scores come
    first, ties by smaller id.

    Rows with a null id, label, vector or component, an empty vector, or one of
    another length than most rows have (the shorter of equally frequent lengths)
    take no part. Zero vectors do. Rows with equal ids are rows of their own,
    each an anchor, positive or negative; an anchor is only no partner of the very row it is. Other columns
    are ignored. A positive without negatives, and an empty table, give no rows.
    """
    s, spark = settings, rows.sparkSession
    asks = F.col(f"`{row_id}`") % 100 == 0 if anchors is None else anchors
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    v = F.col(f"`{vector}`")
    base = rows.filter(_valid(v) & F.col(f"`{row_id}`").isNotNull() & F.col(f"`{label}`").isNotNull()).select(
        F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
        F.transform(v, lambda x: x.cast("long")).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"),
    )
    dims = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return spark.createDataFrame([], out_schema)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # Numbered as written, so every later reading sees the same numbers.
    base = settle(base.filter(F.size("v") == dims.n).withColumns({"norm": norm, "row": F.monotonically_increasing_id()}))
    total = base.count()
    bands = min(s.bands, -(-total // s.shelf))
    cuts = sorted(set(base.agg(F.percentile_approx("norm", [k / bands for k in range(1, bands)])).first()[0])) if bands > 1 else []
    band = F.lit(0)
    for c in cuts:
        band = band + (F.col("norm") > F.lit(c)).cast("int")
    # At most ``bands`` rows: how many shelves each band of lengths has, and from which on.
    sizes = {r.band: (r["count"], r.most) for r in base.groupBy(band.alias("band")).agg(F.count("*").alias("count"), F.max("norm").alias("most")).collect()}
    spans, first = [], 0
    for k in range(len(cuts) + 1):
        n, longest = sizes.get(k, (0, 0.0))
        parts = max(1, -(-n // s.shelf))
        spans.append((first, parts, longest))
        first += parts
    of_band = lambda x: F.get(F.array(*[F.lit(span[x]) for span in spans]), band)
    shelved = base.select(
        (of_band(0) + F.pmod(F.xxhash64("row"), of_band(1))).cast("int").alias("shelf"), F.lit(False).alias("asks"), "row", "id", "label", "v", "norm",
        F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high"),
    )
    listed = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(n).alias("n"), F.lit(x).alias("longest")) for a, n, x in spans])

    def deal(wants: DataFrame) -> DataFrame:
        """Shelves with the anchors that may find something on them."""
        least = F.array_min("low").cast("double")
        reach = F.filter(listed, lambda b: (least <= 0) | (least <= F.col("norm") * b["longest"] * (1 + SLACK)))
        copies = wants.withColumn("b", F.explode(reach)).select(
            F.explode(F.sequence(F.col("b.first"), (F.col("b.first") + F.col("b.n") - 1).cast("int"))).alias("shelf"), F.lit(True).alias("asks"),
            "row", "id", "label", "v", "norm", "low", "high",
        )
        return shelved.unionByName(copies).repartition("shelf").sortWithinPartitions("shelf", "asks")

    def first_of(found: DataFrame, k: int) -> DataFrame:
        by = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), "id", "row")
        return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

    h = F.xxhash64("row")
    taken = lowest(base, h, s.sample, total).orderBy(h, "row").limit(s.sample).select("row", "id", "label", "v").toPandas()
    shared = spark.sparkContext.broadcast(taken)

    def sampled(k: int, same: bool):
        """The windows, narrowed by the ``k``-th best row that the sample has to offer."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shelf = _shelf(shared.value, s)
            for f in frames:
                f = f.copy()
                lows = []
                for row, label, x, low, high in zip(f["row"], f["label"], f["v"], f["low"], f["high"], strict=True):
                    low = [int(y) for y in low]
                    hits = shelf.best(row, label, np.asarray(x, dtype=np.int64), low, high, k, same)
                    for w in range(len(low)):
                        mine = [score for want, score, _, _ in hits if want == w]
                        low[w] = max(low[w], mine[k - 1]) if len(mine) >= k else low[w]
                    lows.append(low)
                f["low"] = lows
                yield f

        return run

    own = base.filter("asks").select("row", "id", "label", "v", "norm")
    ask_schema = "row long, id long, label long, v array<long>, norm double, low array<long>, high array<long>"
    asked = own.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    near = deal(asked.mapInPandas(sampled(s.positives, True), ask_schema)).mapInPandas(_scan(s, s.positives, True), FOUND)
    positives = settle(first_of(near, s.positives).select("anchor", "rank", "score", F.col("id").alias("positive_id")))

    # Whole numbers all the way; below zero there is no room between 80 and 100 per cent of a score.
    up = f"({s.low} * big) div 100 + if(({s.low} * big) % 100 > 0, 1, 0)"
    down = f"({s.high} * big) div 100 - if(({s.high} * big) % 100 < 0, 1, 0)"
    bounds = positives.withColumn("big", F.col("score").cast("decimal(20,0)")).withColumns({"low": F.expr(up), "high": F.expr(down)}).filter("low <= high")
    windows = bounds.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high", "positive_id", "score"))).alias("w"))
    windows = windows.select(F.col("anchor").alias("row"), F.col("w.low").alias("low"), F.col("w.high").alias("high"), "w")
    wants = settle(own.join(windows, "row"))
    far = deal(wants.drop("w").mapInPandas(sampled(s.negatives, False), ask_schema)).mapInPandas(_scan(s, s.negatives, False), FOUND)
    chosen = first_of(far, s.negatives).select(F.col("anchor").alias("row"), "want", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(wants.select("row", F.col("id").alias("anchor_id"), "w"), "row").select(
        "anchor_id", F.get("w", F.col("want"))["positive_id"].alias("positive_id"), "rank", "negative_id",
        F.get("w", F.col("want"))["score"].alias("positive_score"), "negative_score",
    )


def whole(rows: DataFrame, *, vector: str = "embedding", factor: int = 256, into: str = "vector") -> DataFrame:
    """``rows`` with ``into``: each component times ``factor``, rounded down; null where a component is null or not finite."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.withColumn(into, F.when(finite, F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(factor))))))


def oracle(embeddings: str = "embeddings", s: Mining = Mining()) -> str:
    """``op11`` in DuckDB's SQL, by all pairs of anchors and rows."""
    return f"""
WITH b AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM {embeddings}
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM b a JOIN b r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {s.positives}
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN pairs USING (anchor_id)
WHERE NOT same AND {s.low} * positive_score <= 100 * score AND 100 * score <= {s.high} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {s.negatives}
""".strip()
