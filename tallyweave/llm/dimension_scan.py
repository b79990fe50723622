"""Nearest neighbours by inner product with an adaptive dimension scan.

The index is a set of lists around centroids. Largest inner product becomes
nearest neighbour by one more coordinate that brings all rows to one norm. All
vectors are rotated at random, so a few leading columns of a difference tell its
length up to a known error. In each probed list, distances grow by blocks of
columns; a candidate is abandoned as soon as a hypothesis test on its partial
distance says it lies beyond the query's best so far. What survives all columns
is scored on the original vectors in double precision.

Centroids, rotation and the number of lists to probe are fitted on a bounded
sample; every row is indexed. Lists are cut into parts and their queries into
blocks, so a list of any size, of one repeated vector too, is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallyweave.llm.common import lowest, whole_groups
from tallyweave.session import settle

CELL = ["list", "part", "block"]


@dataclass(frozen=True)
class Settings:
    """``sample`` rows fit the index, ``max_lists`` bounds it. ``recall`` is what probing must reach on the sample.
    ``bound_rows`` of it give each query its first bound; one probe in ``head``
    goes first and gives a closer one.

    ``epsilon``: how sure a test must be; a candidate goes if its scaled partial
    distance exceeds the bound (1 + epsilon / sqrt(columns)) times.
    """

    k: int = 20
    sample: int = 20_000
    max_lists: int = 4096
    recall: float = 0.96
    bound_rows: int = 1024
    trial_queries: int = 256
    head: int = 8
    columns: int = 16
    epsilon: float = 2.1
    part: int = 4096
    chunk: int = 512
    seed: int = 5


@dataclass(frozen=True)
class Index:
    """What tasks need: bounded by ``max_lists``, ``bound_rows`` and the dimension."""

    rotation: np.ndarray
    centroids: np.ndarray
    norm: float
    probe: int
    sample: np.ndarray
    sample_ids: np.ndarray


def valid(vector: str):
    """True for vectors that take part: no null or non-finite component, not empty, not zero."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with one more coordinate, all of length ``norm``: the nearest have the largest inner products."""
    rest = np.maximum(norm**2 - (x**2).sum(axis=1), 0)
    return np.column_stack([x, np.sqrt(rest)])


def lift_query(q: np.ndarray) -> np.ndarray:
    return np.column_stack([q, np.zeros(len(q))])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0)


def fit_index(ids: np.ndarray, x: np.ndarray, rows: int, norm: float, s: Settings) -> Index:
    """Fit on sampled rows ``x`` of a table of ``rows``."""
    rng = np.random.default_rng(s.seed)
    up = lift(x, norm)
    lists = int(min(max(1, round(rows**0.5)), s.max_lists, len(x)))
    c = up[rng.choice(len(up), lists, replace=False)].copy()
    for _ in range(8):
        near = np.concatenate([_squared(up[i : i + 4096], c).argmin(axis=1) for i in range(0, len(up), 4096)])
        size = np.bincount(near, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, near, up)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    near = np.concatenate([_squared(up[i : i + 4096], c).argmin(axis=1) for i in range(0, len(up), 4096)])
    # The fewest probes that find the sample's own neighbours often enough.
    pick = rng.choice(len(x), min(s.trial_queries, len(x)), replace=False)
    score = x[pick] @ x.T
    score[np.arange(len(pick)), pick] = -np.inf
    k = min(s.k, len(x) - 1)
    best = np.argsort(-score, axis=1)[:, :k]
    order = np.argsort(_squared(lift_query(x[pick]), c), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None].repeat(len(pick), axis=0), axis=1)
    need = place[np.arange(len(pick))[:, None], near[best]]
    probe = int(np.quantile(need, s.recall)) + 1 if need.size else lists
    rotation = np.linalg.qr(rng.standard_normal((up.shape[1], up.shape[1])))[0]
    return Index(rotation, c, norm, min(lists, probe), x[: s.bound_rows], ids[: s.bound_rows])


def _probes(index: Index, sizes: np.ndarray, s: Settings, ids: np.ndarray, q: np.ndarray) -> list[tuple]:
    """For each query: the lists to probe, its best rows of the sample with their scores, and the bound
    on its k-th squared distance that these prove."""
    order = np.argsort(_squared(lift_query(q), index.centroids), axis=1, kind="stable")
    enough = np.cumsum(sizes[order], axis=1) > s.k
    least = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, order.shape[1])
    out = []
    for i in range(0, len(q), 256):
        some = q[i : i + 256]
        rough = some @ index.sample.T
        rough[ids[i : i + 256, None] == index.sample_ids] = -np.inf
        best = np.argpartition(-rough, min(s.k, rough.shape[1]) - 1, axis=1)[:, : s.k]
        for j, near in enumerate(best):
            near = near[np.isfinite(rough[j, near])]
            # Scores are summed in one way everywhere, so equal vectors have equal scores.
            score = np.einsum("nd,nd->n", np.broadcast_to(some[j], (len(near), q.shape[1])), index.sample[near])
            bound = max((some[j] ** 2).sum() + index.norm**2 - 2 * score.min(), 0) if len(near) == s.k else np.inf
            n = max(index.probe, least[i + j])
            out.append((order[i + j, :n].astype("int32"), bound, index.sample_ids[near], score))
    return out


def scan(q, q_ids, bound, x, x_ids, index: Index, s: Settings) -> list[tuple[int, int, float]]:
    """(query, row, score) of up to ``k`` rows for each query of one cell; queries and rows in their original form."""
    qr, xr = lift_query(q) @ index.rotation, lift(x, index.norm) @ index.rotation
    dims = qr.shape[1]
    ends = [*range(s.columns, dims, s.columns), dims]
    slack = 1 + 1e-9
    bound = bound * slack + 1e-9 * index.norm**2
    best_score = np.full((len(q), s.k), -np.inf)
    best_id = np.full((len(q), s.k), np.iinfo(np.int64).max)
    q2, whole = (q**2).sum(axis=1), index.norm**2
    for i in range(0, len(x), s.chunk):
        part, ids = xr[i : i + s.chunk], x_ids[i : i + s.chunk]
        # The first block of columns for all pairs at once, later ones for what is left.
        so_far = _squared(qr[:, : ends[0]], part[:, : ends[0]])
        limit = bound * (1 + s.epsilon / ends[0] ** 0.5) ** 2 if dims > ends[0] else bound
        a, b = np.nonzero((so_far * (dims / ends[0]) <= limit[:, None]) & (q_ids[:, None] != ids))
        d = so_far[a, b]
        for start, end in zip(ends[:-1], ends[1:]):
            d = d + ((qr[a, start:end] - part[b, start:end]) ** 2).sum(axis=1)
            limit = bound * (1 + s.epsilon / end**0.5) ** 2 if end < dims else bound
            stay = d * (dims / end) <= limit[a]
            a, b, d = a[stay], b[stay], d[stay]
        if not len(a):
            continue
        score = np.einsum("nd,nd->n", q[a], x[i + b])
        for query in np.unique(a):
            mine = a == query if len(q) < 4 else slice(*np.searchsorted(a, [query, query + 1]))
            all_score = np.concatenate([best_score[query], score[mine]])
            all_id = np.concatenate([best_id[query], ids[b[mine]]])
            top = np.lexsort((all_id, -all_score))[: s.k]
            best_score[query], best_id[query] = all_score[top], all_id[top]
            kth = best_score[query, -1]
            if np.isfinite(kth):
                bound[query] = min(bound[query], max(q2[query] + whole - 2 * kth, 0) * slack + 1e-9 * whole)
    at, rank = np.nonzero(np.isfinite(best_score))
    return [(int(q_ids[i]), int(best_id[i, r]), float(best_score[i, r])) for i, r in zip(at, rank)]


def search(
    rows: DataFrame, *, queries=None, row_id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each query.

    ``queries``: a condition on ``rows`` (default: ids divisible by 20). A query's
    own id is no candidate. Rows with a null id, and vectors that are null, empty,
    zero, of another dimension than most, or hold null or non-finite components
    take no part. Of a repeated id the smallest vector counts. Ties go to the smaller id. An empty table gives no rows.
    """
    s, spark = settings, rows.sparkSession
    base = rows.filter(valid(vector) & F.col(f"`{row_id}`").isNotNull()).select(
        F.col(f"`{row_id}`").cast("long").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("v")
    )
    schema = "query_id long, rank int, vec_id long, score double"
    dims = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    base = settle(base.filter(F.size("v") == dims.n).groupBy("id").agg(F.min("v").alias("v")))
    norm = base.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    rows_in_all = base.count()
    taken = lowest(base, F.xxhash64("id"), s.sample, rows_in_all).orderBy(F.xxhash64("id"), "id").limit(s.sample).collect()
    index = fit_index(np.array([r.id for r in taken]), np.array([r.v for r in taken]), rows_in_all, norm, s)
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def nearest_list(vs: pd.Series) -> pd.Series:
        if not len(vs):
            return pd.Series([], dtype="int32")
        return pd.Series(_squared(lift(np.stack(vs), shared.value.norm), shared.value.centroids).argmin(axis=1).astype("int32"))

    placed = settle(base.withColumn("list", nearest_list("v")))
    counted = placed.groupBy("list").count().collect()  # one row for each of at most max_lists lists
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for r in counted:
        sizes[r.list] = r["count"]

    asks = F.col("id") % 20 == 0 if queries is None else queries

    @F.pandas_udf("struct<lists: array<int>, bound: double, ids: array<long>, scores: array<double>>")
    def probes(ids: pd.Series, vs: pd.Series) -> pd.DataFrame:
        rows = _probes(shared.value, sizes, s, ids.to_numpy(), np.stack(vs)) if len(vs) else []
        return pd.DataFrame(rows, columns=["lists", "bound", "ids", "scores"])

    own = settle(placed.filter(asks).select("id", "v", probes("id", "v").alias("p")))
    asked = own.select("id", "v", F.posexplode("p.lists").alias("near", "list"), "p.bound")
    known = own.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("p.ids", "p.scores")).alias("z")).select("query_id", F.col("z.ids").alias("vec_id"), F.col("z.scores").alias("score"))

    def scanned(asked: DataFrame) -> DataFrame:
        """Up to ``k`` rows for each query and cell."""
        load = {r.list: r["count"] for r in asked.groupBy("list").count().collect()}
        shape = spark.createDataFrame(
            [(k, -(-int(n) // s.part), -(-load.get(k, 0) // s.part)) for k, n in enumerate(sizes) if n and load.get(k, 0)], "list int, parts int, blocks int"
        )
        lists = F.broadcast(shape)
        # Rows of a list are dealt to parts, its queries to blocks; a cell is one part with one block.
        left = placed.join(lists, "list").select(
            "list", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("bound"),
        )
        right = asked.join(lists, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"),
            F.lit(True).alias("asks"), "id", "v", "bound",
        )
        cells = left.unionByName(right).repartition(*CELL).sortWithinPartitions(*CELL)
        return cells.mapInPandas(run, "query_id long, vec_id long, score double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, CELL):
            out = []
            for _, g in f.groupby(CELL, sort=False):
                q, x = g[g["asks"]], g[~g["asks"]]
                if len(q) and len(x):
                    out += scan(np.stack(q["v"]), q["id"].to_numpy(), q["bound"].to_numpy(), np.stack(x["v"]), x["id"].to_numpy(), shared.value, s)
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    # The nearest lists go first: the k-th best of what they hold bounds what the others may add.
    head = max(1, index.probe // s.head)
    early = settle(scanned(asked.filter(F.col("near") < head)).unionByName(known))
    one = early.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = one.withColumn("at", at).filter(F.col("at") == s.k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    tight = F.greatest(length + F.lit(norm**2) - 2 * F.col("kth"), F.lit(0.0))
    later = asked.filter(F.col("near") >= head).join(kth, "id", "left").withColumn("bound", F.least("bound", F.coalesce(tight, F.col("bound")))).drop("kth")
    found = early.unionByName(scanned(settle(later)))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
