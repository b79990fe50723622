"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). Each cell's tokens are
weighted by a factor per source, per language and per topic; in turn the factors
of one margin are set so that its weighted tokens meet their targets. The fitted
weights are then scaled to inclusion probabilities that keep a given share of
all tokens, no probability over one, and documents are drawn by a hash of their
id. All of it is DataFrame operations; only scalars come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import WORD
from tallyweave.session import settle

#: Topics by the first pattern that a text holds; what has none is prose.
TOPICS = (
    ("licensing", "[Ll]icen[cs]e"),
    ("credentials", "AKIA|password|token = "),
    ("contact", "[A-Za-z0-9]@[A-Za-z0-9]"),
    ("markup", r"[#$%&*]{3}"),
    ("tabular", r" \| "),
)
MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    """``targets``: shares by margin and value; they need not sum to one. A margin without targets,
    and values that are not listed, aim at their token share to the power ``temperature``."""

    targets: tuple[tuple[str, str, float], ...] = ()
    temperature: float = 0.7
    cycles: int = 10
    keep_share: float = 0.5
    seed: str = "mix-7"
    cells_broadcast: int = 100_000


def topic_of(text: Column, topics=TOPICS) -> Column:
    out = F
    for name, pattern in topics:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone; null ids share one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _targets(cells: DataFrame, margin: str, mix: Mix) -> DataFrame:
    """``margin, share``: what the weighted tokens of each value are to be, in shares of one."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    goal = F.pow("t", F.lit(mix.temperature))
    for m, value, share in mix.targets:
        if m == margin:
            goal = F.when(F.col(margin) == value, F.lit(share)).otherwise(goal)
    own = settle(own.select(margin, goal.alias("goal")))
    total = own.agg(F.sum("goal")).first()[0]
    return own.select(margin, (F.col("goal") / F.lit(total or 1.0)).alias("share"))


def fit(cells: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``cells`` (source, lang, topic, tokens > 0) with ``weight``: fitted by given share of tokens.

    Every cell carries its three factors. A cycle is one plan, written once: per
    margin a sum over its values, joined back by a merge join, which Spark
    splits where one value has many cells; nothing is broadcast.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    # Nulls are values of their own; joins are on the value's place in a struct, which is never null.
    cells = cells.select("*", *[F.struct(F.col(m)).alias(f"k_{m}") for m in MARGINS], *[F.lit(1.0).alias(f"f_{m}") for m in MARGINS])
    for m in MARGINS:
        share = _targets(cells, m, mix).select(F.struct(m).alias(f"k_{m}"), F.col("share").alias(f"s_{m}"))
        cells = cells.join(share.hint("merge"), f"k_{m}")
    cells = settle(cells)
    order = cells.columns
    for _ in range(mix.cycles):
        for m in MARGINS:
            others = [x for x in MARGINS if x != m]
            product = F.col("tokens") * F.col(f"f_{others[0]}") * F.col(f"f_{others[1]}")
            got = cells.groupBy(f"k_{m}").agg(F.sum(product).alias("got"))
            factor = F.col(f"s_{m}") * F.lit(total) / F.col("got")
            cells = cells.join(got.hint("merge"), f"k_{m}").withColumn(f"f_{m}", factor).select(*order)
        cells = settle(cells)
    return cells.select(*MARGINS, "tokens", (F.col("f_source") * F.col("f_lang") * F.col("f_topic")).alias("weight"))


def margins(docs: DataFrame, *, source: str = "source", lang: str = "lang", mix: Mix = Mix(), into: str = "mix") -> DataFrame:
    """``margin, value, share, weighted, expected`` of the result of :func:`mix_documents`.

    ``share`` is the target; ``weighted`` the share of the weighted tokens, ``expected`` that of the
    tokens which the sample is expected to hold. Targets that no weights can meet show as a
    ``weighted`` apart from ``share``; a cap at one moves ``expected``.
    """
    m = F.col(f"`{into}`")
    named = docs.filter(m["n_tokens"] > 0).select(
        F.col(f"`{source}`").alias("source"), F.col(f"`{lang}`").alias("lang"), m["topic"].alias("topic"), m["n_tokens"].cast("double").alias("tokens"),
        (m["n_tokens"] * m["weight"]).alias("w"), (m["n_tokens"] * m["probability"]).alias("e"),
    )
    cells = settle(named.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.sum("w").alias("w"), F.sum("e").alias("e")))
    w, e = cells.agg(F.sum("w"), F.sum("e")).first()
    out = None
    for name in MARGINS:
        share = _targets(cells, name, mix).select(F.struct(name).alias("k"), "share")
        own = cells.groupBy(F.struct(name).alias("k")).agg((F.sum("w") / F.lit(w or 1.0)).alias("weighted"), (F.sum("e") / F.lit(e or 1.0)).alias("expected"))
        one = share.join(own.hint("merge"), "k").select(F.lit(name).alias("margin"), F.col("k")[name].alias("value"), "share", "weighted", "expected")
        out = one if out is None else out.unionByName(one)
    return out


def calibrate(cells: DataFrame, keep_share: float) -> DataFrame:
    """``cells`` with ``probability``: proportional to the weight, at most one, keeping the share of tokens.

    Cells that would pass one are kept whole and leave the rest of the budget to the others.
    """
    cells = settle(cells)
    all_tokens = cells.agg(F.sum("tokens")).first()[0] or 0.0
    scale, bound = 0.0, float("inf")
    while True:
        # Cells with a weight of at least ``bound`` are whole.
        whole = F.col("weight") >= F.lit(bound)
        r = cells.agg(
            F.sum(F.when(whole, F.col("tokens")).otherwise(0.0)).alias("kept"),
            F.sum(F.when(whole, 0.0).otherwise(F.col("tokens") * F.col("weight"))).alias("rest"),
        ).first()
        if not r.rest:
            break
        scale = max(0.0, keep_share * all_tokens - r.kept) / r.rest
        if scale <= 0 or 1.0 / scale >= bound:
            break
        bound = 1.0 / scale
        if not cells.filter(F.col("weight") >= F.lit(bound)).limit(1).count():
            break
    p = F.when(F.col("weight") >= F.lit(bound), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))
    return cells.withColumn("probability", p)


def mix_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", mix: Mix = Mix(), topics=TOPICS,
    into: str = "mix",
) -> DataFrame:
    """``docs`` with ``into``: a struct of topic, n_tokens, weight, probability and sampled.

    Weights and probabilities have six decimals. Null sources and languages are
    values of their own. Texts without words (null, empty, blank) carry no
    tokens: their weight and probability are 0. Rows with equal ids share one
    draw. A column named ``into`` is replaced.
    """
    t = F.col(f"`{text}`")
    tokens = F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long")
    keys = {"__k0": F.col(f"`{source}`"), "__k1": F.col(f"`{lang}`"), "__k2": topic_of(F.coalesce(t, F.lit("")), topics), "__n": tokens}
    keyed = docs.withColumns(keys)
    cells = settle(
        keyed.filter("__n > 0").groupBy(F.col("__k0").alias("source"), F.col("__k1").alias("lang"), F.col("__k2").alias("topic"))
        .agg(F.sum("__n").cast("double").alias("tokens"))
    )
    fitted = settle(calibrate(fit(cells, mix), mix.keep_share).select(
        F.struct(F.col("source").alias("__k0"), F.col("lang").alias("__k1"), F.col("topic").alias("__k2")).alias("__cell"),
        F.round("weight", 6).alias("__w"), F.round("probability", 6).alias("__p"),
    ))
    if fitted.count() <= mix.cells_broadcast:
        fitted = F.broadcast(fitted)
    joined = keyed.withColumn("__cell", F.struct("__k0", "__k1", "__k2")).join(fitted, "__cell", "left")
    w, p = (F.when(F.col("__n") > 0, F.col(c)).otherwise(0.0) for c in ("__w", "__p"))
    result = F.struct(
        F.col("__k2").alias("topic"), F.col("__n").alias("n_tokens"), w.alias("weight"), p.alias("probability"),
        (draw(F.col(f"`{doc_id}`"), mix.seed) < p).alias("sampled"),
    )
    return joined.withColumn(into, result).drop("__k0", "__k1", "__k2", "__n", "__cell", "__w", "__p")


def sample(docs: DataFrame, *, mix: Mix = Mix(), **columns: str) -> DataFrame:
    """The sampled rows with their own columns."""
    mark = "__mix"
    return mix_documents(docs, mix=mix, into=mark, **columns).filter(F.col(mark)["sampled"]).drop(mark)


def oracle(mix: Mix = Mix(), topics=TOPICS, documents: str = "documents") -> str:
    """The same result in DuckDB's SQL: one window per margin and cycle."""
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in topics)
    ctes = [
        f"d AS (SELECT doc_id, source, lang, CASE {topic} ELSE 'prose' END AS topic, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens FROM {documents})",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL)",
        "total AS (SELECT sum(tokens) AS total FROM c)",
    ]
    for m in MARGINS:
        listed = " ".join(f"WHEN {m} = '{v}' THEN {s}" for x, v, s in mix.targets if x == m)
        goal = f"pow(sum(tokens), {mix.temperature})"
        goal = f"CASE {listed} ELSE {goal} END" if listed else goal
        ctes.append(f"g_{m} AS (SELECT {m}, {goal} AS goal FROM c GROUP BY {m})")
        ctes.append(f"t_{m} AS (SELECT {m}, goal / (SELECT sum(goal) FROM g_{m}) AS share FROM g_{m})")
    joins = " ".join(f"JOIN t_{m} ON c.{m} IS NOT DISTINCT FROM t_{m}.{m}" for m in MARGINS)
    shares = ", ".join(f"t_{m}.share AS s_{m}" for m in MARGINS)
    ctes.append(f"w0 AS MATERIALIZED (SELECT c.*, {shares}, tokens AS w FROM c {joins})")
    k = 0
    for _ in range(mix.cycles):
        for m in MARGINS:
            ctes.append(
                f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * s_{m} * (SELECT total FROM total) / sum(w) OVER (PARTITION BY {m}) AS w) FROM w{k})"
            )
            k += 1
    # Largest weights first: the first cell that need not be cut at one sets the scale.
    ctes += [
        f"f AS (SELECT source, lang, topic, tokens, w / tokens AS weight FROM w{k})",
        "o AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY weight DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(tokens) OVER (PARTITION BY weight) AS before, "
        "sum(tokens * weight) OVER (ORDER BY weight RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rest FROM f)",
        f"s AS (SELECT max_by(({mix.keep_share} * (SELECT total FROM total) - before) / rest, weight) AS scale "
        f"FROM o WHERE ({mix.keep_share} * (SELECT total FROM total) - before) / rest * weight < 1)",
        "p AS (SELECT source, lang, topic, round(weight, 6) AS weight, round(least(1.0, weight * (SELECT scale FROM s)), 6) AS probability FROM f)",
    ]
    u = f"(('0x' || substr(md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0)"
    same = " AND ".join(f"d.{m} IS NOT DISTINCT FROM p.{m}" for m in MARGINS)
    prob = "CASE WHEN n_tokens > 0 THEN probability ELSE 0.0 END"
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, d.source, d.lang, d.topic, n_tokens, CASE WHEN n_tokens > 0 THEN weight ELSE 0.0 END AS weight, "
        f"{prob} AS probability, {u} < {prob} AS sampled FROM d LEFT JOIN p ON {same}"
    )
