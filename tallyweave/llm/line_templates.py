"""Line dedup with a tree of line templates.

As in log parsing, a line goes down a tree of fixed depth: by its token count,
then by its leading tokens, a token with a digit counting as variable. In a leaf
the further tokens are generalised: a token that enough lines of the leaf have in
that place stays, any other becomes ``<*>``. A line whose constant part is too
small keeps its own text as template. Templates found in ``min_texts`` different
texts or more are dropped, save where they come first. The longer a line, the less
it recurs by chance: one of ``long_tokens`` constant words or more is dropped from
``long_texts`` texts on, as it stands; one of one or two words only if very many
texts hold it, and never if it has a digit or no letter, as a brace of code.

All steps are counts over (leaf), (leaf, place, token) and (template), which are
combined before they are shuffled, so a line that a third of all documents share
is one row per task. Lines of leaves with fewer rows than their limit cannot
recur and never leave the scan: a bitmap of fixed size tells them, and a join
on the leaf makes up for its false alarms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import as_text, bitmap as bitmap_of, row_key, signed, text_key
from tallyweave.session import settle

VARIABLE = b"<*>"
_NO_DIGITS = bytes(range(48, 58))
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


@dataclass(frozen=True)
class Tree:
    """``leading`` tokens lead to a leaf; lines of fewer than ``min_tokens`` words are short.

    Short lines recur from ``short_texts`` texts on, and at least the share ``short_share`` of the rows.

    ``bits``: the bitmap of leaves has 2 ** bits bits, which is all that is sent to tasks.
    """

    leading: int = 3
    min_tokens: int = 3
    min_texts: int = 10
    long_tokens: int = 20
    long_texts: int = 3
    short_texts: int = 100
    short_share: float = 0.01
    constant_share: float = 0.6
    keep_first: bool = True
    bits: int = 25


def masked_lines(text: str | None, tree: Tree) -> Iterator[tuple[int, list[bytes], int]]:
    """Line number, masked tokens and leaf of each line that can recur."""
    if not text:
        return
    raw = text.encode("utf-8", "surrogatepass")
    digits = len(raw) != len(raw.translate(None, _NO_DIGITS))
    for no, line in enumerate(raw.split(b"\n")):
        tokens = line.split()
        if not tokens:
            continue
        if len(tokens) < tree.min_tokens and (len(line) != len(line.translate(None, _NO_DIGITS)) or not line.translate(None, _NO_LETTERS)):
            continue
        if digits and len(line) != len(line.translate(None, _NO_DIGITS)):
            tokens = [VARIABLE if len(t) != len(t.translate(None, _NO_DIGITS)) else t for t in tokens]
        path = b"%d %s" % (len(tokens), b" ".join(tokens[: tree.leading]))
        yield no, tokens, signed(xxhash.xxh3_64_intdigest(path))


def _leaves(docs: DataFrame, tree: Tree, short: int) -> DataFrame:
    """Leaves that enough rows reach for a line of their length to recur; ``short``: the limit of short lines."""

    @F.pandas_udf("array<struct<leaf: long, size: int>>")
    def leaves(texts: pd.Series) -> pd.Series:
        return pd.Series([list({(leaf, len(tokens)) for _, tokens, leaf in masked_lines(as_text(t), tree)}) for t in texts], dtype=object)

    each = docs.select(F.explode(leaves("t")).alias("l")).select("l.leaf", "l.size")
    least = F.when(F.col("size") < tree.min_tokens, short).when(F.col("size") >= tree.long_tokens, min(tree.long_texts, tree.min_texts))
    enough = F.col("n") >= least.otherwise(tree.min_texts)
    return each.groupBy("leaf").agg(F.count("*").alias("n"), F.max("size").alias("size")).filter(enough).select("leaf")


def _occurrences(docs: DataFrame, bitmap, tree: Tree) -> DataFrame:
    """``rk, doc_id, tk, no, leaf, line``: the lines whose leaf has its bit set."""
    mask = (1 << tree.bits) - 1

    @F.pandas_udf("array<struct<no: int, leaf: long, line: string>>")
    def lines(texts: pd.Series) -> pd.Series:
        bits, out = bitmap.value, []
        for t in texts:
            found = []
            for no, tokens, leaf in masked_lines(as_text(t), tree):
                slot = leaf & mask
                if bits[slot >> 3] >> (slot & 7) & 1:
                    found.append((no, leaf, b" ".join(tokens).decode("utf-8", "replace")))
            out.append(found)
        return pd.Series(out, dtype=object)

    got = docs.select("rk", "id", "tk", F.explode(lines("t")).alias("l"))
    return got.select("rk", "id", "tk", "l.no", "l.leaf", "l.line")


def _templates(lines: DataFrame, tree: Tree) -> DataFrame:
    """``leaf, lk, line, n, size, constants, template``: the template of each different line. ``lines``: leaf, lk, line, n (its texts)."""
    later = F.slice(F.split("line", " "), tree.leading + 1, F.greatest(F.size(F.split("line", " ")) - tree.leading, F.lit(0)))
    each = lines.select("leaf", "lk", "n", F.posexplode(later).alias("place", "token"))
    common = each.groupBy("leaf", "place", "token").agg(F.sum("n").alias("m")).filter(
        (F.col("m") >= tree.min_texts) | (F.col("token") == VARIABLE.decode())
    )
    kept = each.join(common.select("leaf", "place", "token"), ["leaf", "place", "token"]).groupBy("leaf", "lk").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "token"))).alias("constant")
    )
    tokens = F.split("line", " ")
    constant = F.coalesce("constant", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")))
    general = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - 1),
        lambda i: F.when(i < tree.leading, F.get(tokens, i)).otherwise(F.coalesce(F.try_element_at(constant, i - tree.leading), F.lit(VARIABLE.decode()))),
    )
    stay = F.size(F.filter("general", lambda t: t != VARIABLE.decode()))
    return (
        lines.join(kept, ["leaf", "lk"], "left").withColumn("general", general)
        .select(
            "leaf", "lk", "line", "n", F.size(tokens).alias("size"),
            F.size(F.filter(tokens, lambda t: t != VARIABLE.decode())).alias("constants"),
            F.when(stay >= tree.constant_share * F.size("general"), F.concat_ws(" ", "general")).otherwise(F.col("line")).alias("template"),
        )
    )


def recurring_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tree: Tree = Tree()) -> DataFrame:
    """``rk, no, template, texts``: every line to drop, by ``row_key`` and line number from 0.

    A template's texts are counted once each, so copies of one document do not
    make its lines recur. With ``keep_first`` the smallest (doc_id, text key,
    line number) of a template stays; a null id comes last.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    short = max(tree.short_texts, math.ceil(tree.short_share * docs.count()))
    leaves = settle(_leaves(base, tree, short))
    bitmap = spark.sparkContext.broadcast(bitmap_of(leaves, "leaf", tree.bits))
    keyed = base.filter(F.col("t").isNotNull()).withColumns({"rk": row_key(F.col("id"), F.col("t")), "tk": text_key(F.col("t"))})
    occ = settle(_occurrences(keyed, bitmap, tree).withColumn("lk", F.unhex(F.md5("line"))))
    real = occ.select("leaf", "lk", "tk").distinct()
    lines = (
        real.groupBy("leaf", "lk").agg(F.count("*").alias("n"))
        .join(occ.groupBy("leaf", "lk").agg(F.first("line").alias("line")), ["leaf", "lk"])
        .join(leaves, "leaf", "left_semi")
    )
    named = settle(_templates(settle(lines), tree).withColumn("pk", F.unhex(F.md5("template"))))
    found = occ.select("rk", "id", "tk", "no", "leaf", "lk").join(named.select("leaf", "lk", "pk", "size"), ["leaf", "lk"])
    order = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("tk").alias("t"), F.col("no").alias("no"))
    # One row for each template and text first: a hot template is then split over its texts.
    texts = found.groupBy("leaf", "pk", "tk").agg(F.min(order).alias("first"), F.max("size").alias("size"))
    often = texts.groupBy("leaf", "pk").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.max("size").alias("size"))
    often = settle(often.filter(F.col("texts") >= F.when(F.col("size") < tree.min_tokens, short).otherwise(tree.min_texts)).drop("size"))
    lines_often = named.join(often, ["leaf", "pk"]).select("leaf", "lk", "template", "texts", "first")
    # A long line counts as it stands where its template, if it has one, is not frequent enough.
    long = named.filter((F.col("constants") >= tree.long_tokens) & (F.col("n") >= min(tree.long_texts, tree.min_texts)))
    long = long.join(often.select("leaf", "pk"), ["leaf", "pk"], "left_anti").select("leaf", "lk", F.col("line").alias("template"), F.col("n").alias("texts"))
    begin = occ.select("id", "tk", "no", "leaf", "lk").join(long.select("leaf", "lk"), ["leaf", "lk"]).groupBy("leaf", "lk").agg(F.min(order).alias("first"))
    lines_often = lines_often.unionByName(long.join(begin, ["leaf", "lk"]))
    out = occ.select("rk", "id", "tk", "no", "leaf", "lk").join(lines_often, ["leaf", "lk"])
    if tree.keep_first:
        out = out.filter(~order.eqNullSafe(F.col("first")))
    return out.select("rk", "no", "template", "texts")


def drop_recurring(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tree: Tree = Tree(), dropped: str = "dropped_lines"
) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``; ``dropped`` lists their numbers from 0.

    Every row stays, also when all its lines go (its text is then empty). Null
    texts stay null, texts without recurring lines stay as they are. Rows with
    equal id and text get equal results. A column named ``dropped`` is replaced.
    """
    key = "__line_rk"
    gone = recurring_lines(docs, doc_id=doc_id, text=text, tree=tree).groupBy("rk").agg(F.collect_set("no").alias("__line_nos"))
    t = F.col(f"`{text}`")
    nos = F.col("__line_nos")
    left = F.concat_ws("\n", F.filter(F.split(t, "\n", -1), lambda _, i: ~F.array_contains(nos, i)))
    joined = docs.withColumn(key, row_key(F.col(f"`{doc_id}`"), t)).join(gone.withColumnRenamed("rk", key), key, "left")
    return joined.withColumns({
        text: F.when(nos.isNull(), t).otherwise(left),
        dropped: F.coalesce(F.sort_array(nos), F.array().cast("array<int>")),
    }).drop(key, "__line_nos")
