"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, pieces.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and
returns a DataFrame, which is written as Parquet and read again for the next
one. All but the last return the columns of ``documents``. Other columns of the
input are carried along. Nulls, empty texts, repeated rows and empty tables have
the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm import line_templates, mixing, nbest, ngram_join, quality_bands
from tallyweave.llm.common import table
from tallyweave.session import settle

#: The share of tokens that mixing keeps; cells under their target are kept whole first.
MIX = mixing.Mix(keep_share=0.9)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands reject go."""
    return quality_bands.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, save where they come first; every document stays. ``n_chars`` is counted anew."""
    out = line_templates.drop_recurring(docs, dropped="__dropped")
    n = F.when(F.size("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).drop("__dropped").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics come near their target weights."""
    return mixing.sample(docs, mix=MIX).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation and the spans of the next three."""
    return nbest.encode(docs, into="__pieces").select("doc_id", "lang", "source", "__pieces.*")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: zstandard and the piece lattice are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
