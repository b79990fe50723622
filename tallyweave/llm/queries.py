"""The registered queries of this subpackage, with their SQL checks where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm import compression_classifier, credentials, dimension_scan, licenses, line_templates, mixing, nbest, negative_mining, ngram_join, periodic_runs, quality_bands, token_counts, toxicity
from tallyweave.llm.common import table


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def op1_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of remainder 2 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression_classifier.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return compression_classifier.score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op2_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    return dimension_scan.search(table(spark, sf_dir, "embeddings"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_bands.assess(docs, into="q").select("doc_id", "q.*")


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after the recurring lines are gone, and their numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, whose documents links connect, and its number of links."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.link(docs).select(
        F.col("id").alias("doc_id"), F.col("group_id").alias("class_id"), "rep_id", "n_links", "n_class_links"
    )


def op6_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; labels of remainder 0 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell's fitted weight and whether it is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix_documents(docs).select("doc_id", "source", "lang", "mix.*")


def op8_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: the base kinds, and the weak candidates that linking confirms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = credentials.scan(docs, into="s")
    kind = lambda k: F.size(F.filter("s.base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"),
        F.sha2(credentials.written(F.col("s.base")), 256).alias("base_sha256"),
        credentials.written(F.array_sort(F.concat("s.base", "s.weak"))).alias("spans"),
        F.size("s.weak").cast("long").alias("n_weak"), F.size("s.linked").cast("long").alias("n_linked"),
    )


def op9_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license paragraphs, and the families that templates confirm."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.fit(docs))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    return found.select(
        "doc_id", "licenses", F.size("licenses").cast("long").alias("n_paragraphs"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))).alias("families"),
    )


def op10_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best ids and the spans of the next three segmentations."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return nbest.encode(docs).select("doc_id", "pieces.*")


def op11_coordinate_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five negatives for each of the five positives of every row whose id is divisible by 100."""
    rows = negative_mining.whole(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negative_mining.mine(rows.withColumn("label", moved))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, the one that repeats most, and digests of all runs and of the collapsed text."""
    docs = periodic_runs.with_planted_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs, into="p").select("doc_id", "p.*").withColumn("best", periodic_runs.greatest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_merged_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether it is longer than 4,096 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit")
    )


QUERIES = {
    "op1_compression_classifier": op1_compression_classifier,
    "op2_dimension_scan": op2_dimension_scan,
    "op3_compression_bands": op3_compression_bands,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_line_templates": op5_line_templates,
    "op6_recurrent_toxicity": op6_recurrent_toxicity,
    "op7_raked_mixing": op7_raked_mixing,
    "op8_credential_linking": op8_credential_linking,
    "op9_license_classifier": op9_license_classifier,
    "op10_nbest_pieces": op10_nbest_pieces,
    "op11_coordinate_negatives": op11_coordinate_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merged_token_counts": op13_merged_token_counts,
}

ORACLES: dict[str, str] = {"op7_raked_mixing": mixing.oracle(), "op11_coordinate_negatives": negative_mining.oracle()}
