"""Registered queries: streams and their state, each equal to what a batch over all rows gives."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyweave.catalog.audit_trail import ENTRIES as _AUDIT, _tape
from tallyweave.catalog.base import Entry, bank, sql
from tallyweave.catalog.mapping import ENTRIES as _MAPPING
from tallyweave.catalog.views import load, view
from tallyweave.operators import audit, faults
from tallyweave.session import ensure_checkpoint_dir
from tallyweave.streaming import review, watch
from tallyweave.streaming.state import StateTable

ENTRIES: dict[str, Entry] = {}


def _folder(s: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(s)}/stream-{uuid.uuid4().hex}"


def _landed(s: SparkSession, rows: DataFrame, folder: str, parts: Sequence[Column]) -> DataFrame:
    """``rows`` as a stream: one batch for each condition of ``parts``, in their order."""
    for k, part in enumerate(parts):
        # One file per batch, so that a batch is what one trigger reads.
        rows.filter(part).coalesce(1).write.parquet(f"{folder}/part={k}")
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/part=*")


# Change watch ----------------------------------------------------------------


def _split_tapes(s: SparkSession, d: str) -> DataFrame:
    """Tapes that come over three batches; of one the manifest names a row that never comes."""
    tape = _tape(s, d).withColumn("snapshot", F.lit("2024-06-01"))
    counts = tape.groupBy("borrower", "snapshot").agg((F.count(F.lit(1)) + F.max((F.col("borrower") == "FURNITURE").cast("int"))).alias("rows"))
    root = _folder(s)
    third = F.crc32(F.col("loan_id").cast("binary")) % 3
    stream = _landed(s, tape, f"{root}/landing", [third == k for k in range(3)])
    paths = watch.WatchPaths(f"{root}/watch")
    watch.watch_tapes(stream, paths, f"{root}/checkpoint", manifest=lambda _: counts).awaitTermination()
    whole = audit.watermark(_tape(s, d)).select("borrower", F.col("watermark").alias("of_whole"))
    decided = s.read.parquet(paths.decisions).filter("action = 'run'")
    return decided.join(whole, "borrower").select("borrower", "rows", "latest_date", (F.col("watermark") == F.col("of_whole")).alias("as_whole"), (F.col("version") == 2).alias("in_last_batch"))


ENTRIES["watch_stream_fingerprint"] = Entry(
    _split_tapes,
    sql("SELECT borrower, count(*) AS rows, max(begin_date) AS latest_date, TRUE AS as_whole, TRUE AS in_last_batch FROM loan_tape WHERE borrower <> 'FURNITURE' GROUP BY borrower"),
)


def _isolated(s: SparkSession, d: str) -> DataFrame:
    """Two malformed tapes among five: they fail, the others are verified by the same run."""
    t = _tape(s, d).withColumns({c: F.col(c).cast("string") for c in ("principal_amount", "total_loan_amount")})
    last = F.col("loan_id").endswith("7")
    t = t.withColumns(
        {
            "principal_amount": F.when((F.col("borrower") == "BUILDING") & last, "n/a").otherwise(F.col("principal_amount")),
            "begin_date": F.when((F.col("borrower") == "MACHINERY") & last, "soon").otherwise(F.col("begin_date")),
        }
    )
    root = _folder(s)
    paths = watch.WatchPaths(f"{root}/watch")
    stream = _landed(s, t, f"{root}/landing", [F.lit(True)])
    verified = f"{root}/verified"

    def run(decisions: DataFrame, tape: DataFrame) -> None:
        tape.join(decisions.select("borrower"), "borrower", "left_semi").groupBy("borrower").count().write.parquet(verified)

    watch.watch_tapes(stream, paths, f"{root}/checkpoint", run=run, faults=faults.tape_faults).awaitTermination()
    state = watch.latest(s, paths.state, watch.STATE).select("borrower", "run_status", F.col("watermark").isNotNull().alias("remembered"))
    errors = s.read.parquet(paths.errors).select("borrower", "error")
    return state.join(s.read.parquet(verified), "borrower", "left").join(errors, "borrower", "left").select("borrower", "run_status", "remembered", F.col("count").alias("verified_rows"), "error")


ENTRIES["watch_isolated_faults"] = Entry(
    _isolated,
    sql("""SELECT borrower, CASE WHEN bad = 0 THEN 'done' ELSE 'failed' END AS run_status, bad = 0 AS remembered, CASE WHEN bad = 0 THEN n END AS verified_rows,
        CASE WHEN bad > 0 THEN concat(CAST(bad AS VARCHAR), CASE borrower WHEN 'BUILDING' THEN ' unusable cells, first: principal_amount not an amount ''n/a''' ELSE ' unusable cells, first: begin_date not a date ''soon''' END) END AS error
        FROM (SELECT borrower, count(*) AS n, count(*) FILTER (borrower IN ('BUILDING', 'MACHINERY') AND loan_id LIKE '%7') AS bad FROM loan_tape GROUP BY borrower) x"""),
)


def _versions(s: SparkSession, d: str) -> DataFrame:
    """The last event of every user, taken in over nine batches, one of them twice, across merges of the table; some users are taken out."""
    e = load(s, d, "events").select("user_id", "event_id", "event_type")
    top = e.agg(F.max("event_id")).first()[0] or 0
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])
    table = StateTable(_folder(s), schema, ("user_id",), every=3)
    step = top // 9 + 1
    batch = F.floor(F.col("event_id") / step)
    for k in (*range(6), 5, *range(6, 9)):
        part = e.filter(batch == k).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))
        # A first try of batch 5 went wrong.
        table.upsert(part, k)
    gone = e.filter(F.col("user_id") % 10 == 9).select("user_id").distinct()
    table.upsert(gone.select("user_id", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.lit(True).alias("_gone")), 9)
    return table.read(s)


ENTRIES["watch_state_versions"] = Entry(
    _versions, sql("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id % 10 <> 9 GROUP BY user_id")
)


def _edited_files(s: SparkSession, d: str) -> DataFrame:
    """Three polls of a drop folder: files come, some are edited under their name, and one poll is made twice."""
    docs = load(s, d, "documents").filter(F.col("doc_id").isNotNull())
    ledger = watch.FileLedger(_folder(s))
    schema = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("line", T.LongType()), T.StructField("chars", T.LongType())])
    name = F.concat(F.lit("drop/"), F.col("doc_id").cast("string"), F.lit(".csv"))

    def listing(edits: int) -> DataFrame:
        """Every seventh file has been edited ``edits`` times, every fifth comes with the second poll."""
        seen = docs if edits else docs.filter("doc_id % 5 <> 0")
        version = F.when(F.col("doc_id") % 7 == 0, F.lit(edits)).otherwise(F.lit(0))
        return seen.select(name.alias("file_id"), F.concat_ws("@", name, version.cast("string")).alias("fingerprint"))

    def read(files: DataFrame) -> DataFrame:
        version = F.element_at(F.split("fingerprint", "@"), -1).cast("long")
        texts = docs.select(name.alias("file_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), (F.col("doc_id") % 3).alias("more"))
        rows = files.join(texts, "file_id").withColumn("line", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more"))))
        return rows.select("file_id", "line", (F.col("n") + 1000 * version).alias("chars"))

    for number, edits in ((0, 0), (1, 1), (1, 1), (2, 2), (3, 2)):
        ledger.poll(listing(edits), read, number)
    return ledger.rows(s, schema).groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars"))


ENTRIES["watch_file_edits"] = Entry(
    _edited_files,
    sql("""SELECT concat('drop/', CAST(doc_id AS VARCHAR), '.csv') AS file_id, doc_id % 3 + 1 AS rows,
        CAST((doc_id % 3 + 1) * (coalesce(length(text), 0) + CASE WHEN doc_id % 7 = 0 THEN 2000 ELSE 0 END) AS BIGINT) AS chars FROM documents WHERE doc_id IS NOT NULL"""),
)


def _intake(s: SparkSession, d: str) -> DataFrame:
    """Bank rows over three files, the latest ones first."""
    rows, root = bank(s, d), _folder(s)
    third = F.crc32(F.col("key").cast("binary")) % 3
    stream = _landed(s, rows, f"{root}/landing", [third == k for k in (2, 0, 1)])
    watch.intake_statements(stream, f"{root}/bank", f"{root}/checkpoint", buckets=16).awaitTermination()
    return watch.compact(s, f"{root}/bank").select("borrower", "key", "amount", "seq")


ENTRIES["watch_intake_dedupe"] = Entry(_intake, _MAPPING["map_dedupe"].check)

# Review ----------------------------------------------------------------------


def _reviews(s: SparkSession, d: str) -> DataFrame:
    """All actions in three batches of the log, judged with keyed state; the state per exception afterwards."""
    actions, root = view(s, d, "review_actions"), _folder(s)
    top = actions.agg(F.max("seq")).first()[0] or 0
    lean = actions.select("exception_id", F.col("seq").cast("long").alias("seq"), "action")
    cuts = [F.col("seq") <= top // 3, (F.col("seq") > top // 3) & (F.col("seq") <= 2 * top // 3), F.col("seq") > 2 * top // 3]
    stream = _landed(s, lean, f"{root}/landing", cuts)
    review.review_stream(stream, root, f"{root}/checkpoint").awaitTermination()
    judged = s.read.parquet(f"{root}/judged").drop("version").join(actions.select("exception_id", F.col("seq").cast("long").alias("seq"), "reviewer", "note"), ["exception_id", "seq"])
    return audit.state_of(judged)


ENTRIES["review_stream_state"] = Entry(_reviews, _AUDIT["review_state"].check)
