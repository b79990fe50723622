"""Change watch over a tape landing zone and a statement drop folder.

Every micro-batch is judged with the batch operators. State lives in tables of
:mod:`tallyweave.streaming.state`: a batch writes the rows that it changes, and a
retried batch starts from the state before it. The state of a batch is written
last: a run that fails leaves the change unconsumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators import audit
from tallyweave.operators.normalize import drop_repeats
from tallyweave.schema import TRANSACTION
from tallyweave.functions.text import ascii_alnum_key
from tallyweave.session import settle
from tallyweave.streaming.state import BucketTable, StateTable, newest, read_text

STATE = T.StructType(
    [
        T.StructField("borrower", T.StringType()), T.StructField("watermark", T.StringType()), T.StructField("rows", T.LongType()),
        T.StructField("latest_date", T.StringType()), T.StructField("run_status", T.StringType()), T.StructField("post_cut_off", T.BooleanType()),
    ]
)


#: Parts of the fingerprints of tapes that have not come in whole yet.
PARTIAL = T.StructType(
    [
        T.StructField("borrower", T.StringType()), T.StructField("snapshot", T.StringType()), T.StructField("rows", T.LongType()),
        T.StructField("_a", T.DecimalType(38, 0)), T.StructField("_b", T.DecimalType(38, 0)), T.StructField("_x", T.LongType()),
        T.StructField("latest_date", T.StringType()),
    ]
)
FILES = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("poll", T.LongType())])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def latest(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The state of a table by key, or the newest version of a versioned one (before ``before``, when given); empty when there is none."""
    if read_text(spark, f"{path}/_current") is not None:
        return StateTable(path, schema, (schema[0].name,)).read(spark, before)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(T.StructType([*schema, T.StructField("version", T.LongType())])).parquet(path)
    versions = df if before is None else df.filter(F.col("version") < before)
    # Versions are folder names; the filter prunes to one of them.
    top = versions.agg(F.max("version")).first()[0]
    return df.filter(F.col("version") == F.lit(-1 if top is None else top)).drop("version")


def save(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


@dataclass(frozen=True)
class WatchPaths:
    """Folders of a watch: state, decisions taken, borrowers held, runs that failed."""

    root: str

    @property
    def state(self) -> str:
        return f"{self.root}/state"

    @property
    def decisions(self) -> str:
        return f"{self.root}/decisions"

    @property
    def errors(self) -> str:
        return f"{self.root}/errors"

    @property
    def staged(self) -> str:
        return f"{self.root}/staged"

    @property
    def partial(self) -> str:
        return f"{self.root}/partial"


def decide(current: DataFrame, previous: DataFrame, arrivals: DataFrame | None = None, *, cut_off: str = "", hard_stop: bool = True) -> DataFrame:
    """What to do per changed borrower: 'run' or 'held' (changed after the cut-off under a hard stop)."""
    tape = audit.changed(current, previous).select("borrower", "watermark", "rows", "latest_date", F.lit(True).alias("tape_changed"))
    out = tape
    if arrivals is not None:
        extra = arrivals.select("borrower").distinct().join(tape, "borrower", "left_anti").join(current, "borrower", "left")
        out = tape.unionByName(extra.select("borrower", "watermark", "rows", "latest_date", F.lit(False).alias("tape_changed")))
    late = audit.cut_off_status(F.col("latest_date"), cut_off) == "post_cut_off"
    action = F.when(late & F.lit(hard_stop), F.lit("held")).otherwise(F.lit("run"))
    return out.withColumns({"post_cut_off": late, "action": action})


def complete_snapshots(partials: StateTable, batch: DataFrame, manifest: DataFrame, version: int, *, date_column: str = "begin_date") -> DataFrame:
    """``borrower, snapshot, watermark, rows, latest_date`` of the tapes that have come in whole with batch ``version``.

    Rows carry the ``snapshot`` they belong to. The parts of a snapshot's
    fingerprint are added up batch by batch; it is complete once it has the
    number of rows that ``manifest`` (``borrower, snapshot, rows``) names, whichever of
    the two comes last. Of several complete snapshots of a borrower the last one counts.
    """
    keys = ["borrower", "snapshot"]
    spark = batch.sparkSession
    known = partials.read(spark, before=version)
    merged = settle(audit.merge_parts(known.unionByName(audit.fingerprint_parts(batch, keys, date_column)), keys))
    expected = manifest.select(*keys, F.col("rows").alias("expected"))
    ready = settle(audit.fingerprint(merged.join(expected, keys).filter("rows = expected").drop("expected"), keys))
    # What this batch has added to, and what it has taken out.
    touched = merged.join(batch.select(*keys).distinct(), keys, "left_semi").withColumn("_gone", F.lit(False))
    done = ready.select(*keys, F.lit(True).alias("_done"))
    changes = touched.join(done, keys, "left").withColumn("_gone", F.coalesce("_done", F.lit(False))).drop("_done")
    emptied = known.join(done, keys).join(touched.select(*keys), keys, "left_anti").withColumn("_gone", F.lit(True)).drop("_done")
    partials.upsert(changes.unionByName(emptied), version)
    return newest(ready, ["borrower"], [F.desc("snapshot")])


def watch_tapes(
    tapes: DataFrame, paths: WatchPaths, checkpoint: str, run: Callable[[DataFrame, DataFrame], DataFrame] | None = None, *,
    arrivals: Callable[[SparkSession], DataFrame] | None = None, manifest: Callable[[SparkSession], DataFrame] | None = None,
    faults: Callable[[DataFrame], DataFrame] | None = None,
    date_column: str = "begin_date", cut_off: str = "", hard_stop: bool = True, dry_run: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Watch a stream of full tape snapshots (``borrower`` and the tape's columns).

    Without ``manifest`` a borrower's tape is complete within a batch. With it,
    rows name their ``snapshot`` and may come over any number of batches:
    ``manifest(spark)`` tells how many rows a snapshot has, and nothing is
    decided before it has them all (:func:`complete_snapshots`).

    ``faults(tape)`` finds borrowers whose rows cannot be verified (``borrower, error``,
    as :func:`tallyweave.operators.faults.tape_faults` does). They fail by themselves:
    the others of the batch are verified by the same run.

    ``run(decisions, tape)`` verifies the borrowers to run and returns those that
    failed (``borrower``, and ``error`` if it has one); a failed borrower keeps no
    fingerprint, so it is tried again, and the others go on. If ``run`` itself
    breaks off, all of its borrowers count as failed and the stream goes on.
    Failures are written to ``paths.errors``. ``arrivals(spark)`` lists borrowers
    with new statement files: they are run although their tape is unchanged.
    Nothing is run in a dry run, which leaves each borrower's status and
    fingerprint as they were.
    """
    states = StateTable(paths.state, STATE, ("borrower",))
    partials = StateTable(paths.partial, PARTIAL, ("borrower", "snapshot"))

    def whole(batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """The fingerprints to judge and the rows they stand for."""
        if manifest is None:
            snapshot = settle(batch)
            return audit.watermark(snapshot, date_column=date_column), snapshot
        spark = batch.sparkSession
        save(batch, paths.staged, batch_id)
        ready = settle(complete_snapshots(partials, spark.read.schema(batch.schema).parquet(f"{paths.staged}/version={batch_id}"), manifest(spark), batch_id, date_column=date_column))
        staged = spark.read.schema(batch.schema).parquet(paths.staged)
        rows = staged.join(F.broadcast(ready.select("borrower", "snapshot")), ["borrower", "snapshot"], "left_semi")
        return ready.drop("snapshot"), rows.drop("snapshot")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current, tape = whole(batch, batch_id)
        previous = states.read(spark, before=batch_id)
        came = arrivals(spark) if arrivals is not None else None
        decisions = settle(decide(current, previous, came, cut_off=cut_off, hard_stop=hard_stop))
        save(decisions, paths.decisions, batch_id)
        if dry_run:
            return
        to_run, failed = decisions.filter("action = 'run'"), None
        if faults is not None:
            failed = settle(faults(tape.join(to_run.select("borrower"), "borrower", "left_semi")).select("borrower", "error"))
            to_run = to_run.join(failed.select("borrower"), "borrower", "left_anti")
            tape = tape.join(failed.select("borrower"), "borrower", "left_anti")
        if run is not None:
            try:
                more = run(to_run, tape)
            except Exception as exc:  # noqa: BLE001 - written down below; one batch's failure does not end the watch
                more = to_run.select("borrower", F.lit(f"{type(exc).__name__}: {exc}"[:1000]).alias("error"))
            if more is not None:
                more = more.select("borrower", (F.col("error") if "error" in more.columns else F.lit(None)).cast("string").alias("error"))
                failed = more if failed is None else failed.unionByName(more)
        new = decisions.select(
            "borrower", "watermark", "rows", "latest_date",
            F.when(F.col("action") == "run", F.lit("done")).otherwise(F.lit("held")).alias("run_status"), "post_cut_off",
        )
        if failed is not None:
            bad = settle(failed.groupBy("borrower").agg(F.max("error").alias("error")))
            save(bad, paths.errors, batch_id)
            new = new.join(bad.select("borrower", F.lit(True).alias("_bad")), "borrower", "left").withColumns(
                {"watermark": F.when(F.col("_bad").isNull(), F.col("watermark")), "run_status": F.when(F.col("_bad"), F.lit("failed")).otherwise(F.col("run_status"))}
            ).drop("_bad")
        states.upsert(new, batch_id)

    writer = tapes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def statement_table(path: str, buckets: int = 64) -> BucketTable:
    """The bank table: rows without repeats, in buckets by what makes transactions equal."""

    def identity() -> list:
        return [
            F.col("borrower"), F.coalesce(F.col("value_date"), F.lit("")), F.col("amount").cast("decimal(28,2)"),
            F.lower(F.coalesce(F.col("direction"), F.lit(""))), ascii_alnum_key(F.col("description")),
        ]

    return BucketTable(path, TRANSACTION, identity, buckets)


def intake_statements(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, buckets: int = 64) -> StreamingQuery:
    """Statement rows into the bank table (:func:`statement_table`), each file once (file-source bookkeeping).

    A batch reads and rewrites the buckets that its rows fall into. Of repeats,
    within a batch or across batches, the lowest ``seq`` stays, so the
    row that stays does not depend on arrival.
    """
    table = statement_table(path, buckets)

    def each(batch: DataFrame, batch_id: int) -> None:
        table.merge(settle(batch), batch_id, drop_repeats)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compact(spark: SparkSession, path: str) -> DataFrame:
    """All statement rows taken in so far, without repeats."""
    return statement_table(path).read(spark)


@dataclass(frozen=True)
class FileLedger:
    """Statement files by path, each in the version that counts, and the rows read from them."""

    root: str

    def files(self) -> StateTable:
        return StateTable(f"{self.root}/files", FILES, ("file_id",))

    def poll(self, listing: DataFrame, load: Callable[[DataFrame], DataFrame], number: int) -> DataFrame:
        """Take in the files of ``listing`` (``file_id, fingerprint``) that are new or edited; returns them.

        ``load(files)`` reads them into rows with ``file_id``. The ledger is written after the
        rows: a poll that fails is tried again under its ``number`` and doubles nothing. An
        edited file has another fingerprint: its new rows count, those of its former
        version no longer do. A file that has left the listing keeps its rows.
        """
        spark = listing.sparkSession
        known = self.files().read(spark, before=number)
        new = settle(listing.select("file_id", "fingerprint").distinct().join(known, ["file_id", "fingerprint"], "left_anti"))
        load(new).withColumn("poll", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.root}/rows/poll-{number}")
        self.files().upsert(new.withColumn("poll", F.lit(number)), number)
        return new

    def rows(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The rows of every file's version that counts (``schema`` has ``file_id``)."""
        full = T.StructType([*[f for f in schema if f.name != "poll"], T.StructField("poll", T.LongType())])
        stored = spark.read.schema(full).parquet(f"{self.root}/rows/poll-*")
        return stored.join(self.files().read(spark).select("file_id", "poll"), ["file_id", "poll"], "left_semi").drop("poll")


def stream_totals(rows: DataFrame, delay: str = "2 days") -> DataFrame:
    """Inflow and outflow per borrower and day of a live statement stream (``value_ts`` is the event time)."""
    from tallyweave.functions.money import total

    return (
        rows.withWatermark("value_ts", delay)
        .groupBy("borrower", F.window("value_ts", "1 day").alias("day"))
        .agg(total(F.col("amount"), F.col("direction") == "in").alias("cash_in"), total(F.col("amount"), F.col("direction") == "out").alias("cash_out"), F.count(F.lit(1)).alias("rows"))
        .select("borrower", F.col("day.start").alias("day"), "cash_in", "cash_out", "rows")
    )


def stream_without_repeats(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """Live rows, a repeated transaction identity dropped while the watermark remembers it."""
    keyed = rows.withColumns({"_cents": F.col("amount").cast("decimal(28,2)"), "_text": ascii_alnum_key(F.col("description"))})
    identity = ["borrower", "value_date", "_cents", "direction", "_text"]
    return keyed.withWatermark("value_ts", delay).dropDuplicatesWithinWatermark(identity).drop("_cents", "_text")
