"""Streams give what the batch operators give."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tallyweave.operators import audit
from tallyweave.streaming import review, watch


def _folder() -> str:
    return tempfile.mkdtemp(prefix="tallyweave-test-")


def _tape(spark, rows):
    return spark.createDataFrame(rows, "borrower string, loan_id string, begin_date string, total double")


def _watch(spark, source, paths, ckpt, **options):
    schema = "borrower string, loan_id string, begin_date string, total double"
    stream = spark.readStream.schema(schema).parquet(source)
    watch.watch_tapes(stream, paths, ckpt, **options).awaitTermination()


def test_watch_detects_only_changed_borrowers_and_retries_failures(spark):
    source, ckpt, paths = _folder(), _folder(), watch.WatchPaths(_folder())
    first = [("a", "1", "2024-01-01", 10.0), ("a", "2", "2024-01-02", 20.0), ("b", "1", "2024-05-01", 5.0)]
    _tape(spark, first).write.mode("append").parquet(source)
    seen = []

    def run(decisions, batch):
        names = sorted(r[0] for r in decisions.select("borrower").collect())
        seen.append(names)
        return decisions.filter(F.col("borrower") == "b").select("borrower") if len(seen) == 1 else decisions.limit(0).select("borrower")

    _watch(spark, source, paths, ckpt, run=run)
    # Same content in another order: only the borrower whose run failed is tried again.
    _tape(spark, first[::-1]).write.mode("append").parquet(source)
    _watch(spark, source, paths, ckpt, run=run)
    changed = [("a", "1", "2024-01-01", 10.0), ("a", "2", "2024-01-02", 21.0), ("b", "1", "2024-05-01", 5.0)]
    _tape(spark, changed).write.mode("append").parquet(source)
    _watch(spark, source, paths, ckpt, run=run)
    assert seen == [["a", "b"], ["b"], ["a"]]
    state = {r.borrower: r for r in watch.latest(spark, paths.state, watch.STATE).collect()}
    assert state["a"].latest_date == "2024-01-02" and state["b"].run_status == "done"


def test_watch_holds_changes_after_the_cut_off(spark):
    source, paths = _folder(), watch.WatchPaths(_folder())
    _tape(spark, [("a", "1", "2024-01-01", 1.0), ("b", "1", "2024-09-01", 1.0)]).write.mode("append").parquet(source)
    seen = []
    _watch(spark, source, paths, _folder(), cut_off="2024-06-30", run=lambda d, b: seen.extend(r[0] for r in d.collect()))
    assert seen == ["a"]
    assert {r.borrower: r.run_status for r in watch.latest(spark, paths.state, watch.STATE).collect()} == {"a": "done", "b": "held"}


def test_dry_run_changes_nothing_and_arrivals_and_errors_are_handled(spark):
    source, ckpt, paths = _folder(), _folder(), watch.WatchPaths(_folder())
    rows, seen = [("a", "1", "2024-01-01", 1.0), ("b", "1", "2024-01-01", 1.0)], []

    def state():
        return {r.borrower: (r.run_status, r.watermark is None) for r in watch.latest(spark, paths.state, watch.STATE).collect()}

    def fine(decisions, batch):
        seen.append(sorted(r[0] for r in decisions.select("borrower").collect()))

    def breaks(decisions, batch):
        raise RuntimeError("no connection")

    _tape(spark, rows).write.mode("append").parquet(source)
    _watch(spark, source, paths, ckpt, run=fine, dry_run=True)
    assert seen == [] and state() == {}
    for run in (breaks, fine):
        _tape(spark, rows).write.mode("append").parquet(source)
        _watch(spark, source, paths, ckpt, run=run)
        if run is breaks:
            assert state() == {"a": ("failed", True), "b": ("failed", True)}
            assert {(r.borrower, r.error) for r in spark.read.parquet(paths.errors).collect()} == {(x, "RuntimeError: no connection") for x in "ab"}
    _tape(spark, rows).write.mode("append").parquet(source)
    _watch(spark, source, paths, ckpt, run=fine, arrivals=lambda s: s.createDataFrame([("b",)], "borrower string"))
    assert seen == [["a", "b"], ["b"]] and state() == {"a": ("done", False), "b": ("done", False)}


def test_statement_arrival_triggers_a_run_without_a_tape_change(spark):
    current = spark.createDataFrame([("a", "w1", 1, "2024-01-01"), ("b", "w2", 1, "2024-01-01")], "borrower string, watermark string, rows long, latest_date string")
    arrivals = spark.createDataFrame([("b", "f1"), ("b", "f2")], "borrower string, fingerprint string")
    got = watch.decide(current, current, arrivals).collect()
    assert [(r.borrower, r.tape_changed, r.action) for r in got] == [("b", False, "run")]


def test_intake_keeps_one_row_per_transaction_across_files(spark):
    source, store = _folder(), _folder() + "/bank"
    row = "'b' borrower, '{k}' key, 'bank' sheet, 'bank' source_type, '2024-01-02' value_date, 10.0D amount, 'in' direction, '' currency, '{t}' description, 'x' account_ref, 1.0D confidence, {s}L seq"
    spark.sql("SELECT " + row.format(k="k2", t="TxN-1 pay", s=2)).write.mode("append").parquet(source)
    ckpt = _folder()
    from tallyweave.schema import TRANSACTION

    for text in ("TXN 1  Pay", "other"):
        watch.intake_statements(spark.readStream.schema(TRANSACTION).parquet(source), store, ckpt).awaitTermination()
        spark.sql("SELECT " + row.format(k="k1" if text != "other" else "k3", t=text, s=1)).write.mode("append").parquet(source)
    watch.intake_statements(spark.readStream.schema(TRANSACTION).parquet(source), store, ckpt).awaitTermination()
    assert sorted(r.key for r in watch.compact(spark, store).collect()) == ["k1", "k3"]


def test_review_stream_equals_batch(spark):
    source, root, ckpt = _folder(), _folder(), _folder()
    actions = [
        ("x", 1, "approved"), ("x", 2, "rejected"), ("x", 3, "sign_off"), ("y", 1, "sign_off"), ("y", 2, "review_start"),
        ("y", 3, "review_start"), ("y", 4, "rejected"), ("y", 5, "sign_off"), ("z", 1, "review_start"),
    ]
    df = spark.createDataFrame(actions, "exception_id string, seq long, action string")
    for part in ("seq <= 2", "seq > 2"):
        df.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        review.review_stream(stream, root, ckpt).awaitTermination()
    got = spark.read.parquet(f"{root}/judged").select("exception_id", "seq", "valid", "status_after")
    want = audit.judge_reviews(df).select("exception_id", "seq", "valid", "status_after")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_live_totals_and_repeats(spark):
    source = _folder()
    rows = spark.sql(
        "SELECT 'b' borrower, '2024-01-0' || id value_date, timestamp('2024-01-01 10:00:00') + make_interval(0,0,0,cast(id as int)) value_ts, 1.5D * id amount, 'in' direction, 'Pay ' || id description FROM range(1, 5)"
    )
    rows.unionByName(rows.withColumn("description", F.upper("description"))).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    for name, df, mode in (("live_totals", watch.stream_totals(stream), "complete"), ("live_rows", watch.stream_without_repeats(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r.cash_in for r in spark.sql("SELECT * FROM live_totals ORDER BY day").collect()] == [3.0, 6.0, 9.0, 12.0]
    assert spark.table("live_rows").count() == 4
