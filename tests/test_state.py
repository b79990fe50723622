"""What streams keep between batches."""

from __future__ import annotations

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F, types as T

from tallyweave.operators import audit
from tallyweave.operators.faults import cell_faults, tape_faults
from tallyweave.operators.match import contained_pairs
from tallyweave.streaming import watch
from tallyweave.streaming.state import BucketTable, StateTable

KEYED = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def _folder() -> str:
    return tempfile.mkdtemp(prefix="tallyweave-test-")


def _dict(df):
    return {r.k: r.v for r in df.collect()}


def test_state_after_many_versions_retries_and_removals(spark):
    """Any order of keys, retries right before and across a merge, keys taken out; the files on disk stay few."""
    root, rng, want = _folder(), random.Random(1), {}
    table = StateTable(root, KEYED, ("k",), every=3)
    for version in range(10):
        change = {rng.choice("abcdefgh"): rng.randint(0, 99) for _ in range(3)}
        gone = rng.choice("abcdefgh") if version % 5 == 4 else None
        rows = [(k, v, False) for k, v in change.items() if k != gone] + ([(gone, None, True)] if gone else [])
        before = dict(want)
        want |= {k: v for k, v, g in rows if not g}
        want.pop(gone, None)
        if version % 3 == 0:
            # A first try that wrote other rows.
            table.upsert(spark.createDataFrame([("wrong", 1)], KEYED), version)
        assert _dict(table.read(spark, before=version)) == before
        table.upsert(spark.createDataFrame(rows, "k string, v long, _gone boolean"), version)
        assert _dict(table.read(spark)) == want
        # A merged base, its deltas, and those of the state before.
        assert len([x for x in os.listdir(root) if not x.startswith((".", "_"))]) <= 2 * 3 + 2


def test_buckets_that_no_row_falls_into_stay_as_they_are(spark):
    root = _folder()
    table = BucketTable(root, KEYED, lambda: [F.col("k")], buckets=8)
    smallest = lambda df: df.groupBy("k").agg(F.min("v").alias("v"))
    table.merge(spark.createDataFrame([(x, 5) for x in "abcdefghijkl"], KEYED), 0, smallest)
    first = table._pointer(spark)["buckets"]
    touched = table.merge(spark.createDataFrame([("a", 3), ("b", 9)], KEYED), 1, smallest)
    now = table._pointer(spark)["buckets"]
    assert 1 <= len(touched) <= 2 and {b for b in now if now[b] != first[b]} == {str(b) for b in touched}
    for _ in range(2):
        table.merge(spark.createDataFrame([("c", 1), ("z", 7)], KEYED), 2, smallest)
    assert _dict(table.read(spark)) == dict.fromkeys("defghijkl", 5) | {"a": 3, "b": 5, "c": 1, "z": 7}


def test_fingerprints_add_up(spark):
    rows = [("a", str(i), f"2024-01-{i % 28 + 1:02d}", float(i)) for i in range(50)] + [("a", "1", "2024-01-02", 1.0), ("b", "1", None, None)]
    df = spark.createDataFrame(rows, "borrower string, loan_id string, begin_date string, total double")
    part = F.coalesce(F.crc32(F.col("loan_id").cast("binary")) % 3, F.lit(0))
    pieces = None
    for k in range(3):
        one = audit.fingerprint_parts(df.filter(part == k))
        pieces = one if pieces is None else pieces.unionByName(one)
    got = audit.fingerprint(audit.merge_parts(pieces))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, audit.watermark(df).collect()), key=str)


def test_a_manifest_may_come_after_the_rows(spark):
    source, ckpt, paths = _folder(), _folder(), watch.WatchPaths(_folder())
    schema = "borrower string, snapshot string, loan_id string, begin_date string, total double"
    told, seen = [], []

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        watch.watch_tapes(
            stream, paths, ckpt, run=lambda d, tape: seen.append(sorted((r.borrower, r.loan_id) for r in tape.collect())),
            manifest=lambda s: s.createDataFrame(told, "borrower string, snapshot string, rows long"),
        ).awaitTermination()

    go([("a", "s1", "1", "2024-01-01", 1.0), ("b", "s1", "1", "2024-01-01", 1.0)])
    assert seen in ([], [[]])
    told += [("a", "s1", 2), ("b", "s1", 1)]
    go([("c", "s1", "1", "2024-01-01", 1.0)])
    assert seen[-1] == [("b", "1")]
    go([("a", "s1", "2", "2024-01-02", 2.0)])
    assert seen[-1] == [("a", "1"), ("a", "2")]
    whole = audit.watermark(spark.createDataFrame([("a", "1", "2024-01-01", 1.0), ("a", "2", "2024-01-02", 2.0)], "borrower string, loan_id string, begin_date string, total double"))
    state = {r.borrower: r.watermark for r in watch.latest(spark, paths.state, watch.STATE).collect()}
    assert state["a"] == whole.first().watermark and set(state) == {"a", "b"}


def test_an_edited_file_is_read_again_and_a_failed_poll_doubles_nothing(spark):
    ledger = watch.FileLedger(_folder())
    schema = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("line", T.StringType())])

    def listing(*files):
        return spark.createDataFrame([(f, f"{f}@{m}") for f, m in files], "file_id string, fingerprint string")

    def load(files):
        return files.select("file_id", F.concat(F.lit("line of "), "fingerprint").alias("line"))

    def breaks(files):
        raise RuntimeError("disk full")

    def lines():
        return sorted(r.line for r in ledger.rows(spark, schema).collect())

    assert ledger.poll(listing(("x", 1), ("y", 1)), load, 0).count() == 2
    with pytest.raises(RuntimeError):
        ledger.poll(listing(("x", 2), ("y", 1)), breaks, 1)
    assert lines() == ["line of x@1", "line of y@1"]
    assert [r.file_id for r in ledger.poll(listing(("x", 2), ("y", 1)), load, 1).collect()] == ["x"]
    ledger.poll(listing(("x", 2), ("y", 1)), load, 1)
    assert lines() == ["line of x@2", "line of y@1"]
    assert ledger.poll(listing(("x", 2)), load, 2).count() == 0 and lines() == ["line of x@2", "line of y@1"]


def test_cells_that_cannot_be_used(spark):
    rows = [("a", "1", "2024-01-01", "1,000.50"), ("a", "", "2024-13-45", "x"), ("b", "1", "", ""), ("c", None, "31/12/2023", "-5")]
    df = spark.createDataFrame(rows, "borrower string, loan_id string, begin_date string, principal_amount string")
    got = {(r.borrower, r.field, r.reason, r.value) for r in cell_faults(df).collect()}
    assert got == {("a", "loan_id", "missing", None), ("a", "begin_date", "not a date", "2024-13-45"), ("a", "principal_amount", "not an amount", "x"), ("c", "loan_id", "missing", None)}
    assert {r.borrower: r.error.split(",")[0] for r in tape_faults(df).collect()} == {"a": "3 unusable cells", "c": "1 unusable cells"}
    # A tape without the column at all.
    assert tape_faults(df.drop("loan_id").filter("borrower = 'b'")).first().error == "1 unusable cells, first: loan_id missing"


def test_containment_of_needles_of_many_lengths(spark):
    rng = random.Random(6)
    hays = ["".join(rng.choices("abcd ", k=rng.randint(0, 60))) for _ in range(150)] + ["z" * 50_000 + "needle in a very long text" + "q" * 900_000]
    needles = {"", "fee", "needle in", "zzzzzzzz", "zq", "q" * 3000} | {h[i : i + k] for h in hays[:60] for i, k in ((rng.randint(0, 20), rng.randint(1, 25)),)} | set(hays[:10])
    n = spark.createDataFrame([(x,) for x in sorted(needles)], "needle string")
    h = spark.createDataFrame(list(enumerate(hays)), "hay_id long, hay string")
    got = sorted((r.needle, r.hay_id) for r in contained_pairs(n, h).collect())
    assert got == sorted((x, i) for x in needles if x for i, t in enumerate(hays) if x in t and len(x) < len(t))
