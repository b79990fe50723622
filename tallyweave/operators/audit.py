"""Fingerprints, audit-log metrics, review and sign-off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.text import exception_pattern, run_of_event


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Digest of a row's canonical JSON (columns by name, nulls kept)."""
    names = sorted(columns or df.columns)
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)


PARTS = ("rows", "_a", "_b", "_x", "latest_date")


def fingerprint_parts(df: DataFrame, keys: Sequence[str] = ("borrower",), date_column: str = "begin_date") -> DataFrame:
    """What the fingerprint of each key is made of; the parts of two sets of rows add up (:func:`merge_parts`).

    Row digests are folded into a count, two 64-bit halves summed and one xor, so
    a tape of any size is fingerprinted without sorting it, whole or piece by piece.
    """
    digest = row_digest(df, [c for c in df.columns if c not in keys])
    lean = df.select(*keys, F.col(f"`{date_column}`").cast("string").alias("_date"), digest.alias("_d"))

    def half(start: int) -> Column:
        return F.conv(F.substring("_d", start, 15), 16, 10).cast("decimal(38,0)")

    return lean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(half(1)).alias("_a"), F.sum(half(16)).alias("_b"),
        F.bit_xor(half(31).cast("long")).alias("_x"),
        F.max(F.nullif(F.col("_date"), F.lit(""))).alias("latest_date"),
    )


def merge_parts(parts: DataFrame, keys: Sequence[str] = ("borrower",)) -> DataFrame:
    """The parts of all rows of a key from those of its pieces, in whatever order they came."""
    return parts.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("_a").cast("decimal(38,0)").alias("_a"), F.sum("_b").cast("decimal(38,0)").alias("_b"),
        F.bit_xor("_x").alias("_x"), F.max("latest_date").alias("latest_date"),
    )


def fingerprint(parts: DataFrame, keys: Sequence[str] = ("borrower",)) -> DataFrame:
    """Keys with ``watermark, rows, latest_date`` from their parts."""
    text = F.concat_ws("|", F.col("rows").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string"), F.col("_x").cast("string"))
    return parts.select(*keys, F.sha2(text, 256).alias("watermark"), "rows", "latest_date")


def watermark(df: DataFrame, keys: Sequence[str] = ("borrower",), date_column: str = "begin_date") -> DataFrame:
    """Content fingerprint per key: blind to row order, not to repeats."""
    return fingerprint(fingerprint_parts(df, keys, date_column), keys)


def changed(current: DataFrame, previous: DataFrame, keys: Sequence[str] = ("borrower",)) -> DataFrame:
    """Keys that are new or whose fingerprint differs (a dropped fingerprint counts as different)."""
    old = previous.select(*keys, F.col("watermark").alias("_old"))
    return current.join(old, list(keys), "left").filter(~F.col("watermark").eqNullSafe(F.col("_old"))).drop("_old")


def new_files(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """Inbox files whose fingerprint was not taken in yet for that borrower."""
    return files.join(ingested, ["borrower", "fingerprint"], "left_anti")


def run_triggers(current: DataFrame, previous: DataFrame, files: DataFrame, ingested: DataFrame) -> DataFrame:
    """Borrowers to run: the tape changed or a statement arrived."""
    a = changed(current, previous).select("borrower", F.lit(1).alias("tape"), F.lit(0).alias("file"))
    b = new_files(files, ingested).select("borrower", F.lit(0).alias("tape"), F.lit(1).alias("file"))
    return a.unionByName(b).groupBy("borrower").agg(
        (F.max("tape") == 1).alias("tape_changed"), (F.max("file") == 1).alias("statement_arrived")
    )


def cut_off_status(latest_date: Column, cut_off: str) -> Column:
    """'post_cut_off' when the latest date text lies after the cut-off."""
    if not cut_off.strip():
        return F.lit("ok")
    day = F.substring(F.coalesce(latest_date, F.lit("")), 1, 10)
    return F.when((day == "") | (day <= cut_off.strip()), F.lit("ok")).otherwise(F.lit("post_cut_off"))


def lead_times(log: DataFrame, started: Sequence[str] = ("run_started", "watcher_run_started")) -> DataFrame:
    """Seconds from a run's first start to its last logged sign-off; null when unsigned."""
    run = run_of_event(F.col("run_id"), F.col("exception_id"))
    is_start, is_sign = F.col("event").isin(*started), F.col("event") == "sign_off"
    per_run = (
        log.filter(is_start | is_sign)
        .select(F.when(is_start, F.col("run_id")).otherwise(run).alias("run_id"), "ts", "seq", is_start.alias("s"))
        .filter(F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(F.min_by("ts", F.when(F.col("s"), F.col("seq"))).alias("started"),
             F.max_by("ts", F.when(~F.col("s"), F.col("seq"))).alias("signed_off"),
             F.count_if("s").alias("_starts"))
        .filter(F.col("_starts") > 0)
    )
    a, b = F.col("started").try_cast("timestamp"), F.col("signed_off").try_cast("timestamp")
    return per_run.select("run_id", "started", "signed_off", F.round((F.unix_micros(b) - F.unix_micros(a)) / 1e6, 3).alias("elapsed_seconds"))


def run_borrowers(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Borrower of each run as its report states, else 'uploaded'."""
    named = reports.select("run_id", F.nullif(F.col("borrower"), F.lit("")).alias("_b")).groupBy("run_id").agg(F.max("_b").alias("_b"))
    return runs.join(named, "run_id", "left").withColumn("borrower", F.coalesce(F.col("_b"), F.lit("uploaded"))).drop("_b")


def last_verified(log: DataFrame, completed: Sequence[str] = ("run_completed", "watcher_run_completed")) -> DataFrame:
    """Latest completed run per borrower, longest ago first; the first logged wins a tie.

    ``log`` carries ``borrower`` (see :func:`run_borrowers`).
    """
    done = log.filter(F.col("event").isin(*completed) & (F.coalesce(F.col("run_id"), F.lit("")) != ""))
    when = F.coalesce(F.col("ts").cast("string"), F.lit(""))
    return (
        done.groupBy("borrower")
        .agg(F.max_by(F.struct("run_id", F.col("ts").alias("last_verified")), F.struct(when, -F.col("seq"))).alias("x"))
        .select("borrower", "x.run_id", "x.last_verified")
        .orderBy("last_verified", "borrower")
    )


def signed_off(exceptions: DataFrame, log: DataFrame) -> DataFrame:
    """Flag exceptions with an approving sign-off."""
    approved = log.filter((F.col("event") == "sign_off") & F.col("approved")).select(F.col("exception_id").alias("id")).distinct()
    return exceptions.join(approved.withColumn("_s", F.lit(True)), "id", "left").withColumn(
        "signed_off", F.coalesce(F.col("_s"), F.lit(False))
    ).drop("_s")


def verify_signoffs(signoffs: DataFrame, reports: DataFrame) -> DataFrame:
    """Does the report still have the content that was signed? ``reports`` has run_id, borrower, content."""
    now = reports.select("borrower", "run_id", F.sha2(F.col("content"), 256).alias("_now"))
    return signoffs.join(now, ["borrower", "run_id"], "left").withColumn(
        "intact", F.coalesce(F.col("_now") == F.col("report_sha256"), F.lit(False))
    ).drop("_now")


def last_events(log: DataFrame, n: int = 100) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n)


def judge_reviews(actions: DataFrame) -> DataFrame:
    """Validity of every review action and the status it leads to.

    pending -> reviewed -> approved | rejected (a decision may skip 'reviewed'); the
    first decision stands, a start is valid once and before it, a sign-off needs a
    decision. Each rule compares with a minimum, so one exception with very many
    actions is still aggregated map-side.
    """
    decided = F.col("action").isin("approved", "rejected")
    firsts = actions.groupBy("exception_id").agg(
        F.min(F.when(decided, F.col("seq"))).alias("_decision"),
        F.min_by("action", F.when(decided, F.col("seq"))).alias("_outcome"),
        F.min(F.when(F.col("action") == "review_start", F.col("seq"))).alias("_start"),
    )
    seq, d, s = F.col("seq"), F.col("_decision"), F.col("_start")
    valid = (
        F.when(F.col("action") == "review_start", (seq == s) & (d.isNull() | (seq < d)))
        .when(decided, seq == d)
        .when(F.col("action") == "sign_off", d.isNotNull() & (seq > d))
        .otherwise(False)
    )
    status = (
        F.when(d.isNotNull() & (seq >= d), F.col("_outcome"))
        .when(s.isNotNull() & (seq >= s), F.lit("reviewed")).otherwise(F.lit("pending"))
    )
    return (
        actions.join(firsts, "exception_id").withColumn("valid", F.coalesce(valid, F.lit(False)))
        .withColumn("status_after", status).drop("_decision", "_outcome", "_start")
    )


def review_state(actions: DataFrame) -> DataFrame:
    """Final status, reviewer and note per exception."""
    return state_of(judge_reviews(actions))


def state_of(judged: DataFrame) -> DataFrame:
    """The same from actions that have been judged."""
    sets = F.col("valid") & (F.col("action") != "sign_off")
    return judged.groupBy("exception_id").agg(
        F.max_by("status_after", "seq").alias("status"),
        F.max_by("reviewer", F.when(sets, F.col("seq"))).alias("reviewer"),
        F.max_by("note", F.when(sets, F.col("seq"))).alias("review_note"),
        F.count_if(~F.col("valid")).alias("invalid_actions"),
    )


def feedback_events(judged: DataFrame) -> DataFrame:
    """Feedback log rows of decided exceptions, by rule pattern."""
    pattern = exception_pattern(F.col("exception_id"), F.lit("anomaly"))
    return judged.filter(F.col("valid") & F.col("action").isin("approved", "rejected")).select(
        "seq", F.lit("feedback").alias("event"), pattern.alias("pattern"), "action", "reviewer"
    )


def feedback_counts(log: DataFrame) -> DataFrame:
    """Feedback by pattern and action."""
    return log.filter(F.col("event") == "feedback").groupBy("pattern", "action").agg(F.count(F.lit(1)).alias("events"))


def hardening(log: DataFrame) -> DataFrame:
    return log.filter(F.col("event") == "hardening")
