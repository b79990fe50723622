"""Registered queries: change watch, audit log, review and sign-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.catalog.base import Entry, sql
from tallyweave.catalog.views import load, view
from tallyweave.operators import audit
from tallyweave.sources import store

ENTRIES: dict[str, Entry] = {}
_TAPE = ("borrower", "loan_id", "begin_date", "principal_amount", "total_loan_amount", "closure_date", "product")

# Change watch ----------------------------------------------------------------


def _tape(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "loan_tape").select(*_TAPE)


def _before(s: SparkSession, d: str) -> DataFrame:
    """The poll before: one borrower unknown, one with a repeated loan, one with an amount changed, two the same in another order."""
    t = _tape(s, d).orderBy(F.desc("loan_id"))
    again = t.filter((F.col("borrower") == "FURNITURE") & (F.col("loan_id").endswith("1")))
    changed = F.when((F.col("borrower") == "HOUSEHOLD") & F.col("closure_date").isNull(), F.col("total_loan_amount") + 1).otherwise(F.col("total_loan_amount"))
    return t.filter(F.col("borrower") != "BUILDING").withColumn("total_loan_amount", changed).unionByName(again)


ENTRIES["watch_watermark"] = Entry(
    lambda s, d: audit.watermark(_tape(s, d)).select("borrower", "rows", "latest_date"),
    sql("SELECT borrower, count(*) AS rows, max(begin_date) AS latest_date FROM loan_tape GROUP BY borrower"),
)
ENTRIES["watch_changes"] = Entry(
    lambda s, d: audit.changed(audit.watermark(_tape(s, d)), audit.watermark(_before(s, d))).select("borrower", "rows"),
    sql("SELECT borrower, count(*) AS rows FROM loan_tape WHERE borrower IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD') GROUP BY borrower"),
)


def _files(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = load(s, d, "documents")
    files = docs.select(
        F.concat(F.lit("borrower-"), (F.col("doc_id") % 12).cast("string")).alias("borrower"),
        F.concat_ws("@", F.col("doc_id").cast("string"), F.col("n_chars").cast("string")).alias("fingerprint"),
    )
    known = load(s, d, "labels").select(F.col("doc_id").alias("k")).distinct()
    seen = docs.join(known, F.col("doc_id") == F.col("k"), "left_semi").select(
        F.concat(F.lit("borrower-"), (F.col("doc_id") % 12).cast("string")).alias("borrower"),
        F.concat_ws("@", F.col("doc_id").cast("string"), (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).cast("string")).alias("fingerprint"),
    )
    return files, seen


_FILES = "SELECT concat('borrower-', CAST(doc_id % 12 AS VARCHAR)) AS borrower, concat(CAST(doc_id AS VARCHAR), '@', CAST(n_chars AS VARCHAR)) AS fingerprint, doc_id FROM documents"
_NEW = f"SELECT borrower, fingerprint FROM ({_FILES}) f WHERE doc_id % 7 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels)"
ENTRIES["watch_new_files"] = Entry(lambda s, d: audit.new_files(*_files(s, d)), sql(_NEW))


def _triggers(s: SparkSession, d: str) -> DataFrame:
    files, seen = _files(s, d)
    return audit.run_triggers(audit.watermark(_tape(s, d)), audit.watermark(_before(s, d)), files, seen)


ENTRIES["watch_triggers"] = Entry(
    _triggers,
    sql(f"""SELECT borrower, FALSE AS tape_changed, TRUE AS statement_arrived FROM ({_NEW}) n GROUP BY borrower
        UNION ALL SELECT DISTINCT borrower, TRUE, FALSE FROM loan_tape WHERE borrower IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD')"""),
)
ENTRIES["watch_row_digest"] = Entry(
    lambda s, d: load(s, d, "nation").select("n_nationkey", audit.row_digest(load(s, d, "nation")).alias("digest")),
    sql("""SELECT n_nationkey, sha256(concat('{"n_name":"', n_name, '","n_nationkey":', CAST(n_nationkey AS VARCHAR), ',"n_regionkey":', CAST(n_regionkey AS VARCHAR), '}')) AS digest FROM nation"""),
)

# Audit log -------------------------------------------------------------------

ENTRIES["audit_lead_time"] = Entry(
    lambda s, d: audit.lead_times(view(s, d, "run_log")),
    sql("""SELECT st.run_id, started, signed_off, round(epoch(CAST(signed_off AS TIMESTAMP) - CAST(started AS TIMESTAMP)), 3) AS elapsed_seconds
        FROM (SELECT run_id, arg_min(ts, seq) AS started FROM run_log WHERE event = 'run_started' GROUP BY 1) st
        LEFT JOIN (SELECT split_part(exception_id, ':', 1) AS run_id, arg_max(ts, seq) AS signed_off FROM run_log WHERE event = 'sign_off' GROUP BY 1) so USING (run_id)"""),
)
ENTRIES["audit_last_verified"] = Entry(
    lambda s, d: audit.last_verified(view(s, d, "run_log")),
    sql("""SELECT borrower, run_id, ts AS last_verified FROM (SELECT *, row_number() OVER (PARTITION BY borrower ORDER BY ts DESC, seq) AS rn FROM run_log WHERE event = 'run_completed') x WHERE rn = 1"""),
)


def _reports(s: SparkSession, d: str) -> DataFrame:
    """A report per user's run; every fourth names no borrower."""
    u = load(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rid = F.concat(F.lit("r"), F.col("user_id").cast("string"))
    borrower = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("b"), (F.col("user_id") % 9).cast("string")))
    body = F.to_json(F.struct(rid.alias("run_id"), F.lit("done").alias("status"), F.struct(borrower.alias("borrower"), F.col("n").alias("rows")).alias("inputs")))
    return u.select("user_id", rid.alias("run_id"), borrower.alias("borrower"), body.alias("content"))


ENTRIES["audit_run_borrower"] = Entry(
    lambda s, d: audit.run_borrowers(view(s, d, "run_log").filter(F.col("run_id").isNotNull()).select("seq", "run_id"), _reports(s, d)),
    sql("""SELECT seq, run_id, CASE WHEN CAST(substring(run_id, 2) AS BIGINT) % 4 <> 0 THEN concat('b', CAST(CAST(substring(run_id, 2) AS BIGINT) % 9 AS VARCHAR)) ELSE 'uploaded' END AS borrower FROM run_log WHERE run_id IS NOT NULL"""),
)
ENTRIES["audit_signed_off"] = Entry(
    lambda s, d: audit.signed_off(view(s, d, "run_log").filter(F.col("exception_id").isNotNull()).select(F.col("exception_id").alias("id")).distinct(), view(s, d, "run_log")),
    sql("""SELECT DISTINCT exception_id AS id, exception_id IN (SELECT exception_id FROM run_log WHERE event = 'sign_off' AND approved AND exception_id IS NOT NULL) AS signed_off FROM run_log WHERE exception_id IS NOT NULL"""),
)
ENTRIES["audit_last_events"] = Entry(
    lambda s, d: audit.last_events(view(s, d, "run_log")).select("seq", "event"), sql("SELECT seq, event FROM run_log ORDER BY seq DESC LIMIT 100")
)
ENTRIES["audit_hardening"] = Entry(
    lambda s, d: audit.hardening(view(s, d, "run_log")).select("seq", "pattern"), sql("SELECT seq, pattern FROM run_log WHERE event = 'hardening'")
)
ENTRIES["audit_past_runs"] = Entry(
    lambda s, d: store.past_runs(view(s, d, "run_log").filter(F.col("run_id").isNotNull())), sql("SELECT DISTINCT run_id FROM run_log WHERE run_id IS NOT NULL")
)


def _signoffs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, existing, reports): repeats, blanks, runs signed before and runs without a report."""
    r = _reports(s, d).withColumn("borrower", F.coalesce("borrower", F.lit("uploaded")))
    k = F.col("user_id")
    requests = r.select("borrower", "run_id", F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" officer "), k.cast("string"))).alias("signed_by"), F.lit("2024-03-01").alias("signed_at"), F.lit(" ok ").alias("note"))
    later = requests.withColumns({"signed_at": F.lit("2024-03-02"), "signed_by": F.when(F.col("signed_by") == " ", " ").otherwise(F.lit("late"))})
    existing = r.filter(k % 6 == 0).select("borrower", "run_id", F.sha2("content", 256).alias("report_sha256"))
    return requests.unionByName(later), existing, r.filter(k % 7 != 0).select("borrower", "run_id", "content")


_U = "SELECT DISTINCT user_id AS u, concat('r', CAST(user_id AS VARCHAR)) AS run_id, CASE WHEN user_id % 4 <> 0 THEN concat('b', CAST(user_id % 9 AS VARCHAR)) ELSE 'uploaded' END AS borrower FROM events"
ENTRIES["audit_signoff_accept"] = Entry(
    lambda s, d: store.new_signoffs(*_signoffs(s, d))[0].select("run_id", "borrower", "signed_by", "signed_at", "note"),
    sql(f"SELECT run_id, borrower, concat('officer ', CAST(u AS VARCHAR)) AS signed_by, '2024-03-01' AS signed_at, 'ok' AS note FROM ({_U}) x WHERE u % 5 <> 0 AND u % 6 <> 0 AND u % 7 <> 0"),
)
ENTRIES["audit_signoff_refuse"] = Entry(
    lambda s, d: store.new_signoffs(*_signoffs(s, d))[1],
    sql(f"SELECT run_id, borrower, CASE WHEN u % 5 = 0 THEN 'no signer' WHEN u % 6 = 0 THEN 'already signed off' ELSE 'no report' END AS reason FROM ({_U}) x WHERE u % 5 = 0 OR u % 6 = 0 OR u % 7 = 0"),
)


def _intact(s: SparkSession, d: str) -> DataFrame:
    """Reports edited after signing, and reports gone."""
    r = _reports(s, d).withColumn("borrower", F.coalesce("borrower", F.lit("uploaded")))
    signed = r.select("borrower", "run_id", F.sha2("content", 256).alias("report_sha256"))
    now = r.filter(F.col("user_id") % 11 != 0).withColumn("content", F.when(F.col("user_id") % 3 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    return audit.verify_signoffs(signed, now).select("run_id", "intact")


ENTRIES["audit_signoff_intact"] = Entry(_intact, sql(f"SELECT run_id, u % 11 <> 0 AND u % 3 <> 0 AS intact FROM ({_U}) x"))

# Review ----------------------------------------------------------------------

_FOLD = """SELECT a.*, CASE action WHEN 'review_start' THEN seq = st AND (dec IS NULL OR seq < dec) WHEN 'sign_off' THEN dec IS NOT NULL AND seq > dec ELSE seq = dec END AS valid,
 CASE WHEN dec IS NOT NULL AND seq >= dec THEN outcome WHEN st IS NOT NULL AND seq >= st THEN 'reviewed' ELSE 'pending' END AS status_after FROM review_actions a
 JOIN (SELECT exception_id AS e, min(seq) FILTER (action IN ('approved', 'rejected')) AS dec, arg_min(action, seq) FILTER (action IN ('approved', 'rejected')) AS outcome, min(seq) FILTER (action = 'review_start') AS st FROM review_actions GROUP BY 1) f ON a.exception_id = f.e"""
ENTRIES["review_transitions"] = Entry(
    lambda s, d: audit.judge_reviews(view(s, d, "review_actions")).select("seq", "exception_id", "action", "valid", "status_after"),
    sql(f"SELECT seq, exception_id, action, valid, status_after FROM ({_FOLD}) x"),
)
ENTRIES["review_state"] = Entry(
    lambda s, d: audit.review_state(view(s, d, "review_actions")),
    sql(f"""SELECT exception_id, arg_max(status_after, seq) AS status, arg_max(reviewer, seq) FILTER (valid AND action <> 'sign_off') AS reviewer, arg_max(note, seq) FILTER (valid AND action <> 'sign_off') AS review_note,
        count(*) FILTER (NOT valid) AS invalid_actions FROM ({_FOLD}) x GROUP BY exception_id"""),
)
ENTRIES["review_feedback"] = Entry(
    lambda s, d: audit.feedback_counts(audit.feedback_events(audit.judge_reviews(view(s, d, "review_actions")))),
    sql(f"SELECT split_part(exception_id, ':', 3) AS pattern, action, count(*) AS events FROM ({_FOLD}) x WHERE valid AND action IN ('approved', 'rejected') GROUP BY 1, 2"),
)
