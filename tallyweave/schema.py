"""Shared row shapes."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTION = T.StructType(
    [
        T.StructField("borrower", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("value_date", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("direction", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("account_ref", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)

# Exceptions carry a count and the first evidence key; the full evidence is its
# own relation (exception_id, evidence_key), because one duplicate group can
# hold a large share of all rows and must never become one array.
EXCEPTION_COLUMNS = (
    "borrower", "id", "kind", "rule", "severity", "description", "evidence_count", "first_evidence", "status",
)
EVIDENCE_COLUMNS = ("borrower", "exception_id", "evidence_key")

RUN_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("exception_id", T.StringType()),
        T.StructField("borrower", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("reviewer", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("approved", T.BooleanType()),
        T.StructField("effect", T.StringType()),
        T.StructField("change_made", T.StringType()),
        T.StructField("ts", T.StringType()),
    ]
)

DIR_IN = "in"
DIR_OUT = "out"
