"""Registered queries: anomaly rules, assets, ranking and routing."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.catalog.base import LIMITS, Entry, all_rows, balances, bank, ledger, rates, sql, COLUMNS
from tallyweave.catalog.figures import PAIRS, breaches, num
from tallyweave.catalog.views import view
from tallyweave.functions.text import containment_verdict
from tallyweave.operators import aggregate, assets, rank, rules
from tallyweave.plans import verification
from tallyweave.sources import store

ENTRIES: dict[str, Entry] = {}
_SHOWN = ("borrower", "id", "rule", "severity", "description", "evidence_count", "first_evidence")


def _found(s: SparkSession, d: str, name: str) -> rules.Findings:
    return rules.detect(all_rows(s, d), LIMITS, [name])


# One view of all rows as the rules see them, and one of the medians.
RX = "SELECT borrower, key, seq, value_date, direction, coalesce(description, '') AS description, trim(coalesce(account_ref, '')) AS account_ref, sheet, amount_base AS amt FROM all_fx"
MED = "SELECT borrower, median(amt) AS med FROM rx GROUP BY borrower"
ROUND = "CASE WHEN amt <= 0 THEN 0.0 WHEN amt % 1000 = 0 THEN 1.0 WHEN amt % 100 = 0 THEN 0.5 ELSE 0.0 END"
SQL: dict[str, str] = {}
SQL["dup"] = f"""SELECT borrower, concat(borrower, ':anom:dup:', k) AS id, 'dup' AS rule, 0.5 AS severity,
 concat('Duplicate transaction: ''', description, ''' ', {num('CAST(c AS DOUBLE)')}, ' on ', day, ' appears ', CAST(n AS VARCHAR), 'x') AS description, n AS evidence_count, k AS first_evidence
 FROM (SELECT borrower, description, CAST(amt AS DECIMAL(28,2)) AS c, coalesce(value_date, '') AS day, count(*) AS n, arg_min(key, seq) AS k FROM rx GROUP BY 1, 2, 3, 4 HAVING count(*) > 1) g"""


def _single(rule: str, severity: str, text: str, source: str, where: str) -> str:
    return f"""SELECT borrower, concat(borrower, ':anom:{rule}:', key) AS id, '{rule}' AS rule, {severity} AS severity, {text} AS description, 1 AS evidence_count, key AS first_evidence FROM {source} WHERE {where}"""


_Q = "' (''', description, ''')'"
SQL["round"] = _single(
    "round", f"round(least(1.0, 0.2 + 0.4 * {ROUND} + 0.2 * least(1.0, amt / (med * 10.0))), 4)",
    f"concat('Round-dollar amount ', {num('amt')}, ' is ', format('{{:.1f}}', amt / med), 'x the median ', {num('med')}, {_Q})",
    "rx JOIN med USING (borrower)", f"{ROUND} > 0 AND med > 0 AND amt > med * 3.0",
)
SQL["vol"] = _single(
    "vol", "0.6", f"concat('Volume anomaly: ', {num('amt')}, ' > 10x median ', {num('med')}, {_Q})", "rx JOIN med USING (borrower)", "med > 0 AND amt > med * 10.0"
)
SQL["offhours"] = _single(
    "offhours", "0.5", f"concat('Off-hours transaction at ', lpad(CAST(h AS VARCHAR), 2, '0'), ':00 (outside 22:00-05:00 business window): ', {num('amt')}, {_Q})",
    "(SELECT *, CAST(substring(value_date, 12, 2) AS INTEGER) AS h FROM rx WHERE length(value_date) > 10) t", "h >= 22 OR h < 5",
)
SQL["seqjump"] = _single(
    "seqjump", "0.75",
    f"concat('Pattern break on account ''', account_ref, ''': ', {num('amt')}, ' is ', format('{{:.1f}}', amt / mean), 'x its own trailing average ', {num('mean')}, ' (last ', CAST(n AS VARCHAR), ' txns)', {_Q})",
    """(SELECT *, CAST(s AS DOUBLE) / n AS mean FROM (SELECT *, count(*) OVER w AS n, sum(CAST(amt AS DECIMAL(28,10))) OVER w AS s FROM rx WHERE account_ref <> ''
        WINDOW w AS (PARTITION BY borrower, sheet, account_ref ORDER BY CAST(value_date AS TIMESTAMP), value_date, seq, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) q) z""",
    "n >= 3 AND mean > 0 AND amt > mean * 10.0",
)
SQL["roundtrip"] = """SELECT d.borrower, concat(d.borrower, ':anom:roundtrip:', d.loan) AS id, 'roundtrip' AS rule, 0.8 AS severity,
 concat('Same-day disbursement and collection for loan ', d.loan, ' on ', d.day, ' (round-tripping)') AS description, 2 AS evidence_count, d.key AS first_evidence
 FROM (SELECT borrower, substring(description, 14) AS loan, arg_max(value_date, seq) AS day, arg_max(key, seq) AS key FROM rx WHERE description LIKE 'disbursement:%' GROUP BY 1, 2) d
 JOIN (SELECT borrower, substring(description, 13) AS loan, arg_min(value_date, seq) AS day, arg_min(key, seq) AS key FROM rx WHERE description LIKE 'collections:%' GROUP BY 1, 2) c
 ON d.borrower = c.borrower AND d.loan = c.loan AND d.day = c.day"""
_GROUPED = """SELECT borrower, account_ref, substring(value_date, 1, 10) AS day, count(*) AS n, list_sort(list(amt))[count(*) // 2 + 1] AS mid, list(amt) AS amts,
 sum(CAST(amt AS DECIMAL(28,10))) AS total, arg_min(key, seq) AS k FROM rx WHERE account_ref <> '' GROUP BY 1, 2, 3 HAVING count(*) >= 3"""
SQL["microsplit"] = f"""SELECT borrower, concat(borrower, ':anom:microsplit:', account_ref, '|', day) AS id, 'microsplit' AS rule, 0.85 AS severity,
 concat('Possible structuring on account ''', account_ref, ''' on ', day, ': ', CAST(n AS VARCHAR), ' similar-size transactions (~', {num('mid')}, ' each) totaling ', {num('CAST(CAST(total AS DECIMAL(38,4)) AS DOUBLE)')}) AS description,
 n AS evidence_count, k AS first_evidence FROM ({_GROUPED}) g JOIN med USING (borrower)
 WHERE mid > 0 AND med > 0 AND CAST(total AS DOUBLE) > med * 3.0 AND len(list_filter(amts, lambda a: abs(a - mid) > mid * 0.15)) = 0"""
NAMES = {"dup": "anom_duplicate", "round": "anom_round", "roundtrip": "anom_roundtrip", "vol": "anom_volume", "seqjump": "anom_seqjump", "offhours": "anom_offhours", "microsplit": "anom_microsplit"}
for _rule, _name in NAMES.items():
    ENTRIES[_name] = Entry(lambda s, d, r=_rule: _found(s, d, r).exceptions.select(*_SHOWN), sql(SQL[_rule], rx=RX, med=MED))
ENTRIES["anom_duplicate_evidence"] = Entry(
    lambda s, d: _found(s, d, "dup").evidence,
    sql("""SELECT borrower, concat(borrower, ':anom:dup:', k) AS exception_id, key AS evidence_key FROM (
        SELECT borrower, key, count(*) OVER w AS n, first_value(key) OVER (PARTITION BY borrower, description, CAST(amt AS DECIMAL(28,2)), value_date ORDER BY seq) AS k FROM rx
        WINDOW w AS (PARTITION BY borrower, description, CAST(amt AS DECIMAL(28,2)), value_date)) g WHERE n > 1""", rx=RX),
)
ENTRIES["anom_structuring_evidence"] = Entry(
    lambda s, d: _found(s, d, "microsplit").evidence,
    sql(f"SELECT rx.borrower, m.id AS exception_id, rx.key AS evidence_key FROM rx JOIN ({SQL['microsplit']}) m ON rx.borrower = m.borrower AND concat(rx.account_ref, '|', substring(rx.value_date, 1, 10)) = split_part(m.id, ':', 4)", rx=RX, med=MED),
)

# Assets ----------------------------------------------------------------------

_ASSET = """SELECT e.borrower, concat('asset:', f, ':', plate) AS id, f AS rule, CASE f WHEN 'not_checked' THEN 0.9 WHEN 'check_failed' THEN 0.7 ELSE 0.85 END AS severity,
 CASE f WHEN 'not_checked' THEN concat('Asset ', plate, ' (', CASE WHEN borrower = '' THEN 'unknown borrower' ELSE borrower END, ') has no registry check on file')
  WHEN 'check_failed' THEN concat('Registry check for asset ', plate, ' returned no usable record (status: ''', CASE WHEN r_status = '' THEN 'no data' ELSE r_status END, ''')')
  ELSE concat('Asset ', plate, ': registry owner ''', r_owner, ''' does not match the expected owner ''', trim(expected_owner), '''') END AS description FROM (
 SELECT e.*, trim(r.status) AS r_status, trim(r.owner) AS r_owner, CASE WHEN r.plate IS NULL THEN 'not_checked' WHEN lower(trim(status)) LIKE 'error%' OR (trim(owner) = '' AND lower(trim(status)) IN ('no data', '')) THEN 'check_failed'
   WHEN expected_owner <> '' AND owner <> '' AND regexp_replace(lower(trim(expected_owner)), '\\s+', ' ', 'g') <> regexp_replace(lower(trim(owner)), '\\s+', ' ', 'g') THEN 'owner_mismatch' END AS f
 FROM assets_expected e LEFT JOIN registry_results r ON e.plate = r.plate) e WHERE f IS NOT NULL"""


def _asset_findings(s: SparkSession, d: str) -> DataFrame:
    return assets.verify(view(s, d, "assets_expected"), view(s, d, "registry_results"))


ENTRIES["asset_existence"] = Entry(lambda s, d: _asset_findings(s, d).select("borrower", "id", "rule", "severity", "description"), sql(_ASSET))
ENTRIES["asset_evidence"] = Entry(
    lambda s, d: assets.evidence(_asset_findings(s, d)).select("exception_id", "evidence_key"),
    sql(f"""SELECT id AS exception_id, concat('expected:', split_part(id, ':', 3)) AS evidence_key FROM ({_ASSET}) a WHERE rule <> 'check_failed'
        UNION ALL SELECT id, concat('registry:', split_part(id, ':', 3)) FROM ({_ASSET}) a WHERE rule <> 'not_checked'"""),
)
ENTRIES["asset_coverage"] = Entry(
    lambda s, d: assets.checked_coverage(view(s, d, "assets_expected"), view(s, d, "registry_results")),
    sql("""SELECT count(r.plate) AS rows_ingested, count(*) AS population_size, round(count(r.plate) * 100.0 / count(*), 2) AS coverage_pct FROM assets_expected e LEFT JOIN registry_results r ON e.plate = r.plate"""),
)
_VERDICT = r"""CASE WHEN brand = '' OR model = '' THEN 'No data' WHEN e = '' THEN 'Mismatch' WHEN contains(concat(b, m), e) OR contains(e, concat(b, m)) THEN 'Match'
 WHEN contains(e, b) OR contains(e, m) THEN 'Partial Match' ELSE 'Mismatch' END"""
_VERDICTS = rf"""SELECT plate, borrower, expected_owner, expected_vehicle, CASE WHEN hit IS NULL THEN '(not checked)' WHEN status <> '' THEN status WHEN brand <> '' OR owner <> '' THEN 'Found' ELSE 'No data' END AS status,
 coalesce(trim(owner), '') AS owner, brand, model, CASE WHEN expected_vehicle = '' THEN '' ELSE {_VERDICT} END AS verdict FROM (
 SELECT e.plate, e.borrower, e.expected_owner, e.expected_vehicle, r.plate AS hit, r.status, r.owner, coalesce(r.brand, '') AS brand, coalesce(r.model, '') AS model,
  regexp_replace(lower(e.expected_vehicle), '[^a-z0-9]', '', 'g') AS e, regexp_replace(lower(coalesce(r.brand, '')), '[^a-z0-9]', '', 'g') AS b, regexp_replace(lower(coalesce(r.model, '')), '[^a-z0-9]', '', 'g') AS m
 FROM assets_expected e LEFT JOIN registry_results r ON e.plate = r.plate) x"""


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    return assets.verdicts(view(s, d, "assets_expected"), view(s, d, "registry_results"))


ENTRIES["asset_verdicts"] = Entry(_verdicts, sql(_VERDICTS))
ENTRIES["asset_vehicle_verdict"] = Entry(
    lambda s, d: _verdicts(s, d).select("plate", containment_verdict(F.col("expected_vehicle"), F.col("brand"), F.col("model")).alias("verdict")),
    sql(f"SELECT plate, {_VERDICT} AS verdict FROM ({_VERDICTS.split(' FROM (', 1)[1]}"),
)
ENTRIES["asset_status_counts"] = Entry(
    lambda s, d: aggregate.status_counts(view(s, d, "registry_results")),
    sql("SELECT count(*) FILTER (status = 'Found') AS found, count(*) FILTER (status = 'No data') AS no_data, count(*) FILTER (status LIKE 'Error%') AS errors FROM registry_results"),
)
ENTRIES["asset_sheet"] = Entry(
    lambda s, d: assets.verification_sheet(_verdicts(s, d)).select("Plate", "Brand", "Model", "Year", "Status", "Verdict", F.col("Expected vehicle").alias("Expected")),
    sql(f"""SELECT plate AS "Plate", brand AS "Brand", model AS "Model", '' AS "Year", status AS "Status", verdict AS "Verdict", expected_vehicle AS "Expected" FROM ({_VERDICTS}) v"""),
)

# Ranking and routing ---------------------------------------------------------


@lru_cache(maxsize=4)
def _run(app: str, s: SparkSession, d: str, state: tuple) -> verification.Verification:
    return verification.verify(
        verification.Inputs(tape=view(s, d, "loan_tape"), bank=bank(s, d), ledger=ledger(s, d), rates=rates(s, d), balances=balances(s, d),
                            register=view(s, d, "assets_expected"), registry=view(s, d, "registry_results")), LIMITS, COLUMNS
    )


def run(s: SparkSession, d: str) -> verification.Verification:
    """One verification per application and state of the data: the lists and reports below read its written tables.

    The state is the length and time of change of the input files, so changed tables are verified anew.
    """
    hadoop, conf = s._jvm.org.apache.hadoop.fs, s.sparkContext._jsc.hadoopConfiguration()
    state = []
    for t in ("customer", "orders", "lineitem", "part", "supplier", "events"):
        path = hadoop.Path(f"{d}/{t}.parquet")
        fs = path.getFileSystem(conf)
        state += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)] if fs.exists(path) else []
    return _run(s.sparkContext.applicationId, s, d, tuple(state))


_ANOM = " UNION ALL ".join(f"SELECT borrower, id, rule, 'anomaly' AS kind, severity, description FROM ({q}) r" for q in SQL.values())
FOUND = f"{_ANOM} UNION ALL SELECT borrower, id, rule, 'reconciliation', severity, description FROM ({breaches('pairs')}) b UNION ALL SELECT borrower, id, rule, 'asset', severity, description FROM ({_ASSET}) a"
RANKED = """SELECT borrower, id, rule, kind, s AS severity, severity AS severity_raw, concat(description, ' [severity=', format('{:.2f}', s), ']') AS description FROM (
 SELECT *, round(CASE WHEN hi = lo THEN 0 ELSE (severity - lo) / (hi - lo) END, 4) AS s FROM (SELECT *, min(severity) OVER (PARTITION BY borrower) AS lo, max(severity) OVER (PARTITION BY borrower) AS hi FROM found) f) g"""
_STEPS = {"rx": RX, "med": MED, "pairs": PAIRS, "found": FOUND, "ranked": RANKED}
_RANKED_COLS = ("borrower", "id", "rule", "kind", "severity", "severity_raw", "description")
ENTRIES["rank_minmax"] = Entry(lambda s, d: run(s, d).exceptions.select(*_RANKED_COLS), sql("SELECT * FROM ranked", **_STEPS))
ENTRIES["rank_forensic"] = Entry(lambda s, d: rank.forensic(run(s, d).exceptions, LIMITS).select("id", "severity"), sql("SELECT id, severity FROM ranked WHERE severity >= 0.75", **_STEPS))
ENTRIES["rank_referrals"] = Entry(lambda s, d: rank.referrals(run(s, d).exceptions).select("id", "rule"), sql("SELECT id, rule FROM ranked WHERE rule IN ('roundtrip', 'microsplit', 'seqjump')", **_STEPS))
ENTRIES["rank_top25"] = Entry(
    lambda s, d: rank.top(run(s, d).exceptions).select("id", "severity", "exception_count_total", "exceptions_truncated"),
    sql("SELECT id, severity, (SELECT count(*) FROM ranked) AS exception_count_total, (SELECT count(*) FROM ranked) > 25 AS exceptions_truncated FROM ranked ORDER BY severity DESC, id LIMIT 25", **_STEPS),
)
ENTRIES["rank_top20"] = Entry(
    lambda s, d: rank.top_for_report(run(s, d).exceptions).select("id", "severity"), sql("SELECT id, severity FROM ranked ORDER BY severity DESC, id DESC LIMIT 20", **_STEPS)
)
ENTRIES["rank_ordered"] = Entry(
    lambda s, d: rank.ordered(run(s, d).exceptions).select("id", "severity"), sql("SELECT id, severity FROM ranked ORDER BY severity DESC, id", **_STEPS)
)
ENTRIES["rank_by_kind"] = Entry(lambda s, d: rank.by_kind(run(s, d).exceptions), sql("SELECT kind, count(*) AS exceptions FROM ranked GROUP BY kind", **_STEPS))
ENTRIES["rank_by_pattern"] = Entry(
    lambda s, d: rank.by_pattern(run(s, d).exceptions), sql("SELECT replace(rule, 'recon:', '') AS pattern, count(*) AS exceptions FROM ranked GROUP BY 1", **_STEPS)
)


def _header(v: verification.Verification) -> DataFrame:
    return store.report_header(v.reported, v.exceptions, LIMITS).select("borrower", "collections", "exception_count", "forensic_count", "referral_count")


ENTRIES["report_header"] = Entry(
    lambda s, d: _header(run(s, d)),
    sql("""SELECT p.borrower, rep_collections AS collections, count(*) AS exception_count, count(*) FILTER (severity >= 0.75) AS forensic_count, count(*) FILTER (rule IN ('roundtrip', 'microsplit', 'seqjump')) AS referral_count
        FROM pairs p JOIN ranked r ON p.borrower = r.borrower GROUP BY 1, 2""", **_STEPS),
)
