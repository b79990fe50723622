"""Registered queries: sources, mapping, predicates and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.catalog.base import CATEGORIES, COLUMNS, OUTSTANDING, PAID, Entry, bank, rates, sql, tape_events
from tallyweave.catalog.views import load, view
from tallyweave.config import TapeColumns
from tallyweave.functions import dates, money as money_fn, text
from tallyweave.operators import audit, fx, grids, normalize, registry_json, statements
from tallyweave.operators.rules.single import roundness
from tallyweave.session import ensure_checkpoint_dir, settle, sweep
from tallyweave.sources import loading, tables

ENTRIES: dict[str, Entry] = {}
CANON = ["borrower", "key", "sheet", "value_date", "amount", "direction", "currency", "description", "account_ref", "seq"]
CANON_SQL = ", ".join(CANON)


# Sources ---------------------------------------------------------------------

def _tape_scan(spark: SparkSession, sf: str) -> DataFrame:
    tape = view(spark, sf, "loan_tape")
    return tables.scan_tape(tape, borrower="BUILDING", date_from="1996-01-01", date_to="1997-12-31").select(
        "borrower", "loan_id", "begin_date", "principal_amount"
    )


ENTRIES["src_tape_scan"] = Entry(
    _tape_scan,
    sql("SELECT borrower, loan_id, begin_date, principal_amount FROM loan_tape WHERE borrower='BUILDING' AND begin_date BETWEEN '1996-01-01' AND '1997-12-31'"),
)
ENTRIES["src_borrowers"] = Entry(
    lambda s, d: tables.list_borrowers(view(s, d, "loan_tape")), sql("SELECT DISTINCT borrower FROM loan_tape ORDER BY borrower")
)


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    """Statement exports as grids: a title row, a blank row, the header, then the data; one per order."""
    rows = settle(view(spark, sf, "statement_export"))
    sweep(spark)
    data = rows.select(
        F.col("account_ref").alias("file"), (F.row_number().over(_per_file()) + 2).cast("long").alias("seq"),
        F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in _GRID]).alias("cells"),
    )
    files = rows.select(F.col("account_ref").alias("file")).distinct()
    top = F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.array(F.lit("Statement of moves"), F.lit("")).alias("cells")),
        F.struct(F.lit(1).cast("long").alias("seq"), F.array(F.lit(""), F.lit("")).alias("cells")),
        F.struct(F.lit(2).cast("long").alias("seq"), F.array(*[F.lit(c) for c in _GRID]).alias("cells")),
    )
    return files.select("file", F.inline(top)).unionByName(data)


_GRID = ["Date", "Transaction Code", "Description", "Debit (-)", "Credit (+)", "Running Balance"]


def _per_file():
    from pyspark.sql import Window

    return Window.partitionBy("account_ref").orderBy("seq", "Running Balance")


def _grid_header(spark: SparkSession, sf: str) -> DataFrame:
    t = grids.with_header(_grid(spark, sf))
    return t.select(
        "file", "seq", F.array_join("header", "|").alias("header"), grids.cell_named("transaction code").alias("code"),
        grids.cell_named("balance").alias("balance"),
    )


ENTRIES["src_grid_header"] = Entry(
    _grid_header,
    sql("""SELECT account_ref AS file, row_number() OVER (PARTITION BY account_ref ORDER BY seq, "Running Balance") - 1 AS seq,
        'Date|Transaction Code|Description|Debit (-)|Credit (+)|Running Balance' AS header, "Transaction Code" AS code, "Running Balance" AS balance FROM statement_export"""),
)


def _stitched(spark: SparkSession, sf: str) -> DataFrame:
    """Each export cut in two tables, the header repeated, behind a summary table without rows."""
    g = settle(_grid(spark, sf).filter(F.col("seq") >= 2))
    sweep(spark)
    parts = g.withColumn("table_no", F.when((F.col("seq") > 4), 2).otherwise(1))
    late = parts.filter(F.col("table_no") == 2).select("file", "table_no").distinct()
    repeated = late.select("file", "table_no", F.lit(2).cast("long").alias("seq"), F.array(*[F.lit(c) for c in _GRID]).alias("cells"))
    summary = parts.select("file").distinct().select("file", F.lit(0).alias("table_no"), F.lit(2).cast("long").alias("seq"), F.array(F.lit("Starting Balance"), F.lit("0.00")).alias("cells"))
    from pyspark.sql import Window

    numbered = parts.unionByName(repeated).unionByName(summary).withColumn(
        "row_no", F.row_number().over(Window.partitionBy("file", "table_no").orderBy("seq")) - 1
    )
    numbered = settle(numbered)
    sweep(spark, g)
    t = grids.stitch(numbered)
    value = lambda name: F.get(F.filter("row", lambda p: p["column"] == name), F.lit(0))["value"]
    return t.select("file", value("Transaction Code").alias("code"), value("Running Balance").alias("balance"))


ENTRIES["src_table_stitch"] = Entry(
    _stitched, sql("""SELECT account_ref AS file, "Transaction Code" AS code, "Running Balance" AS balance FROM statement_export""")
)


def _registry_latest(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "registry_results").select("plate", "status", "owner", "seq")
    old = r.withColumn("status", F.lit("stale")).withColumn("file_order", F.lit(1))
    new = r.withColumn("file_order", F.lit(2))
    again = new.withColumn("seq", F.col("seq") + 1000000000).withColumn("owner", F.upper("owner"))
    return tables.latest_results(old.unionByName(new).unionByName(again))


ENTRIES["src_registry_latest"] = Entry(_registry_latest, sql("SELECT plate, status, upper(owner) AS owner FROM registry_results"))


def _registry_json(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier")
    k = F.col("s_suppkey").cast("string")
    inner = F.struct(F.concat(F.lit("inner-"), k).alias("marca"), F.concat(F.lit("L"), k).alias("linea"), F.lit("2019").alias("modelo"), F.concat(F.lit("VIN"), k).alias("no-Vin"))
    doc = F.to_json(
        F.struct(
            F.lit("ok").alias("message"),
            F.struct(
                F.concat(F.lit("PL-"), k).alias("plate"), F.array(F.struct(F.lit("deep").alias("color")), F.struct(F.lit("later").alias("color"))).alias("list"),
                F.struct(inner.alias("vehicle"), F.lit("").alias("Estado Del Vehiculo")).alias("wrap"),
                F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Marca "), k)).alias("marca"),
            ).alias("data"),
        )
    )
    docs = s.select(F.col("s_suppkey").alias("plate_id"), F.lit("CO").alias("country"), doc.alias("response"))
    return registry_json.canonical_records(docs, "country", "plate_id")


ENTRIES["src_registry_json"] = Entry(
    _registry_json,
    sql("""SELECT s_suppkey AS lookup, 'CO' AS country, concat('PL-', CAST(s_suppkey AS VARCHAR)) AS plate,
        CASE WHEN s_suppkey % 2 = 0 THEN concat('Marca ', CAST(s_suppkey AS VARCHAR)) ELSE concat('inner-', CAST(s_suppkey AS VARCHAR)) END AS brand,
        concat('L', CAST(s_suppkey AS VARCHAR)) AS model, '2019' AS year, concat('VIN', CAST(s_suppkey AS VARCHAR)) AS vin, '' AS owner, 'deep' AS color, '' AS status FROM supplier"""),
)


def _inbox(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    kinds = F.array(*[F.lit(x) for x in ("pdf", "CSV", "docx", "xlsx", "txt", "tsv")])
    files = d.select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"),
        F.concat(F.lit("statement."), F.col("source"), F.lit("."), F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int"))).alias("name"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0")).alias("modified_at"),
    )
    return tables.inbox_of(files)


ENTRIES["src_inbox"] = Entry(
    _inbox,
    sql("""SELECT *, concat(file_id, '@', modified_at) AS fingerprint FROM (
        SELECT concat('f', CAST(doc_id AS VARCHAR)) AS file_id, concat('statement.', source, '.', list_extract(['pdf','CSV','docx','xlsx','txt','tsv'], CAST(doc_id % 6 + 1 AS INTEGER))) AS name,
        concat('2024-01-', lpad(CAST(n_chars % 28 + 1 AS VARCHAR), 2, '0')) AS modified_at FROM documents) f
        WHERE name NOT LIKE '%.docx' AND name NOT LIKE '%.txt'"""),
)


def _fx_feed(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "customer")
    """Three days of every code, and KES, which the static rates have too, from all customers."""
    day = F.explode(F.sequence(F.lit(1), F.lit(3)))
    body = F.to_json(F.struct(F.concat(F.lit("2024-05-0"), F.col("day").cast("string")).alias("date"), F.map_from_arrays(
        F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("kes")),
        F.array((F.col("c_custkey") % 50 * F.col("day")).cast("double"), F.lit(128.0) * F.col("day"))).alias("usd")))
    live = fx.feed_rates(n.withColumn("day", day).select(body.alias("json")))
    return fx.overlay_rates(live, rates(spark, sf))


ENTRIES["src_fx_feed"] = Entry(
    _fx_feed,
    sql("""SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS currency, 1.0 / CAST(c_custkey % 50 * 3 AS DOUBLE) AS rate, 'live' AS source FROM customer WHERE c_custkey % 50 > 0
        UNION ALL SELECT 'KES', 1.0 / 384.0, 'live'
        UNION ALL SELECT currency, rate, 'static' FROM fx_rates WHERE currency <> 'KES'"""),
)

# Mapping ---------------------------------------------------------------------

ENTRIES["map_tape_events"] = Entry(
    lambda s, d: tape_events(s, d).select(*CANON), sql(f"SELECT {CANON_SQL} FROM tape_tx")
)


def _renamed_tape(spark: SparkSession, sf: str) -> DataFrame:
    """A tape under a lender's own names, money as text with thousands separators."""
    t = view(spark, sf, "loan_tape")
    own = t.select(
        "borrower", "seq", F.col("loan_id").alias("loanid"), F.col("begin_date").alias("origination_date"),
        F.format_number("principal_amount", 2).alias("principal"), F.format_number("total_loan_amount", 2).alias("total loan"),
        F.col("principal_outstanding").cast("string").alias("principal_outstanding"), "interest_outstanding", "fee_outstanding", "closure_date", "company_due_date", "currency",
    )

    config = TapeColumns(overrides={"lender": {"loan_id": "loanid", "begin_date": "origination_date", "principal_amount": "principal", "total_loan_amount": "total loan"}})
    return normalize.tape_events(normalize.resolve_tape(own, config.resolve("lender")), COLUMNS).select(*CANON)


_RENAMED = """
SELECT borrower, concat('tape:', borrower, ':', loan_id, ':disb') AS key, 'tape' AS sheet, begin_date AS value_date, abs(principal_amount) AS amount,
       'out' AS direction, currency, concat('disbursement:', loan_id) AS description, borrower AS account_ref, seq * 2 AS seq FROM loan_tape WHERE principal_amount <> 0
UNION ALL
SELECT borrower, concat('tape:', borrower, ':', loan_id, ':coll'), 'tape', coalesce(closure_date, company_due_date, begin_date), {paid}, 'in', currency,
       concat('collections:', loan_id), borrower, seq * 2 + 1 FROM loan_tape WHERE {paid} <> 0
"""
_NO_PENALTY = PAID.replace(OUTSTANDING, OUTSTANDING.rsplit(" + ", 1)[0] + ")")
ENTRIES["map_column_resolve"] = Entry(_renamed_tape, sql(_RENAMED.format(paid=_NO_PENALTY)))


def _statement_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, "statement_export")
    roles = normalize.detect_roles([c for c in df.columns if c not in ("account_ref", "seq")])
    return normalize.statement_rows(df, roles).select("key", "value_date", "amount", "direction", "description", "account_ref", "seq")


ENTRIES["map_statement_rows"] = Entry(
    _statement_rows,
    sql("""SELECT concat('bank:', account_ref, ':', CAST(seq AS VARCHAR)) AS key, value_date, amount, direction, description, account_ref, seq FROM line_moves WHERE amount <> 0"""),
)


def _signed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A single signed amount column on mobile statements, with blanks and zeros to drop."""
    e = view(spark, sf, "bank_events").select(
        F.col("account_ref"), F.col("event_id").alias("seq"), F.col("value_date").alias("date"),
        F.when(F.col("event_id") % 13 == 0, "").when(F.col("event_id") % 17 == 0, "0.00")
        .otherwise(F.concat(F.when(F.col("direction") == "out", "-").otherwise(""), F.format_number("amount", 2))).alias("amount"),
        F.col("description").alias("narration"), "currency",
    )
    return normalize.statement_rows(e, normalize.detect_roles(["date", "amount", "narration"]), sheet="mobile_money").select(
        "key", "sheet", "value_date", "amount", "direction", "currency", "description"
    )


ENTRIES["map_signed_rows"] = Entry(
    _signed_rows,
    sql("""SELECT concat('bank:', account_ref, ':', CAST(event_id AS VARCHAR)) AS key, 'mobile_money' AS sheet, value_date, amount, direction, currency, description
        FROM bank_events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND amount <> 0"""),
)
ENTRIES["map_ledger_rows"] = Entry(
    lambda s, d: normalize.simple_rows(view(s, d, "ledger"), sheet="ledger").select(*CANON), sql(f"SELECT {CANON_SQL} FROM ledger_tx")
)
ENTRIES["map_union"] = Entry(
    lambda s, d: normalize.combine(tape_events(s, d), normalize.simple_rows(view(s, d, "ledger"), sheet="ledger"), bank(s, d)).groupBy("sheet", "direction").agg(F.count(F.lit(1)).alias("n")),
    sql("SELECT sheet, direction, count(*) AS n FROM all_tx GROUP BY sheet, direction"),
)


def _money_texts(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    n, k = F.format_number("o_totalprice", 2), F.col("o_orderkey") % 8
    return o.select(
        "o_orderkey",
        F.when(k == 0, F.concat(F.lit("$"), n)).when(k == 1, F.concat(F.lit("("), n, F.lit(")"))).when(k == 2, F.concat(F.lit("KES "), n))
        .when(k == 3, F.concat(F.lit("KES -"), n)).when(k == 4, F.concat(F.lit(" -"), n)).when(k == 5, "n/a").when(k == 6, "").otherwise(n).alias("cell"),
    )


ENTRIES["fn_parse_amount"] = Entry(
    lambda s, d: _money_texts(s, d).select("o_orderkey", money_fn.parse_amount(F.col("cell")).alias("amount"), money_fn.parse_money(F.col("cell")).alias("tape_money")),
    sql("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0,2,7) THEN o_totalprice WHEN o_orderkey % 8 IN (1,3,4) THEN -o_totalprice END AS amount,
        CASE o_orderkey % 8 WHEN 7 THEN o_totalprice WHEN 4 THEN -o_totalprice ELSE 0 END AS tape_money FROM orders"""),
)
ENTRIES["fn_normalize_text"] = Entry(
    lambda s, d: load(s, d, "part").select(
        "p_partkey", text.normalize_value(F.concat(F.lit(" "), F.col("p_name"), F.lit("! #1 "))).alias("plain"),
        text.normalize_value(F.concat(F.col("p_name"), F.lit("! #1")), ignore_spaces=True, ignore_special_chars=True).alias("loose"),
        text.normalize_value(F.col("p_type"), case_sensitive=True).alias("cased"), text.name_key(F.concat(F.lit("  A\t B "), F.col("p_brand"))).alias("name_key"),
        text.alnum_key(F.col("p_type")).alias("alnum"),
    ),
    sql(r"""SELECT p_partkey, trim(lower(concat(p_name, '! #1'))) AS plain, regexp_replace(replace(lower(concat(p_name, '! #1')), ' ', ''), '[^\w\s-]', '', 'g') AS loose,
        trim(p_type) AS cased, concat('a b ', lower(trim(p_brand))) AS name_key, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS alnum FROM part"""),
)
ENTRIES["fn_month_bucket"] = Entry(
    lambda s, d: _dated(s, d).select("key", dates.month_key(F.col("d")).alias("month"), dates.hour_of(F.col("d")).alias("hour"), F.date_format(dates.parse_when(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("parsed")),
    sql("""SELECT key, CASE k WHEN 2 THEN '(undated)' ELSE substring(value_date, 1, 7) END AS month, CASE WHEN k <> 1 AND k <> 2 AND length(value_date) > 10 THEN CAST(substring(value_date, 12, 2) AS INTEGER) END AS hour,
        CASE k WHEN 1 THEN concat(substring(value_date, 1, 10), ' 00:00:00') WHEN 2 THEN NULL ELSE CASE WHEN length(value_date) > 10 THEN value_date ELSE concat(value_date, ' 00:00:00') END END AS parsed
        FROM (SELECT key, value_date, seq % 3 AS k FROM bank_rows) x"""),
)


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    b, k, v = view(spark, sf, "bank_rows"), F.col("seq") % 3, F.col("value_date")
    dmy = F.concat_ws("-", F.substring(v, 9, 2), F.substring(v, 6, 2), F.substring(v, 1, 4))
    return b.select("key", F.when(k == 1, dmy).when(k == 2, "soon").otherwise(v).alias("d"))


ENTRIES["fn_month_name_date"] = Entry(
    lambda s, d: load(s, d, "orders").select("o_orderkey", dates.month_name_date(F.concat(F.lit("on "), F.date_format("o_orderdate", "MMMM d"), F.lit("th, "), F.date_format("o_orderdate", "yyyy"))).alias("iso")),
    sql("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS iso FROM orders"),
)
ENTRIES["fn_roundness"] = Entry(
    lambda s, d: bank(s, d).select("key", roundness(F.col("amount")).alias("roundness")),
    sql("SELECT key, CASE WHEN amount <= 0 THEN 0.0 WHEN amount % 1000 = 0 THEN 1.0 WHEN amount % 100 = 0 THEN 0.5 ELSE 0.0 END AS roundness FROM bank_rows"),
)
ENTRIES["fn_clean_plate"] = Entry(
    lambda s, d: view(s, d, "assets_expected").select("seq", text.clean_plate(F.concat(F.col("plate"), F.lit(". x"))).alias("plate")),
    sql("SELECT seq, concat('PL', CAST(seq AS VARCHAR), 'X') AS plate FROM assets_expected"),
)
ENTRIES["fn_fix_scan_text"] = Entry(
    lambda s, d: load(s, d, "documents").select("doc_id", F.sha2(text.fix_scan_text(F.col("text")), 256).alias("digest")),
    sql("SELECT doc_id, sha256(replace(replace(replace(replace(text, '@', '0'), '—', '-'), '–', '-'), '€', 'e')) AS digest FROM documents"),
)
ENTRIES["fn_html_to_text"] = Entry(
    lambda s, d: load(s, d, "pages").select("page_id", F.sha2(text.strip_html(F.col("html")), 256).alias("digest"), F.length(text.strip_html(F.col("html"))).alias("n_chars")),
    sql(r"""SELECT page_id, sha256(t) AS digest, length(t) AS n_chars FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', chr(10), 'g') AS t FROM pages) p"""),
)
ENTRIES["fn_duration"] = Entry(
    lambda s, d: load(s, d, "events").select("event_id", text.duration_text(F.when(F.col("event_id") % 10 != 0, F.col("event_id") * 37)).alias("elapsed")),
    sql("""SELECT event_id, CASE WHEN t IS NULL THEN 'not signed off' ELSE concat(CASE WHEN t // 86400 > 0 THEN concat(t // 86400, 'd ') ELSE '' END, CASE WHEN (t % 86400) // 3600 > 0 THEN concat((t % 86400) // 3600, 'h ') ELSE '' END,
        CASE WHEN (t % 3600) // 60 > 0 THEN concat((t % 3600) // 60, 'm ') ELSE '' END, t % 60, 's') END AS elapsed FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_id * 37 END AS t FROM events) e"""),
)
ENTRIES["fn_exception_pattern"] = Entry(
    lambda s, d: view(s, d, "review_actions").select("seq", text.exception_pattern(F.when(F.col("seq") % 4 == 0, "odd").otherwise(F.col("exception_id")), F.lit("anomaly")).alias("pattern")),
    sql("SELECT seq, CASE WHEN seq % 4 = 0 THEN 'anomaly' ELSE split_part(exception_id, ':', 3) END AS pattern FROM review_actions"),
)
ENTRIES["fn_run_of_event"] = Entry(
    lambda s, d: view(s, d, "run_log").select("seq", text.run_of_event(F.col("run_id"), F.col("exception_id")).alias("run")),
    sql("SELECT seq, coalesce(run_id, CASE WHEN exception_id LIKE '%:%' THEN split_part(exception_id, ':', 1) END) AS run FROM run_log"),
)
ENTRIES["map_category"] = Entry(
    lambda s, d: bank(s, d).select("key", normalize.category(F.col("description"), CATEGORIES).alias("category")),
    sql("""SELECT key, CASE WHEN upper(description) LIKE '%SIGNUP%' AND (upper(description) LIKE '%REF 1%' OR upper(description) LIKE '%REF 2%') THEN 'internal transfer'
        WHEN upper(description) LIKE '%PURCHASE%' THEN 'payment processor' WHEN upper(description) LIKE '%ITF%' THEN 'tax' WHEN upper(description) LIKE '%COMISI%' THEN 'bank fee' ELSE 'other' END AS category FROM bank_rows"""),
)
ENTRIES["map_period_filter"] = Entry(
    lambda s, d: normalize.in_periods(normalize.combine(tape_events(s, d), bank(s, d)), ["2024-01", "1997-03", "1998-11"]).select(*CANON),
    sql(f"SELECT {CANON_SQL} FROM (SELECT * FROM tape_tx UNION ALL SELECT * FROM bank_tx) x WHERE substring(value_date, 1, 7) IN ('2024-01', '1997-03', '1998-11')"),
)
ENTRIES["map_cohort_filter"] = Entry(
    lambda s, d: normalize.in_cohort(view(s, d, "loan_tape"), periods=["1996-05", "1996-06"], products=["1-URGENT", "2-HIGH"], countries=["NATION_1", "KENYA", "PERU", "CHINA", "FRANCE"]).select("loan_id", "begin_date", "product", "country"),
    sql("""SELECT loan_id, begin_date, product, country FROM loan_tape WHERE substring(begin_date, 1, 7) IN ('1996-05', '1996-06') AND product IN ('1-URGENT', '2-HIGH')
        AND country IN ('NATION_1', 'KENYA', 'PERU', 'CHINA', 'FRANCE')"""),
)
ENTRIES["map_pick_lists"] = Entry(
    lambda s, d: normalize.pick_lists(view(s, d, "loan_tape")),
    sql("""SELECT DISTINCT 'period' AS field, substring(begin_date, 1, 7) AS value FROM loan_tape UNION ALL SELECT DISTINCT 'product', product FROM loan_tape WHERE product IS NOT NULL
        UNION ALL SELECT DISTINCT 'country', country FROM loan_tape WHERE country IS NOT NULL"""),
)
ENTRIES["map_dedupe"] = Entry(
    lambda s, d: normalize.drop_repeats(bank(s, d)).select("borrower", "key", "amount", "seq"),
    sql(r"""SELECT borrower, key, amount, seq FROM (SELECT *, row_number() OVER (PARTITION BY borrower, value_date, CAST(amount AS DECIMAL(28,2)), direction, lower(regexp_replace(description, '[^A-Za-z0-9]', '', 'g')) ORDER BY seq) AS rn FROM bank_rows) x WHERE rn = 1"""),
)


def _cut_off(spark: SparkSession, sf: str) -> DataFrame:
    latest = view(spark, sf, "loan_tape").groupBy("borrower").agg(F.max(F.nullif(F.col("begin_date"), F.lit(""))).alias("latest_date"))
    return latest.select("borrower", "latest_date", audit.cut_off_status(F.col("latest_date"), "1998-07-31").alias("status"), audit.cut_off_status(F.col("latest_date"), "").alias("no_guard"))


ENTRIES["map_cut_off"] = Entry(
    _cut_off,
    sql("SELECT borrower, max(begin_date) AS latest_date, CASE WHEN max(begin_date) > '1998-07-31' THEN 'post_cut_off' ELSE 'ok' END AS status, 'ok' AS no_guard FROM loan_tape GROUP BY borrower"),
)

# Registry and vehicle --------------------------------------------------------

ENTRIES["fn_lookup_status"] = Entry(
    lambda s, d: view(s, d, "registry_results").select("plate", text.lookup_status(F.col("status"), F.col("brand"), F.col("owner"), F.when(F.col("seq") % 10 == 0, F.lit("timed out"))).alias("status")),
    sql("""SELECT plate, CASE WHEN seq % 10 = 0 THEN 'Error: timed out' WHEN status <> '' THEN status WHEN brand <> '' OR owner <> '' THEN 'Found' ELSE 'No data' END AS status FROM registry_results"""),
)
ENTRIES["src_statement_lines"] = Entry(
    lambda s, d: statements.lines(view(s, d, "statement_texts")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last")),
    sql("SELECT file, count(*) AS n, max(line) AS last FROM (SELECT file, unnest(string_split(text, chr(10))) AS line FROM statement_texts) x GROUP BY file"),
)


# Files -----------------------------------------------------------------------

_OWN_NAMES = TapeColumns(
    overrides={"MACHINERY": {"loan_id": "Contract No", "begin_date": "Start", "principal_amount": "Capital", "total_loan_amount": "Total Due", "principal_outstanding": "Open Capital"}},
    negative_sign_borrowers=frozenset({"MACHINERY"}),
)
_TAPE_COLUMNS = ("loan_id", "begin_date", "principal_amount", "total_loan_amount", "principal_outstanding", "interest_outstanding", "fee_outstanding", "penalty_outstanding", "closure_date", "currency")


def _write_file(s: SparkSession, rows: DataFrame, order: str, columns: list, folder: str, name: str) -> str:
    """One CSV file with a header and a known name, its rows in ``order``."""
    rows.orderBy(order).select(*columns).coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(f"{folder}/{name}.parts")
    jvm, conf = s._jvm, s._jsc.hadoopConfiguration()
    parts = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parts")
    fs = parts.getFileSystem(conf)
    part = next(x.getPath() for x in fs.listStatus(parts) if x.getPath().getName().startswith("part-"))
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    return f"{folder}/{name}"


def _dropped_files(s: SparkSession, d: str) -> DataFrame:
    """Two tapes under different names for their columns, a ledger, two statements of one name in two folders (with quotes and line breaks), and a simple table."""
    root = f"{ensure_checkpoint_dir(s)}/files-{uuid.uuid4().hex}"
    tape, led, moves = view(s, d, "loan_tape"), view(s, d, "ledger"), view(s, d, "bank_rows")
    out = []
    for b, names in (("BUILDING", {}), ("MACHINERY", _OWN_NAMES.overrides["MACHINERY"])):
        columns = [F.col(c).cast("string").alias(names.get(c, c)) for c in _TAPE_COLUMNS]
        out.append((_write_file(s, tape.filter(F.col("borrower") == b), "seq", columns, root, f"tape {b.lower()}.csv"), b, "tape"))
    out.append((_write_file(s, led.filter(F.col("borrower") == "BUILDING"), "seq", ["as_of", "ledger_balance", "account", "currency"], root, "books.csv"), "BUILDING", "ledger"))
    text = F.concat(F.lit('said "'), F.col("description"), F.lit('",\nthen more'))
    money = F.col("amount").cast("decimal(18,2)").cast("string")
    side = lambda way: F.when(F.col("direction") == way, money).otherwise("")
    split = [F.col("value_date").alias("Value Date"), text.alias("Narration"), side("out").alias("Debit"), side("in").alias("Credit")]
    out.append((_write_file(s, moves.filter("borrower = 'BUILDING'"), "seq", split, f"{root}/a", "march.csv"), "BUILDING", "bank"))
    one = F.when(F.col("direction") == "out", F.concat(F.lit("-"), money)).otherwise(money)
    single = [F.col("value_date").alias("DATE"), one.alias("Amount"), text.alias("Details"), F.col("currency").alias("Currency")]
    out.append((_write_file(s, moves.filter("borrower = 'MACHINERY'"), "seq", single, f"{root}/b", "march.csv"), "MACHINERY", "mobile_money"))
    out.append((_write_file(s, led.filter(F.col("borrower") == "MACHINERY"), "seq", [F.col("as_of").alias("date"), F.col("ledger_balance").alias("amount"), F.col("account").alias("type")], root, "cash.csv"), "MACHINERY", "cash_map"))
    return s.createDataFrame([*out, (f"{root}/gone.csv", "MACHINERY", "bank"), (f"{root}/scan.pdf", "MACHINERY", "bank")], "file string, borrower string, sheet string")


def _loaded(s: SparkSession, d: str) -> DataFrame:
    rows = loading.load_normalized(s, _dropped_files(s, d), _OWN_NAMES)
    return rows.select("borrower", "sheet", "account_ref", "value_date", F.round("amount", 4).alias("amount"), "direction", "currency", "description", "seq")


_MOVES = "SELECT *, row_number() OVER (PARTITION BY borrower ORDER BY seq) - 1 AS pos, CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE) AS cents FROM bank_rows"
_NARRATION = """concat('said "', description, '",', chr(10), 'then more')"""
_PART_PAID = PAID.replace("company_due_date", "NULL")
ENTRIES["src_load_normalize"] = Entry(
    _loaded,
    sql(f"""SELECT borrower, 'tape' AS sheet, concat('tape ', lower(borrower)) AS account_ref, begin_date AS value_date, round(abs(principal_amount), 4) AS amount, 'out' AS direction, currency, concat('disbursement:', loan_id) AS description, 2 * pos AS seq
          FROM t WHERE principal_amount <> 0 AND begin_date IS NOT NULL
        UNION ALL SELECT borrower, 'tape', concat('tape ', lower(borrower)), coalesce(closure_date, begin_date), round({_PART_PAID}, 4), 'in', currency, concat('collections:', loan_id), 2 * pos + 1 FROM t WHERE {_PART_PAID} <> 0 AND coalesce(closure_date, begin_date) IS NOT NULL
        UNION ALL SELECT borrower, CASE borrower WHEN 'BUILDING' THEN 'ledger' ELSE 'other' END, CASE borrower WHEN 'BUILDING' THEN 'books' ELSE 'cash' END, as_of, round(abs(CAST(ledger_balance AS DOUBLE)), 4), CASE WHEN CAST(ledger_balance AS DOUBLE) >= 0 THEN 'in' ELSE 'out' END,
          CASE borrower WHEN 'BUILDING' THEN currency ELSE '' END, account, row_number() OVER (PARTITION BY borrower ORDER BY seq) - 1 FROM ledger WHERE borrower IN ('BUILDING', 'MACHINERY')
        UNION ALL SELECT borrower, CASE borrower WHEN 'BUILDING' THEN 'bank' ELSE 'mobile_money' END, 'march', value_date, cents, direction, CASE borrower WHEN 'BUILDING' THEN '' ELSE currency END, {_NARRATION}, pos FROM m WHERE borrower IN ('BUILDING', 'MACHINERY') AND cents <> 0""",
        t="SELECT *, row_number() OVER (PARTITION BY borrower ORDER BY seq) - 1 AS pos FROM loan_tape WHERE borrower IN ('BUILDING', 'MACHINERY')", m=_MOVES),
)


def _kinds(s: SparkSession, d: str) -> DataFrame:
    found = loading.file_kinds(loading.read_files(s, _dropped_files(s, d), _OWN_NAMES))
    return found.groupBy("borrower", "sheet", "kind").agg(F.sum("rows").alias("rows"), F.count_distinct("signature").alias("signatures"))


ENTRIES["src_file_kinds"] = Entry(
    _kinds,
    sql("""SELECT borrower, 'tape' AS sheet, 'tape' AS kind, count(*) AS rows, 1 AS signatures FROM loan_tape WHERE borrower IN ('BUILDING', 'MACHINERY') GROUP BY 1
        UNION ALL SELECT borrower, CASE borrower WHEN 'BUILDING' THEN 'ledger' ELSE 'cash_map' END, 'simple', count(*), 1 FROM ledger WHERE borrower IN ('BUILDING', 'MACHINERY') GROUP BY 1
        UNION ALL SELECT borrower, CASE borrower WHEN 'BUILDING' THEN 'bank' ELSE 'mobile_money' END, 'statement', count(*), 1 FROM bank_rows WHERE borrower IN ('BUILDING', 'MACHINERY') GROUP BY 1"""),
)
