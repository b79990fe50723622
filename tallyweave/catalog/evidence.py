"""Registered queries: matching, statements, cash maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.catalog.base import Entry, bank, money, rates, sql, tape_events
from tallyweave.catalog.views import load, view
from tallyweave.functions.money import plain_number
from tallyweave.operators import aggregate, cashmap, fx, match, normalize, positioned, statements
from tallyweave.session import settle, sweep

ENTRIES: dict[str, Entry] = {}

# Matching --------------------------------------------------------------------


def _reported(s: SparkSession, d: str) -> DataFrame:
    """Collections as reported: every tenth text repeats, some are blank."""
    return tape_events(s, d).filter(F.col("direction") == "in").select(
        "seq", F.when(F.col("seq") % 37 == 0, "").when(F.col("seq") % 10 == 1, "collections:bulk").otherwise(F.col("description")).alias("description"), "amount"
    )


def _independent(s: SparkSession, d: str) -> DataFrame:
    """Narrations: equal (case aside), embedded in a longer text for every third loan, or about something else."""
    o = view(s, d, "loan_tape").select("seq", "loan_id", F.col("total_loan_amount").alias("amount"))
    name, k = F.concat(F.lit("collections:"), F.col("loan_id")), F.col("seq") % 12
    return o.select(
        F.col("seq").alias("seq"),
        F.when(k % 3 == 0, F.concat(F.lit("transfer for "), name, F.lit(" thanks"))).when(k == 1, "Collections:BULK").when(k == 2, F.upper(name)).when(k == 4, "").otherwise(F.concat(F.lit("deposit "), F.col("loan_id"))).alias("description"),
        "amount",
    )


_REP = "SELECT seq, CASE WHEN seq % 37 = 0 THEN '' WHEN seq % 10 = 1 THEN 'collections:bulk' ELSE description END AS description, amount FROM tape_tx WHERE direction = 'in'"
_IND = """SELECT seq, CASE WHEN seq % 12 % 3 = 0 THEN concat('transfer for collections:', loan_id, ' thanks') WHEN seq % 12 = 1 THEN 'Collections:BULK' WHEN seq % 12 = 2 THEN upper(concat('collections:', loan_id))
 WHEN seq % 12 = 4 THEN '' ELSE concat('deposit ', loan_id) END AS description, total_loan_amount AS amount FROM loan_tape"""
_EXACT = """SELECT r.seq AS reported_seq, i.seq AS independent_seq, r.v AS match_key, 'exact' AS match_type FROM (SELECT seq, lower(trim(description)) AS v, row_number() OVER (PARTITION BY lower(trim(description)) ORDER BY seq) AS n FROM rep WHERE trim(description) <> '') r
 JOIN (SELECT seq, lower(trim(description)) AS v, row_number() OVER (PARTITION BY lower(trim(description)) ORDER BY seq) AS n FROM ind WHERE trim(description) <> '') i ON r.v = i.v AND r.n = i.n"""
_SIDES = {"rep": _REP, "ind": _IND}
ENTRIES["match_exact"] = Entry(lambda s, d: match.match(_reported(s, d), _independent(s, d), partial=False), sql(_EXACT, **_SIDES))

#: Serving in order by rounds: every reported row asks for the best place of its list that has not refused it, a place
#: keeps the earliest row. The k-th row of a text begins with the k-th place, since those before it are served first.
_SERVED = """WITH RECURSIVE rv AS MATERIALIZED (SELECT seq AS r, lower(trim(description)) AS v FROM rep WHERE trim(description) <> ''),
iv AS MATERIALIZED (SELECT seq AS i, lower(trim(description)) AS w FROM ind WHERE trim(description) <> ''),
dv AS MATERIALIZED (SELECT DISTINCT v FROM rv), dw AS MATERIALIZED (SELECT DISTINCT w FROM iv),
inner_ AS (SELECT DISTINCT v, w FROM (SELECT w, substr(w, CAST(s.s AS BIGINT), n) AS part FROM dw, (SELECT DISTINCT length(v) AS n FROM dv) l, unnest(range(1, length(w) - n + 2)) AS s(s)) x JOIN dv ON part = v),
outer_ AS (SELECT DISTINCT v, w FROM (SELECT v, substr(v, CAST(s.s AS BIGINT), n) AS part FROM dv, (SELECT DISTINCT length(w) AS n FROM dw) l, unnest(range(1, length(v) - n + 2)) AS s(s)) x JOIN dw ON part = w),
places AS MATERIALIZED (SELECT v, w, i, row_number() OVER (PARTITION BY v ORDER BY v = w DESC, i) AS k FROM (SELECT * FROM inner_ UNION SELECT * FROM outer_) e JOIN iv USING (w)),
asks AS (
  SELECT 0 AS round, r, v, row_number() OVER (PARTITION BY v ORDER BY r) AS k FROM rv
  UNION ALL
  SELECT round + 1, r, v, CASE WHEN r = first THEN k ELSE k + 1 END FROM (
    SELECT *, max(CASE WHEN r <> first THEN 1 ELSE 0 END) OVER () AS refused FROM (
      SELECT a.round, a.r, a.v, a.k, min(a.r) OVER (PARTITION BY p.i) AS first FROM asks a JOIN places p ON a.v = p.v AND a.k = p.k) x) y
  WHERE refused = 1
)
SELECT a.r AS reported_seq, p.i AS independent_seq, CASE WHEN p.v = p.w THEN p.v ELSE concat(p.v, ' ~ ', p.w) END AS match_key, CASE WHEN p.v = p.w THEN 'exact' ELSE 'partial' END AS match_type
FROM asks a JOIN places p ON a.v = p.v AND a.k = p.k WHERE a.round = (SELECT max(round) FROM asks)"""
ENTRIES["match_partial"] = Entry(lambda s, d: match.match(_reported(s, d), _independent(s, d)), sql(f"SELECT * FROM ({_SERVED}) pairs", **_SIDES))


def _unmatched(s: SparkSession, d: str) -> DataFrame:
    r, i = settle(_reported(s, d)), settle(_independent(s, d))
    pairs = settle(match.match(r, i))
    sweep(s)
    side = lambda df, name: match.unmatched(df, pairs, name).select(F.lit(name).alias("side"), "seq")
    return side(r, "reported").unionByName(side(i, "independent"))


ENTRIES["match_unmatched"] = Entry(
    _unmatched,
    sql("SELECT 'reported' AS side, seq FROM rep WHERE seq NOT IN (SELECT reported_seq FROM pairs) UNION ALL SELECT 'independent', seq FROM ind WHERE seq NOT IN (SELECT independent_seq FROM pairs)", **_SIDES, pairs=_SERVED),
)


def _report(s: SparkSession, d: str) -> DataFrame:
    r, i = settle(_reported(s, d)), settle(_independent(s, d))
    pairs = settle(match.match(r, i))
    sweep(s)
    out = match.report(r, i, pairs)
    return out.select(F.col("Status").alias("status"), F.col("Match key").alias("match_key"), F.col("`Reported: seq`").alias("reported_seq"), F.col("`Independent: seq`").alias("independent_seq"))


ENTRIES["match_report"] = Entry(
    _report,
    sql("""SELECT CASE p.match_type WHEN 'exact' THEN 'Matched' WHEN 'partial' THEN 'Partial match' ELSE 'In reported only' END AS status, coalesce(p.match_key, '') AS match_key, r.seq AS reported_seq, p.independent_seq
        FROM rep r LEFT JOIN pairs p ON r.seq = p.reported_seq UNION ALL SELECT 'In independent only', '', NULL, seq FROM ind WHERE seq NOT IN (SELECT independent_seq FROM pairs)""", **_SIDES, pairs=_SERVED),
)
ENTRIES["match_any_column"] = Entry(
    lambda s, d: match.match(view(s, d, "loan_tape").select("seq", "loan_id"), load(s, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("# ")).alias("code")),
                             reported_col="loan_id", independent_col="code", partial=False, ignore_special_chars=True),
    sql("SELECT seq AS reported_seq, seq AS independent_seq, loan_id AS match_key, 'exact' AS match_type FROM loan_tape"),
)

# Statements ------------------------------------------------------------------


def _texts(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "statement_texts")


_PARSED = """SELECT file, concat('bank:', file, ':', CAST(CASE WHEN layout_no = 2 THEN n - 1 ELSE n + 1 END AS VARCHAR)) AS key,
 CASE layout_no WHEN 0 THEN concat(day_month, '-2021') WHEN 1 THEN concat(day_month, '-', yr) ELSE value_date END AS value_date, amount,
 direction, CASE layout_no WHEN 0 THEN description WHEN 1 THEN description ELSE description END AS description, CASE WHEN layout_no <> 1 THEN CAST(balance AS DOUBLE) END AS balance,
 CASE WHEN layout_no = 2 THEN 'iso_running' ELSE 'flat' END AS layout_used FROM statement_lines WHERE layout_no <> 3"""
_SHOWN = ("file", "key", "value_date", "amount", "direction", "description", "balance", "layout_used")
ENTRIES["stmt_parse"] = Entry(
    lambda s, d: statements.parse(_texts(s, d)).select(*_SHOWN),
    sql(f"SELECT * REPLACE (CASE WHEN layout_used = 'iso_running' THEN abs(amount) ELSE amount END AS amount) FROM ({_PARSED}) p"),
)
# The layouts tell themselves apart by the balance and by how they were read.
_LAYOUTS = {0: "layout_used = 'flat' AND balance IS NOT NULL", 1: "layout_used = 'flat' AND balance IS NULL", 2: "layout_used = 'iso_running'"}
for _name, _no in (("stmt_two_date", 0), ("stmt_single_date", 1), ("stmt_iso_running", 2)):
    ENTRIES[_name] = Entry(
        lambda s, d, n=_no: statements.parse(_texts(s, d)).filter(_LAYOUTS[n]).select("file", "value_date", "amount", "direction", "description", "balance"),
        sql(f"SELECT file, value_date, amount, direction, description, balance FROM ({_PARSED.replace('<> 3', f'= {_no}')}) p"),
    )
ENTRIES["stmt_shape"] = Entry(
    lambda s, d: statements.shape(_texts(s, d)).select("file", "layout", "bank", "account_no", "currency", "opening_balance", "closing_balance", "total_debits"),
    sql("""SELECT file, CASE max(layout_no) WHEN 0 THEN 'two_date' WHEN 1 THEN 'single_date' WHEN 2 THEN 'iso_running' ELSE '' END AS layout, 'absa' AS bank, CAST(max(l_orderkey) + 1000000 AS VARCHAR) AS account_no,
        CASE max(layout_no) WHEN 0 THEN 'PEN' WHEN 1 THEN 'KES' WHEN 2 THEN 'USD' ELSE '' END AS currency, CASE WHEN max(layout_no) = 2 THEN 0.0 END AS opening_balance,
        CASE WHEN max(layout_no) = 2 THEN CAST(sum(CAST(CASE WHEN direction = 'out' THEN -amount ELSE amount END AS DECIMAL(18,2))) AS DOUBLE) END AS closing_balance, CAST(NULL AS DOUBLE) AS total_debits FROM statement_lines GROUP BY file"""),
)
_SUMS = """SELECT file, max(layout_no) AS layout_no, CAST(CAST(coalesce(sum(CASE WHEN direction='out' THEN CAST(amount AS DECIMAL(28,10)) END), 0) AS DECIMAL(38,4)) AS DOUBLE) AS debits,
 CAST(CAST(coalesce(sum(CASE WHEN direction='in' THEN CAST(amount AS DECIMAL(28,10)) END), 0) AS DECIMAL(38,4)) AS DOUBLE) AS credits FROM statement_lines WHERE layout_no <> 3 GROUP BY file"""
ENTRIES["stmt_tie_out"] = Entry(
    lambda s, d: statements.tie_out(statements.parse(_texts(s, d)), statements.shape(_texts(s, d))).select("file", "debits", "credits", "tied_out"),
    sql(f"SELECT file, debits, credits, CASE WHEN layout_no = 2 THEN TRUE END AS tied_out FROM ({_SUMS}) x"),
)


def _broken(s: SparkSession, d: str) -> DataFrame:
    """The texts with every other declared closing balance wrong, and some files read from scans."""
    t = _texts(s, d)
    key = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    wrong = F.regexp_replace("text", r"\$0\.00 \$1\.00 \$1\.00 \$-?[\d.]+", r"\$0.00 \$1.00 \$1.00 \$9999999.99")
    return t.withColumn("text", F.when(key % 8 == 2, wrong).otherwise(F.col("text"))).withColumn("ocr", key % 3 == 0)


ENTRIES["stmt_grade"] = Entry(
    lambda s, d: statements.grade(statements.parse(_broken(s, d)), statements.shape(_broken(s, d))).select("file", "key", "confidence", "tie_out"),
    sql(f"""SELECT file, key, CASE WHEN k % 3 = 0 THEN least(c, 0.6) ELSE c END AS confidence, CASE WHEN k % 8 = 2 THEN 'failed' WHEN k % 4 = 2 THEN 'ok' END AS tie_out
        FROM (SELECT *, CASE WHEN k % 8 = 2 THEN 0.5 ELSE 1.0 END AS c FROM (SELECT *, CAST(regexp_extract(file, '(\\d+)', 1) AS BIGINT) AS k FROM ({_PARSED}) p) q) r"""),
)
ENTRIES["stmt_spot_list"] = Entry(
    lambda s, d: normalize.flag_spot_checks(statements.ingest(_broken(s, d)), 0.85).filter("needs_spot_check").select("account_ref", "key", "confidence"),
    sql(f"""SELECT file AS account_ref, key, CASE WHEN k % 8 = 2 THEN 0.5 ELSE 0.6 END AS confidence FROM (SELECT *, CAST(regexp_extract(file, '(\\d+)', 1) AS BIGINT) AS k FROM ({_PARSED}) p) q WHERE k % 8 = 2 OR k % 3 = 0
        UNION ALL SELECT file, concat('bank:', file, ':unmapped'), 0.0 FROM statement_texts WHERE layout_no = 3"""),
)
ENTRIES["stmt_currency_stamp"] = Entry(
    lambda s, d: normalize.stamp_currency(statements.parse(_texts(s, d)), statements.shape(_texts(s, d)).select("account_ref", "currency")).groupBy("currency").agg(F.count(F.lit(1)).alias("rows")),
    sql("SELECT CASE layout_no WHEN 0 THEN 'PEN' WHEN 1 THEN 'KES' ELSE 'USD' END AS currency, count(*) AS rows FROM statement_lines WHERE layout_no <> 3 GROUP BY 1"),
)
ENTRIES["stmt_currency_of"] = Entry(
    lambda s, d: normalize.statement_currency(bank(s, d), bank(s, d).groupBy("account_ref").agg(F.when(F.max("seq") % 2 == 0, F.lit("PEN")).otherwise(F.lit("")).alias("currency"))),
    sql("""SELECT account_ref, CASE WHEN max(seq) % 2 = 0 THEN 'PEN' ELSE coalesce(arg_min(currency, seq) FILTER (currency <> ''), '') END AS currency FROM bank_rows GROUP BY account_ref"""),
)
ENTRIES["stmt_placeholder"] = Entry(
    lambda s, d: statements.placeholders(_texts(s, d), statements.parse(_texts(s, d)), "no known layout").select("key", "description", "confidence"),
    sql("SELECT concat('bank:', file, ':unmapped') AS key, 'no known layout' AS description, 0.0 AS confidence FROM statement_texts WHERE layout_no = 3"),
)
ENTRIES["stmt_closing_balance"] = Entry(
    lambda s, d: statements.closing_balances(statements.parse(_texts(s, d))),
    sql("SELECT file, CASE WHEN max(layout_no) <> 1 THEN CAST(arg_max(balance, n) AS DOUBLE) END AS closing_balance FROM statement_lines WHERE layout_no <> 3 GROUP BY file"),
)
ENTRIES["stmt_table_balance"] = Entry(
    # The order of rows outgrows 64 bits once part keys reach a million.
    lambda s, d: normalize.closing_balance(view(s, d, "statement_export").withColumnRenamed("Running Balance", "balance").withColumn("seq", F.col("seq").cast("decimal(19,0)") * F.lit(1000000000000).cast("decimal(13,0)") + F.abs(plain_number(F.col("balance")) * 100).cast("long"))),
    sql("""SELECT account_ref, CAST(arg_max(b, seq * 1000000000000 + abs(CAST(round(CAST(b AS DOUBLE) * 100) AS BIGINT))) AS DOUBLE) AS closing_balance FROM (SELECT account_ref, seq, "Running Balance" AS b FROM statement_export) x GROUP BY account_ref"""),
)


def _moves(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "statement_lines")
    return m.select("file", F.col("n").alias("line_no"), F.abs("amount").alias("amount"), F.col("balance").cast("double").alias("balance"), "description")


ENTRIES["stmt_running_balance"] = Entry(
    lambda s, d: statements.running_direction(_moves(s, d)).select("file", "line_no", "direction"),
    sql("SELECT file, n AS line_no, CASE WHEN n = 1 THEN CASE WHEN description LIKE '%deposit%' THEN 'in' ELSE 'out' END ELSE direction END AS direction FROM statement_lines"),
)


# Positioned tables -----------------------------------------------------------

_X = {"#": (10.0, 20.0), "DATE": (40.0, 70.0), "NARRATION": (120.0, 190.0), "DEBIT": (300.0, 340.0), "CREDIT": (400.0, 450.0), "BALANCE": (500.0, 560.0)}


def _words(s: SparkSession, d: str) -> DataFrame:
    """Statements of orders as words on a page: a title, the header, per line a leading narration, the row, a trailing narration, a footer."""
    # The words of a file lie together; dates are spelled out afterwards.
    m = view(s, d, "statement_lines").select("file", "n", "direction", "money", "balance_text", "day").repartition("file").select(
        "file", "n", "direction", "money", "balance_text", F.date_format("day", "MMMM").alias("mon"), F.date_format("day", "d").alias("dd"), F.date_format("day", "yyyy").alias("yy"),
    )

    def word(text, x0: float, top, dx: float = 0.0):
        return F.struct(text.alias("text"), F.lit(x0 + dx).alias("x0"), F.lit(x0 + dx + 20.0).alias("x1"), top.cast("double").alias("top"), (top + 8.0).cast("double").alias("bottom"))

    top = F.col("n") * 40 + 100
    out, unsigned = F.col("direction") == "out", F.regexp_replace("money", "^-", "")
    per_row = F.array(
        word(F.lit("lead"), 120.0, top - 12), word(F.concat(F.lit("n"), F.col("n").cast("string")), 145.0, top - 12.5),
        word(F.col("n").cast("string"), 12.0, top), word(F.col("mon"), 40.0, top), word(F.concat(F.col("dd"), F.lit("th")), 58.0, top + 1), word(F.col("yy"), 72.0, top),
        word(F.lit("pay"), 120.0, top), word(F.when(out, unsigned).otherwise(F.lit("-")), 310.0, top), word(F.when(out, F.lit("-")).otherwise(unsigned), 410.0, top),
        word(F.col("balance_text"), 510.0, top), word(F.lit("tail"), 121.0, top + 12),
    )
    heads = F.array(word(F.lit("Statement"), 10.0, F.lit(10)), *[
        F.struct(F.lit(k).alias("text"), F.lit(a).alias("x0"), F.lit(b).alias("x1"), F.lit(60.0).alias("top"), F.lit(68.0).alias("bottom")) for k, (a, b) in _X.items()
    ])
    foot = F.array(word(F.lit("Page"), 10.0, F.lit(100000)), word(F.lit("1"), 40.0, F.lit(100000)), word(F.lit("of"), 60.0, F.lit(100000)), word(F.lit("1"), 80.0, F.lit(100000)))
    # The first line of a file brings what its page has once.
    every = m.select("file", F.inline(F.when(F.col("n") == 1, F.concat(heads, foot, per_row)).otherwise(per_row)))
    return every.withColumn("page", F.lit(1))


# The lead-in of the first row comes before any row; later ones follow the row above.
_TOLD = "concat(CASE WHEN n = 1 THEN 'lead n1 ' ELSE '' END, 'pay tail', CASE WHEN n < c THEN concat(' lead n', CAST(n + 1 AS VARCHAR)) ELSE '' END)"
_TABLE = f"SELECT file, n AS seq, value_date, abs(amount) AS amount, direction, {_TOLD} AS description, CAST(balance AS DOUBLE) AS balance FROM (SELECT *, count(*) OVER (PARTITION BY file) AS c FROM statement_lines) x"
ENTRIES["stmt_positioned_rows"] = Entry(
    lambda s, d: positioned.table_rows(_words(s, d)).select("file", "seq", "value_date", "amount", "direction", "description", "balance"), sql(_TABLE)
)
ENTRIES["stmt_positioned_raw"] = Entry(
    lambda s, d: positioned.raw_table(_words(s, d)).select("file", "seq", F.col("`#`").alias("no"), "NARRATION", "BALANCE"),
    sql(f"SELECT file, n AS seq, CAST(n AS VARCHAR) AS no, {_TOLD} AS \"NARRATION\", balance_text AS \"BALANCE\" FROM (SELECT *, count(*) OVER (PARTITION BY file) AS c FROM statement_lines) x"),
)
ENTRIES["stmt_page_lines"] = Entry(
    lambda s, d: positioned.page_lines(_words(s, d)).groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("words")).alias("words")),
    sql("SELECT file, 3 + 3 * count(*) AS lines, 11 + 11 * count(*) AS words FROM statement_lines GROUP BY file"),
)

# Cash maps -------------------------------------------------------------------


def _maps(s: SparkSession, d: str) -> DataFrame:
    """A free-text or structured cash map per supplier."""
    sup = load(s, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    free = F.concat(
        F.lit("Borrower name: Lender "), k, F.lit("\n4.2 For each, describe its purpose, bank and currency\n[Account 9: template]\nAccount 1: Collections at Bank"),
        F.when(F.col("s_nationkey") % 2 == 0, " A").otherwise(" B"), F.lit(", daily. Account 2: Payouts, no bank named\nan additional escrow account with Trust House.\n4.3 Next question\nAccount 3: outside"),
    )
    doc = F.to_json(F.struct(
        F.struct(F.concat(F.lit("Lender "), k).alias("borrower_name")).alias("narrative"),
        F.array(
            F.struct(F.lit("a1").alias("id"), F.lit("Main").alias("label"), F.lit("Bank A").alias("bank_name"), F.lit("KES").alias("currency"), F.array(F.lit("payroll"), F.lit("tax")).alias("purpose")),
            F.struct(F.lit("a2").alias("id"), F.lit(None).cast("string").alias("label"), F.lit("").alias("bank_name"), F.lit("").alias("currency"), F.array().cast("array<string>").alias("purpose")),
        ).alias("accounts"),
    ))
    return sup.select(
        k.alias("borrower"), F.concat(F.lit("map-"), k, F.when(F.col("s_suppkey") % 2 == 0, ".txt").otherwise(".json")).alias("file"),
        F.when(F.col("s_suppkey") % 2 == 0, free).otherwise(doc).alias("text"),
    )


def _account_rows(s: SparkSession, d: str) -> DataFrame:
    return cashmap.accounts(cashmap.parse(_maps(s, d)))


_B = "CASE WHEN s_nationkey % 2 = 0 THEN 'Bank A' ELSE 'Bank B' END"
_ACCOUNTS = f"""SELECT CAST(s_suppkey AS VARCHAR) AS borrower, concat('Lender ', CAST(s_suppkey AS VARCHAR)) AS borrower_name, p AS position,
 CASE WHEN s_suppkey % 2 = 0 THEN list_extract(['account_1', 'account_2', 'account_extra_3'], p + 1) ELSE list_extract(['a1', 'a2'], p + 1) END AS id,
 CASE WHEN s_suppkey % 2 = 0 THEN list_extract([{_B}, '', 'Trust House'], p + 1) ELSE list_extract(['Bank A', ''], p + 1) END AS bank_name,
 CASE WHEN s_suppkey % 2 = 0 THEN list_extract([concat('Collections at ', {_B}, ', daily.'), 'Payouts, no bank named an additional escrow account with Trust House.', 'x'], p + 1) ELSE list_extract(['Main — payroll, tax', 'a2'], p + 1) END AS description
 FROM supplier CROSS JOIN (SELECT unnest([0, 1]) AS p) n"""
ENTRIES["cashmap_accounts"] = Entry(
    lambda s, d: _account_rows(s, d).select("borrower", "borrower_name", "position", "id", "bank_name", "description"),
    sql(_ACCOUNTS.replace("list_extract([" + _B + ", '', 'Trust House'], p + 1)", "list_extract([" + _B + ", 'Trust House'], p + 1)")),
)


def _mentions(s: SparkSession, d: str) -> DataFrame:
    sup, k = load(s, d, "supplier"), F.col("s_suppkey").cast("string")
    return sup.select(k.alias("borrower"), F.concat(F.lit("st-"), k).alias("file"), F.when(F.col("s_suppkey") % 3 == 0, "nothing named").otherwise("moved by BANK A in May").alias("text"))


ENTRIES["cashmap_candidates"] = Entry(
    lambda s, d: cashmap.candidates(_mentions(s, d), _account_rows(s, d)).select("borrower", "account_ref", "id", "by_name"),
    sql("""SELECT borrower, concat('st-', borrower) AS account_ref, id, named AS by_name FROM (SELECT *, max(hit) OVER (PARTITION BY borrower) AS named FROM (SELECT *, CAST(borrower AS BIGINT) % 3 <> 0 AND bank_name = 'Bank A' AS hit FROM acc) a) b WHERE hit OR NOT named""",
        acc=_ACCOUNTS.replace("list_extract([" + _B + ", '', 'Trust House'], p + 1)", "list_extract([" + _B + ", 'Trust House'], p + 1)")),
)


def _summaries(s: SparkSession, d: str) -> DataFrame:
    """Every statement text: parsed rows in base currency, its own shape, and the accounts of its borrower's cash map. Some bank rows name no account."""
    # Written once: the texts are read seven times below, shapes and rows twice.
    texts = settle(_texts(s, d))
    key = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    shapes = settle(statements.shape(texts).select("account_ref", "layout", "bank", "account_no", "currency"))
    parsed = settle(statements.parse(texts).select("file", "line_no", "borrower", "account_ref", "currency", "amount", "direction", "balance"))
    sweep(s)
    stamped = normalize.stamp_currency(parsed, shapes.select("account_ref", "currency"))
    loose = bank(s, d).filter(F.col("account_ref") == "")
    rows = fx.convert(normalize.combine(stamped, loose), rates(s, d))
    mentions = texts.select(
        "file", (key % 10 + 1).cast("string").alias("borrower"), F.concat("text", F.when(key % 3 == 0, "\nmoved by BANK B in May").otherwise("")).alias("text")
    )
    named = cashmap.candidates(mentions, _account_rows(s, d)).select("account_ref", F.col("id").alias("label"))
    balance = statements.closing_balances(parsed).select(F.col("file").alias("account_ref"), "closing_balance")
    out = aggregate.statement_summaries(rows, balance, shapes, named)
    return out.select(
        "account_ref", "cash_in", "cash_out", "transaction_count", "closing_balance", "layout", "bank", "account_no", "declared_currency",
        F.array_join("candidate_accounts", ",").alias("candidates"),
    )


# Every text says "Bank account", which names Bank A.
_HIT = "(bank_name = 'Bank A' OR says AND bank_name = 'Bank B')"
ENTRIES["stmt_summaries"] = Entry(
    _summaries,
    sql(f"""SELECT t.*, layout, bank, account_no, declared_currency, candidates FROM (
        SELECT file AS account_ref, CASE WHEN max(layout_no) = 3 THEN 0.0 ELSE {money('amount * rate', "direction='in'")} END AS cash_in, CASE WHEN max(layout_no) = 3 THEN 0.0 ELSE {money('amount * rate', "direction='out'")} END AS cash_out,
          CASE WHEN max(layout_no) = 3 THEN 0 ELSE count(*) END AS transaction_count, CASE WHEN max(layout_no) IN (0, 2) THEN CAST(arg_max(balance, n) AS DOUBLE) END AS closing_balance
        FROM (SELECT *, CASE layout_no WHEN 0 THEN 0.25 WHEN 1 THEN 0.0078125 ELSE 1.0 END::DOUBLE AS rate FROM statement_lines) l GROUP BY file
        UNION ALL SELECT '', {money('amount_base', "direction='in'")}, {money('amount_base', "direction='out'")}, count(*), NULL FROM bank_fx WHERE account_ref = '' HAVING count(*) > 0) t
        LEFT JOIN (SELECT file, CASE max(layout_no) WHEN 0 THEN 'two_date' WHEN 1 THEN 'single_date' WHEN 2 THEN 'iso_running' ELSE '' END AS layout, 'absa' AS bank, CAST(max(l_orderkey) + 1000000 AS VARCHAR) AS account_no,
          CASE max(layout_no) WHEN 0 THEN 'PEN' WHEN 1 THEN 'KES' WHEN 2 THEN 'USD' ELSE '' END AS declared_currency, max(l_orderkey) % 10 + 1 AS b, max(l_orderkey) % 3 = 0 AS says FROM statement_lines GROUP BY file) h ON t.account_ref = h.file
        LEFT JOIN (SELECT CAST(borrower AS BIGINT) AS b, says, string_agg(id, ',' ORDER BY id) AS candidates FROM (
          SELECT *, {_HIT} AS hit, max({_HIT}) OVER (PARTITION BY borrower, says) AS any_hit FROM acc CROSS JOIN (SELECT unnest([TRUE, FALSE]) AS says) q) a WHERE hit OR NOT any_hit GROUP BY 1, 2) c ON h.b = c.b AND h.says = c.says""",
        acc=_ACCOUNTS.replace("list_extract([" + _B + ", '', 'Trust House'], p + 1)", "list_extract([" + _B + ", 'Trust House'], p + 1)")),
)
