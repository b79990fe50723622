"""The driver tables dressed up as the engine's inputs.

Each view is one SQL text that runs unchanged on Spark and on an ANSI database,
so a query and its check start from the same rows. Every view covers its whole
table; deviations (round amounts, copies, split payments) are planted, not cut.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

VIEWS: dict[str, str] = {}

VIEWS["fx_rates"] = """
SELECT * FROM (VALUES ('KES',CAST(0.0078125 AS DOUBLE)),('PEN',CAST(0.25 AS DOUBLE)),('NGN',CAST(0.000625 AS DOUBLE))) AS t(currency, rate)
"""

VIEWS["loan_tape"] = """
SELECT c_mktsegment AS borrower,
       o_orderkey AS seq,
       CAST(o_orderkey AS STRING) AS loan_id,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS begin_date,
       CASE WHEN o_orderkey % 7 = 0 THEN floor(o_totalprice/1000)*1000 ELSE o_totalprice END AS principal_amount,
       CASE WHEN o_orderkey % 7 = 0 THEN floor(o_totalprice/1000)*1000 ELSE o_totalprice END + 100*COALESCE(n_lines,0) AS total_loan_amount,
       CASE o_orderstatus WHEN 'F' THEN CAST(0 AS DOUBLE) WHEN 'P' THEN floor(o_totalprice/2) ELSE floor(o_totalprice) END
         * CASE WHEN c_mktsegment='MACHINERY' THEN -1 ELSE 1 END AS principal_outstanding,
       CAST(50*COALESCE(n_open,0) AS DOUBLE) AS interest_outstanding,
       CAST(10*COALESCE(n_ret,0) AS DOUBLE) AS fee_outstanding,
       CAST(CASE WHEN o_orderkey % 11 = 0 THEN -25 ELSE 0 END AS DOUBLE) AS penalty_outstanding,
       CASE WHEN o_orderstatus='F' THEN CASE WHEN o_orderkey % 13 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE CAST(last_ship AS STRING) END END AS closure_date,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS STRING) END AS company_due_date,
       CASE c_nationkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'KES' WHEN 2 THEN 'pen ' WHEN 3 THEN 'XXX' ELSE '' END AS currency,
       o_orderstatus AS status, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE n_name END AS country,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderpriority END AS product,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey % 120 AS STRING) END AS days_past_due
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey LEFT JOIN (
  SELECT l_orderkey,
         SUM(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END) AS n_open,
         SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS n_ret,
         COUNT(*) AS n_lines,
         MAX(CAST(l_shipdate AS DATE)) AS last_ship
  FROM lineitem GROUP BY l_orderkey) li ON l_orderkey=o_orderkey
"""

VIEWS["bank_events"] = """
SELECT event_id, user_id,
       CASE user_id % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS borrower,
       CASE WHEN user_id % 6 = 0 THEN 'mobile_money' ELSE 'bank' END AS sheet,
       CASE WHEN event_id % 97 = 0 THEN (floor(value)+1)*1000 WHEN event_id % 89 = 0 THEN CAST(75 AS DOUBLE) ELSE value END AS amount,
       CASE WHEN event_id % 3 = 0 THEN CAST(CAST(ts AS DATE) AS STRING) ELSE CAST(date_trunc('second', ts) AS STRING) END AS value_date,
       CASE WHEN event_type IN ('purchase','click','view') THEN 'in' ELSE 'out' END AS direction,
       CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'KES' WHEN 2 THEN 'USD' ELSE 'ZZZ' END AS currency,
       concat(event_type, ' ref ', CAST(event_id AS STRING)) AS description,
       CASE WHEN user_id % 10 = 9 THEN '' ELSE concat('acct-', CAST(user_id % 25 AS STRING)) END AS account_ref
FROM events
"""

VIEWS["bank_rows"] = """
SELECT borrower, concat('bank:', CAST(user_id AS STRING), ':', CAST(event_id AS STRING)) AS key, sheet, value_date, amount,
       direction, currency, description, account_ref, event_id AS seq
FROM bank_events
UNION ALL
SELECT borrower, concat('bank:dup:', CAST(event_id AS STRING)), sheet, value_date, amount, direction, currency, description,
       account_ref, 1000000000000 + event_id
FROM bank_events WHERE event_id % 101 = 0
UNION ALL
SELECT borrower, concat('bank:split:', CAST(event_id AS STRING), ':', CAST(k AS STRING)), sheet, '2024-02-01', CAST(9000 + 100*k AS DOUBLE), 'out', 'USD',
       concat('split ', CAST(k AS STRING)), concat('split-', CAST(event_id AS STRING)), 2000000000000 + event_id*10 + k
FROM bank_events JOIN (SELECT * FROM (VALUES (1),(2),(3),(4)) AS v(k)) kk ON event_id % 503 = 0
"""

VIEWS["ledger"] = """
SELECT c_mktsegment AS borrower, c_custkey AS seq, '2024-01-31' AS as_of, CAST(c_acctbal AS STRING) AS ledger_balance, c_name AS account,
       CASE c_nationkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'KES' ELSE '' END AS currency, 'ledger' AS account_ref
FROM customer
"""

VIEWS["assets_expected"] = """
SELECT s_suppkey AS seq, concat('PL-', CAST(s_suppkey AS STRING)) AS plate, concat('borrower ', CAST(s_nationkey AS STRING)) AS borrower,
       CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE concat('Owner  ', CAST(s_suppkey AS STRING)) END AS expected_owner,
       CASE WHEN s_suppkey % 8 = 0 THEN '' WHEN s_suppkey % 3 = 0 THEN concat('Brand', CAST(s_nationkey AS STRING), ' Model ', CAST(s_suppkey % 10 AS STRING))
            WHEN s_suppkey % 3 = 1 THEN concat('brand', CAST(s_nationkey AS STRING), '-other') ELSE 'unrelated car' END AS expected_vehicle
FROM supplier
"""

VIEWS["registry_results"] = """
SELECT s_suppkey AS seq, concat('PL-', CAST(s_suppkey AS STRING)) AS plate,
       CASE s_suppkey % 5 WHEN 0 THEN 'Found' WHEN 1 THEN 'No data' WHEN 2 THEN 'Error: timeout' ELSE '' END AS status,
       CASE WHEN s_suppkey % 5 IN (1,2) THEN '' WHEN s_suppkey % 7 = 0 THEN 'Someone Else' ELSE concat(' OWNER ', CAST(s_suppkey AS STRING)) END AS owner,
       CASE WHEN s_suppkey % 5 IN (1,2) THEN '' ELSE concat('Brand', CAST(s_nationkey AS STRING)) END AS brand,
       CASE WHEN s_suppkey % 5 IN (1,2) THEN '' ELSE concat('Model ', CAST(s_suppkey % 10 AS STRING)) END AS model
FROM supplier WHERE s_suppkey % 4 <> 3
"""

VIEWS["run_log"] = """
SELECT event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'run_started' WHEN 'view' THEN 'run_completed' WHEN 'purchase' THEN 'sign_off' WHEN 'error' THEN 'hardening' ELSE 'review' END AS event,
       CASE WHEN event_type IN ('signup','view') THEN concat('r', CAST(user_id AS STRING)) END AS run_id,
       CASE WHEN event_type IN ('purchase','click') THEN concat('r', CAST(user_id AS STRING), ':anom:dup:', CAST(event_id % 1000 AS STRING)) END AS exception_id,
       CAST(date_trunc('second', ts) AS STRING) AS ts, concat('borrower-', CAST(user_id % 12 AS STRING)) AS borrower,
       concat('pattern-', CAST(user_id % 7 AS STRING)) AS pattern, event_id % 2 = 0 AS approved
FROM events
"""

VIEWS["review_actions"] = """
SELECT event_id AS seq, concat('r', CAST(user_id % 40 AS STRING), ':anom:', CASE user_id % 3 WHEN 0 THEN 'dup' WHEN 1 THEN 'vol' ELSE 'seqjump' END, ':', CAST(event_id % 500 AS STRING)) AS exception_id,
       CASE event_type WHEN 'signup' THEN 'review_start' WHEN 'view' THEN 'approved' WHEN 'purchase' THEN 'sign_off' WHEN 'error' THEN 'rejected' ELSE 'review_start' END AS action,
       concat('officer-', CAST(user_id % 9 AS STRING)) AS reviewer, concat('note ', CAST(event_id AS STRING)) AS note
FROM events
"""

# One statement per order, its lines as movements with a running balance.
VIEWS["line_moves"] = """
SELECT concat('order-', CAST(l_orderkey AS STRING)) AS account_ref, l_orderkey, l_partkey * 10 + l_linenumber AS seq,
       CAST(l_shipdate AS DATE) AS day, CAST(CAST(l_shipdate AS DATE) AS STRING) AS value_date, l_extendedprice AS amount,
       CASE WHEN l_returnflag = 'R' THEN 'out' ELSE 'in' END AS direction,
       CASE WHEN l_linestatus = 'F' THEN 'item final' ELSE 'item deposit' END AS description,
       sum(CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)))
         OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 10 + l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING) AS balance
FROM lineitem
"""

VIEWS["statement_export"] = """
SELECT account_ref, seq, value_date AS "Date", concat('T-', CAST(l_orderkey AS STRING)) AS "Transaction Code", description AS "Description",
       CASE WHEN direction = 'out' THEN CAST(CAST(amount AS DECIMAL(18,2)) AS STRING) ELSE '' END AS "Debit (-)",
       CASE WHEN direction = 'in' THEN CAST(CAST(amount AS DECIMAL(18,2)) AS STRING) END AS "Credit (+)",
       CAST(balance AS STRING) AS "Running Balance"
FROM line_moves
"""

# The same statements as text, in four layouts; the last is none the parser knows.
VIEWS["statement_lines"] = """
SELECT l_orderkey, concat('st-', CAST(l_orderkey AS STRING), '.txt') AS file, l_orderkey % 4 AS layout_no, value_date, day, amount, direction, balance,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY seq, amount) AS n,
       concat(description, ' ', CAST(seq AS STRING)) AS description,
       CASE WHEN direction = 'out' THEN '-' ELSE '' END AS sign, CAST(CAST(amount AS DECIMAL(18,2)) AS STRING) AS money, CAST(balance AS STRING) AS balance_text,
       concat(substring(value_date, 9, 2), '-', substring(value_date, 6, 2)) AS day_month, substring(value_date, 1, 4) AS yr
FROM line_moves
"""

VIEWS["statement_texts"] = """
SELECT file, max(layout_no) AS layout_no, count(*) AS n_lines,
       concat('Absa Bank account no. ', CAST(max(l_orderkey) + 1000000 AS STRING), chr(10),
         CASE max(layout_no) WHEN 0 THEN 'MONEDA: SOLES 01-01-2021' WHEN 1 THEN 'Currency KES' WHEN 2 THEN 'Currency USD' ELSE 'free notes' END, chr(10),
         CASE WHEN max(layout_no) = 2 THEN concat('STARTING BALANCE TOTAL DEPOSITS (+) TOTAL WITHDRAWALS (-) ENDING BALANCE', chr(10), '$0.00 $1.00 $1.00 $',
            CAST(sum(CAST(CASE WHEN direction = 'out' THEN -amount ELSE amount END AS DECIMAL(18,2))) AS STRING), chr(10)) ELSE '' END,
         listagg(CASE layout_no
           WHEN 0 THEN concat(day_month, ' ', day_month, ' ', description, ' ', sign, money, ' ', '9.15 ', balance_text)
           WHEN 1 THEN concat(day_month, '-', yr, ' ', description, ' ', sign, money)
           WHEN 2 THEN concat(value_date, ' TXN-A', CAST(n AS STRING), 'B ', description, ' $', money, ' $', balance_text)
           ELSE concat('moved on ', value_date, ': ', description) END, chr(10)) WITHIN GROUP (ORDER BY n)) AS text
FROM statement_lines GROUP BY file
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(text: str) -> set[str]:
    return set(re.findall(r"[a-z_]+", text))


def needed(text: str) -> list[str]:
    """Views a text uses, in the order they have to be defined."""
    out: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS:
            if other != name and other in _words(VIEWS[name]):
                visit(other)
        if name not in out:
            out.append(name)

    for v in VIEWS:
        if v in _words(text):
            visit(v)
    return out


def for_spark(text: str) -> str:
    """Quoted identifiers in Spark's spelling."""
    return re.sub(r'"([^"]+)"', r"`\1`", text)


def for_check(text: str) -> str:
    """Ordered string aggregation in the checking database's spelling."""
    return text.replace("listagg(", "string_agg(").replace(") WITHIN GROUP (ORDER BY n)", " ORDER BY n)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view as a DataFrame."""
    names = needed(name)
    wanted = set().union(*[_words(VIEWS[n]) for n in names])
    for t in TABLES:
        if t in wanted:
            load(spark, sf_dir, t).createOrReplaceTempView(t)
    for n in names[:-1]:
        spark.sql(for_spark(VIEWS[n])).createOrReplaceTempView(n)
    return spark.sql(for_spark(VIEWS[names[-1]]))


def check_sql(body: str, **ctes: str) -> str:
    """``body`` with the views (and extra CTEs, in the given order) it needs."""
    whole = " ".join([*ctes.values(), body])
    parts = [f"{n} AS ({for_check(VIEWS[n]).strip()})" for n in needed(whole)]
    parts += [f"{n} AS ({t.strip()})" for n, t in ctes.items()]
    return f"WITH {', '.join(parts)} {body.strip()}" if parts else body.strip()
