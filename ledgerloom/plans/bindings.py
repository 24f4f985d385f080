"""Reconciliation tables derived from the test tables.

Each is one SELECT that Spark and DuckDB both read; table names stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAME = "repeat(substr('ABCDE', CAST({k} % 5 AS INT) + 1, 1), 6)"
_BANK_NAME = "concat('Bank ', c_nationkey % 3)"

SPARSE, DENSE = "CAST(round(o_totalprice * 100) AS BIGINT)", "CAST(floor(o_totalprice / 2000) AS BIGINT) * 200000 + 100"

VIEWS = {
    "sellout": "SELECT CAST(l_orderkey AS STRING) AS order_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents, substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) AS month, l_linenumber AS line_no FROM {lineitem} WHERE l_linenumber <= 3",
    "refund": "SELECT DISTINCT CAST(l_orderkey AS STRING) AS order_id FROM {lineitem} WHERE l_linenumber = 4 AND l_returnflag = 'R'",
    "returned": "SELECT DISTINCT CAST(l_orderkey AS STRING) AS order_id FROM {lineitem} WHERE l_linenumber = 5 AND l_returnflag = 'A' AND l_suppkey % 4 = 0",
    "transfer": "SELECT DISTINCT CAST(l_orderkey AS STRING) AS order_id FROM {lineitem} WHERE l_linenumber = 6 AND l_returnflag = 'N' AND l_linestatus = 'F'",
    "settlement": "SELECT CAST(o_orderkey AS STRING) AS partner_txn_id, CAST(round(o_totalprice * 100) AS BIGINT) AS rmb_cents, CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'P' END AS type, CASE o_custkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'CNY' END AS currency, substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS month FROM {orders} WHERE o_orderkey % 10 <> 7",
    "bank": f"""SELECT concat('B', o_orderkey) AS txn_id, o_orderkey AS ord, CASE WHEN o_orderkey % 97 = 5 THEN '' ELSE lpad(CAST(c_nationkey % 5 AS STRING), 10, '6') END AS account_no, {_BANK_NAME} AS bank_name,
        CAST(o_orderdate AS DATE) AS transaction_date, CASE WHEN o_orderkey % 2 = 0 THEN 'in' ELSE 'out' END AS flow, {{cents}} AS amount_cents, {_NAME.format(k='o_custkey')} AS counterparty_name, '' AS summary, '' AS description
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "ledger": f"""SELECT concat('E', o_orderkey, '-', p) AS entry_id, o_orderkey * 2 + p AS ord, CASE WHEN o_orderkey % 211 = 1 THEN lpad(CAST((c_nationkey + 1) % 5 AS STRING), 10, '6') WHEN o_orderkey % 89 = 3 THEN '' ELSE lpad(CAST(c_nationkey % 5 AS STRING), 10, '6') END AS account_no,
        {_BANK_NAME} AS bank_name, least(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT), last_day(CAST(o_orderdate AS DATE))) AS transaction_date,
        CASE WHEN (o_orderkey % 2 = 0) = (o_orderkey % 211 <> 1) THEN 'in' ELSE 'out' END AS flow,
        CASE WHEN o_orderkey % 7 = 3 AND p = 1 THEN CAST(floor(({{cents}}) * 0.6) AS BIGINT) WHEN o_orderkey % 7 = 3 THEN {{cents}} - CAST(floor(({{cents}}) * 0.6) AS BIGINT) ELSE {{cents}} + CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END END AS amount_cents,
        {_NAME.format(k='(o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)')} AS counterparty_name, CASE WHEN o_orderkey % 211 = 1 THEN '资金调拨' ELSE '' END AS summary, CASE WHEN o_orderkey % 211 = 1 THEN '银行存款' ELSE '' END AS subject
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey CROSS JOIN (SELECT 1 AS p UNION ALL SELECT 2 AS p) parts WHERE o_orderkey % 10 <> 0 AND (p = 1 OR o_orderkey % 7 = 3)""",
    "day_ledger": f"""SELECT concat('D', o_orderkey, '-', p) AS entry_id, o_orderkey * 2 + p AS ord, CASE WHEN o_orderkey % 97 = 5 THEN '' ELSE lpad(CAST(c_nationkey % 5 AS STRING), 10, '6') END AS account_no, {_BANK_NAME} AS bank_name, CAST(o_orderdate AS DATE) AS transaction_date,
        CASE WHEN o_orderkey % 2 = 0 THEN 'in' ELSE 'out' END AS flow, CASE WHEN p = 1 THEN CAST(floor(({{cents}}) * 0.6) AS BIGINT) ELSE {{cents}} - CAST(floor(({{cents}}) * 0.6) AS BIGINT) END AS amount_cents, {_NAME.format(k='o_custkey')} AS counterparty_name, '' AS summary, '' AS subject
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey CROSS JOIN (SELECT 1 AS p UNION ALL SELECT 2 AS p) parts""",
    "fee_bank": "SELECT concat('F', event_id) AS txn_id, event_id AS ord, CAST(user_id AS STRING) AS account_no, '' AS bank_name, CAST(ts AS DATE) AS transaction_date, 'out' AS flow, CAST(round(value * 10) AS BIGINT) AS amount_cents, '' AS counterparty_name, '手续费' AS summary, '' AS description FROM {events} WHERE event_type = 'click' AND value <= 300",
    "fee_ledger": """SELECT concat('G', user_id, '-', month) AS entry_id, user_id AS ord, CAST(user_id AS STRING) AS account_no, '' AS bank_name, last_day(min(day)) AS transaction_date, 'out' AS flow,
        CAST(sum(cents) - CASE WHEN user_id % 3 = 0 THEN max(cents) ELSE 0 END + CASE WHEN user_id % 5 = 0 THEN 7 ELSE 0 END AS BIGINT) AS amount_cents, '' AS counterparty_name, '手续费' AS summary, '' AS subject
        FROM (SELECT user_id, CAST(ts AS DATE) AS day, substr(CAST(CAST(ts AS DATE) AS STRING), 1, 7) AS month, CAST(round(value * 10) AS BIGINT) AS cents FROM {events} WHERE event_type = 'click' AND value <= 300) c GROUP BY user_id, month""",
}
TABLES = ("orders", "customer", "lineitem", "events", "nation", "supplier")


def view(spark: SparkSession, sf_dir: str, name: str, cents: str = SPARSE) -> DataFrame:
    sql = VIEWS[name].replace("{cents}", cents)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def ctes(*names: str, cents: str = SPARSE) -> str:
    """The same views as the head of a DuckDB query."""
    plain = {t: t for t in TABLES}
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('{cents}', cents).format(**plain)})" for n in names)


def ratio_sql(a: str, b: str) -> str:
    """SQL for the similarity of two normalised texts: twice their longest common subsequence over both lengths, row by row."""
    start = f"list_transform(range(0, len({a}) + 1), lambda z: CAST(0 AS BIGINT))"
    cell = f"greatest(prev[i + 1], acc[-1], prev[i] + CAST(({a})[i] = ch AS BIGINT))"
    row = f"list_reduce(CAST(range(1, len({a}) + 1) AS BIGINT[]), lambda acc, i: list_append(acc, {cell}), [CAST(0 AS BIGINT)])"
    common = f"list_last(list_reduce(string_split({b}, ''), lambda prev, ch: {row}, {start}))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {common} / (len({a}) + len({b})) END"
