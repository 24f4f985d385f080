"""Registered queries: value functions, quality checks, layouts and cleaning over raw tables derived from the test tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import cleaning, layout, outbound, quality
from ..operators.scratch import materialise, scratch_dir
from ..sources import records
from .bindings import TABLES, VIEWS, ratio_sql, view
from .queries import query

_X = "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING)"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
VIEWS |= {
    "raw": f"""SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '--' WHEN 2 THEN concat('(', {_X}, ')') WHEN 3 THEN concat('￥', {_X}, '元') WHEN 4 THEN concat('1,', {_X}) WHEN 5 THEN 'abc' WHEN 6 THEN concat({_X}, ' ca') WHEN 7 THEN concat(' -', {_X}) ELSE {_X} END AS amount,
        CASE o_orderkey % 6 WHEN 0 THEN {_DAY} WHEN 1 THEN replace({_DAY}, '-', '/') WHEN 2 THEN replace({_DAY}, '-', '') WHEN 3 THEN concat({_DAY}, ' 08:09:10') WHEN 4 THEN 'soon' ELSE '' END AS day,
        CASE o_orderkey % 5 WHEN 0 THEN concat('收到', repeat(substr('甲乙丙丁', CAST(o_custkey % 4 AS INT) + 1, 1), 3), '的货款') WHEN 1 THEN concat('付给 Acme-', o_custkey, '/invoice') WHEN 2 THEN '手续费 2022/01/01 - 2022/01/31' WHEN 3 THEN concat(o_custkey % 12 + 1, '月服务费') ELSE concat('GIRO ', o_orderpriority) END AS summary,
        CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' a ' ELSE concat(o_custkey % 7, '|', ' 8', '||x') END AS note, CAST(round(o_totalprice * 100) AS BIGINT) % 200000 AS cents, CAST(o_orderdate AS DATE) AS own_day FROM {{orders}}""",
    "dirty": f"""SELECT concat('s', o_custkey % 3) AS source_id, o_orderkey AS row_no, concat('E', o_orderkey) AS entry_id, CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN replace({_DAY}, '-', '/') ELSE {_DAY} END AS transaction_date,
        CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'A-77' ELSE lpad(CAST(o_custkey % 5 AS STRING), 10, '6') END AS account_no, CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'X｜Y' ELSE 'Bank' END AS bank_name, CASE WHEN o_orderkey % 37 = 0 THEN 'both' WHEN o_orderkey % 2 = 0 THEN 'in' ELSE 'out' END AS flow,
        CASE WHEN o_orderkey % 41 = 0 THEN 'nan' WHEN o_orderkey % 43 = 0 THEN '0' WHEN o_orderkey % 47 = 0 THEN concat('-', {_X}) ELSE {_X} END AS amount, CASE WHEN o_orderkey % 2 = 0 THEN {_X} ELSE '' END AS ledger_debit, CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 53 = 0 THEN {_X} ELSE '' END AS ledger_credit,
        CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'cp' END AS counterparty_name, CASE WHEN o_orderkey % 34 = 0 THEN '' ELSE 'subject' END AS subject FROM {{orders}}""",
    "files": """SELECT s_suppkey AS ord, concat(CASE s_suppkey % 4 WHEN 0 THEN 'Bank/' WHEN 1 THEN 'ledger/' WHEN 2 THEN 'other/' ELSE '' END, 'd', s_suppkey % 5, CASE s_suppkey % 3 WHEN 0 THEN '/建设银行 2022' WHEN 1 THEN '/招商银行 2021' ELSE '/x' END, '.xlsx') AS relative, concat('d', s_suppkey % 5) AS directory,
        CASE s_suppkey % 3 WHEN 0 THEN 'CCB' WHEN 1 THEN 'CMB' ELSE '' END AS bank_name, CASE WHEN s_suppkey % 4 = 0 THEN concat('622', s_suppkey) ELSE '' END AS account_no, CASE s_suppkey % 4 WHEN 0 THEN 'bank_statement' WHEN 1 THEN 'ledger' ELSE 'unknown' END AS kind,
        CASE s_suppkey % 6 WHEN 0 THEN 'Recap' WHEN 1 THEN 'Sellout-出库' WHEN 2 THEN 'refund only' WHEN 3 THEN 'Rongqing Return WH' WHEN 4 THEN 'to bonded' ELSE 'misc' END AS sheet, 2022 AS year FROM {supplier}""",
    "sheets": """SELECT c_custkey AS ord, split_part('Filter 1;Sellout filtered;sellout without refund;RECAP;月汇总;collect;Sheet1;to be invoiced;To be credited;出库总表;税费;Sellout A;4月出库;Refund Only;refund only系统;仅退款;资损;Return WH;Rongqing Return;货损;return to bonded;退回保税仓;Interim退回;misc;to bonded;refund', ';', CAST(c_custkey % 26 AS INT) + 1) AS sheet,
        split_part('ICBC-2022.xlsx;工行2021 2019;boc_2020;中行流水;ABC 2023;农行;CCB;建行2018;cmb;招行2022;民生;华润 1999;other 2024;icbc boc', ';', CAST(c_custkey % 14 AS INT) + 1) AS name,
        split_part('手续费;银行代扣 3;银行已扣费;银行手续费;食堂;二维码;pos 12;商户款;社保;医保;税务;税收;汇缴;1.2-1.31;3月5 至 3月 9;5/1~5/7;2022年3月;12 月份;3月;货款;invoice;', ';', CAST(c_custkey % 22 AS INT) + 1) AS said FROM {customer}""",
    "cells": f"""SELECT concat('f', o_custkey % 40) AS source_file, concat('sh', o_custkey % 3) AS source_sheet, o_custkey % 3 AS sheet_ord, o_orderkey AS row_key, concat('src', o_custkey % 4) AS source_id,
        array('1', concat('acc', o_custkey), {_DAY}, CASE o_orderkey % 3 WHEN 0 THEN '借' WHEN 1 THEN '贷' ELSE '' END, '', CASE WHEN o_orderkey % 2 = 0 THEN 'Payee' ELSE '' END, '', concat('付给 Firm', o_custkey % 9, '/x'), '', 'd', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('1,', {_X}) END, '3.50') AS cells FROM {{orders}}""",
    "ledger_cells": f"""SELECT concat('f', o_custkey % 4) AS source_file, 'L' AS source_sheet, concat('src', o_custkey % 4) AS source_id, o_orderkey AS row_no, CASE WHEN o_orderkey % 2 = 0
        THEN array(CASE WHEN o_orderkey % 10 = 0 THEN 'sum' ELSE '1002' END, substr({_DAY}, 1, 4), substr({_DAY}, 6, 2), substr({_DAY}, 9, 2), {_DAY}, '收', '7', 'text', 'sub', CASE WHEN o_orderkey % 4 = 0 THEN {_X} ELSE '' END, CASE WHEN o_orderkey % 4 = 2 THEN {_X} ELSE '' END)
        ELSE array('1002', substr({_DAY}, 6, 2), substr({_DAY}, 9, 2), {_DAY}, '付', '8', 'text', CASE WHEN o_orderkey % 3 = 0 THEN {_X} ELSE '' END, CASE WHEN o_orderkey % 3 <> 0 THEN {_X} ELSE '' END, '', '') END AS cells FROM {{orders}}""",
}


def sql_view(*names: str) -> str:
    plain = {t: t for t in TABLES}
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**plain).replace('array(', 'list_value(')})" for n in names)


def _amount_sql(c: str) -> str:
    clean = f"regexp_replace(trim({c}), '[,￥¥元 ()]', '', 'g')"
    value = f"coalesce(TRY_CAST({clean} AS DECIMAL(20,4)), TRY_CAST(nullif(regexp_extract({clean}, '-?[0-9]+([.][0-9]+)?'), '') AS DECIMAL(20,4)), 0)"
    return f"CASE WHEN {clean} IN ('', '-', '--') THEN 0 WHEN trim({c}) LIKE '(%)' THEN -abs({value}) ELSE {value} END"


_DATE = "coalesce(TRY_CAST(CASE WHEN regexp_full_match(trim({c}), '[0-9]{{8}}') THEN substr(trim({c}), 1, 4) || '-' || substr(trim({c}), 5, 2) || '-' || substr(trim({c}), 7, 2) ELSE replace(split_part(trim({c}), ' ', 1), '/', '-') END AS DATE), NULL)"


@query(sql_view("raw") + f" SELECT k, CAST(round(({_amount_sql('amount')}) * 100) AS BIGINT) AS cents, TRY_CAST(nullif(regexp_extract(coalesce(note, ''), '[0-9]+'), '') AS BIGINT) AS first_int FROM raw")
def parse_amounts(spark, d):
    return view(spark, d, "raw").select("k", s.amount_to_cents("amount").alias("cents"), s.parse_int("note").alias("first_int"))


@query(sql_view("raw") + f" SELECT k, CAST(round(({_amount_sql('amount')}) * 100) AS BIGINT) AS cents FROM raw")
def parse_amounts_platform(spark, d):
    return view(spark, d, "raw").select("k", s.cents(s.parse_amount_platform("amount")).alias("cents"))


@query(sql_view("raw") + f", p AS (SELECT k, day, own_day, {_DATE.format(c='day')} AS parsed FROM raw) SELECT k, parsed, coalesce(strftime(parsed, '%Y-%m-%d'), trim(day)) AS shown, own_day AS rebuilt, regexp_replace(day, '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})$', '\\1-\\2-\\3') AS compact FROM p")
def parse_dates(spark, d):
    return view(spark, d, "raw").select("k", s.parse_date("day").alias("parsed"), s.csv_date("day").alias("shown"), s.date_from_parts(F.year("own_day"), F.month("own_day"), F.day("own_day")).alias("rebuilt"), s.compact_date("day").alias("compact"))


@query(sql_view("raw") + " SELECT k, regexp_replace(lower(trim(summary)), '[\\s,，。；;：:/\\\\()\\[\\]（）【】\\-_=+]', '', 'g') AS normal, regexp_replace(coalesce(note, ''), '[^0-9]', '', 'g') AS digits, CASE WHEN coalesce(trim(note), '') IN ('', trim(summary)) THEN trim(summary) ELSE trim(summary) || ' | ' || trim(note) END AS joined, CASE WHEN coalesce(trim(note), '') = '' THEN trim(summary) ELSE trim(note) END AS first_text FROM raw")
def text_norm(spark, d):
    return view(spark, d, "raw").select("k", s.normalize_text("summary").alias("normal"), s.digits("note").alias("digits"), s.join_unique("summary", "note").alias("joined"), s.first_nonblank("note", "summary").alias("first_text"))


@query(sql_view("raw") + " SELECT k, substr(trim(regexp_extract(regexp_replace(trim(summary), '^(收到|收|付给|支付|付)', ''), '^(.*?)(/|的|关于|$)', 1), ' ,，。；;：:-_'), 1, 80) AS name, regexp_replace(lower(summary), '[^\\p{L}\\p{N}_]+', '', 'g') AS name_key FROM raw")
def counterparty_extract(spark, d):
    return view(spark, d, "raw").select("k", s.extract_counterparty("summary").alias("name"), s.counterparty_key(F.lit(""), "summary").alias("name_key"))


@query(sql_view("raw") + " SELECT k, array_to_string(list_filter(list_transform(string_split(coalesce(trim(note), ''), '|'), lambda v: trim(v)), lambda v: v <> ''), ',') AS ids, lower(coalesce(trim(note), '')) IN ('true', '1', 'yes', 'y', '是', '通过') AS approved FROM raw")
def ids_split(spark, d):
    return view(spark, d, "raw").select("k", F.array_join(s.split_ids("note"), ",").alias("ids"), s.as_bool("note").alias("approved"))


@query(sql_view("raw") + " SELECT k, regexp_matches(summary, '手续费|SMSP|Service Charge') AND cents <= 100000 AS fee, regexp_matches(upper(trim(summary)), '^(OBSS|GIRO)') AS bulk, contains(summary, '调拨') AS moved FROM raw")
def flags_fee_transfer(spark, d):
    return view(spark, d, "raw").select("k", s.is_fee("summary", F.lit(""), F.lit(""), "cents").alias("fee"), s.is_bulk_payment("summary", F.lit("")).alias("bulk"), s.is_transfer("summary", F.lit("银行存款")).alias("moved"))


@query(sql_view("raw") + ", p AS (SELECT k, own_day, TRY_CAST(nullif(regexp_extract(summary, '([0-9]{1,2})月', 1), '') AS INT) AS m FROM raw) SELECT k, CASE WHEN m BETWEEN 1 AND 12 THEN make_date(year(own_day), m, 1) ELSE CAST(date_trunc('month', own_day) AS DATE) END AS period_start, last_day(CASE WHEN m BETWEEN 1 AND 12 THEN make_date(year(own_day), m, 1) ELSE own_day END) AS period_end FROM p")
def infer_period(spark, d):
    p = view(spark, d, "raw").select("k", s.infer_period("summary", "own_day").alias("p"))
    return p.select("k", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


@query(sql_view("raw") + " SELECT k, substr(md5('bank:' || k || ':' || summary || CASE WHEN coalesce(trim(note), '') = '' THEN '' ELSE ':' || trim(note) END), 1, 12) AS sid, 'src:r' || k AS row_id FROM raw")
def stable_ids(spark, d):
    return view(spark, d, "raw").select("k", s.stable_id("bank", "k", "summary", "note").alias("sid"), s.source_row_id(F.lit("src"), F.lit(""), F.lit(""), "k", False).alias("row_id"))


@query(sql_view("raw") + " SELECT k, strftime(own_day, '%Y-%m-%d') AS day_text, CASE WHEN cents = 0 THEN '' ELSE format('{:.2f}', cents / 100) END AS amount_text, CASE WHEN length(trim(summary)) > 8 THEN substr(trim(summary), 1, 8) || '...' ELSE trim(summary) END AS short, CASE WHEN k % 2 = 0 THEN cents ELSE -cents END AS signed, CASE WHEN k % 100 >= 82 THEN 'high' WHEN k % 100 >= 65 THEN 'medium' ELSE 'low' END AS label FROM raw")
def format_cells(spark, d):
    flow = F.when(F.col("k") % 2 == 0, "in").otherwise("out")
    return view(spark, d, "raw").select("k", s.format_date("own_day").alias("day_text"), s.format_amount(F.col("cents") / 100).alias("amount_text"), s.shorten("summary", 8).alias("short"), s.signed_cents(flow, "cents").alias("signed"), s.confidence_label((F.col("k") % 100) / 100).alias("label"))


@query(sql_view("raw") + ", p AS (SELECT k, CAST(k % 15 AS INT) AS m FROM raw) SELECT k, CASE WHEN k % 3 = 0 AND m BETWEEN 1 AND 12 THEN '2021-' || lpad(m::VARCHAR, 2, '0') WHEN k % 3 = 1 AND m BETWEEN 1 AND 12 THEN '2023' || '-' || lpad(m::VARCHAR, 2, '0') WHEN k % 3 = 2 AND m BETWEEN 1 AND 12 THEN '2022-' || lpad(m::VARCHAR, 2, '0') ELSE 'unknown' END AS path_month, CASE WHEN m BETWEEN 1 AND 12 THEN '2022-' || lpad(m::VARCHAR, 2, '0') ELSE 'unknown' END AS name_month FROM p")
def month_keys(spark, d):
    m = (F.col("k") % 15).cast("string")
    path = F.when(F.col("k") % 3 == 0, F.concat(F.lit("in/"), m, F.lit("-21/a.csv"))).when(F.col("k") % 3 == 1, F.concat(F.lit("in/2023"), F.lpad(m, 2, "0"), F.lit("/b.csv"))).otherwise(F.concat(F.lit("in/"), m, F.lit("/c.csv")))
    return view(spark, d, "raw").select("k", s.month_from_path(path).alias("path_month"), s.month_from_filename(F.concat(m, F.lit("月.xlsx"))).alias("name_month"))


@query(f"SELECT c_custkey, round({ratio_sql('x', 'y')}, 6) AS similarity FROM (SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9#]', '', 'g') AS x, regexp_replace(lower(c_mktsegment || c_name), '[^a-z0-9#]', '', 'g') AS y FROM customer)")
def text_similarity(spark, d):
    from ..functions.similarity import text_similarity as sim

    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", F.round(sim("c_name", F.concat_ws(" ", "c_mktsegment", "c_name")), 6).alias("similarity"))


# Quality -----------------------------------------------------------------------------------------------------------


def _dq(check: str, tests: dict[str, str]) -> str:
    parts = [f"SELECT '{check}' AS \"check\", source_id AS source, '{f}' AS field, count(*) FILTER (WHERE {t}) AS bad_count, count(*) AS total FROM dirty GROUP BY source_id" for f, t in tests.items()]
    return sql_view("dirty") + " " + " UNION ALL ".join(parts)


def _num(c: str) -> str:
    return f"TRY_CAST(replace(trim({c}), ',', '') AS DECIMAL(20,4))"


@query(sql_view("dirty") + f", b AS (SELECT *, coalesce({_num('amount')} = 0, true) AS bad FROM dirty), r AS (SELECT source_id, row_no, row_number() OVER (PARTITION BY source_id ORDER BY row_no) AS k FROM b WHERE bad), t AS (SELECT source_id, string_agg(row_no::VARCHAR, ',' ORDER BY row_no) AS sample_rows FROM r WHERE k <= 10 GROUP BY source_id) SELECT 'amount_zero_or_invalid' AS \"check\", source_id AS source, 'amount' AS field, count(*) FILTER (WHERE bad) AS bad_count, count(*) AS total, coalesce(any_value(sample_rows), '') AS sample_rows FROM b LEFT JOIN t USING (source_id) GROUP BY source_id")
def dq_amounts(spark, d):
    return quality.amount_problems(view(spark, d, "dirty"))


@query(_dq("negative", {c: f"{_num(c)} < 0" for c in ("amount", "ledger_debit", "ledger_credit")}))
def dq_negative(spark, d):
    return quality.negative_values(view(spark, d, "dirty"), ["amount", "ledger_debit", "ledger_credit"])


@query(_dq("blank", {c: f"trim({c}) = ''" for c in ("transaction_date", "account_no", "entry_id", "flow", "amount")}))
def dq_required(spark, d):
    return quality.blanks(view(spark, d, "dirty"), ["transaction_date", "account_no", "entry_id", "flow", "amount"])


@query(_dq("literal_null", {c: f"trim({c}) IN ('nan', 'None', 'NaN', 'N/A', 'NoneType')" for c in ("amount", "bank_name")}))
def dq_literals(spark, d):
    return quality.literal_nulls(view(spark, d, "dirty"), ["amount", "bank_name"])


@query(sql_view("dirty") + " SELECT source_id AS source, flow AS value, count(*) AS n FROM dirty WHERE flow NOT IN ('in', 'out') GROUP BY ALL")
def dq_flow(spark, d):
    return quality.flow_values(view(spark, d, "dirty"))


@query(_dq("unparsable_or_negative", {c: f"trim({c}) <> '' AND ({_num(c)} IS NULL OR {_num(c)} < 0)" for c in ("amount", "ledger_debit")}))
def dq_numbers(spark, d):
    return quality.unusable_numbers(view(spark, d, "dirty"), ["amount", "ledger_debit"])


@query(_dq("date_format", {"transaction_date": "NOT regexp_full_match(trim(transaction_date), '[0-9]{4}-[0-9]{2}-[0-9]{2}')"}))
def dq_dates(spark, d):
    return quality.bad_dates(view(spark, d, "dirty"))


_D, _C, _A = (f"coalesce({_num(c)}, 0)" for c in ("ledger_debit", "ledger_credit", "amount"))


@query(_dq("direction", {"flow": f"NOT CASE flow WHEN 'in' THEN {_D} > 0 AND {_C} = 0 AND abs({_A} - {_D}) <= 0.01 WHEN 'out' THEN {_C} > 0 AND {_D} = 0 AND abs({_A} - {_C}) <= 0.01 ELSE true END"}))
def dq_direction(spark, d):
    return quality.direction_conflicts(view(spark, d, "dirty"), "ledger_debit", "ledger_credit")


@query(sql_view("dirty") + ", a AS (SELECT source_id AS source, count(*) AS total, count(*) FILTER (WHERE account_no = '') AS blank_account, count(*) FILTER (WHERE bank_name = '') AS blank_bank, count(*) FILTER (WHERE account_no = '' AND bank_name = '' AND subject = '') AS blank_all FROM dirty GROUP BY 1) SELECT *, CASE WHEN blank_account = total THEN 'all' WHEN blank_account > 0 THEN 'some' ELSE 'none' END AS account_state, CASE WHEN blank_bank = total THEN 'all' WHEN blank_bank > 0 THEN 'some' ELSE 'none' END AS bank_state FROM a")
def dq_accounts(spark, d):
    return quality.account_completeness(view(spark, d, "dirty"))


@query(sql_view("dirty") + " SELECT 'account_no' AS field, account_no AS value, count(*) AS n FROM dirty WHERE NOT regexp_full_match(account_no, '[0-9 ]*') GROUP BY account_no UNION ALL SELECT 'bank_name', bank_name, count(*) FROM dirty WHERE regexp_matches(bank_name, '[｜|]|银行存款') GROUP BY bank_name")
def dq_normalize(spark, d):
    return quality.values_to_normalize(view(spark, d, "dirty"))


@query(sql_view("dirty") + " SELECT row_no, CASE WHEN bank_name = 'X｜Y' THEN 'X Y' ELSE bank_name END AS bank_name, bank_name = 'X｜Y' AS replaced FROM dirty")
def dq_apply_mapping(spark, d):
    rows = view(spark, d, "dirty")
    mapping = rows.where("bank_name = 'X｜Y'").select(F.col("bank_name").alias("value"), F.lit("X Y").alias("replacement")).distinct()
    return quality.apply_normalization(rows.select("row_no", "bank_name"), mapping, "bank_name")


@query(sql_view("dirty") + ", x AS (SELECT *, CASE WHEN regexp_full_match(transaction_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN transaction_date END AS iso FROM dirty) SELECT source_id AS source, count(*) AS n, count(DISTINCT nullif(account_no, '')) AS accounts, min(iso) AS first_day, max(iso) AS last_day, count(*) FILTER (WHERE flow = 'in') AS in_rows, count(*) FILTER (WHERE flow = 'out') AS out_rows FROM x GROUP BY 1")
def dq_source_stats(spark, d):
    return quality.source_stats(view(spark, d, "dirty"))


_CENTS = f"CAST(round(({_amount_sql('amount')}) * 100) AS BIGINT)"
_SIDE = "SELECT count(*) FILTER (WHERE counterparty_name = '') AS {p}_blank, CAST(coalesce(sum(CASE flow WHEN 'in' THEN " + _CENTS + " WHEN 'out' THEN -" + _CENTS + " ELSE 0 END), 0) AS BIGINT) AS {p}_net FROM dirty WHERE {w}"


@query(sql_view("dirty") + ", b AS (" + _SIDE.format(p="bank", w="true") + "), l AS (" + _SIDE.format(p="ledger", w="flow <> 'both'") + ") SELECT *, abs(bank_net - ledger_net) <= 1 AS agree FROM b, l")
def dq_net_cross(spark, d):
    rows = view(spark, d, "dirty")
    return quality.net_of_sides(rows, rows.where("flow <> 'both'"))


# Layouts -----------------------------------------------------------------------------------------------------------


@query(sql_view("files") + " SELECT ord, CASE WHEN NOT contains(relative, '/') THEN 'unknown' WHEN lower(split_part(relative, '/', 1)) = 'bank' THEN 'bank_statement' WHEN lower(split_part(relative, '/', 1)) = 'ledger' THEN 'ledger' ELSE 'unknown' END AS kind FROM files")
def dir_class(spark, d):
    return view(spark, d, "files").select("ord", layout.directory_class("relative").alias("kind"))


@query(sql_view("sheets") + """ SELECT ord, CASE WHEN regexp_matches(lower(sheet), 'filter|without refund|recap|汇总|collect|sheet|to be invoiced|to be credited|出库总表|税费') THEN 'skip' WHEN regexp_matches(lower(sheet), 'sellout|出库') THEN 'sellout'
    WHEN regexp_matches(lower(sheet), 'refund only|仅退款|资损') THEN 'refund' WHEN regexp_matches(lower(sheet), 'return wh|rongqing return|货损') THEN 'return' WHEN regexp_matches(lower(sheet), 'return to bonded|退回保税仓|interim退回') THEN 'transfer' ELSE 'skip' END AS kind FROM sheets""")
def sheet_class(spark, d):
    return view(spark, d, "sheets").select("ord", layout.sheet_class("sheet").alias("kind"))


@query(sql_view("sheets") + r""" SELECT ord, regexp_matches(lower(said), '手续费|银行代扣|银行已扣费|银行手续费|食堂|二维码|pos|商户|社保|医保|税务|税收|汇缴')
    OR regexp_matches(said, '[0-9]{1,2}\s*[.月/]\s*[0-9]{1,2}\s*(-|~|至|到|—)\s*[0-9]{1,2}\s*[.月/]\s*[0-9]{1,2}') OR regexp_matches(said, '[0-9]{4}年[0-9]{1,2}\s*月') OR regexp_matches(said, '[0-9]{1,2}\s*月份') AS grouped FROM sheets""")
def looks_grouped(spark, d):
    from ..operators.candidates import looks_grouped as grouped

    return view(spark, d, "sheets").select("ord", grouped("said").alias("grouped"))


@query(sql_view("files") + " SELECT ord, CASE ord % 3 WHEN 0 THEN 'batch' WHEN 1 THEN 'transaction' ELSE CASE WHEN ord % 10 > 5 THEN 'transaction' ELSE 'unknown' END END AS kind FROM files")
def settlement_class(spark, d):
    f = view(spark, d, "files").select("ord", (F.col("ord") % 10).alias("n"), F.array(F.when(F.col("ord") % 3 == 0, "settle_batch_no").when(F.col("ord") % 3 == 1, "partner_transaction_id").otherwise("amount")).alias("header"))
    return f.select("ord", layout.settlement_class("header", "n").alias("kind"))


_BANKS = (("icbc|工行", "中国工商银行", "icbc"), ("boc|中行", "中国银行", "boc"), ("abc|农行", "中国农业银行", "abc"), ("ccb|建行", "中国建设银行", "ccb"), ("cmb|招行", "招商银行", "cmb"), ("民生", "中国民生银行", "ceb"), ("华润", "华润银行", "unknown"))
_BANK_CASE = " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{{{k}}}'" for k, (p, _, _) in enumerate(_BANKS))


@query(sql_view("sheets") + f" SELECT ord, CASE {_BANK_CASE.format(*[b for _, b, _ in _BANKS])} ELSE '' END AS bank_name, coalesce(TRY_CAST(nullif(regexp_extract(name, '(20[0-9]{{2}})', 1), '') AS INT), 2022) AS year, CASE {_BANK_CASE.format(*[c for _, _, c in _BANKS])} ELSE 'unknown' END AS bank_code FROM sheets")
def file_meta(spark, d):
    return view(spark, d, "sheets").select("ord", layout.file_meta("name", 2022).alias("m")).select("ord", "m.*")


_FILL = sql_view("files") + ", f AS (SELECT directory, bank_name, arg_min(account_no, ord) FILTER (WHERE account_no <> '') AS known FROM files GROUP BY ALL)"


@query(_FILL + " SELECT ord, coalesce(nullif(account_no, ''), known, '') AS account_no FROM files JOIN f USING (directory, bank_name)")
def account_backfill(spark, d):
    return layout.backfill_accounts(view(spark, d, "files")).select("ord", "account_no")


@query(sql_view("files") + " SELECT ord, concat_ws(',', CASE WHEN bank_name = '' THEN 'bank_name' END, CASE WHEN account_no = '' THEN 'account_no' END) AS missing FROM files WHERE kind <> 'unknown' AND (bank_name = '' OR account_no = '')")
def incomplete_sources(spark, d):
    return layout.incomplete_sources(view(spark, d, "files")).select("ord", "missing")


@query(sql_view("files") + ", x AS (SELECT *, unnest([sheet, 'two']) AS sh FROM files) SELECT ord, sh AS sheet, concat_ws('_', nullif(bank_name, ''), kind, year::VARCHAR, sh) AS source_id FROM x")
def sheet_entries(spark, d):
    files = view(spark, d, "files").withColumn("sheets", F.array("sheet", F.lit("two"))).drop("sheet")
    return layout.expand_sheets(files).select("ord", "sheet", "source_id")


def _cells(spark, d):
    c = view(spark, d, "cells")
    from pyspark.sql import Window

    return c.withColumn("row_no", F.row_number().over(Window.partitionBy("source_file", "source_sheet").orderBy("row_key")))


_ROWS = sql_view("cells") + ", c AS (SELECT *, row_number() OVER (PARTITION BY source_file, source_sheet ORDER BY row_key) AS row_no FROM cells)"


@query(_ROWS + ", t AS (SELECT source_file, source_sheet, sheet_ord, CAST(bool_or(row_no <= 5 AND contains(array_to_string(cells, ' '), 'Payee')) AS INT) + CAST(bool_or(row_no <= 5 AND contains(array_to_string(cells, ' '), '借')) AS INT) AS score FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, sheet_ord) AS k FROM t) SELECT source_file, source_sheet, score FROM r WHERE k = 1", name="select_sheet")
def select_sheet(spark, d):
    return layout.select_sheet(_cells(spark, d), ["payee", "借"])


@query(_ROWS + ", f AS (SELECT source_file, source_sheet, arg_min(list_filter(cells, lambda v: trim(v) <> ''), row_no) AS names FROM c GROUP BY ALL) SELECT source_file, source_sheet, substr(md5(array_to_string(list_sort(names), '|')), 1, 8) AS signature FROM f")
def column_signature(spark, d):
    return layout.sheet_signatures(_cells(spark, d))


@query(_ROWS + ", h AS (SELECT source_file, source_sheet, min(row_no) FILTER (WHERE row_no <= 20 AND len(list_filter(cells, lambda v: trim(v) <> '')) >= 9) AS head FROM c GROUP BY ALL) SELECT source_file, source_sheet, row_no FROM c JOIN h USING (source_file, source_sheet) WHERE row_no <= coalesce(head + 8, 30)")
def smart_sample(spark, d):
    return layout.smart_sample(_cells(spark, d), header_min=9).select("source_file", "source_sheet", F.col("row_no").cast("long").alias("row_no"))


@query(_ROWS + """, s AS (SELECT source_file, source_sheet, max(CASE WHEN row_no = 1 THEN cells END) AS one, max(CASE WHEN row_no = 2 THEN cells END) AS two FROM c WHERE row_no <= 2 GROUP BY ALL),
    p AS (SELECT *, 2 * len(list_filter(one, lambda v: trim(v) = '' OR starts_with(v, 'Unnamed') OR TRY_CAST(v AS DOUBLE) IS NOT NULL)) > len(one) AND two IS NOT NULL AS second FROM s),
    n AS (SELECT source_file, source_sheet, CASE WHEN second THEN 2 ELSE 1 END AS header_row, CASE WHEN second THEN two ELSE one END AS names FROM p),
    u AS (SELECT source_file, source_sheet, header_row, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY source_file, source_sheet, name ORDER BY pos) - 1 AS dup FROM u)
    SELECT source_file, source_sheet, header_row, string_agg(CASE WHEN dup > 0 THEN name || '_dup' || dup ELSE name END, '|' ORDER BY pos) AS names FROM k GROUP BY ALL""")
def header_promote(spark, d):
    return layout.promote_header(_cells(spark, d)).select("source_file", "source_sheet", "header_row", F.array_join("names", "|").alias("names"))


_PROFILED = ("amount", "day", "summary", "note")
_PROFILE = " UNION ALL ".join(f"SELECT k, '{c}' AS field, coalesce(trim({c}), '') AS value FROM raw" for c in _PROFILED)


@query(sql_view("raw") + f", x AS ({_PROFILE})" + r""", f AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY k) AS r FROM x WHERE value <> ''), t AS (SELECT field, avg(CASE WHEN regexp_matches(value, '^[-+]?[0-9,]+(\.[0-9]+)?$') THEN 1 ELSE 0 END) AS num, avg(CASE WHEN regexp_matches(value, '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}') THEN 1 ELSE 0 END) AS dat FROM f WHERE r <= 100 GROUP BY field)
    SELECT field, count(*) AS n, count(*) FILTER (WHERE value <> '') AS filled, coalesce(any_value(CASE WHEN num >= 0.8 THEN 'number' WHEN dat >= 0.8 THEN 'date' ELSE 'text' END), 'empty') AS kind, field = 'amount' AS is_amount, false AS is_date FROM x LEFT JOIN t USING (field) GROUP BY field""")
def profile_columns(spark, d):
    return layout.profile_columns(view(spark, d, "raw").select("k", *_PROFILED), "k")


@query(_ROWS + " SELECT DISTINCT source_file, source_sheet, '62220000' || substr(source_file, 2) AS account_no FROM c WHERE row_no = 2")
def account_from_cells(spark, d):
    heads = F.array(*[F.element_at(F.array(*map(F.lit, layout.ACCOUNT_WORDS)), (F.regexp_extract("source_file", r"\d+", 0).cast("int") % len(layout.ACCOUNT_WORDS)) + 1), F.lit("卡号")])
    value = F.array(F.concat(F.lit("62220000"), F.regexp_extract("source_file", r"\d+", 0)), F.lit("12345678"))
    rows = _cells(spark, d).withColumn("cells", F.when(F.col("row_no") == 1, heads).when(F.col("row_no") == 2, value).otherwise(F.col("cells")))
    return layout.account_from_cells(rows)


_AT = "coalesce(trim(cells[{k} + 1]), '')"


@query(sql_view("cells") + f", a AS (SELECT row_key, {_AT.format(k=3)} AS side, TRY_CAST({_AT.format(k=2)} AS DATE) AS transaction_date, abs(CAST(round(({_amount_sql(_AT.format(k=10))}) * 100) AS BIGINT)) AS amount_cents, {_AT.format(k=5)} AS payee, {_AT.format(k=7)} AS summary FROM cells) SELECT row_key, transaction_date, CASE side WHEN '借' THEN 'out' WHEN '贷' THEN 'in' END AS flow, amount_cents, CASE WHEN payee <> '' THEN payee ELSE regexp_extract(summary, '付给 (.*?)/', 1) END AS counterparty_name FROM a WHERE side <> '' AND amount_cents > 0")
def bank_positional(spark, d):
    out = cleaning.clean_bank_positional(view(spark, d, "cells").withColumn("row_no", F.col("row_key")))
    return out.select(F.col("row_no").alias("row_key"), "transaction_date", "flow", "amount_cents", "counterparty_name")


_NET = f"CAST(round((({_amount_sql('debit')}) - ({_amount_sql('credit')})) * 100) AS BIGINT)"


@query(sql_view("ledger_cells") + f", a AS (SELECT row_no, row_no % 2 = 0 AS y, cells FROM ledger_cells WHERE regexp_matches(cells[1], '[0-9]')), b AS (SELECT row_no, TRY_CAST(CASE WHEN y THEN cells[5] ELSE cells[4] END AS DATE) AS transaction_date, CASE WHEN y THEN cells[10] ELSE cells[8] END AS debit, CASE WHEN y THEN cells[11] ELSE cells[9] END AS credit, CASE WHEN y THEN cells[6] || cells[7] ELSE cells[5] || cells[6] END AS voucher_no FROM a), n AS (SELECT *, {_NET} AS net FROM b) SELECT row_no, transaction_date, CASE WHEN net > 0 THEN 'in' ELSE 'out' END AS flow, abs(net) AS amount_cents, voucher_no FROM n WHERE net <> 0")
def ledger_positional(spark, d):
    return cleaning.clean_ledger_positional(view(spark, d, "ledger_cells")).select("row_no", "transaction_date", "flow", "amount_cents", "voucher_no")


@query(sql_view("raw") + f", b AS (SELECT k, day, CAST(round(({_amount_sql('amount')}) * 100) AS BIGINT) AS c FROM raw), n AS (SELECT k, {_DATE.format(c='day')} AS transaction_date, CASE WHEN k % 2 = 0 THEN c ELSE 0 END AS credit, CASE WHEN k % 2 = 1 THEN c ELSE 0 END AS debit FROM b) SELECT k, transaction_date, CASE WHEN credit > 0 THEN 'in' ELSE 'out' END AS flow, CASE WHEN credit > 0 THEN credit ELSE debit END AS amount_cents FROM n WHERE credit > 0 OR debit > 0")
def bank_named(spark, d):
    raw = view(spark, d, "raw").select("k", F.col("day").alias("交易时间"), F.when(F.col("k") % 2 == 0, F.col("amount")).otherwise("").alias("收入金额"), F.when(F.col("k") % 2 == 1, F.col("amount")).otherwise("").alias("支出金额"))
    return cleaning.clean_bank_named(raw).select("k", "transaction_date", "flow", "amount_cents")


@query(sql_view("raw") + f", b AS (SELECT k, day, CAST(round(({_amount_sql('amount')}) * 100) AS BIGINT) AS c FROM raw WHERE trim(day) <> ''), n AS (SELECT k, {_DATE.format(c='day')} AS transaction_date, CASE WHEN k % 2 = 0 THEN c ELSE 0 END AS debit, CASE WHEN k % 2 = 1 THEN c ELSE 0 END AS credit FROM b) SELECT k, transaction_date, CASE WHEN debit > 0 THEN 'in' ELSE 'out' END AS flow, CASE WHEN debit > 0 THEN debit ELSE credit END AS amount_cents FROM n WHERE debit > 0 OR credit > 0")
def ledger_named(spark, d):
    raw = view(spark, d, "raw").select("k", F.col("day").alias("凭证日期"), F.when(F.col("k") % 2 == 0, F.col("amount")).otherwise("").alias("借方"), F.when(F.col("k") % 2 == 1, F.col("amount")).otherwise("").alias("贷方"))
    return cleaning.clean_ledger_named(raw).select("k", "transaction_date", "flow", "amount_cents")


_PLAIN = f"CAST(({_amount_sql('amount')}) AS DOUBLE)"
_TXN = {"partner_txn_id": "CAST(k AS VARCHAR)", "original_txn_id": "coalesce(trim(note), '')", "amount": _PLAIN, "rmb_amount": _PLAIN, "fee": "NULL::DOUBLE", "settlement": "NULL::DOUBLE", "rmb_settlement": _PLAIN, "currency": "'CNY'", "rate": "NULL::DOUBLE", "payment_time": "trim(day)", "type": "'P'", "month": "'2022-01'", "source_file": "'a.csv'"}


def _told(columns: tuple[str, ...], values: dict[str, str]) -> str:
    """A SELECT list of the standard columns, those without a value blank."""
    return ", ".join(f"{values.get(c, chr(39) * 2)} AS {c}" for c in columns)


def _doubles(df, numbers):
    return df.withColumns({c: F.col(c).cast("double") for c in numbers if c in df.columns})


@query(sql_view("raw") + f" SELECT {_told(outbound.SETTLEMENT_COLUMNS, _TXN)} FROM raw")
def settlement_txn(spark, d):
    raw = view(spark, d, "raw").select(
        F.col("k").cast("string").alias("Partner Transaction ID"), F.coalesce(F.trim("note"), F.lit("")).alias("original_partner_transaction_id"), "amount", F.col("amount").alias("RMB Amount"), F.col("amount").alias("rmb_settlement"),
        F.lit("CNY").alias("currency"), F.trim("day").alias("payment_time"), F.lit("P").alias("type"), F.lit("2022-01").alias("month"), F.lit("a.csv").alias("source_file"), F.lit("x").alias("transaction_id"),
    )
    return _doubles(outbound.clean_settlement(raw), outbound.SETTLEMENT_NUMBERS)


@query(sql_view("raw") + f" SELECT {_told(outbound.BATCH_COLUMNS, {'settle_batch_no': 'CAST(k AS VARCHAR)', 'settle_date': 'trim(day)', 'amount': _PLAIN, 'fee': '0.0::DOUBLE', 'settlement': _PLAIN, 'currency': chr(39) + 'USD' + chr(39)})} FROM raw")
def settlement_batch(spark, d):
    raw = view(spark, d, "raw").select(F.col("k").cast("string").alias("Settle Batch No"), F.trim("day").alias("Settle Date"), F.col("amount").alias("Amount"), F.lit("none").alias("Fee"), F.col("amount").alias("settlement"), F.lit("USD").alias("currency"), F.lit("").alias("extra"))
    return _doubles(outbound.clean_settlement_batches(raw), outbound.BATCH_NUMBERS)


_EARLY = {"order_id": "CAST(k AS VARCHAR)", "amount": _PLAIN, "freight": "2.5::DOUBLE", "quantity": "3.0::DOUBLE", "product_name": "'title'", "product_code": "'code'", "nsv": _PLAIN, "buyer_name": "'nick'", "order_time": "trim(day)", "ship_time": "trim(day)", "source_sheet": "'early'"}
_LATE = {"order_id": "CAST(k AS VARCHAR)", "amount": _PLAIN, "freight": "NULL::DOUBLE", "quantity": "1.0::DOUBLE", "product_name": "'goods'", "nsv": "NULL::DOUBLE", "recipient_name": "'someone'", "shop_name": "'shop'", "warehouse_name": "'w1'", "logistics_no": "'L'", "logistics_company": "'C'", "payment_time": "trim(day)", "status": "'done'", "source_sheet": "'late'"}


@query(sql_view("raw") + f" SELECT {_told(outbound.SELLOUT_COLUMNS, _EARLY)} FROM raw WHERE k % 2 = 0 UNION ALL SELECT {_told(outbound.SELLOUT_COLUMNS, _LATE)} FROM raw WHERE k % 2 = 1")
def sellout_clean(spark, d):
    raw, key = view(spark, d, "raw"), F.col("k").cast("string")
    named = lambda **c: [v.alias(n) for n, v in c.items()]
    early = raw.where("k % 2 = 0").select(*named(订单编号=key, 交易订单号=F.lit("second"), 总金额=F.col("amount"), 买家应付邮费=F.lit("2.5"), 宝贝总数量=F.lit("3"), 宝贝标题=F.lit("title"), 货品编码=F.lit("code"), NSV=F.col("amount"), 买家会员名=F.lit("nick"), 订单创建时间=F.trim("day"), 出库日期=F.trim("day"), 手机=F.lit("1"), source_sheet=F.lit("early")))
    late = raw.where("k % 2 = 1").select(*named(交易订单号=key, 订单金额=F.col("amount"), 商品数量=F.lit("1"), 商品名称=F.lit("goods"), 收件人=F.lit("someone"), 店铺名称=F.lit("shop"), 仓库名称=F.lit("w1"), 配送运单号=F.lit("L"), 配送公司=F.lit("C"), 支付时间=F.trim("day"), 订单状态=F.lit("done"), source_sheet=F.lit("late")))
    return _doubles(cleaning.concat_sources([outbound.clean_sellout(early), outbound.clean_sellout(late)], list(outbound.SELLOUT_COLUMNS)), outbound.SELLOUT_NUMBERS)


_REFUND = {"order_id": "CAST(k AS VARCHAR)", "refund_time": "trim(day)", "refund_amount": _PLAIN, "refund_type": "'hand'", "need_return": "'no'", "product_name": "'title'", "buyer_name": "'nick'", "status": "'ok'", "shop_name": "'shop'", "amount": "7.0::DOUBLE", "quantity": "NULL::DOUBLE", "nsv": "NULL::DOUBLE"}
_REFUND_ALL = tuple(dict.fromkeys(outbound.REFUND_COLUMNS + outbound.SELLOUT_COLUMNS))


@query(sql_view("raw") + f" SELECT {_told(_REFUND_ALL, _REFUND)} FROM raw")
def refund_clean(spark, d):
    raw = view(spark, d, "raw")
    columns = {"退款编号": F.col("k").cast("string"), "交易订单号": F.lit("second"), "退款完结时间": F.trim("day"), "买家退款金额": F.col("amount"), "手工退款/系统退款": F.lit("hand"), "是否需要退货": F.lit("no"), "宝贝标题": F.lit("title"), "买家昵称": F.lit("nick"), "状态": F.lit("ok"), "店铺名称": F.lit("shop"), "订单金额": F.lit("7")}
    return _doubles(outbound.clean_refund(raw.select(*[v.alias(n) for n, v in columns.items()])), outbound.REFUND_NUMBERS)


_MOVED = {"order_id": "CAST(k AS VARCHAR)", "erp_order_id": "'E'", "transfer_id": "'T'", "lp_id": "'LP'", "product_code": "'P'", "product_name": "'goods'", "warehouse_name": "'w'", "transfer_time": "trim(day)", "doc_type": "'in'", "stock_type": "'good'", "merchant_code": "'M'", "quantity": "2.0::DOUBLE", "nsv": _PLAIN}


@query(sql_view("raw") + f" SELECT {_told(outbound.TRANSFER_COLUMNS, _MOVED)} FROM raw")
def transfer_clean(spark, d):
    raw = view(spark, d, "raw")
    columns = {"交易订单号": F.col("k").cast("string"), "ERP订单号": F.lit("E"), "单号": F.lit("T"), "LP单号": F.lit("LP"), "货品编码": F.lit("P"), "货品名称": F.lit("goods"), "仓库名称": F.lit("w"), "出入库时间": F.trim("day"), "单据类型": F.lit("in"), "库存类型": F.lit("good"), "商家编码": F.lit("M"), "出入数量": F.lit("2"), "NSV": F.col("amount")}
    return _doubles(outbound.clean_transfer(raw.select(*[v.alias(n) for n, v in columns.items()])), outbound.TRANSFER_NUMBERS)


# Sheets exported as delimited text, written to the shared folder and read again ---------------------------------------

_NAMING = r"source_file=([^/]+)/source_sheet=([^/]+)/[^/]+\.csv$"


def _exported(spark, rows, order: str) -> str:
    """Writes the cells of ``rows`` as one headerless file a sheet, in ``order``; returns the folder."""
    path = f"{scratch_dir(spark)}/grid-{uuid.uuid4().hex}"
    wide = rows.select("source_file", "source_sheet", order, *[F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(12)])
    dealt = wide.repartition("source_file", "source_sheet").sortWithinPartitions("source_file", "source_sheet", order).drop(order)
    dealt.write.partitionBy("source_file", "source_sheet").option("emptyValue", "").csv(path)
    return path


@query(_ROWS + ", f AS (SELECT source_file, min(source_sheet) AS source_sheet FROM c GROUP BY source_file) SELECT source_file, source_sheet, CAST(row_no AS INT) AS row_no, array_to_string(cells, '|') AS cells FROM c JOIN f USING (source_file, source_sheet)")
def grid_cells(spark, d):
    """Each workbook's first sheet, cell by cell."""
    path = _exported(spark, view(spark, d, "cells"), "row_key")
    out = records.read_cells(spark, path, naming=_NAMING, block_bytes=4096)
    return out.select("source_file", "source_sheet", "row_no", F.array_join("cells", "|", "").alias("cells"))


_BANK_ROWS = f""", t AS (SELECT source_file, source_sheet, sheet_ord, CAST(bool_or(row_no <= 5 AND contains(array_to_string(cells, ' '), 'Payee')) AS INT) + CAST(bool_or(row_no <= 5 AND contains(array_to_string(cells, ' '), '借')) AS INT) AS score FROM c GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, sheet_ord) AS k FROM t), z AS (SELECT c.* FROM c JOIN r USING (source_file, source_sheet) WHERE k = 1),
    s AS (SELECT source_file, max(CASE WHEN row_no = 1 THEN cells END) AS one, max(CASE WHEN row_no = 2 THEN cells END) AS two FROM z WHERE row_no <= 2 GROUP BY ALL),
    p AS (SELECT source_file, CASE WHEN 2 * len(list_filter(one, lambda v: trim(v) = '' OR starts_with(v, 'Unnamed') OR TRY_CAST(v AS DOUBLE) IS NOT NULL)) > len(one) AND two IS NOT NULL THEN 2 ELSE 1 END AS header_row FROM s),
    h AS (SELECT source_file, min(row_no) FILTER (WHERE row_no <= 20 AND len(list_filter(cells, lambda v: trim(v) <> '')) >= 9) AS head FROM z GROUP BY ALL),
    a AS (SELECT source_file, source_sheet, row_no, {_AT.format(k=3)} AS side, abs(CAST(round(({_amount_sql(_AT.format(k=10))}) * 100) AS BIGINT)) AS amount_cents FROM z),
    lc AS (SELECT *, row_no AS orig, row_number() OVER (PARTITION BY source_file ORDER BY row_no) AS place FROM ledger_cells),
    la AS (SELECT source_file, source_sheet, place, orig % 2 = 0 AS y, cells FROM lc WHERE regexp_matches(cells[1], '[0-9]')), lb AS (SELECT *, CASE WHEN y THEN cells[10] ELSE cells[8] END AS debit, CASE WHEN y THEN cells[11] ELSE cells[9] END AS credit FROM la),
    ln AS (SELECT *, {_NET} AS net FROM lb)"""


@query(sql_view("cells", "ledger_cells") + _ROWS[len(sql_view("cells")) :] + _BANK_ROWS + """ SELECT source_file, source_sheet, CAST(row_no AS INT) AS row_no, CASE side WHEN '借' THEN 'out' ELSE 'in' END AS flow, amount_cents, header_row, row_no <= coalesce(head + 8, 30) AS sampled
    FROM a JOIN p USING (source_file) JOIN h USING (source_file) WHERE side <> '' AND amount_cents > 0 UNION ALL SELECT source_file, source_sheet, CAST(place AS INT), CASE WHEN net > 0 THEN 'in' ELSE 'out' END, abs(net), NULL, NULL FROM ln WHERE net <> 0""")
def grid_sheets(spark, d):
    """Exported sheets read back: the chosen sheet of each statement with its header row and sample, cleaned; ledgers cleaned."""
    cells = records.read_cells(spark, _exported(spark, view(spark, d, "cells"), "row_key"), every=True, naming=_NAMING).withColumn("source_id", F.col("source_file"))
    cells = materialise(cells, "grid-cells")
    key = ["source_file", "source_sheet"]
    chosen = cells.join(layout.select_sheet(cells, ["payee", "借"]), key, "left_semi")
    told = layout.promote_header(chosen).select(*key, "header_row")
    sampled = layout.smart_sample(chosen, header_min=9).select(*key, "row_no", F.lit(True).alias("sampled"))
    rows = cleaning.clean_bank_positional(chosen).join(told, key).join(sampled, [*key, "row_no"], "left")
    bank = rows.select(*key, "row_no", "flow", "amount_cents", "header_row", F.coalesce("sampled", F.lit(False)).alias("sampled"))
    ledger = records.read_cells(spark, _exported(spark, view(spark, d, "ledger_cells"), "row_no"), naming=_NAMING).withColumn("source_id", F.col("source_file"))
    entries = cleaning.clean_ledger_positional(ledger).select(*key, "row_no", "flow", "amount_cents", F.lit(None).cast("int").alias("header_row"), F.lit(None).cast("boolean").alias("sampled"))
    return bank.unionByName(entries)


def _sheets_of_layouts(spark, d):
    """Sheets of three layouts, one with a name twice, and of a fourth that no parser knows; each with a title above its header."""
    raw = view(spark, d, "raw").where("own_day is not null")
    kind = F.pmod(F.col("k"), F.lit(4)).cast("int")
    day, cents = F.col("own_day").cast("string"), F.col("cents").cast("string")
    shapes = [F.array(day, cents, F.lit("x"), F.lit("")), F.array(cents, F.lit("y"), day, cents), F.array(F.lit("z"), day, F.lit("w"), F.concat(cents, F.lit("0"))), F.array(day, day, day, day)]
    heads = [["date", "amount", "note", "more"], ["amount", "memo", "booked", "amount"], ["who", "booked", "what", "mills"], ["a", "b", "c", "d"]]
    body = raw.select(F.concat(F.lit("f"), kind.cast("string")).alias("source_file"), F.lit("s").alias("source_sheet"), (F.col("k") + 3).cast("int").alias("row_no"), F.element_at(F.array(*shapes), kind + 1).alias("cells"))
    head = spark.createDataFrame([(f"f{n}", "s", 2, h) for n, h in enumerate(heads)] + [(f"f{n}", "s", 1, ["title"]) for n in range(4)], "source_file string, source_sheet string, row_no int, cells array<string>")
    return body.unionByName(head), heads


def _parsers(heads):
    import pandas as pd

    def parser(day: str, amount: str, factor: int):
        return lambda rows: pd.DataFrame({"source_file": rows["source_file"], "row_no": rows["row_no"], "day": rows[day], "cents": rows[amount].astype("int64") // factor})

    signature = lambda names: hashlib.md5("|".join(sorted(names)).encode()).hexdigest()[:8]
    return {signature(h): parser(*how) for h, how in zip(heads, [("date", "amount", 1), ("booked", "amount", 1), ("booked", "mills", 10)])}


@query(sql_view("raw") + " SELECT 'f' || k % 4 AS source_file, CAST(k + 3 AS INT) AS row_no, strftime(own_day, '%Y-%m-%d') AS day, cents FROM raw WHERE k % 4 < 3")
def layouts_by_signature(spark, d):
    cells, heads = _sheets_of_layouts(spark, d)
    return cleaning.apply_layouts(cells, "source_file string, row_no int, day string, cents long", _parsers(heads), together=500)[0]


@query(sql_view("raw") + " SELECT 'f3' AS source_file, 's' AS source_sheet, substr(md5('a|b|c|d'), 1, 8) AS signature, count(*) AS rows FROM raw WHERE k % 4 = 3 HAVING count(*) > 0")
def layouts_unknown(spark, d):
    cells, heads = _sheets_of_layouts(spark, d)
    return cleaning.apply_layouts(cells, "source_file string, row_no int, day string, cents long", _parsers(heads))[1]
