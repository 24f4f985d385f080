"""Registered queries: orders, reports, pairs and matching over the derived tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, orders, pairs, reports
from .bindings import DENSE, SPARSE, ctes, ratio_sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


# Orders ------------------------------------------------------------------------------------------------------------

_OUT = ("sellout", "refund", "returned", "transfer")
_NET = ctes(*_OUT) + ", excluded AS (SELECT order_id FROM refund UNION SELECT order_id FROM returned UNION SELECT order_id FROM transfer), net AS (SELECT * FROM sellout WHERE order_id NOT IN (SELECT order_id FROM excluded))"
_MATCHED = _NET.replace("WITH ", ctes("settlement") + ", ", 1) + ", matched AS (SELECT order_id AS match_id, n.order_id, n.amount_cents, n.month AS month_outbound, n.line_no, s.partner_txn_id, s.rmb_cents, s.type, s.currency, s.month AS month_settlement FROM net n JOIN settlement s ON n.order_id = s.partner_txn_id), uo AS (SELECT * FROM net WHERE order_id NOT IN (SELECT partner_txn_id FROM settlement)), us AS (SELECT * FROM settlement WHERE partner_txn_id NOT IN (SELECT order_id FROM net))"


def _outbound(spark: SparkSession, d: str) -> list[DataFrame]:
    return [view(spark, d, n) for n in _OUT]


def _order_tables(spark: SparkSession, d: str):
    out = _outbound(spark, d)
    net, settlement = orders.net_outbound(*out), view(spark, d, "settlement")
    return out, net, orders.match_by_id(net, settlement), orders.unmatched(net, "order_id", settlement, "partner_txn_id"), orders.unmatched(settlement, "partner_txn_id", net, "order_id")


@query(_NET + " SELECT * FROM net")
def net_outbound(spark, d):
    return orders.net_outbound(*_outbound(spark, d))


@query(ctes(*_OUT) + ", r AS (SELECT order_id, 'refund' AS reason, 0 AS k FROM refund UNION ALL SELECT order_id, 'return', 1 FROM returned UNION ALL SELECT order_id, 'transfer', 2 FROM transfer), g AS (SELECT order_id, string_agg(reason, '|' ORDER BY k) AS reasons FROM r GROUP BY order_id) SELECT s.*, reasons FROM sellout s JOIN g USING (order_id)")
def exclusion_reasons(spark, d):
    return orders.exclusion_reasons(*_outbound(spark, d))


@query(_MATCHED + " SELECT * FROM matched")
def id_match(spark, d):
    return _order_tables(spark, d)[2]


@query(_MATCHED + " SELECT * FROM uo")
def unmatched_outbound(spark, d):
    return _order_tables(spark, d)[3]


@query(_MATCHED + " SELECT * FROM us")
def unmatched_settlement(spark, d):
    return _order_tables(spark, d)[4]


@query(_MATCHED + " SELECT match_id, line_no, amount_cents, rmb_cents, amount_cents - rmb_cents AS diff_cents, amount_cents = rmb_cents AS amount_match FROM matched")
def amount_compare(spark, d):
    return orders.compare_amounts(_order_tables(spark, d)[2]).select("match_id", "line_no", "amount_cents", "rmb_cents", "diff_cents", "amount_match")


_MONTHS = """, p AS (
    SELECT month_outbound AS month, 1 AS m, 0 AS uo, 0 AS us, amount_cents AS a, rmb_cents AS r FROM matched
    UNION ALL SELECT month, 0, 1, 0, NULL, NULL FROM uo UNION ALL SELECT month, 0, 0, 1, NULL, NULL FROM us)
SELECT coalesce(month, 'TOTAL') AS month, CAST(sum(m) AS BIGINT) AS matched_count, CAST(sum(a) AS BIGINT) AS matched_outbound_cents, CAST(sum(r) AS BIGINT) AS matched_settlement_cents,
    CAST(sum(uo) AS BIGINT) AS unmatched_outbound, CAST(sum(us) AS BIGINT) AS unmatched_settlement FROM p GROUP BY ROLLUP (month)"""


@query(_MATCHED + _MONTHS)
def order_match_summary(spark, d):
    _, _, matched, left, right = _order_tables(spark, d)
    return orders.monthly_match_summary(matched, left, right)


@query(_MATCHED + """ SELECT count(*) AS matched_pairs, count(DISTINCT match_id) AS matched_orders, CAST(sum(amount_cents) AS BIGINT) AS matched_outbound_cents, CAST(sum(rmb_cents) AS BIGINT) AS matched_settlement_cents,
    (SELECT count(*) FROM uo) AS unmatched_outbound, (SELECT CAST(sum(amount_cents) AS BIGINT) FROM uo) AS unmatched_outbound_cents, (SELECT count(*) FROM us) AS unmatched_settlement, (SELECT CAST(sum(rmb_cents) AS BIGINT) FROM us) AS unmatched_settlement_cents,
    (SELECT count(DISTINCT order_id) FROM net) AS outbound_orders, (SELECT count(*) FROM net) AS net_rows, (SELECT count(*) FROM sellout) AS sellout_rows, (SELECT count(*) FROM refund) AS refund_rows, (SELECT count(*) FROM returned) AS return_rows,
    (SELECT count(*) FROM transfer) AS transfer_rows, round(100.0::DOUBLE * count(DISTINCT match_id) / (SELECT count(DISTINCT order_id) FROM net), 2) AS match_rate, (SELECT count(*) FROM sellout) - (SELECT count(*) FROM net) AS filtered_rows FROM matched""")
def order_match_metrics(spark, d):
    out, net, matched, left, right = _order_tables(spark, d)
    return orders.match_metrics(*out, net, matched, left, right)


@query(ctes("settlement") + """, c AS (SELECT month, currency, count(*) AS n FROM settlement GROUP BY ALL), top AS (SELECT month, arg_max(currency, (n, -ascii(currency))) AS currency FROM c GROUP BY month),
    m AS (SELECT month, count(*) AS txn_count, count(*) FILTER (WHERE type = 'P') AS payment_count, count(*) FILTER (WHERE type = 'R') AS refund_count, CAST(sum(rmb_cents) AS BIGINT) AS total_amount_cents, CAST(sum(rmb_cents) AS BIGINT) AS total_rmb_cents FROM settlement GROUP BY month)
    SELECT m.*, currency FROM m JOIN top USING (month) UNION ALL SELECT 'TOTAL', CAST(sum(txn_count) AS BIGINT), CAST(sum(payment_count) AS BIGINT), CAST(sum(refund_count) AS BIGINT), CAST(sum(total_amount_cents) AS BIGINT), CAST(sum(total_rmb_cents) AS BIGINT), '' FROM m""")
def settlement_summary(spark, d):
    return orders.settlement_monthly_summary(view(spark, d, "settlement").withColumn("amount_cents", F.col("rmb_cents")))


# Reports -----------------------------------------------------------------------------------------------------------

_BOTH = ctes("bank", "ledger")
_KEYED = "SELECT regexp_replace(account_no, '[^0-9]', '', 'g') AS account_no, strftime(transaction_date, '%Y-%m') AS month, flow, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM {} GROUP BY 1, 2, 3"
_CHECK = _BOTH + f", b AS ({_KEYED.format('bank')}), g AS ({_KEYED.format('ledger')})" + """, chk AS (SELECT coalesce(b.account_no, g.account_no) AS account_no, coalesce(b.month, g.month) AS month, coalesce(b.flow, g.flow) AS flow, coalesce(b.n, 0) AS bank_count, coalesce(b.total_cents, 0) AS bank_cents,
    coalesce(g.n, 0) AS ledger_count, coalesce(g.total_cents, 0) AS ledger_cents, coalesce(b.total_cents, 0) - coalesce(g.total_cents, 0) AS diff_cents, CASE WHEN abs(coalesce(b.total_cents, 0) - coalesce(g.total_cents, 0)) <= 1 THEN 'ok' ELSE 'mismatch' END AS status
    FROM b FULL JOIN g ON b.account_no = g.account_no AND b.month = g.month AND b.flow = g.flow)"""
_RATES = ", rates AS (SELECT account_no, strftime(transaction_date, '%Y-%m') AS month, flow, round(count(*) FILTER (WHERE amount_cents <= 20000000) / count(*), 6) AS match_rate FROM bank GROUP BY ALL)"


def _bank(spark, d, cents=SPARSE):
    return view(spark, d, "bank", cents)


def _ledger(spark, d, cents=SPARSE):
    return view(spark, d, "ledger", cents)


@query(ctes("bank") + " " + _KEYED.format("bank"))
def flow_summary(spark, d):
    return reports.flow_summary(_bank(spark, d))


@query(_CHECK + " SELECT * FROM chk")
def flow_check(spark, d):
    return reports.flow_check(_bank(spark, d), _ledger(spark, d))


def _rated(spark, d):
    bank = _bank(spark, d)
    return reports.flow_check(bank, _ledger(spark, d), 1_000_000, reports.match_rates(bank, bank.where("amount_cents <= 20000000").select("txn_id")))


@query(_CHECK + _RATES + " SELECT account_no, month, flow, match_rate FROM rates")
def match_rate(spark, d):
    bank = _bank(spark, d)
    return reports.match_rates(bank, bank.where("amount_cents <= 20000000").select("txn_id"))


@query(_CHECK.replace("<= 1 THEN", "<= 1000000 THEN") + _RATES + """ SELECT flow, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS mismatch,
    round(coalesce(sum(coalesce(match_rate, 0) * bank_count) FILTER (WHERE status = 'ok') / nullif(sum(bank_count) FILTER (WHERE status = 'ok'), 0), 0.0), 6) AS rate FROM chk LEFT JOIN rates USING (account_no, month, flow) GROUP BY flow""")
def flow_rate_totals(spark, d):
    return reports.flow_rate_totals(_rated(spark, d))


@query(_CHECK + " SELECT * FROM chk WHERE status = 'mismatch' ORDER BY account_no, month, flow LIMIT 20")
def top_mismatches(spark, d):
    return reports.top_mismatches(reports.flow_check(_bank(spark, d), _ledger(spark, d)))


_CASH = "CAST(coalesce(sum(amount_cents) FILTER (WHERE flow = 'in'), 0) AS BIGINT) AS income_cents, CAST(coalesce(sum(amount_cents) FILTER (WHERE flow = 'out'), 0) AS BIGINT) AS expense_cents, CAST(coalesce(sum(amount_cents) FILTER (WHERE flow = 'in'), 0) - coalesce(sum(amount_cents) FILTER (WHERE flow = 'out'), 0) AS BIGINT) AS net_cents, count(*) AS n"


@query(ctes("ledger") + f", x AS (SELECT *, strftime(transaction_date, '%Y-%m') AS month FROM ledger) SELECT month, {_CASH} FROM x GROUP BY month UNION ALL SELECT 'TOTAL', {_CASH} FROM x")
def cash_flow_month(spark, d):
    return reports.cash_flow(_ledger(spark, d))


@query(ctes("ledger") + f", x AS (SELECT *, strftime(transaction_date, '%Y-%m') AS month FROM ledger) SELECT bank_name, month, {_CASH} FROM x GROUP BY bank_name, month UNION ALL SELECT 'TOTAL', 'TOTAL', {_CASH} FROM x")
def cash_flow_bank_month(spark, d):
    return reports.cash_flow(_ledger(spark, d), by_bank=True)


@query(ctes("bank") + " SELECT flow, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM bank GROUP BY flow")
def flow_totals(spark, d):
    return reports.flow_totals(_bank(spark, d))


@query(_BOTH + """, a AS (SELECT account_no, min((CASE WHEN side = 0 THEN '0' ELSE '1' END) || bank_name) AS nm FROM (SELECT account_no, bank_name, 0 AS side FROM bank UNION ALL SELECT account_no, bank_name, 1 FROM ledger) GROUP BY account_no),
    b AS (SELECT account_no, month(transaction_date) AS month_no, sum(amount_cents) FILTER (WHERE flow = 'out') AS bank_debit, sum(amount_cents) FILTER (WHERE flow = 'in') AS bank_credit FROM bank GROUP BY ALL),
    g AS (SELECT account_no, month(transaction_date) AS month_no, sum(amount_cents) FILTER (WHERE flow = 'in') AS ledger_debit, sum(amount_cents) FILTER (WHERE flow = 'out') AS ledger_credit FROM ledger GROUP BY ALL),
    s AS (SELECT account_no, substr(nm, 2) AS bank_name, CAST(unnest(range(1, 13)) AS INT) AS month_no FROM a)
    SELECT account_no, bank_name, month_no, CAST(coalesce(ledger_debit, 0) AS BIGINT) AS ledger_debit, CAST(coalesce(bank_credit, 0) AS BIGINT) AS bank_credit, CAST(coalesce(ledger_credit, 0) AS BIGINT) AS ledger_credit, CAST(coalesce(bank_debit, 0) AS BIGINT) AS bank_debit,
    CAST(coalesce(ledger_debit, 0) - coalesce(bank_credit, 0) AS BIGINT) AS debit_diff, CAST(coalesce(ledger_credit, 0) - coalesce(bank_debit, 0) AS BIGINT) AS credit_diff FROM s LEFT JOIN b USING (account_no, month_no) LEFT JOIN g USING (account_no, month_no)""")
def wp_monthly(spark, d):
    return reports.working_paper_monthly(_bank(spark, d), _ledger(spark, d))


@query(ctes("bank") + " SELECT 'Entity' AS entity, bank_name || '  ' || account_no AS label, account_no, flow, txn_id, strftime(transaction_date, '%Y-%m-%d') AS day, format('{:.2f}', amount_cents / 100) AS amount, amount_cents FROM bank WHERE amount_cents >= 7000000")
def wp_detail(spark, d):
    return reports.working_paper_detail(_bank(spark, d), entity="Entity")


@query(_BOTH + " SELECT 'bank' AS result, count(*) AS n FROM bank UNION ALL SELECT 'ledger', count(*) FROM ledger")
def result_counts(spark, d):
    return reports.row_counts({"bank": _bank(spark, d), "ledger": _ledger(spark, d)})


# Pairs -------------------------------------------------------------------------------------------------------------


def _records(spark, d, cents=SPARSE):
    return pairs.to_records(_bank(spark, d, cents), "bank"), pairs.to_records(_ledger(spark, d, cents), "ledger")


def _sql_pairs(cents: str, flow: str = "b.flow = l.flow", account: str = "(b.account_no = l.account_no OR b.account_no = '' OR l.account_no = '')", days: int = 30, entries: str = "true") -> str:
    return ctes("bank", "ledger", cents=cents) + f""", e AS (SELECT b.txn_id AS bank, l.entry_id AS ledger, CAST(abs(b.transaction_date - l.transaction_date) AS INT) AS day_diff, abs(b.amount_cents - l.amount_cents) AS cent_diff, b.counterparty_name AS bn, l.counterparty_name AS ln, concat_ws('|', l.counterparty_name, nullif(l.summary, ''), nullif(l.subject, '')) AS said, b.ord AS b_ord, l.ord AS l_ord
        FROM bank b JOIN ledger l ON strftime(b.transaction_date, '%Y-%m') = strftime(l.transaction_date, '%Y-%m') AND {flow} AND l.amount_cents BETWEEN b.amount_cents - 1 AND b.amount_cents + 1
        WHERE {account} AND abs(b.transaction_date - l.transaction_date) <= {days} AND {entries})"""


@query(_sql_pairs(DENSE) + " SELECT bank, ledger, day_diff, cent_diff FROM e")
def pair_candidates(spark, d):
    return pairs.pair_candidates(*_records(spark, d, DENSE)).select(F.col("b_id").alias("bank"), F.col("l_id").alias("ledger"), "day_diff", "cent_diff")


@query(_sql_pairs(SPARSE, "b.flow <> l.flow", "true", 3, "l.summary LIKE '%调拨%'") + " SELECT bank, ledger, day_diff, cent_diff FROM e")
def transfer_candidates(spark, d):
    bank, ledger = _records(spark, d)
    entries = ledger.where("summary like '%调拨%'")
    return pairs.pair_candidates(bank, entries, 1, 3, inverted=True).select(F.col("b_id").alias("bank"), F.col("l_id").alias("ledger"), "day_diff", "cent_diff")


#: Bank texts are six times one letter: of an entry's text the same name is common, and nothing of another one.
ALIKE = "CASE WHEN bn = ln THEN 2.0::DOUBLE * length(bn) / (length(bn) + length(said)) ELSE 0.0::DOUBLE END"
_SCORES = _sql_pairs(DENSE) + f" SELECT bank, ledger, round(0.52::DOUBLE * (1 - cent_diff / 2.0::DOUBLE) + 0.25::DOUBLE * (1 - day_diff / 31.0::DOUBLE) + 0.23::DOUBLE * {ALIKE}, 4) AS score FROM e"


def _pair_scores(spark, d):
    return pairs.pair_scores(*_records(spark, d, DENSE))


@query(_SCORES)
def pair_scores(spark, d):
    return _pair_scores(spark, d)


@query(_SCORES)
def pair_scores_all(spark, d):
    """The same under its earlier name."""
    return _pair_scores(spark, d)


_NAMED = _sql_pairs(DENSE).rstrip() + f""", t AS (SELECT *, lower(bn) || (b_ord % 1000) AS x, (l_ord % 1000) || lower(ln) || 'co.' AS y FROM (SELECT bank, ledger, day_diff, cent_diff, bn, ln, b_ord, l_ord FROM e WHERE b_ord % 5 = 0 AND l_ord % 2 = 1))
    SELECT bank, ledger, round(0.52::DOUBLE * (1 - cent_diff / 2.0::DOUBLE) + 0.25::DOUBLE * (1 - day_diff / 31.0::DOUBLE) + 0.23::DOUBLE * {ratio_sql('x', 'y')}, 4) AS score FROM t"""


@query(_NAMED)
def pair_scores_named(spark, d):
    """Scores of every fifth bank row with first entries, under names that share parts: numbers, the name, and more."""
    bank, ledger = _records(spark, d, DENSE)
    bank = bank.where("ord % 5 = 0").withColumn("counterparty_name", F.concat("counterparty_name", F.lit(" "), F.col("ord") % 1000))
    ledger = ledger.where("ord % 2 = 1").withColumn("counterparty_name", F.concat(F.col("ord") % 1000, F.lit("-"), "counterparty_name", F.lit(" Co.")))
    ledger = ledger.withColumns({"summary": F.lit(""), "subject": F.lit("")})
    return pairs.pair_scores(bank, ledger)


#: Amounts of different levels never meet, so the edges of each month, flow and level are gone through in their order.
_GREEDY = _sql_pairs(DENSE).replace("WITH ", "WITH RECURSIVE ", 1) + f""", g AS (SELECT e.bank, e.ledger, e.b_ord, e.l_ord, round(0.52::DOUBLE * (1 - cent_diff / 2.0::DOUBLE) + 0.25::DOUBLE * (1 - day_diff / 31.0::DOUBLE) + 0.23::DOUBLE * {ALIKE}, 4) AS score,
        strftime(b.transaction_date, '%Y-%m') || b.flow || (b.amount_cents + 1000) // 200000 AS part FROM e JOIN bank b ON b.txn_id = e.bank),
    r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, b_ord, l_ord) AS turn FROM g WHERE score >= 0.58),
    s AS (
        SELECT DISTINCT part, CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS bank, CAST(NULL AS VARCHAR) AS ledger, CAST(NULL AS DOUBLE) AS score FROM r
        UNION ALL
        SELECT s.part, r.turn, CASE WHEN list_contains(s.used, r.bank) OR list_contains(s.used, r.ledger) THEN s.used ELSE list_concat(s.used, [r.bank, r.ledger]) END,
            CASE WHEN NOT list_contains(s.used, r.bank) AND NOT list_contains(s.used, r.ledger) THEN r.bank END, r.ledger, r.score FROM s JOIN r ON r.part = s.part AND r.turn = s.turn + 1
    ) SELECT bank, ledger, score FROM s WHERE bank IS NOT NULL"""


@query(_GREEDY)
def one_to_one(spark, d):
    return pairs.one_to_one(*_records(spark, d, DENSE))


_DAILY = ctes("bank", "day_ledger") + """, near AS (SELECT * FROM day_ledger), open AS (SELECT DISTINCT transaction_date AS day, flow FROM bank WHERE account_no = ''),
    wb AS (SELECT transaction_date AS day, flow, count(*) AS nb, sum(amount_cents) AS sb, list(txn_id ORDER BY ord) AS banks FROM bank GROUP BY ALL), wl AS (SELECT transaction_date AS day, flow, count(*) AS nl, sum(amount_cents) AS sl, list(entry_id ORDER BY ord) AS ledgers FROM near GROUP BY ALL),
    w AS (SELECT * FROM wb JOIN wl USING (day, flow) JOIN open USING (day, flow) WHERE nb > 1 AND nl > 1 AND abs(sb - sl) <= 1),
    bb AS (SELECT transaction_date AS day, flow, account_no, count(*) AS nb, sum(amount_cents) AS sb, list(txn_id ORDER BY ord) AS banks FROM bank WHERE account_no <> '' GROUP BY ALL), ll AS (SELECT transaction_date AS day, flow, account_no, count(*) AS nl, sum(amount_cents) AS sl, list(entry_id ORDER BY ord) AS ledgers FROM near GROUP BY ALL),
    g AS (SELECT banks, ledgers FROM w UNION ALL SELECT banks, ledgers FROM bb JOIN ll USING (day, flow, account_no) ANTI JOIN w USING (day, flow) WHERE nb > 1 AND nl > 1 AND abs(sb - sl) <= 1)
    SELECT array_to_string(banks, '|') AS bank_ids, array_to_string(ledgers, '|') AS ledger_ids FROM g"""


def _daily(spark, d):
    bank, _ = _records(spark, d)
    out = matching.daily_many_to_many(bank, pairs.to_records(view(spark, d, "day_ledger"), "ledger"))
    return out.select(F.concat_ws("|", "banks").alias("bank_ids"), F.concat_ws("|", "ledgers").alias("ledger_ids"))


@query(_DAILY)
def daily_many_to_many(spark, d):
    return _daily(spark, d)


@query(_DAILY)
def daily_many_to_many_all(spark, d):
    """The same under its earlier name."""
    return _daily(spark, d)


@query()
def fee_groups(spark, d):
    return matching.fee_groups(pairs.to_records(view(spark, d, "fee_bank"), "bank"), pairs.to_records(view(spark, d, "fee_ledger"), "ledger"))


_NEAREST = ctes("fee_bank", "fee_ledger") + """, p AS (SELECT l.entry_id, l.amount_cents AS want, b.txn_id, b.amount_cents AS cents, abs(b.transaction_date - l.transaction_date) AS far, row_number() OVER (PARTITION BY l.entry_id ORDER BY abs(b.transaction_date - l.transaction_date), b.ord) AS k
        FROM fee_ledger l JOIN fee_bank b ON b.account_no = l.account_no AND b.amount_cents > 0 AND strftime(b.transaction_date, '%Y-%m') = strftime(l.transaction_date, '%Y-%m') WHERE l.amount_cents BETWEEN 1 AND 100000),
    q AS (SELECT entry_id, any_value(want) AS want, count(*) AS n, sum(cents) AS total, list({'id': txn_id, 'c': cents, 'far': far} ORDER BY k) AS pool FROM p WHERE k <= 200 GROUP BY entry_id),
    f AS (SELECT *, list_reduce(pool, lambda a, x: CASE WHEN a.done OR a.total + x.c > want + 1 THEN a
            ELSE {'total': a.total + x.c, 'n': a.n + 1, 'days': a.days + 1 - x.far / 31.0::DOUBLE, 'ids': list_append(a.ids, x.id), 'done': abs(a.total + x.c - want) <= 1 AND a.n >= 1} END,
        {'total': 0::HUGEINT, 'n': 0::BIGINT, 'days': 0.0::DOUBLE, 'ids': CAST([] AS VARCHAR[]), 'done': false}) AS g FROM q WHERE n > 1)"""


@query(_NEAREST + """, z AS (SELECT entry_id, want, abs(total - want) <= 1 AS whole, CASE WHEN abs(total - want) <= 1 THEN total ELSE g.total END AS sum, CASE WHEN abs(total - want) <= 1 THEN list_transform(pool, lambda x: x.id) ELSE g.ids END AS ids,
        CASE WHEN abs(total - want) <= 1 THEN list_avg(list_transform(pool, lambda x: 1 - x.far / 31.0::DOUBLE)) ELSE g.days / g.n END AS near FROM f WHERE abs(total - want) <= 1 OR g.done)
    SELECT array_to_string(ids, '|') AS bank_ids, entry_id AS ledger_ids, round(0.55::DOUBLE * (1 - abs(sum - want) / 2.0::DOUBLE) + 0.25::DOUBLE * near + 0.20::DOUBLE, 4) AS score FROM z""")
def fee_groups_by_day(spark, d):
    """Fee entries against all, or the nearest, of their month's fees."""
    out = matching.fee_groups(pairs.to_records(view(spark, d, "fee_bank"), "bank"), pairs.to_records(view(spark, d, "fee_ledger"), "ledger"), deep=False)
    return out.select(F.concat_ws("|", "banks").alias("bank_ids"), F.concat_ws("|", "ledgers").alias("ledger_ids"), "score")


_MOVES = _sql_pairs(SPARSE, "b.flow <> l.flow", "true", 3, "l.summary LIKE '%调拨%' AND l.subject LIKE '%银行存款%'").replace("WITH ", "WITH RECURSIVE ", 1) + f""", m AS (SELECT e.*, regexp_replace(b.account_no, '[^0-9]', '', 'g') = regexp_replace(l.account_no, '[^0-9]', '', 'g') AS same,
        0.52::DOUBLE * (1 - cent_diff / 2.0::DOUBLE) + 0.25::DOUBLE * (1 - day_diff / 4.0::DOUBLE) + 0.23::DOUBLE * {ALIKE} AS score, dense_rank() OVER (ORDER BY e.l_ord) AS turn FROM e JOIN bank b ON b.txn_id = e.bank JOIN ledger l ON l.entry_id = e.ledger),
    open AS (
        SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS taken
        UNION ALL
        SELECT o.turn + 1, list_concat(o.taken, coalesce((SELECT CASE WHEN count(*) FILTER (WHERE NOT same) > 0 OR count(*) = 1 THEN [arg_min(bank || '>' || ledger, (same, day_diff, -score, b_ord))] ELSE [] END
            FROM m WHERE m.turn = o.turn + 1 AND NOT list_contains(list_transform(o.taken, lambda x: split_part(x, '>', 1)), bank)), [])) FROM open o WHERE o.turn < (SELECT max(turn) FROM m)
    ), last AS (SELECT unnest(taken) AS pair FROM open WHERE turn = (SELECT max(turn) FROM m))
    SELECT split_part(pair, '>', 1) AS bank_ids, split_part(pair, '>', 2) AS ledger_ids, round(0.55::DOUBLE * (1 - cent_diff / 2.0::DOUBLE) + 0.25::DOUBLE * (1 - day_diff / 4.0::DOUBLE) + 0.20::DOUBLE * (bn = ln)::INT, 4) AS score
    FROM last JOIN m ON m.bank = split_part(pair, '>', 1) AND m.ledger = split_part(pair, '>', 2)"""


@query(_MOVES)
def transfers(spark, d):
    out = matching.transfers(*_records(spark, d))
    return out.select(F.concat_ws("|", "banks").alias("bank_ids"), F.concat_ws("|", "ledgers").alias("ledger_ids"), "score")


@query()
def one_to_many(spark, d):
    return matching.group_passes(*_records(spark, d), kinds=("one_to_many",))


@query()
def many_to_one(spark, d):
    """Two bank rows on a day for every entry."""
    halves, whole = pairs.to_records(view(spark, d, "day_ledger"), "ledger"), pairs.to_records(_bank(spark, d), "bank")
    return matching.group_passes(halves, whole, kinds=("many_to_one",))


@query()
def cleanup(spark, d):
    """Small fees against the same fees a cent higher, as entries."""
    fees = view(spark, d, "fee_bank")
    entries = fees.withColumnRenamed("txn_id", "entry_id").withColumn("amount_cents", F.col("amount_cents") + 1)
    return matching.cleanup(pairs.to_records(fees, "bank"), pairs.to_records(entries, "ledger"))


@query()
def match_all(spark, d):
    return matching.match_transactions(*_records(spark, d))


@query()
def match_rows(spark, d):
    bank, ledger = _records(spark, d)
    return matching.match_rows(matching.match_transactions(bank, ledger), bank, ledger)


@query()
def match_stats(spark, d):
    return matching.match_stats(matching.match_transactions(*_records(spark, d)))
