"""Orders against settlements: net outbound rows, matching by id, comparison and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import text

REASONS = ("refund", "return", "transfer")
TOTAL = "TOTAL"


def order_key(column: str):
    """Trimmed order id; null where blank, so that rows without an id match nothing."""
    return F.nullif(text(column), F.lit(""))


def excluded_orders(refund: DataFrame, returned: DataFrame, transfer: DataFrame, key: str = "order_id") -> DataFrame:
    """order_id and reasons (pipe-joined in the order refund, return, transfer), one row per excluded order."""
    tagged = [d.select(order_key(key).alias(key), F.lit(k).alias("place")).where(F.col(key).isNotNull()) for k, d in enumerate((refund, returned, transfer))]
    ids = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.sort_array(F.collect_set("place")).alias("places"))
    names = F.array(*map(F.lit, REASONS))
    return ids.select(key, F.array_join(F.transform("places", lambda p: F.element_at(names, p + 1)), "|").alias("reasons"))


def net_outbound(sellout: DataFrame, refund: DataFrame, returned: DataFrame, transfer: DataFrame, key: str = "order_id") -> DataFrame:
    """Sellout rows whose order was neither refunded nor returned nor transferred."""
    ids = reduce(DataFrame.unionByName, [d.select(order_key(key).alias("_id")) for d in (refund, returned, transfer)]).where("_id is not null").distinct()
    return sellout.join(ids, order_key(key) == F.col("_id"), "left_anti")


def exclusion_reasons(sellout: DataFrame, refund: DataFrame, returned: DataFrame, transfer: DataFrame, key: str = "order_id") -> DataFrame:
    reasons = excluded_orders(refund, returned, transfer, key).withColumnRenamed(key, "_id")
    return sellout.join(reasons, order_key(key) == F.col("_id")).drop("_id")


def match_by_id(net: DataFrame, settlement: DataFrame, order_id: str = "order_id", txn_id: str = "partner_txn_id") -> DataFrame:
    """One row per pair with the same id; columns that both sides have get _outbound and _settlement."""
    both = set(net.columns) & set(settlement.columns)
    left = net.select(order_key(order_id).alias("match_id"), *[F.col(c).alias(f"{c}_outbound" if c in both else c) for c in net.columns])
    right = settlement.select(order_key(txn_id).alias("_id"), *[F.col(c).alias(f"{c}_settlement" if c in both else c) for c in settlement.columns])
    return left.join(right, F.col("match_id") == F.col("_id")).drop("_id")


def unmatched(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose id the other side does not have; rows without an id are unmatched."""
    return rows.join(others.select(order_key(other_key).alias("_id")).where("_id is not null"), order_key(key) == F.col("_id"), "left_anti")


def compare_amounts(matched: DataFrame, outbound: str = "amount_cents", settlement: str = "rmb_cents") -> DataFrame:
    """Adds diff_cents and amount_match (a difference of under a cent)."""
    diff = F.col(outbound) - F.col(settlement)
    return matched.withColumns({"diff_cents": diff, "amount_match": F.abs(diff) < 1})


def monthly_match_summary(matched: DataFrame, unmatched_outbound: DataFrame, unmatched_settlement: DataFrame, month: str = "month_outbound") -> DataFrame:
    """Per month: matched pairs, unmatched rows of either side, amounts of matched pairs; then a TOTAL row."""
    pairs = matched.groupBy(F.col(month).alias("month")).agg(F.count(F.lit(1)).alias("matched_count"), F.sum("amount_cents").alias("matched_outbound_cents"), F.sum("rmb_cents").alias("matched_settlement_cents"))
    left = unmatched_outbound.groupBy("month").agg(F.count(F.lit(1)).alias("unmatched_outbound"))
    right = unmatched_settlement.groupBy("month").agg(F.count(F.lit(1)).alias("unmatched_settlement"))
    counts = ["matched_count", "unmatched_outbound", "unmatched_settlement"]
    sums = ["matched_outbound_cents", "matched_settlement_cents"]
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (pairs, left, right))
    months = parts.groupBy("month").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], *[F.sum(c).alias(c) for c in sums])
    total = months.agg(F.lit(TOTAL).alias("month"), *[F.sum(c).alias(c) for c in counts + sums])
    return months.unionByName(total)


def match_metrics(sellout, refund, returned, transfer, net, matched, unmatched_outbound, unmatched_settlement) -> DataFrame:
    """One row: pairs, distinct matched ids, unmatched rows, match rate in per cent, amounts, and rows of every input."""
    pairs = matched.agg(F.count(F.lit(1)).alias("matched_pairs"), F.countDistinct("match_id").alias("matched_orders"), F.sum("amount_cents").alias("matched_outbound_cents"), F.sum("rmb_cents").alias("matched_settlement_cents"))
    left = unmatched_outbound.agg(F.count(F.lit(1)).alias("unmatched_outbound"), F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("unmatched_outbound_cents"))
    right = unmatched_settlement.agg(F.count(F.lit(1)).alias("unmatched_settlement"), F.coalesce(F.sum("rmb_cents"), F.lit(0)).alias("unmatched_settlement_cents"))
    ids = net.agg(F.countDistinct(order_key("order_id")).alias("outbound_orders"), F.count(F.lit(1)).alias("net_rows"))
    rows = [d.agg(F.count(F.lit(1)).alias(f"{n}_rows")) for n, d in (("sellout", sellout), ("refund", refund), ("return", returned), ("transfer", transfer))]
    one = reduce(DataFrame.crossJoin, [pairs, left, right, ids, *rows])  # single rows
    rate = F.round(F.when(F.col("outbound_orders") > 0, 100.0 * F.col("matched_orders") / F.col("outbound_orders")).otherwise(0.0), 2)
    return one.withColumns({"match_rate": rate, "filtered_rows": F.col("sellout_rows") - F.col("net_rows")})


def settlement_monthly_summary(txn: DataFrame) -> DataFrame:
    """Per month: rows, payments, refunds, sums, most frequent currency (the smallest on ties); then a TOTAL row."""
    sums = ["amount_cents", "rmb_cents"]
    months = txn.groupBy("month").agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum((F.col("type") == "P").cast("long")).alias("payment_count"), F.sum((F.col("type") == "R").cast("long")).alias("refund_count"),
        *[F.sum(c).alias(f"total_{c}") for c in sums], F.mode("currency", True).alias("currency"),
    )
    total = months.agg(F.lit(TOTAL).alias("month"), *[F.sum(c).alias(c) for c in ("txn_count", "payment_count", "refund_count", *(f"total_{c}" for c in sums))], F.lit("").alias("currency"))
    return months.unionByName(total)
