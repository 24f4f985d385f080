"""Completeness checks, totals and working-paper tables of bank and ledger records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import digits, format_amount, format_date, month_of, text

KEY = ["account_no", "month", "flow"]


def keyed(df: DataFrame) -> DataFrame:
    """Rows with a date and a direction, keyed by account digits, month and lower-case flow."""
    flow = F.lower(text("flow"))
    return df.where(F.col("transaction_date").isNotNull() & flow.isin("in", "out")).withColumns({"account_no": digits("account_no"), "month": month_of("transaction_date"), "flow": flow})


def flow_summary(df: DataFrame) -> DataFrame:
    return keyed(df).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("total_cents"))


def match_rates(bank: DataFrame, matched_ids: DataFrame) -> DataFrame:
    """Share of distinct bank ids per key that some match holds; ``matched_ids`` has txn_id."""
    ids = keyed(bank).where(text("txn_id") != "").select(*KEY, "txn_id").distinct()
    hit = ids.join(matched_ids.select("txn_id").distinct().withColumn("_hit", F.lit(1)), "txn_id", "left")
    return hit.groupBy(*KEY).agg(F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("match_rate"))


def flow_check(bank: DataFrame, ledger: DataFrame, tolerance_cents: int = 1, rates: DataFrame | None = None) -> DataFrame:
    """Counts and totals of both sides for every key of either, their difference, and ok or mismatch."""
    b = flow_summary(bank).select(*KEY, F.col("n").alias("bank_count"), F.col("total_cents").alias("bank_cents"))
    g = flow_summary(ledger).select(*KEY, F.col("n").alias("ledger_count"), F.col("total_cents").alias("ledger_cents"))
    values = ["bank_count", "bank_cents", "ledger_count", "ledger_cents"]
    out = b.join(g, KEY, "full").select(*KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in values])
    out = out.withColumn("diff_cents", F.col("bank_cents") - F.col("ledger_cents"))
    out = out.withColumn("status", F.when(F.abs("diff_cents") <= tolerance_cents, "ok").otherwise("mismatch"))
    return out if rates is None else out.join(rates, KEY, "left").withColumn("match_rate", F.coalesce("match_rate", F.lit(0.0)))


def flow_rate_totals(check: DataFrame) -> DataFrame:
    """Per flow: keys, ok keys, mismatches, and the match rate of ok keys weighted by their bank rows."""
    ok = F.col("status") == "ok"
    weight = F.sum(F.when(ok, F.col("bank_count")).otherwise(0))
    return check.groupBy("flow").agg(
        F.count(F.lit(1)).alias("total"), F.sum(ok.cast("long")).alias("ok"), F.sum((~ok).cast("long")).alias("mismatch"),
        F.round(F.when(weight > 0, F.sum(F.when(ok, F.col("match_rate") * F.col("bank_count")).otherwise(0.0)) / weight).otherwise(0.0), 6).alias("rate"),
    )


def top_mismatches(check: DataFrame, n: int = 20) -> DataFrame:
    return check.where("status = 'mismatch'").orderBy(*KEY).limit(n)


def cash_flow(df: DataFrame, by_bank: bool = False) -> DataFrame:
    """Income, expense, net and rows by month, or by bank and month; the grand total has the key TOTAL."""
    keys = ["bank_name", "month"] if by_bank else ["month"]
    income, expense = (F.sum(F.when(F.col("flow") == f, F.col("amount_cents")).otherwise(0)) for f in ("in", "out"))
    named = df.withColumn("month", month_of("transaction_date"))
    sums = named.rollup(*keys).agg(F.grouping_id().alias("level"), income.alias("income_cents"), expense.alias("expense_cents"), (income - expense).alias("net_cents"), F.count(F.lit(1)).alias("n"))
    total = 2 ** len(keys) - 1
    kept = sums.where(F.col("level").isin(0, total))
    return kept.select(*[F.when(F.col("level") == total, "TOTAL").otherwise(F.col(k)).alias(k) for k in keys], "income_cents", "expense_cents", "net_cents", "n")


def flow_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("flow").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("total_cents"))


def working_paper_monthly(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """For each account of either side and months 1 to 12 the four sums and their differences; years fold together."""
    accounts = bank.select("account_no", "bank_name", F.lit(0).alias("side")).unionByName(ledger.select("account_no", "bank_name", F.lit(1).alias("side")))
    accounts = accounts.groupBy("account_no").agg(F.min(F.when(text("bank_name") != "", F.struct("side", "bank_name")))["bank_name"].alias("bank_name"))
    spine = accounts.select("account_no", "bank_name", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month_no"))

    def sums(df: DataFrame, debit: str, credit: str) -> DataFrame:
        return df.groupBy("account_no", F.month("transaction_date").alias("month_no")).agg(*[F.sum(F.when(F.col("flow") == f, F.col("amount_cents")).otherwise(0)).alias(c) for f, c in ((debit[0], debit[1]), (credit[0], credit[1]))])

    b = sums(bank, ("out", "bank_debit"), ("in", "bank_credit"))
    g = sums(ledger, ("in", "ledger_debit"), ("out", "ledger_credit"))
    out = reduce(lambda x, y: x.join(y, ["account_no", "month_no"], "left"), (spine, b, g))
    values = ["ledger_debit", "bank_credit", "ledger_credit", "bank_debit"]
    out = out.select("account_no", "bank_name", "month_no", *[F.coalesce(c, F.lit(0)).alias(c) for c in values])
    return out.withColumns({"debit_diff": F.col("ledger_debit") - F.col("bank_credit"), "credit_diff": F.col("ledger_credit") - F.col("bank_debit")})


def working_paper_detail(df: DataFrame, min_cents: int = 7_000_000, entity: str = "") -> DataFrame:
    """Large transactions by account, direction and falling amount, with display text."""
    kept = df.where(F.col("amount_cents") >= min_cents)
    out = kept.select(
        F.lit(entity).alias("entity"), F.concat(text("bank_name"), F.lit("  "), text("account_no")).alias("label"), "account_no", "flow", "txn_id",
        format_date("transaction_date").alias("day"), format_amount(F.col("amount_cents") / 100).alias("amount"), "amount_cents",
    )
    return out.orderBy("account_no", "flow", F.desc("amount_cents"), "txn_id")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.agg(F.lit(n).alias("result"), F.count(F.lit(1)).alias("n")) for n, d in tables.items()])
