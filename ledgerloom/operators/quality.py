"""Data-quality checks of cleaned tables whose columns are text. One aggregation pass each, no row leaves its task but samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_amount, text

LITERAL_NULLS = ("nan", "None", "NaN", "N/A", "NoneType")
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def _number(c: str) -> Column:
    return F.regexp_replace(text(c), ",", "").try_cast("decimal(20,4)")


def _sums(df: DataFrame, source: str, check: str, tests: dict[str, Column]) -> DataFrame:
    """check, source, field, bad_count, total: one pass for all fields."""
    one = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("total"), *[F.sum(t.cast("long")).alias(f) for f, t in tests.items()])
    return one.unpivot(["source", "total"], list(tests), "field", "bad_count").select(F.lit(check).alias("check"), "source", "field", "bad_count", "total")


def amount_problems(df: DataFrame, source: str = "source_id", row_no: str = "row_no", column: str = "amount", samples: int = 10) -> DataFrame:
    """Amounts that are zero or not a number, with the first bad row numbers of each source."""
    bad = F.coalesce(_number(column) == 0, F.lit(True))
    counts = _sums(df, source, "amount_zero_or_invalid", {column: bad})
    first = F.row_number().over(Window.partitionBy(source).orderBy(row_no))
    rows = df.where(bad).withColumn("_k", first).where(F.col("_k") <= samples).groupBy(F.col(source).alias("source")).agg(F.array_join(F.sort_array(F.collect_list(row_no)), ",").alias("sample_rows"))
    return counts.join(rows, "source", "left").withColumn("sample_rows", F.coalesce("sample_rows", F.lit("")))


def negative_values(df: DataFrame, columns: list[str], source: str = "source_id") -> DataFrame:
    return _sums(df, source, "negative", {c: F.coalesce(_number(c) < 0, F.lit(False)) for c in columns})


def blanks(df: DataFrame, columns: list[str], source: str = "source_id") -> DataFrame:
    return _sums(df, source, "blank", {c: text(c) == "" for c in columns})


def schema_differences(df: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """Missing and extra columns; names only, nothing is read."""
    return [c for c in expected if c not in df.columns], [c for c in df.columns if c not in expected]


def literal_nulls(df: DataFrame, columns: list[str], source: str = "source_id") -> DataFrame:
    return _sums(df, source, "literal_null", {c: text(c).isin(*LITERAL_NULLS) for c in columns})


def flow_values(df: DataFrame, source: str = "source_id") -> DataFrame:
    return df.where(~text("flow").isin("in", "out")).groupBy(F.col(source).alias("source"), text("flow").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def unusable_numbers(df: DataFrame, columns: list[str], source: str = "source_id") -> DataFrame:
    """Filled values that are no number, or negative."""
    return _sums(df, source, "unparsable_or_negative", {c: (text(c) != "") & (_number(c).isNull() | (_number(c) < 0)) for c in columns})


def bad_dates(df: DataFrame, column: str = "transaction_date", source: str = "source_id") -> DataFrame:
    return _sums(df, source, "date_format", {column: ~text(column).rlike(ISO_DATE)})


def direction_conflicts(df: DataFrame, debit: str, credit: str, source: str = "source_id") -> DataFrame:
    """Ledger rows whose sides contradict the flow: in has the debit alone, out the credit alone, and the amount is that side's."""
    d, c, a = (F.coalesce(_number(x), F.lit(0)) for x in (debit, credit, "amount"))
    fine = F.when(text("flow") == "in", (d > 0) & (c == 0) & (F.abs(a - d) <= 0.01)).when(text("flow") == "out", (c > 0) & (d == 0) & (F.abs(a - c) <= 0.01)).otherwise(True)
    return _sums(df, source, "direction", {"flow": ~fine})


def account_completeness(df: DataFrame, source: str = "source_id") -> DataFrame:
    """Per source: blank accounts, blank banks, rows without account, bank and subject, and none or some for each."""
    acc, bank, subject = (text(c) == "" for c in ("account_no", "bank_name", "subject"))
    n = F.count(F.lit(1))
    state = lambda bad: F.when(bad == n, "all").when(bad > 0, "some").otherwise("none")
    a, b, c = (F.sum(x.cast("long")) for x in (acc, bank, acc & bank & subject))
    return df.groupBy(F.col(source).alias("source")).agg(n.alias("total"), a.alias("blank_account"), b.alias("blank_bank"), c.alias("blank_all"), state(a).alias("account_state"), state(b).alias("bank_state"))


def values_to_normalize(df: DataFrame) -> DataFrame:
    """Account numbers with other than digits and blanks, and bank names with bars or subjects in them: values and rows."""
    wanted = {"account_no": ~text("account_no").rlike(r"^[0-9 ]*$"), "bank_name": text("bank_name").rlike(r"[｜|]|银行存款")}
    found = [df.where(t).groupBy(F.lit(c).alias("field"), text(c).alias("value")).agg(F.count(F.lit(1)).alias("n")) for c, t in wanted.items()]
    return reduce(DataFrame.unionByName, found)


def apply_normalization(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace values of ``column`` by the mapping's (value, replacement); adds ``replaced``. The mapping is joined, not
    collected; Spark sends it to all tasks only if it is small."""
    m = mapping.select(F.col("value").alias("_value"), F.col("replacement").alias("_new")).dropDuplicates(["_value"])
    out = df.join(m, text(column) == F.col("_value"), "left")
    return out.withColumns({column: F.coalesce("_new", column), "replaced": F.col("_new").isNotNull()}).drop("_value", "_new")


def source_stats(df: DataFrame, source: str = "source_id") -> DataFrame:
    iso = F.when(text("transaction_date").rlike(ISO_DATE), text("transaction_date"))
    flows = [F.sum((text("flow") == f).cast("long")).alias(f"{f}_rows") for f in ("in", "out")]
    return df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.nullif(text("account_no"), F.lit(""))).alias("accounts"), F.min(iso).alias("first_day"), F.max(iso).alias("last_day"), *flows)


def net_of_sides(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Blank counterparties and the net of in and out on both sides, and whether the nets agree within a cent."""

    def one(df: DataFrame, p: str) -> DataFrame:
        a = F.round(parse_amount("amount") * 100).cast("long")
        net = F.sum(F.when(text("flow") == "in", a).when(text("flow") == "out", -a).otherwise(0))
        return df.agg(F.sum((text("counterparty_name") == "").cast("long")).alias(f"{p}_blank"), F.coalesce(net, F.lit(0)).alias(f"{p}_net"))

    both = one(bank, "bank").crossJoin(one(ledger, "ledger"))  # one row each
    return both.withColumn("agree", F.abs(F.col("bank_net") - F.col("ledger_net")) <= 1)
