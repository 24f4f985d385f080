"""Raw layouts to fixed tables: projections and filters over sheet rows (cells by position) or named columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cents, compact_date, date_from_parts, extract_counterparty, first_nonblank, join_unique_array, parse_amount, parse_date, parse_int, source_row_id, text

# Names that sources use for the standard columns.
BANK_ALIASES = {"交易时间": "transaction_date", "收入金额": "credit", "支出金额": "debit", "账户余额": "balance", "对方账号": "counterparty_account", "对方户名": "counterparty_name", "摘要": "summary"}
LEDGER_ALIASES = {"凭证日期": "transaction_date", "借方": "debit", "贷方": "credit", "编号": "voucher_no", "类型": "voucher_type", "摘要": "summary", "科目": "subject", "供应商名称": "counterparty_name"}


def cell(k: int, cells: str = "cells") -> Column:
    return F.coalesce(F.trim(F.get(F.col(cells), F.lit(k))), F.lit(""))


def clean_bank_positional(cells: DataFrame) -> DataFrame:
    """Statements of 13 columns: 2 date, 3 direction (借 out, 贷 in), 4-6 counterparty, 7-9 text, 10 amount, 11 balance."""
    amount = parse_amount(cell(10))
    flow = F.when(cell(3) == "借", "out").when(cell(3) == "贷", "in")
    out = cells.select(
        source_row_id("source_id", "source_file", "source_sheet", "row_no", False).alias("txn_id"), "source_id", "source_file", "source_sheet", "row_no",
        parse_date(cell(2)).alias("transaction_date"), flow.alias("flow"), F.abs(cents(amount)).alias("amount_cents"),
        first_nonblank(cell(4), cell(5), cell(6), extract_counterparty(F.concat_ws(" ", cell(7), cell(8), cell(9)))).alias("counterparty_name"), cell(1).alias("counterparty_account"),
        cell(7).alias("summary"), cell(9).alias("description"), cents(parse_amount(cell(11))).alias("balance_cents"), join_unique_array("cells").alias("raw_text"),
    )
    return out.where("transaction_date is not null and flow is not null and amount_cents > 0")


def clean_ledger_positional(cells: DataFrame) -> DataFrame:
    """Ledgers of 11 columns with or without a year in column 1, told row by row; the net of debit and credit gives the flow."""
    dated = F.coalesce(parse_int(cell(1)) >= 1900, F.lit(False))
    at = lambda with_year, without: F.when(dated, cell(with_year)).otherwise(cell(without))
    year = F.when(dated, parse_int(cell(1))).otherwise(F.year(parse_date(cell(3))))
    day = F.coalesce(date_from_parts(year, parse_int(at(2, 1)), parse_int(at(3, 2))), parse_date(at(4, 3)))
    net = cents(parse_amount(at(9, 7)) - parse_amount(at(10, 8)))
    out = cells.where(cell(0).rlike("[0-9]")).select(
        source_row_id("source_id", "source_file", "source_sheet", "row_no", False).alias("entry_id"), "source_id", "source_file", "source_sheet", "row_no", cell(0).alias("account_no"), day.alias("transaction_date"),
        F.when(net > 0, "in").when(net < 0, "out").alias("flow"), F.abs(net).alias("amount_cents"), F.greatest(net, F.lit(0)).alias("ledger_debit_cents"), F.greatest(-net, F.lit(0)).alias("ledger_credit_cents"),
        F.concat(at(5, 4), at(6, 5)).alias("voucher_no"), at(7, 6).alias("summary"), F.when(dated, cell(8)).otherwise("").alias("subject"), join_unique_array("cells").alias("raw_text"),
    )
    return out.where("transaction_date is not null and amount_cents > 0")


def rename_columns(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Aliases to standard names; the first column for a name wins, other columns for it and names with a leading _ go."""
    chosen: dict[str, str] = {}
    for c in df.columns:
        if not c.startswith("_"):
            chosen.setdefault(aliases.get(c, c), c)
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in chosen.items()])


def _sided(df: DataFrame, first: str, first_flow: str, second: str, second_flow: str) -> DataFrame:
    a, b = cents(parse_amount(first)), cents(parse_amount(second))
    out = df.withColumns({"flow": F.when(a > 0, first_flow).when(b > 0, second_flow), "amount_cents": F.when(a > 0, a).otherwise(b)})
    return out.where("flow is not null")


def clean_bank_named(df: DataFrame, aliases: dict[str, str] = BANK_ALIASES) -> DataFrame:
    """Credit is in, else debit is out; rows with neither go."""
    named = rename_columns(df, aliases)
    return _sided(named.withColumn("transaction_date", parse_date("transaction_date")), "credit", "in", "debit", "out")


def clean_ledger_named(df: DataFrame, aliases: dict[str, str] = LEDGER_ALIASES) -> DataFrame:
    """Rows with a voucher date (20200115 too); debit is in, credit is out."""
    named = rename_columns(df, aliases).where(text("transaction_date") != "")
    return _sided(named.withColumn("transaction_date", parse_date(compact_date("transaction_date"))), "debit", "in", "credit", "out")


def concat_sources(frames: list[DataFrame], standard: list[str]) -> DataFrame:
    """Union on the standard columns, missing ones blank, extras after."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    lacking = [F.lit("").alias(c) for c in standard if c not in out.columns]
    extras = [c for c in out.columns if c not in standard]
    return out.select("*", *lacking).select(*standard, *extras)


def finish_layout(df: DataFrame, standard: list[str], source_id: str, source_file: str, id_col: str, bank_name: str = "", account_no: str = "") -> DataFrame:
    """After a user's parser: all standard columns, the configured source, bank and account, and ids built anew."""
    for c in standard:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("").cast("string"))
    df = df.withColumns({"source_id": F.lit(source_id), "source_file": F.lit(source_file), "bank_name": F.lit(bank_name) if bank_name else F.col("bank_name"), "account_no": F.lit(account_no) if account_no else F.col("account_no")})
    return df.withColumn(id_col, source_row_id("source_id", "source_file", "source_sheet", "row_no", True))


LAYOUTS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def register_layout(signature: str, parser: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    """A user's parser for the sheets with this column signature: rows of one sheet in, standard rows out."""
    LAYOUTS[signature] = parser


def apply_layout(cells: DataFrame, signature: str, schema: str) -> DataFrame:
    return cells.groupBy("source_id", "source_sheet").applyInPandas(LAYOUTS[signature], schema)


#: Rows of a sheet that a user's parser sees at once.
PARSED = 10_000


def apply_layouts(cells: DataFrame, schema: str, layouts: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] | None = None, least: int = 4, together: int = PARSED) -> tuple[DataFrame, DataFrame]:
    """All sheets through the parsers of their own signatures, in one plan: (rows, unknown).

    A sheet's signature is that of its first row with ``least`` filled cells, and what stands below is its rows. A parser
    gets rows of one sheet, ``together`` at most, as a frame with source_file, source_sheet, row_no and the cells under
    their names (of repeated names the first holds), and returns rows of ``schema``; rows must not depend on each other.
    ``unknown`` has the sheets whose signature no parser is registered for: source_file, source_sheet, signature, rows.
    """
    from .layout import sheet_headers

    known = dict(LAYOUTS if layouts is None else layouts)
    key = ["source_file", "source_sheet"]
    heads = sheet_headers(cells, least)
    body = cells.join(heads, key).where(F.col("row_no") > F.col("header_row"))
    ours = F.col("signature").isin(*known) if known else F.lit(False)
    chunk = F.floor(F.col("row_no") / together).alias("chunk")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names, frame = group["names"].iloc[0], group[[*key, "row_no"]].copy()
        for k, name in enumerate(names):
            name = (name or "").strip()
            if name and name not in frame.columns:
                frame[name] = [c[k] if k < len(c) else "" for c in group["cells"]]
        return known[group["signature"].iloc[0]](frame.sort_values("row_no", ignore_index=True))

    rows = body.where(ours).select(*key, "row_no", "cells", "names", "signature", chunk)
    unknown = body.where(~ours).groupBy(*key, "signature").agg(F.count(F.lit(1)).alias("rows"))
    return rows.groupBy(*key, "chunk").applyInPandas(run, schema), unknown


def display_table(df: DataFrame, names: dict[str, str], flows: tuple[str, str] = ("收入", "支出")) -> DataFrame:
    """Columns under display names, directions in words."""
    told = df.withColumn("flow", F.when(F.col("flow") == "in", flows[0]).when(F.col("flow") == "out", flows[1]).otherwise(F.col("flow"))) if "flow" in df.columns else df
    return told.select(*[F.col(c).alias(n) for c, n in names.items()])


def may_fill(unmatched_bank: DataFrame, unmatched_ledger: DataFrame, only_when_matched: bool = True) -> bool:
    """Working papers are filled only when nothing is left unmatched (if asked for)."""
    return not only_when_matched or (unmatched_bank.isEmpty() and unmatched_ledger.isEmpty())
