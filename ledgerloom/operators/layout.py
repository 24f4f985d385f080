"""Finding out what files and sheets hold: classes, headers, months, accounts, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import text

# Directory names, sheet words, bank names and codes, account headings.
DIRECTORY_CLASSES = {"银行流水": "bank_statement", "bank": "bank_statement", "序时账": "ledger", "ledger": "ledger", "底稿": "working_paper", "working_paper": "working_paper"}
SKIP_WORDS = ("filter", "filtered", "without refund", "recap", "汇总", "collect", "sheet", "to be invoiced", "to be credited", "出库总表", "税费")
SHEET_WORDS = {
    "sellout": ("sellout", "出库"),
    "refund": ("refund only", "refund only系统", "仅退款", "资损"),
    "return": ("return wh", "rongqing return", "货损"),
    "transfer": ("return to bonded", "退回保税仓", "interim退回"),
}
BANK_HINTS = {
    "中国工商银行": ("icbc", "工行"),
    "中国银行": ("boc", "中行"),
    "中国农业银行": ("abc", "农行"),
    "中国建设银行": ("ccb", "建行"),
    "招商银行": ("cmb", "招行"),
    "中国民生银行": ("民生",),
    "华润银行": ("华润",),
}
BANK_CODES = ("icbc", "abc", "boc", "ccb", "cmb", "cib", "spdb", "ceb", "citic")
BANK_WORDS = {
    "icbc": ("工商银行", "工行"),
    "ccb": ("建设银行", "建行"),
    "abc": ("农业银行", "农行"),
    "boc": ("中国银行", "中行"),
    "cmb": ("招商银行", "招行"),
    "cib": ("兴业银行", "兴业"),
    "spdb": ("浦发银行", "浦发"),
    "ceb": ("光大银行", "光大", "民生银行", "民生"),
    "citic": ("中信银行", "中信"),
}
ACCOUNT_WORDS = ("账号", "卡号", "account", "账户号", "acc_no", "accno")


def _blank(v: Column) -> Column:
    return F.coalesce(F.trim(v), F.lit("")) == ""


def directory_class(relative_path) -> Column:
    first = F.lower(F.get(F.split(text(relative_path), "/"), F.lit(0)))
    nested = text(relative_path).contains("/")
    told = F.lit("unknown")
    for name, kind in DIRECTORY_CLASSES.items():
        told = F.when(first == name.lower(), kind).otherwise(told)
    return F.when(nested, told).otherwise("unknown")


def _has(said: Column, words) -> Column:
    return F.greatest(*[said.contains(w) for w in words], F.lit(False))


def _first_of(said: Column, words: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    """The first key one of whose words is in the text."""
    out = F.when(F.lit(False), otherwise)
    for key, some in words.items():
        out = out.when(_has(said, some), key)
    return out.otherwise(otherwise)


def sheet_class(name) -> Column:
    """sellout, refund, return or transfer by words in a sheet's name; skip if it has a word to skip by, or none."""
    n = F.lower(text(name))
    return F.when(_has(n, SKIP_WORDS), "skip").otherwise(_first_of(n, SHEET_WORDS, "skip"))


def settlement_class(header, n_rows) -> Column:
    h = header if isinstance(header, Column) else F.col(header)
    return F.when(F.array_contains(h, "settle_batch_no"), "batch").when(F.array_contains(h, "partner_transaction_id"), "transaction").when(F.array_contains(h, "amount") & (F.col(n_rows) > 5), "transaction").otherwise("unknown")


def bank_code(name) -> Column:
    """Short code of a bank by its name; unknown without one."""
    n = text(name)
    code = _first_of(F.lower(n), {c: (c,) for c in BANK_CODES}, "")
    return F.when(code != "", code).otherwise(_first_of(n, BANK_WORDS, "unknown"))


def file_meta(name, default_year: int | None = None) -> Column:
    """struct(bank_name, year, bank_code) told by a file name; the year is the first one of this century in it."""
    n = text(name)
    bank = _first_of(F.lower(n), BANK_HINTS, "")
    year = F.nullif(F.regexp_extract(n, r"(20\d{2})", 1), F.lit("")).try_cast("int")
    return F.struct(bank.alias("bank_name"), F.coalesce(year, F.lit(default_year).cast("int")).alias("year"), bank_code(bank).alias("bank_code"))


def backfill_accounts(files: DataFrame, order: str = "ord") -> DataFrame:
    """Files of one directory and bank share the first account that any of them has."""
    whole = Window.partitionBy("directory", "bank_name").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.first(F.nullif(text("account_no"), F.lit("")), ignorenulls=True).over(whole)
    return files.withColumn("account_no", F.coalesce(F.nullif(text("account_no"), F.lit("")), known, F.lit("")))


def incomplete_sources(files: DataFrame) -> DataFrame:
    """Bank and ledger files that lack a bank name or an account, with the fields they lack."""
    lacks = F.array_compact(F.array(*[F.when(text(c) == "", F.lit(c)) for c in ("bank_name", "account_no")]))
    return files.where(F.col("kind").isin("bank_statement", "ledger")).withColumn("missing", F.array_join(lacks, ",")).where("missing <> ''")


def expand_sheets(files: DataFrame) -> DataFrame:
    """One entry per sheet of a file, with an id of bank, kind, year and sheet."""
    out = files.withColumn("sheet", F.explode_outer("sheets"))
    return out.withColumn("source_id", F.concat_ws("_", F.nullif(text("bank_name"), F.lit("")), "kind", F.col("year").cast("string"), "sheet")).drop("sheets")


def select_sheet(cells: DataFrame, words: list[str], rows: int = 5, hint: str | int | None = None) -> DataFrame:
    """The sheet of each file that ``hint`` names (by number from 0, or by name where the file has it), else the sheet with
    most distinct ``words`` in its first rows. Sheets with nothing in them come last, ties go to the first sheet."""
    said = F.lower(F.array_join("cells", " ", ""))
    hits = [F.max((F.when(F.col("row_no") <= rows, said).otherwise("")).contains(w.lower()).cast("int")) for w in words]
    filled = F.max(F.exists("cells", lambda v: ~_blank(v)).cast("int"))
    score = cells.groupBy("source_file", "source_sheet", "sheet_ord").agg(sum(hits[1:], hits[0]).alias("score"), filled.alias("filled"))
    if isinstance(hint, int):
        meant = F.row_number().over(Window.partitionBy("source_file").orderBy("sheet_ord")) == hint + 1
    else:
        meant = F.col("source_sheet") == hint if hint else F.lit(False)
    told = score.withColumn("_meant", meant)
    best = Window.partitionBy("source_file").orderBy(F.desc("_meant"), F.desc("filled"), F.desc("score"), "sheet_ord")
    return told.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("source_file", "source_sheet", "score")


def promote_header(cells: DataFrame) -> DataFrame:
    """Per sheet the header row number (the second row if most of the first is blank or numbers) and the column names,
    repeated names numbered."""
    poor = lambda c: F.size(F.filter(c, lambda v: _blank(v) | v.startswith("Unnamed") | v.try_cast("double").isNotNull())) > F.size(c) / 2
    first = cells.where("row_no <= 2").groupBy("source_file", "source_sheet").agg(F.max(F.when(F.col("row_no") == 1, F.col("cells"))).alias("one"), F.max(F.when(F.col("row_no") == 2, F.col("cells"))).alias("two"))
    second = poor(F.col("one")) & F.col("two").isNotNull()
    chosen = first.select("source_file", "source_sheet", F.when(second, 2).otherwise(1).alias("header_row"), F.when(second, F.col("two")).otherwise(F.col("one")).alias("names"))
    earlier = lambda v, k: F.size(F.filter(F.slice("names", 1, k), lambda o: o == v))
    return chosen.withColumn("names", F.transform("names", lambda v, k: F.when(earlier(v, k) > 0, F.concat(v, F.lit("_dup"), earlier(v, k).cast("string"))).otherwise(v)))


def column_signature(names) -> Column:
    n = names if isinstance(names, Column) else F.col(names)
    return F.substring(F.md5(F.array_join(F.sort_array(F.transform(n, lambda v: F.trim(v))), "|")), 1, 8)


def sheet_signatures(cells: DataFrame, least: int = 4) -> DataFrame:
    """Signature of each sheet's first row with ``least`` filled cells."""
    filled = F.filter("cells", lambda v: ~_blank(v))
    first = cells.where(F.size(filled) >= least).groupBy("source_file", "source_sheet").agg(F.min_by(filled, "row_no").alias("names"))
    return first.select("source_file", "source_sheet", column_signature("names").alias("signature"))


def sheet_headers(cells: DataFrame, least: int = 4) -> DataFrame:
    """Each sheet's first row with ``least`` filled cells: header_row, names (blank ones included), signature."""
    filled = F.filter("cells", lambda v: ~_blank(v))
    first = cells.where(F.size(filled) >= least).groupBy("source_file", "source_sheet").agg(F.min_by(F.struct("row_no", "cells"), "row_no").alias("h"))
    names = F.filter("h.cells", lambda v: ~_blank(v))
    return first.select("source_file", "source_sheet", F.col("h.row_no").alias("header_row"), F.col("h.cells").alias("names"), column_signature(names).alias("signature"))


def smart_sample(cells: DataFrame, header_min: int = 8, data_rows: int = 8, search: int = 20, otherwise: int = 30) -> DataFrame:
    """Rows up to the first wide row of the first ``search``, and ``data_rows`` more; else the first ``otherwise``."""
    wide = (F.size(F.filter("cells", lambda v: ~_blank(v))) >= header_min) & (F.col("row_no") <= search)
    head = F.min(F.when(wide, F.col("row_no"))).over(Window.partitionBy("source_file", "source_sheet"))
    return cells.withColumn("_head", head).where(F.col("row_no") <= F.coalesce(F.col("_head") + data_rows, F.lit(otherwise))).drop("_head")


def profile_columns(df: DataFrame, order: str, sample: int = 100) -> DataFrame:
    """Per column: rows, filled values, and the type of 80 % of the first filled values: number, date, text or empty."""
    names = [c for c in df.columns if c != order]
    long = df.select(order, *[text(c).alias(c) for c in names]).unpivot([order], names, "field", "value")
    counts = long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") != "").cast("long")).alias("filled"))
    # The first values of a column: the least `order` below a bound that holds enough of them is not known, so rank per column.
    first = long.where("value <> ''").withColumn("_k", F.row_number().over(Window.partitionBy("field").orderBy(order))).where(F.col("_k") <= sample)
    number = F.avg(F.col("value").rlike(r"^[-+]?[\d,]+(\.\d+)?$").cast("int"))
    date = F.avg(F.col("value").rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}").cast("int"))
    kinds = first.groupBy("field").agg(F.when(number >= 0.8, "number").when(date >= 0.8, "date").otherwise("text").alias("kind"))
    amount = F.lower("field").rlike("amount|金额|price|借方|贷方")
    return counts.join(kinds, "field", "left").select("field", "n", "filled", F.coalesce("kind", F.lit("empty")).alias("kind"), amount.alias("is_amount"), F.lower("field").rlike("date|日期|时间").alias("is_date"))


def account_from_cells(cells: DataFrame, rows: int = 3) -> DataFrame:
    """Per sheet the first value of digits, 8 at least, below a row's first account heading, within the first rows."""
    sheet = ["source_file", "source_sheet"]
    long = cells.where(F.col("row_no") <= rows).select(*sheet, "row_no", F.posexplode("cells").alias("pos", "value"))
    heading = _has(F.lower(F.coalesce("value", F.lit(""))), ACCOUNT_WORDS)
    heads = long.where(heading).groupBy(*sheet, F.col("row_no").alias("head")).agg(F.min("pos").alias("pos"))
    found = long.join(heads, [*sheet, "pos"]).where((F.col("row_no") > F.col("head")) & F.trim("value").rlike(r"^\d{8,}$"))
    return found.groupBy(*sheet).agg(F.min_by(F.trim("value"), F.struct("head", "row_no")).alias("account_no"))
