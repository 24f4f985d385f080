"""Parsing, normalising and labelling of statement and ledger values, all as column expressions.

Null and blank text mean the same throughout. Money is compared in whole cents.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and limits of the matching rules.
FEE_WORDS = "手续费|SMSP|Service Charge"
FEE_PERIOD = r"\d{4}/\d{2}/\d{2}\s*[-~到]\s*\d{4}/\d{2}/\d{2}"
FEE_MAX_CENTS = 100_000
TRUE_WORDS = ("true", "1", "yes", "y", "是", "通过")
DATE_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d", "yyyyMMdd", "M/d/yyyy")
REVIEW_SEPARATOR = "\n---ROW---\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x) -> Column:
    return F.coalesce(F.trim(_c(x).cast("string")), F.lit(""))


def blank_to_null(x) -> Column:
    return F.nullif(text(x), F.lit(""))


def first_nonblank(*xs) -> Column:
    return F.coalesce(*[blank_to_null(x) for x in xs], F.lit(""))


def join_unique(*xs, sep: str = " | ") -> Column:
    return F.array_join(F.array_distinct(F.filter(F.array(*[text(x) for x in xs]), lambda v: v != "")), sep)


def join_unique_array(values, sep: str = " | ") -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(_c(values), lambda v: F.coalesce(F.trim(v), F.lit(""))), lambda v: v != "")), sep)


def _number(clean: Column, pattern: str) -> Column:
    found = F.regexp_extract(clean, pattern, 0)
    return F.coalesce(clean.try_cast("decimal(20,4)"), F.nullif(found, F.lit("")).try_cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))


def parse_amount(x) -> Column:
    """Amounts of statements and ledgers: separators and currency marks go; in parentheses an amount is negative."""
    raw = text(x)
    clean = F.regexp_replace(raw, "[,￥¥元 ()]", "")
    value = _number(clean, r"-?\d+(?:\.\d+)?")
    amount = F.when(raw.rlike(r"^\(.*\)$"), -F.abs(value)).otherwise(value)
    return F.when(clean.isin("", "-", "--"), F.lit(0).cast("decimal(20,4)")).otherwise(amount)


def parse_amount_platform(x) -> Column:
    """Amounts of platform files: more currency marks and any white space."""
    clean = F.regexp_replace(text(x), r"[,￥¥元$€£\s]", "")
    inner = F.regexp_replace(clean, r"^\((.*)\)$", "$1")
    value = _number(inner, r"[-+]?\d+\.?\d*")
    amount = F.when(clean.rlike(r"^\(.*\)$"), -F.abs(value)).otherwise(value)
    return F.when(clean.isin("", "-", "--"), F.lit(0).cast("decimal(20,4)")).otherwise(amount)


def cents(amount) -> Column:
    return F.round(_c(amount) * 100, 0).cast("bigint")


def amount_to_cents(x) -> Column:
    return cents(parse_amount(x))


def parse_int(x) -> Column:
    raw = text(x)
    return F.coalesce(raw.try_cast("double").try_cast("bigint"), F.nullif(F.regexp_extract(raw, r"\d+", 0), F.lit("")).try_cast("bigint"))


def parse_date(x) -> Column:
    raw = text(x)
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def date_from_parts(y, m, d) -> Column:
    parts = F.format_string("%04d-%02d-%02d", *[F.coalesce(_c(v).cast("int"), F.lit(0)) for v in (y, m, d)])
    return F.when((_c(y) > 0) & (_c(m) > 0) & (_c(d) > 0), F.try_to_timestamp(parts, F.lit("yyyy-MM-dd")).cast("date"))


def csv_date(x) -> Column:
    return F.coalesce(F.date_format(parse_date(x), "yyyy-MM-dd"), text(x))


def compact_date(x) -> Column:
    return F.regexp_replace(text(x), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def digits(x) -> Column:
    return F.regexp_replace(text(x), "[^0-9]", "")


def normalize_text(x) -> Column:
    return F.regexp_replace(F.lower(text(x)), r"[\s,，。；;：:/\\()\[\]（）【】\-_=+]", "")


def extract_counterparty(summary) -> Column:
    """The name in a summary such as 收到…的…: a leading verb goes, the rest ends at a separator; 80 characters."""
    rest = F.regexp_replace(text(summary), "^(收到|收|付给|支付|付)", "")
    name = F.regexp_extract(rest, "^(?s)(.*?)(?:/|的|关于|$)", 1)
    return F.substring(F.regexp_replace(name, r"^[\s,，。；;：:\-_]+|[\s,，。；;：:\-_]+$", ""), 1, 80)


def counterparty_key(counterparty, summary) -> Column:
    return F.regexp_replace(F.lower(first_nonblank(counterparty, summary)), r"(?U)\W+", "")


def stable_id(prefix: str, row, *parts) -> Column:
    told = F.array_join(F.filter(F.array(*[text(p) for p in parts]), lambda v: v != ""), ":")
    return F.substring(F.md5(F.concat(F.lit(f"{prefix}:"), _c(row).cast("string"), F.lit(":"), told)), 1, 12)


def source_row_id(source_id, source_file, source_sheet, row_no, generated: bool) -> Column:
    if generated:
        return F.concat_ws("_", text(source_id), text(source_file), text(source_sheet), _c(row_no).cast("string"))
    return F.concat(text(source_id), F.lit(":r"), _c(row_no).cast("string"))


def as_bool(x) -> Column:
    return F.lower(text(x)).isin(*TRUE_WORDS)


def split_ids(x) -> Column:
    return F.filter(F.transform(F.split(text(x), r"[|]"), lambda v: F.trim(v)), lambda v: v != "")


def is_fee(summary, description, counterparty, amount_cents) -> Column:
    said = F.concat_ws(" ", *[F.coalesce(_c(x), F.lit("")) for x in (summary, description, counterparty)])
    return (said.rlike(FEE_WORDS) | said.rlike(FEE_PERIOD)) & (_c(amount_cents) <= FEE_MAX_CENTS)


def is_bulk_payment(summary, description) -> Column:
    return F.upper(text(summary)).rlike("^(OBSS|GIRO)") | F.upper(text(description)).rlike("^(OBSS|GIRO)")


def is_transfer(summary, subject) -> Column:
    return text(summary).contains("调拨") & text(subject).contains("银行存款")


def infer_period(summary, day) -> Column:
    """struct(start, end): a range m.d-m.d in the text (into the next year if it ends in an earlier month), else a month
    named in it, else the calendar month of ``day``; impossible dates fall through to the next rule."""
    s, d = text(summary), _c(day)
    period = r"(?<!\d)(\d{1,2})\s*[.月/]\s*(\d{1,2})\s*(?:-|~|至|到|—)\s*(\d{1,2})\s*[.月/]\s*(\d{1,2})(?!\d)"
    month_word = r"(?:(\d{4})年)?(\d{1,2})\s*月"
    number = lambda pattern, k: F.nullif(F.regexp_extract(s, pattern, k), F.lit("")).cast("int")
    year = F.year(d)
    first_month, last_month = number(period, 1), number(period, 3)
    start = date_from_parts(year, first_month, number(period, 2))
    end = date_from_parts(F.when(last_month < first_month, year + 1).otherwise(year), last_month, number(period, 4))
    month = date_from_parts(F.coalesce(number(month_word, 1), year), number(month_word, 2), F.lit(1))
    own = F.trunc(d, "month")
    ranged = start.isNotNull() & end.isNotNull()
    first = F.when(ranged, start).otherwise(F.coalesce(month, own))
    return F.struct(first.alias("start"), F.when(ranged, end).otherwise(F.last_day(F.coalesce(month, own))).alias("end"))


def signed_cents(flow, amount_cents) -> Column:
    return F.when(_c(flow) == "out", -_c(amount_cents)).otherwise(_c(amount_cents))


def format_date(x) -> Column:
    return F.coalesce(F.date_format(_c(x), "yyyy-MM-dd"), F.lit(""))


def format_amount(x) -> Column:
    value = F.coalesce(_c(x).cast("double"), F.lit(0.0))
    return F.when(value == 0, F.lit("")).otherwise(F.format_string("%.2f", value))


def confidence_label(score, high: float = 0.82, medium: float = 0.65) -> Column:
    return F.when(_c(score) >= high, "high").when(_c(score) >= medium, "medium").otherwise("low")


def shorten(x, n: int) -> Column:
    return F.when(F.length(text(x)) > n, F.concat(F.substring(text(x), 1, n), F.lit("..."))).otherwise(text(x))


def month_of(day) -> Column:
    return F.date_format(_c(day), "yyyy-MM")


def month_from_path(path, default_year: int = 2022) -> Column:
    """The month that a folder or file name tells, parts from the last to the first: MM-YY, YYYYMM or a bare month."""

    def one(part: Column) -> Column:
        mm_yy, yyyymm, bare = (F.regexp_extract(part, p, 1) for p in (r"^(\d{1,2})-\d{2}$", r"(20\d{2}(?:0[1-9]|1[0-2]))", r"^(0?[1-9]|1[0-2])$"))
        yy = F.regexp_extract(part, r"^\d{1,2}-(\d{2})$", 1)
        return (
            F.when((mm_yy != "") & mm_yy.try_cast("int").between(1, 12), F.concat(F.lit("20"), yy, F.lit("-"), F.lpad(mm_yy, 2, "0")))
            .when(yyyymm != "", F.concat(F.substring(yyyymm, 1, 4), F.lit("-"), F.substring(yyyymm, 5, 2)))
            .when(bare != "", F.concat(F.lit(f"{default_year}-"), F.lpad(bare, 2, "0")))
        )

    told = F.filter(F.transform(F.reverse(F.split(text(path), r"[/\\]")), one), lambda m: m.isNotNull())
    return F.coalesce(F.get(told, F.lit(0)), F.lit("unknown"))


def month_from_filename(name, default_year: int = 2022) -> Column:
    n = text(name)
    named, yyyymm = F.regexp_extract(n, r"(\d{1,2})月", 1), F.regexp_extract(n, r"(20\d{2}(?:0[1-9]|1[0-2]))", 1)
    return (
        F.when((named != "") & named.try_cast("int").between(1, 12), F.concat(F.lit(f"{default_year}-"), F.lpad(named, 2, "0")))
        .when(yyyymm != "", F.concat(F.substring(yyyymm, 1, 4), F.lit("-"), F.substring(yyyymm, 5, 2)))
        .otherwise("unknown")
    )
