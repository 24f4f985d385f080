import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as s
from ledgerloom.operators import cleaning, layout, quality
from ledgerloom.sources import files


def _one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column).collect()]


def test_amounts(spark):
    got = _one(spark, s.parse_amount("x"), "(1,234.50)", "--", "￥12元", "abc", None, "-5", "3 ca")
    assert got == [Decimal("-1234.5"), 0, 12, 0, 0, -5, 3]
    assert _one(spark, s.parse_amount_platform("x"), "$5", "(€ 7.25)", "+3") == [5, Decimal("-7.25"), 3]
    assert _one(spark, s.amount_to_cents("x"), "0.005", "113,714.21") == [1, 11371421]


def test_dates(spark):
    day = datetime.date(2022, 1, 5)
    assert _one(spark, s.parse_date("x"), "2022/1/5", "20220105", "2022-01-05 00:12:39", "1/5/2022", "junk", "", None) == [day] * 4 + [None] * 3
    p = spark.createDataFrame([("12.25-1.5", datetime.date(2022, 12, 30)), ("13.40-14.2", datetime.date(2022, 3, 2)), ("2021年2月", day), ("", day)], "t string, d date").select(s.infer_period("t", "d").alias("p")).collect()
    assert [(r.p.start.isoformat(), r.p.end.isoformat()) for r in p] == [("2022-12-25", "2023-01-05"), ("2022-03-01", "2022-03-31"), ("2021-02-01", "2021-02-28"), ("2022-01-01", "2022-01-31")]


def test_texts(spark):
    assert _one(spark, s.extract_counterparty("x"), "收到甲公司的货款", "付给 Acme/x", "关于", None) == ["甲公司", "Acme", "", ""]
    assert _one(spark, F.array_join(s.split_ids("x"), ","), " a | 0|b||", None) == ["a,0,b", ""]
    assert _one(spark, s.month_from_path("x"), "in/09-22/f.csv", "a/202203/b", "x/7/z", "none") == ["2022-09", "2022-03", "2022-07", "unknown"]


def test_layouts_and_checks(spark):
    cells = spark.createDataFrame([("f", "s", 0, k, c) for k, c in ((1, ["1", "", "2"]), (2, ["name", "name", "date"]), (3, ["a", "b", "c"]))], "source_file string, source_sheet string, sheet_ord int, row_no int, cells array<string>")
    head = layout.promote_header(cells).first()
    assert head["header_row"] == 2 and head["names"] == ["name", "name_dup1", "date"]
    raw = spark.createDataFrame([("s", "f", "t", 1, ["1", "9", "2022-09-24 00:12:39", "借", "", "Payee", "", "memo", "", "d", "4.50", "113,714.21", ""]), ("s", "f", "t", 2, ["x"])], "source_id string, source_file string, source_sheet string, row_no int, cells array<string>")
    row = cleaning.clean_bank_positional(raw).collect()
    assert [(r["txn_id"], r["flow"], r["amount_cents"], r["counterparty_name"], r["balance_cents"]) for r in row] == [("s:r1", "out", 450, "Payee", 11371421)]
    df = spark.createDataFrame([("s", 1, "0"), ("s", 2, "x"), ("s", 3, "5")], "source_id string, row_no int, amount string")
    got = quality.amount_problems(df).first()
    assert (got["bad_count"], got["total"], got["sample_rows"]) == (2, 3, "1,2")


def test_rename_first_wins(spark):
    df = spark.createDataFrame([("1", "2", "3")], "a string, b string, _c string")
    out = cleaning.rename_columns(df, {"a": "x", "b": "x"})
    assert out.columns == ["x"] and out.first()[0] == "1"


def test_csv_family(spark, tmp_path):
    (tmp_path / "09-22").mkdir()
    (tmp_path / "09-22" / "a.csv").write_text("\ufeffPartner Transaction Id,Amount,Remarks\n1, 5 ,数据\n2,nan,\n")
    (tmp_path / "b.csv").write_text("Amount,Fee,amount\n7,1,9\n")
    (tmp_path / "c.csv").write_bytes("Settle Batch No,备注\n3,货款\n".encode("gbk"))
    (tmp_path / "d.csv").write_bytes(b"Amount,Remarks\n4,\x80\xff\n")
    (tmp_path / "e.csv").write_text("\n")
    listed = files.list_inputs(spark, str(tmp_path))
    assert sorted((r["name"], r["top"]) for r in listed.collect()) == [("a.csv", "09-22"), ("b.csv", ""), ("c.csv", ""), ("d.csv", ""), ("e.csv", "")]
    paths = [r["path"] for r in listed.collect()]
    table = files.read_settlement_csv(spark, paths)
    got = sorted((r["source_file"], r["partner_transaction_id"], r["amount"], r["fee"], r["remarks"], r["备注"]) for r in table.collect())
    assert got == [("a.csv", "1", "5", None, "数据", None), ("a.csv", "2", "", None, "", None), ("b.csv", None, "7", "1", None, None), ("c.csv", None, None, None, None, "货款"), ("d.csv", None, "4", None, "\x80ÿ", None)]
    index = {r["path"][-5:]: (r["month"], r["type"], r["n"], r["error"]) for r in files.file_index(table, files.probe_files(spark, paths)).collect()}
    assert index == {"a.csv": ("2022-09", "transaction", 2, ""), "b.csv": ("unknown", "unknown", 1, ""), "c.csv": ("unknown", "batch", 1, ""), "d.csv": ("unknown", "unknown", 1, ""), "e.csv": ("unknown", "error", 0, "no header")}
    assert files.load_clean(spark, str(tmp_path / "none"), "a string").count() == 0
    rows = spark.createDataFrame([("4月.xlsx", "Sellout"), ("4月.xlsx", "Sellout")], "source_file string, source_sheet string")
    sheets = spark.createDataFrame([("4月.xlsx", "Sellout"), ("4月.xlsx", "Recap")], "source_file string, source_sheet string")
    assert sorted(map(tuple, files.sheet_index(rows, sheets).collect())) == [("4月.xlsx", "Recap", "skip", "2022-04", 0), ("4月.xlsx", "Sellout", "sellout", "2022-04", 2)]
    out = str(tmp_path / "out")
    files.write_result(rows, out, "csv")
    assert files.load_clean(spark, out, "source_file string, source_sheet string").count() == 2


def test_layouts_of_users(spark):
    import pandas as pd

    cells = spark.createDataFrame([("s", "f", "t", k, ["2022-01-0" + str(k), "5"]) for k in (1, 2)], "source_id string, source_file string, source_sheet string, row_no int, cells array<string>")
    cleaning.register_layout("abc", lambda group: pd.DataFrame({"row_no": group["row_no"], "amount": [c[1] for c in group["cells"]]}))
    parsed = cleaning.apply_layout(cells, "abc", "row_no int, amount string").withColumns({"source_sheet": F.lit("t"), "source_file": F.lit("f")})
    done = cleaning.finish_layout(parsed, ["txn_id", "amount", "bank_name", "account_no", "source_id"], "s", "f", "txn_id", bank_name="Bank")
    assert sorted((r["txn_id"], r["amount"], r["bank_name"], r["account_no"]) for r in done.collect()) == [("s_f_t_1", "5", "Bank", ""), ("s_f_t_2", "5", "Bank", "")]
    assert quality.schema_differences(done, ["txn_id", "other"]) == (["other"], [c for c in done.columns if c != "txn_id"])
    shown = cleaning.display_table(done.withColumn("flow", F.lit("in")), {"flow": "方向", "amount": "金额"})
    assert shown.columns == ["方向", "金额"] and {r[0] for r in shown.collect()} == {"收入"}
    assert not cleaning.may_fill(done, done.where("false")) and cleaning.may_fill(done.where("false"), done.where("false")) and cleaning.may_fill(done, done, False)
