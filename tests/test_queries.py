"""Registered queries against their SQL, on the smallest tables."""

import datetime
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["net_outbound", "exclusion_reasons", "id_match", "order_match_summary", "order_match_metrics", "settlement_summary", "flow_check", "wp_monthly", "pair_scores", "daily_many_to_many", "parse_amounts", "parse_dates", "infer_period", "month_keys", "dq_direction", "bank_positional", "ledger_positional", "cand_runs", "routed", "sheet_class", "file_meta", "looks_grouped", "header_promote", "settlement_txn", "refund_clean", "transfer_clean", "cand_period", "cand_ranked", "grid_sheets", "layouts_by_signature", "approvals_applied", "accepted_or_blocked", "transfers", "one_to_one", "text_similarity", "cand_without_overlap"]


def _plain(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return "None"
    if isinstance(v, datetime.datetime):
        return str(v)[:10]
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.6f}".rstrip("0").rstrip(".")
    return str(v)


def _rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    for t in ("orders", "customer", "lineitem", "events", "nation", "supplier"):
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    assert _rows(entry.queries()[name](spark, SF).toPandas()) == _rows(duckdb.sql(entry.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
