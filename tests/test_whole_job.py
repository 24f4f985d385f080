"""Registered queries and operators over all rows, against plain Python."""

import datetime
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.functions.scalars import normalize_text
from ledgerloom.operators import candidates, pairs
from ledgerloom.plans.bindings import DENSE, SPARSE, view

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def _rows(spark, name, side, cents, folder=SF):
    records = pairs.to_records(view(spark, folder, name, cents), side)
    return sorted(records.withColumn("said", normalize_text(pairs.side_text(side))).collect(), key=lambda r: r["ord"])


def _alike(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 2 * table[-1][-1] / (len(a) + len(b)) if a and b else 0.0


@here
def test_pair_scores_of_all_entries(spark):
    banks, known, want, told = defaultdict(list), {}, {}, set()
    for b in _rows(spark, "bank", "bank", DENSE, LARGER):
        banks[b["month"], b["flow"], b["cents"]].append(b)
    for g in _rows(spark, "ledger", "ledger", DENSE, LARGER):
        for b in (b for cents in range(g["cents"] - 1, g["cents"] + 2) for b in banks[g["month"], g["flow"], cents]):
            days = abs((b["day"] - g["day"]).days)
            if days <= 30 and (b["account"] == g["account"] or not b["account"] or not g["account"]):
                said = (b["said"], g["said"])
                if said not in known:
                    known[said] = _alike(*said)
                want[b["id"], g["id"]] = 0.52 * (1 - abs(b["cents"] - g["cents"]) / 2) + 0.25 * (1 - days / 31) + 0.23 * known[said]
                told |= {(b["id"], g["id"])} if g["summary"] else set()
    got = {(r["bank"], r["ledger"]): r["score"] for r in entry.queries()["pair_scores_all"](spark, LARGER).collect()}
    assert told and set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-4


@here
def test_daily_groups_of_all_bank_rows(spark):
    def grouped(rows, *keys):
        out = defaultdict(list)
        for r in rows:
            out[tuple(r[k] for k in keys)].append(r)
        return out

    def agree(b, g):
        return len(b) > 1 and len(g) > 1 and abs(sum(r["cents"] for r in b) - sum(r["cents"] for r in g)) <= 1

    banks, entries, want, taken = _rows(spark, "bank", "bank", SPARSE), _rows(spark, "day_ledger", "ledger", SPARSE), set(), set()
    told = lambda b, g: ("|".join(r["id"] for r in b), "|".join(r["id"] for r in g))
    days, their_days = grouped(banks, "day", "flow"), grouped(entries, "day", "flow")
    for key, b in days.items():
        if any(not r["account"] for r in b) and agree(b, their_days[key]):
            taken.add(key)
            want.add(told(b, their_days[key]))
    assert taken
    theirs = grouped(entries, "day", "flow", "account")
    for key, b in grouped(banks, "day", "flow", "account").items():
        if key[2] and key[:2] not in taken and agree(b, theirs[key]):
            want.add(told(b, theirs[key]))
    got = [tuple(r) for r in entry.queries()["daily_many_to_many_all"](spark, SF).select("bank_ids", "ledger_ids").collect()]
    assert len(got) == len(want) and set(got) == want


def _some(spark, rows):
    data = [(i, k, a, datetime.date(2022, 1, d), "2022-01", "in", c, n, "", "", "", "", "") for k, (i, a, d, c, n) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, ord long, account string, day date, month string, flow string, cents long, counterparty_name string, summary string, description string, subject string, voucher_no string, bank_name string")


def test_subsets_across_blank_accounts(spark):
    bank = _some(spark, [("b1", "", 3, 100, "Acme"), ("b2", "1", 4, 201, "Acme"), ("b3", "2", 5, 4000, "Beta"), ("b4", "2", 6, 5003, "Beta")])
    ledger = _some(spark, [("l1", "1", 7, 301, "Acme"), ("l2", "", 7, 9003, "Beta"), ("l3", "1", 7, 9003, "Beta")])
    got = {(tuple(sorted(r["banks"])), r["ledgers"][0]) for r in candidates.subset_groups(bank, ledger).collect()}
    assert got == {(("b1", "b2"), "l1"), (("b3", "b4"), "l2")}


def test_all_candidates_hold_large_subsets(spark):
    amounts = [1000 + 7 * k * k for k in range(15)]
    bank = _some(spark, [(f"b{k:02}", "1", 1 + k, c, "Acme") for k, c in enumerate(amounts)] + [("far", "1", 28, 5, "Acme")])
    ledger = _some(spark, [("l", "1", 20, sum(amounts), "Acme")])
    all_of = tuple(f"b{k:02}" for k in range(15))
    rows = candidates.build_candidates(bank, ledger).collect()
    assert "manual_time_window_many_to_one" in {r["match_type"] for r in rows if tuple(sorted(r["banks"])) == all_of}
    grouped = candidates.grouped_subsets(bank, ledger.withColumn("summary", F.lit("手续费"))).collect()
    assert [(r["match_type"], tuple(sorted(r["banks"]))) for r in grouped] == [("many_to_one", all_of)]
    assert candidates.grouped_subsets(bank, ledger).count() == 0
