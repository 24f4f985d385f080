"""Findings on larger tables, in small."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import subset
from ledgerloom.functions.subset import subset_sum
from ledgerloom.operators import candidates, review


def test_match_ids_are_never_cut(spark):
    ids = spark.createDataFrame([(7,), (99_999,), (105_036,), (105_037,)], "serial long").select(review.match_id("serial").alias("m"))
    assert [r["m"] for r in ids.collect()] == ["M00007", "M99999", "M105036", "M105037"]
    assert review.highest_serial(ids.withColumnRenamed("m", "match_id")) == 105_037


def _records(spark, rows):
    data = [(i, k, a, datetime.date(2022, 1, d), "2022-01", "in", c, "Acme", "") for k, (i, a, d, c) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, ord long, account string, day date, month string, flow string, cents long, counterparty_name string, summary string")


def _drawn(seed, n, name, high):
    r = random.Random(seed)
    return [(f"{name}{k}", r.choice(["", "1", "2"]), r.randint(1, 28), r.randint(1, high)) for k in range(n)]


@pytest.mark.parametrize("window", [365, 4])
def test_earliest_smaller_rows_block_by_block(spark, monkeypatch, window):
    monkeypatch.setattr(candidates, "BLOCK", 7)
    banks, entries = _drawn(1, 120, "b", 400), _drawn(2, 90, "l", 900)
    want = {}
    for i, account, day, cents in entries:
        near = [(d, k, b, c) for k, (b, a, d, c) in enumerate(banks) if (a == account or not a or not account) and abs(d - day) <= window and c <= cents + 1]
        pool = sorted(near)[:9]
        found = [pool[p][2] for p in subset_sum([r[3] for r in pool], cents, 1, 60, 2, 1000)]
        if found:
            want[i] = found
    got = candidates.manual_subsets(_records(spark, banks), _records(spark, entries), window=window, pool=9, steps=1000).collect()
    assert want and {r["ledgers"][0]: r["banks"] for r in got} == want and len(got) == len(want)


def test_runs_beyond_all_entries_are_not_made(spark):
    bank = _records(spark, _drawn(3, 300, "b", 500)).withColumn("limit", F.lit(900))
    few, every = candidates.runs(bank, 2, 80, "limit"), candidates.runs(bank, 2, 80)
    assert sorted(few.collect()) == sorted(every.where("total <= 900").collect())
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_windows_against_single_entries_and_runs(spark):
    banks, entries = sorted(_drawn(4, 60, "b", 60), key=lambda r: r[2]), sorted(_drawn(5, 40, "l", 200), key=lambda r: r[2])

    def spans(rows, least, most):
        for a in ("", "1", "2"):
            mine = [r for r in rows if r[1] == a]
            yield from ((a, mine[x : x + n]) for x in range(len(mine)) for n in range(least, min(most, len(mine) - x) + 1))

    for size in ((1, 1), (2, 4)):
        want = sorted(("|".join(r[0] for r in x), "|".join(r[0] for r in y)) for a, x in spans(banks, 2, 10) for b, y in spans(entries, *size) if a == b and abs(sum(r[3] for r in x) - sum(r[3] for r in y)) <= 1)
        got = candidates.window_groups(_records(spark, banks), _records(spark, entries), 1, 10, *size, keep=None)
        assert want and sorted(("|".join(r["banks"]), "|".join(r["ledgers"])) for r in got.collect()) == want


@pytest.mark.parametrize("window", [45, 3])
def test_entries_meet_lists_of_equal_amounts(spark, window):
    banks, entries = _drawn(6, 200, "b", 6), _drawn(7, 60, "l", 6)
    want, told = set(), {r["id"]: (r["first"], r["last"]) for r in candidates._dated(_records(spark, entries)).collect()}
    for i, account, day, cents in entries:
        around = [datetime.date(2022, 1, day) + datetime.timedelta(x) for x in (-window, window)]
        low, high = (f([x, y]) for f, x, y in zip((min, max), told[i], around))
        near = [b for b, a, d, c in banks if (a == account or not a or not account) and low <= datetime.date(2022, 1, d) <= high and abs(c - cents) <= 1]
        want |= {(b, i) for b in near[:8]}
    found = candidates.exact_pairs(_records(spark, banks), _records(spark, entries), window=window)
    got = [(r["banks"][0], r["ledgers"][0]) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    if window == 45:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l_id" not in plan


def test_members_are_told_alike_for_pairs_and_groups(spark):
    bank, ledger = _records(spark, _drawn(8, 6, "b", 50)), _records(spark, _drawn(9, 6, "l", 50))
    more = {c: F.lit("") for c in ("description", "voucher_no")}
    bank, ledger = bank.withColumns(more), ledger.withColumns(more)
    rows = [("one_to_one", ["b1"], ["l2"]), ("one_to_one", ["b2"], ["gone"]), ("many_to_one", ["b4", "b3"], ["l1"]), ("own", ["b5"], ["l5"])]
    day = datetime.date(2022, 1, 2)
    made = candidates.signature(spark.createDataFrame([(*r, 5, 6, 0.5, day, day, "needs_review", "", True, 0.8, "") for r in rows], "match_type string, banks array<string>, ledgers array<string>, bank_cents long, ledger_cents long, score double, period_start date, period_end date, status string, candidate_id string, llm_approve boolean, llm_confidence double, llm_reason string"))
    made = made.withColumn("candidate_signature", F.when(F.col("match_type") == "own", "mine").otherwise(F.col("candidate_signature")))
    told = {r["candidate_signature"]: json.loads(r["payload"]) for r in review.payload(made, bank, ledger).collect()}
    assert {k: ([x["id"] for x in v["bank_rows"]], [x["id"] for x in v["ledger_rows"]]) for k, v in told.items()} == {"one_to_one:b1:l2": (["b1"], ["l2"]), "many_to_one:b4|b3:l1": (["b4", "b3"], ["l1"]), "mine": (["b5"], ["l5"])}
    assert [x["pos"] for x in told["many_to_one:b4|b3:l1"]["bank_rows"]] == [0, 1]
    used = spark.createDataFrame([("bank", "b5")], "side string, id string")
    table = review.review_table(made, used, bank, ledger)
    seen = {r["candidate_signature"]: r for r in table.collect()}
    assert set(seen) == {"one_to_one:b1:l2", "one_to_one:b2:gone", "many_to_one:b4|b3:l1"}
    assert seen["one_to_one:b2:gone"]["ledger_summary"] is None and seen["one_to_one:b1:l2"]["ledger_summary"].startswith("l2 | 2022-01-")
    assert seen["many_to_one:b4|b3:l1"]["bank_summary"].split(review.LINE_BREAK)[0].startswith("b4 |") and seen["one_to_one:b1:l2"]["counterparty_consistency"] == 1.0


@pytest.mark.parametrize("early", [0, 5])
def test_smallest_amounts_are_counted_as_if_visited(monkeypatch, early):
    """Plain search, node by node, against the one that looks the smallest amounts up."""
    monkeypatch.setattr(subset, "EARLY", early)
    monkeypatch.setattr(subset, "TAIL", 6)
    r = random.Random(10)
    for _ in range(3000):
        high = r.choice([4, 30, 1000])
        amounts = [r.randrange(-1, high) for _ in range(r.randrange(0, 16))]
        target, tolerance, most, least, steps, results = r.randrange(0, high * 5), r.randrange(0, 3), r.randrange(1, 12), r.randrange(1, 4), r.choice([5, 50, 500, 100_000]), r.choice([1, 3])
        order = sorted((k for k, a in enumerate(amounts) if a > 0), key=lambda k: -amounts[k])
        found, seen = [], 1

        def go(at, chosen, total):
            nonlocal seen
            for x in range(at, len(order)):
                now = total + amounts[order[x]]
                if now > target + tolerance:
                    continue
                if total + sum(amounts[k] for k in order[x : x + most - len(chosen)]) < target - tolerance:
                    return True
                seen += 1
                if seen > steps:
                    return False
                if len(chosen) + 1 >= least and now >= target - tolerance:
                    found.append([*chosen, order[x]])
                    if len(found) >= results:
                        return False
                elif len(chosen) + 1 < most and not go(x + 1, [*chosen, order[x]], now):
                    return False
            return True

        go(0, [], 0)
        assert subset.subset_sums(amounts, target, tolerance, most, least, steps, results) == (found, seen <= steps)


def test_long_searches_look_the_smallest_amounts_up():
    r = random.Random(11)
    amounts = [r.randrange(1000, 30_000_000) * 4 for _ in range(80)]
    subset._tail_sums.cache_clear()
    found, ended = subset.subset_sums(amounts, 120_000_002, 1, 60, 2, 100_000)  # no sum of fours is that near
    told = subset._tail_sums.cache_info()
    assert (found, ended) == ([], False) and 0 < told.hits < 5_000
