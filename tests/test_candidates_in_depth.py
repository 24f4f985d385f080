"""Contiguous windows and monthly parts against plain loops, and a bucket of many equal amounts."""

import datetime
import random
import re
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import ratio
from ledgerloom.functions.subset import consistency, normalized, pool_subsets, unique_joined
from ledgerloom.operators import candidates

COLUMNS = "id string, ord long, account string, day date, month string, flow string, cents long, counterparty_name string, summary string, description string, subject string, voucher_no string, bank_name string, raw_text string"


def _records(spark, rows):
    data = [(i, k, a, datetime.date(2022, 1, d), "2022-01", f, c, who, "", "", "", "", "", "") for k, (i, a, d, f, c, who) in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS)


def _random(rng, p, n, low, high, days=6):
    return [(f"{p}{k}", rng.choice(["1", "2"]), rng.randrange(1, days + 1), "in", rng.randrange(low, high), rng.choice(["Acme", "Bolt"])) for k in range(n)]


@pytest.mark.parametrize("seed,keep", [(1, 50), (2, 7), (3, 400)])
def test_best_windows_are_those_of_all_pairs(spark, monkeypatch, seed, keep):
    monkeypatch.setattr(candidates, "STRETCH", 7)
    rng = random.Random(seed)
    bank, ledger = _records(spark, _random(rng, "b", 60, 1, 3)), _records(spark, _random(rng, "l", 30, 2, 5))
    few = candidates.window_groups(bank, ledger, bank_most=6, ledger_most=4, keep=keep)
    every = candidates.window_groups(bank, ledger, bank_most=6, ledger_most=4, keep=None)
    order = lambda d: [tuple(r) for r in candidates.measured(d, bank, ledger).withColumn("score", candidates.many_score()).orderBy(*candidates.many_order()).limit(keep).select(*candidates.COLUMNS).collect()]
    got, want = order(few), order(every)
    assert len(want) == keep and got == want


def test_a_bucket_of_equal_fees(spark):
    side = lambda p, n: spark.range(n).select(
        F.concat(F.lit(p), "id").alias("id"), F.col("id").alias("ord"), F.lit("1").alias("account"), F.date_add(F.lit("2022-01-01").cast("date"), (F.col("id") % 28).cast("int")).alias("day"),
        F.lit("2022-01").alias("month"), F.lit("out").alias("flow"), F.lit(500).cast("long").alias("cents"), F.lit("Fee").alias("counterparty_name"), *[F.lit("").alias(c) for c in ("summary", "description", "subject", "voucher_no", "bank_name", "raw_text")],
    )
    found = candidates.window_groups(side("b", 10_000), side("l", 10_000)).collect()
    assert len(found) == 50
    assert all(len(r["banks"]) == len(r["ledgers"]) == 2 and r["period_start"] == r["period_end"] for r in found)


def _plain_subsets(amounts, target, tolerance, most, results):
    found = []

    def go(start, chosen, total):
        if len(found) >= results:
            return
        if chosen and abs(total - target) <= tolerance:
            found.append(list(chosen))
            return
        if len(chosen) >= most or total > target + tolerance:
            return
        for k in range(start, len(amounts)):
            go(k + 1, [*chosen, k], total + amounts[k])

    go(0, [], 0)
    return found


def test_subsets_keep_the_order_of_the_pool():
    rng = random.Random(4)
    for _ in range(1500):
        amounts = [rng.randrange(1, 25) for _ in range(rng.randrange(0, 9))]
        case = rng.randrange(1, 60), rng.randrange(0, 3), rng.randrange(1, 6), rng.randrange(1, 9)
        assert pool_subsets(amounts, *case) == (_plain_subsets(amounts, *case), True)
    assert pool_subsets([1] * 30, 29, steps=9) == ([], False)


Row = namedtuple("Row", "id cents day said cp")


def _plain_parts(banks, entries, each, tolerance=1):
    """The parts of a bucket, as their rule is told."""
    runs = [entries[a:b] for a in range(len(entries)) for b in range(a + 1, min(a + 8, len(entries)) + 1)][:180]
    share = lambda rows: max(sum(r.cp == c.cp for r in rows) for c in rows) / len(rows)
    span = lambda rows: (max(r.day for r in rows) - min(r.day for r in rows)).days
    runs.sort(key=lambda es: (share(es), -len(es), -span(es), sum(e.cents for e in es)), reverse=True)
    made = {}
    for es in runs:
        target, text = sum(e.cents for e in es), normalized(unique_joined(e.said for e in es))
        centre = sum(e.day.toordinal() for e in es) / len(es)
        pool = sorted((b for b in banks if b.cents <= target + tolerance), key=lambda b: (ratio(normalized(b.said), text), -abs(b.day.toordinal() - centre), share([b, *es]), -b.cents), reverse=True)
        found = [[pool[k] for k in f] for f in _plain_subsets([b.cents for b in pool], target, tolerance, 40, max(1, each - len(made)))]
        found.sort(key=lambda bs: (ratio(normalized(unique_joined(b.said for b in bs)), text), min(share(bs), share(es)), -span([*bs, *es]), -len(bs) - len(es)), reverse=True)
        for bs in found:
            if len(bs) + len(es) > 2:
                made.setdefault((frozenset(b.id for b in bs), frozenset(e.id for e in es)))
                if len(made) >= each:
                    return set(made)
    return set(made)


@pytest.mark.parametrize("seed", [5, 6])
def test_monthly_parts_follow_the_rule(spark, seed):
    rng = random.Random(seed)
    banks = [(f"b{k}", "1", rng.randrange(1, 28), "in", rng.randrange(2, 30), rng.choice(["Acme", "Bolt", "Acme Bolt"])) for k in range(9)]
    total = sum(b[4] for b in banks)
    cuts = sorted(rng.sample(range(1, total), 3))
    entries = [(f"l{k}", "1", rng.randrange(1, 28), "in", hi - lo, rng.choice(["Acme", "Bolt"])) for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, total]))]
    plain = lambda rows: [Row(i, c, datetime.date(2022, 1, d), w, re.sub(r"\W+", "", w.lower())) for i, _, d, _, c, w in sorted(rows, key=lambda r: (r[2], rows.index(r)))]
    want = _plain_parts(plain(banks), plain(entries), 8)
    whole = (frozenset(b[0] for b in banks), frozenset(e[0] for e in entries))
    found = candidates.monthly_balances(_records(spark, banks), _records(spark, entries), each=8).collect()
    got = {(frozenset(r["banks"]), frozenset(r["ledgers"])) for r in found}
    assert got <= want | {whole} and len(got) == min(8, len(want | {whole})) > 2
    if len(want | {whole}) <= 8:
        assert got == want | {whole}


def test_consistency():
    assert consistency(["a", "b", "a"]) == 2 / 3 and consistency([]) == 0.0


def _pool(banks, entry, key, ok, most):
    met = [b for b in banks if b["month"] == entry["month"] and b["flow"] == entry["flow"] and (not b["account"] or not entry["account"] or b["account"] == entry["account"]) and ok(b)]
    return [b["id"] for b in sorted(met, key=key)[:most]]


@pytest.mark.parametrize("seed", [8, 9])
def test_pools_hold_what_comparing_all_pairs_finds(spark, seed):
    rng = random.Random(seed)
    who = ["Acme", "Acme 12", "Bolt", "Bolt 7 Acme", "Cord"]
    rows = lambda p, n, low, high: [dict(id=f"{p}{k}", ord=k, account=rng.choice(["", "1", "2"]), day=datetime.date(2022, 1, rng.randrange(1, 29)), month="2022-01", flow=rng.choice(["in", "out"]), cents=rng.randrange(low, high), counterparty_name=rng.choice(who), summary=rng.choice(["", "1.3-1.9", "1月", "手续费"]) if p == "l" else "") for k in range(n)]
    banks, entries = rows("b", 120, 1, 90), rows("l", 40, 20, 100)
    table = lambda part: spark.createDataFrame([(r["id"], r["ord"], r["account"], r["day"], r["month"], r["flow"], r["cents"], r["counterparty_name"], r["summary"], "", "", "", "", "") for r in part], COLUMNS)
    bank, ledger = table(banks), table(entries)
    said = lambda r: normalized(unique_joined([r["counterparty_name"], r["summary"]]))
    far = lambda b, g: abs((b["day"] - g["day"]).days)
    relaxed = {}
    for r in candidates.relaxed_pools(bank, ledger, 6).collect():
        relaxed.setdefault(r["anchor"], []).append((r["k"], r["id"]))
    want = {g["id"]: _pool(banks, g, lambda b, g=g: (-ratio(said(b), said(g)), far(b, g), -b["cents"], b["ord"]), lambda b, g=g: b["cents"] <= g["cents"] + 1, 6) for g in entries}
    assert {a: [i for _, i in sorted(v)] for a, v in relaxed.items()} == {a: v for a, v in want.items() if v}
    periods = {r["id"]: (r["first"], r["last"]) for r in candidates._dated(candidates.grouped_entries(ledger)).collect()}
    grouped = {}
    for r in candidates.grouped_pools(bank, ledger, 6).collect():
        grouped.setdefault(r["anchor"], []).append((r["k"], r["id"]))
    want = {}
    for g in entries:
        if g["id"] in periods:
            low, high = periods[g["id"]]
            key = lambda b, g=g: (-ratio(said(b), said(g)), abs(b["cents"] - g["cents"]), b["ord"])
            inside = _pool(banks, g, key, lambda b, low=low, high=high: low <= b["day"] <= high, 6)
            want[g["id"]] = inside or _pool(banks, g, key, lambda b: True, 6)
    assert {a: [i for _, i in sorted(v)] for a, v in grouped.items()} == {a: v for a, v in want.items() if v} and len(grouped) > 10
