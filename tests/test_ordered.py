"""Passes that go in order, against going through the rows one by one; and at a size that no single task could rank."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.subset import pair_score, subset_sum
from ledgerloom.operators import cleaning, layout, matching, review

COLUMNS = "id string, ord long, account string, day date, month string, flow string, cents long, counterparty_name string, summary string, description string, subject string, voucher_no string, bank_name string"


def _records(spark, rows):
    data = [(r["id"], r["ord"], r["account"], r["day"], r["day"].isoformat()[:7], r["flow"], r["cents"], r["who"], r["summary"], "", r.get("subject", ""), "", "") for r in rows]
    return spark.createDataFrame(data, COLUMNS)


def _rows(rng, side, n, low, high, summary="", subject="", accounts=("1", "2"), days=28):
    return [dict(id=f"{side}{k}", ord=k, account=rng.choice(accounts), day=datetime.date(2022, 1, rng.randrange(1, days + 1)), flow=rng.choice(["in", "out"]), cents=rng.randrange(low, high), who=rng.choice(["Acme", "Bolt"]), summary=summary, subject=subject) for k in range(n)]


def _fee_rule(banks, entries, tolerance=1):
    """Both rounds entry by entry: whole pool, then greedily by nearness, then the first subset."""
    used, done, out = set(), set(), set()
    for allowed in (lambda b: b["summary"] == "手续费", lambda b: not b["summary"].startswith("OBSS")):
        for g in entries:
            if g["id"] in done:
                continue
            pool = [b for b in banks if b["id"] not in used and allowed(b) and (b["account"], b["flow"]) == (g["account"], g["flow"])]
            pool = sorted(pool, key=lambda b: abs((b["day"] - g["day"]).days))[: matching.FEE_POOL]
            if len(pool) < 2:
                continue
            group, total = [], 0
            if abs(sum(b["cents"] for b in pool) - g["cents"]) <= tolerance:
                group = pool
            else:
                for b in pool:
                    if total + b["cents"] <= g["cents"] + tolerance:
                        group, total = [*group, b], total + b["cents"]
                        if abs(total - g["cents"]) <= tolerance and len(group) > 1:
                            break
                else:
                    group = [pool[k] for k in subset_sum([b["cents"] for b in pool], g["cents"], tolerance, 10)]
            if len(group) >= 2:
                used |= {b["id"] for b in group}
                done.add(g["id"])
                out.add((tuple(b["id"] for b in group), g["id"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fees_go_in_order(spark, monkeypatch, seed):
    monkeypatch.setattr(matching, "FEE_POOL", 5)  # lists run out, so that they have to grow
    rng = random.Random(seed)
    banks = _rows(rng, "b", 120, 5, 60, "手续费")
    for b in banks[::3]:
        b["summary"] = rng.choice(["OBSS x", "other"])
    entries = _rows(rng, "l", 30, 60, 200, "手续费")
    got = {(tuple(r["banks"]), r["ledgers"][0]) for r in matching.fee_groups(_records(spark, banks), _records(spark, entries)).collect()}
    want = _fee_rule(banks, entries)
    assert got == want and len(want) > 5


@pytest.mark.parametrize("seed", [3, 4])
def test_transfers_go_in_order(spark, seed):
    rng = random.Random(seed)
    banks = _rows(rng, "b", 90, 100, 106, accounts=("1", "2", "3"), days=12)
    entries = _rows(rng, "l", 70, 100, 106, "资金调拨", "银行存款", accounts=("1", "2", "3"), days=12)
    score = lambda b, g: pair_score(abs(b["cents"] - g["cents"]), abs((b["day"] - g["day"]).days), b["who"].lower(), (g["who"] + g["summary"] + g["subject"]).lower(), 1, 3)
    used, want = set(), set()
    for g in entries:
        free = [b for b in banks if b["id"] not in used and b["flow"] != g["flow"] and abs(b["cents"] - g["cents"]) <= 1 and abs((b["day"] - g["day"]).days) <= 3]
        cross, same = [b for b in free if b["account"] != g["account"]], [b for b in free if b["account"] == g["account"]]
        pick = min(cross, key=lambda b: (abs((b["day"] - g["day"]).days), -score(b, g))) if cross else same[0] if len(same) == 1 else None
        if pick:
            used.add(pick["id"])
            want.add((pick["id"], g["id"]))
    found = matching.transfers(_records(spark, banks), _records(spark, entries)).collect()
    assert {(r["banks"][0], r["ledgers"][0]) for r in found} == want and len(want) > 20
    assert all(r["score"] is not None for r in found)


def test_no_group_reaches_python_but_lists(spark):
    """A month of one account with 20,000 rows on either side: what a task sees is a list, and the pass ends."""
    n = 20_000
    side = lambda p, cents: spark.range(n).select(
        F.concat(F.lit(p), "id").alias("id"), F.col("id").alias("ord"), F.lit("1").alias("account"), F.date_add(F.lit("2022-01-01").cast("date"), (F.xxhash64("id", F.lit(p)) % 14 + 14).cast("int")).alias("day"),
        F.lit("2022-01").alias("month"), F.lit("in").alias("flow"), cents.cast("long").alias("cents"), F.element_at(F.array(*map(F.lit, ("Acme", "Bolt", "Cord"))), (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int")).alias("counterparty_name"),
        *[F.lit("").alias(c) for c in ("summary", "description", "subject", "voucher_no", "bank_name")],
    )
    banks, entries = side("b", 10_000_000 + F.col("id") * 977), side("l", 4_000_000 + F.col("id") * 463 + F.xxhash64("id") % 50)
    began = time.time()
    found = matching.group_passes(banks, entries, kinds=("one_to_many",), most=3).collect()
    assert time.time() - began < 600
    ids = [i for r in found for i in r["ledgers"]]
    assert len(ids) == len(set(ids))


def test_scores_of_groups(spark):
    rng = random.Random(6)
    from ledgerloom.functions.subset import group_score

    banks, entries = _rows(rng, "b", 30, 5, 60), _rows(rng, "l", 30, 5, 60)
    groups, want = [], {}
    for k in range(8):
        b, g = banks[3 * k : 3 * k + 1 + k % 3], entries[3 * k : 3 * k + 1 + k // 3]
        groups.append(([x["id"] for x in b], [x["id"] for x in g], None))
        plain = lambda xs: [matching.Member(x["id"], x["cents"], x["day"].toordinal(), x["who"]) for x in xs]
        want[groups[-1][0][0]] = group_score(plain(b), plain(g), 1, 30)
    df = spark.createDataFrame(groups, "banks array<string>, ledgers array<string>, score double")
    got = {r["banks"][0]: r["score"] for r in matching.group_scores(df, _records(spark, banks), _records(spark, entries)).collect()}
    assert got == pytest.approx(want, abs=1e-4)
    done = spark.createDataFrame([(["b1"], ["l1"], 0.5)], "banks array<string>, ledgers array<string>, score double")
    assert matching.group_scores(done, _records(spark, banks), _records(spark, entries)).first()["score"] == 0.5


def test_approvals_one_by_one(spark):
    rng = random.Random(9)
    banks, entries = _rows(rng, "b", 40, 10, 14, accounts=("", "1", "2")), _rows(rng, "l", 40, 10, 14, accounts=("", "1", "2"))
    byid = {r["id"]: r for r in banks + entries}
    rows = [(k, [f"b{rng.randrange(42)}"], [f"l{rng.randrange(42)}"], rng.choice([None, 0.3, 0.95])) for k in range(150)]
    held = [(["b0"], ["l0"], "M00012"), (["b1"], ["l1"], "x9")]
    used, status = {"b0", "l0", "b1", "l1"}, {}
    for k, b, g, _ in rows:
        if any(i not in byid or i in used for i in b + g) or abs(byid[b[0]]["cents"] - byid[g[0]]["cents"]) > 1:
            status[k] = "blocked_conflict_or_amount_diff"
        elif byid[b[0]]["flow"] != byid[g[0]]["flow"] or (byid[b[0]]["account"] and byid[g[0]]["account"] and byid[b[0]]["account"] != byid[g[0]]["account"]):
            status[k] = "blocked_cross_month_or_flow_account"
        else:
            status[k] = "approved_applied"
            used |= {*b, *g}
    approved = spark.createDataFrame(rows, "ord long, banks array<string>, ledgers array<string>, llm_confidence double")
    matches = spark.createDataFrame(held, "banks array<string>, ledgers array<string>, match_id string")
    out = review.apply_approvals(approved, _records(spark, banks), _records(spark, entries), matches=matches)
    assert {r["ord"]: r["status"] for r in out.review.collect()} == status and len(set(status.values())) == 3
    done = out.matches.orderBy("ord").collect()
    assert [r["match_id"] for r in done] == [f"M{k:05}" for k in range(13, 13 + len(done))] and all(r["score"] >= 0.75 for r in done)
    assert {r["id"] for r in out.unmatched_bank.collect()} == {b["id"] for b in banks} - {i for r in done for i in r["banks"]}
    none = review.apply_approvals(approved.where("false"), _records(spark, banks), _records(spark, entries))
    assert none.matches.count() == none.review.count() == 0


def test_numbers_of_matches(spark):
    matches = spark.createDataFrame([(k % 3, f"k{k}", 0.1 * (k % 4) if k % 5 else None) for k in range(40)], "pass int, match_key string, score double")
    got = {r["match_key"]: r["match_id"] for r in matching.numbered_matches(matches, 100).collect()}
    want = sorted(matches.collect(), key=lambda r: (r["pass"], -(r["score"] or 0.0), r["match_key"]))
    assert got == {r["match_key"]: f"M{k:05}" for k, r in enumerate(want, 101)}


def test_sheet_hints(spark):
    rows = [("f", s, k, 1, [w]) for k, (s, w) in enumerate([("a", " "), ("b", "date"), ("c", "x")])] + [("g", "a", 0, 1, [""]), ("g", "z", 1, 1, [None])]
    cells = spark.createDataFrame(rows, "source_file string, source_sheet string, sheet_ord int, row_no int, cells array<string>")
    told = lambda **x: {r["source_file"]: r["source_sheet"] for r in layout.select_sheet(cells, ["date"], **x).collect()}
    assert told() == {"f": "b", "g": "a"} and told(hint="c") == {"f": "c", "g": "a"}
    assert told(hint=1) == {"f": "b", "g": "z"} and told(hint="none") == {"f": "b", "g": "a"} and told(hint="a") == {"f": "a", "g": "a"}


def test_layouts_without_parsers(spark):
    cells = spark.createDataFrame([("f", "s", 1, ["a", "b", "a", "d"]), ("f", "s", 2, ["1"]), ("f", "t", 1, ["x"])], "source_file string, source_sheet string, row_no int, cells array<string>")
    rows, unknown = cleaning.apply_layouts(cells, "a string", {})
    assert rows.count() == 0 and [(r["source_sheet"], r["rows"]) for r in unknown.collect()] == [("s", 1)]
    signature = unknown.first()["signature"]
    rows, unknown = cleaning.apply_layouts(cells, "a string, b string", {signature: lambda frame: frame[["a", "b"]]})
    assert [tuple(r) for r in rows.collect()] == [("1", "")] and unknown.count() == 0
