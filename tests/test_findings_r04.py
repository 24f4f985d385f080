"""Findings of round 4, in small."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import candidates, pairs
from ledgerloom.sources import records


def _records(spark, rows):
    """(id, account, day of January, cents, counterparty) as records."""
    data = [(i, k, a, datetime.date(2022, 1, d), "2022-01", "in", c, who, *[""] * 5) for k, (i, a, d, c, who) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, ord long, account string, day date, month string, flow string, cents long, counterparty_name string, summary string, description string, subject string, voucher_no string, bank_name string")


def test_windows_are_told_level_by_level(spark, monkeypatch):
    r = random.Random(1)
    drawn = lambda p, n: [(f"{p}{k}", r.choice(["1", "2"]), r.randint(1, 9), r.randint(1, 3), r.choice(["Acme", "Bolt"])) for k in range(n)]
    bank, ledger = _records(spark, drawn("b", 150)), _records(spark, drawn("l", 150))
    placed = candidates._placed(bank)
    every = candidates.told_runs(placed, 2, 6).collect()
    for share, span in ((1.0, 0), (1.0, None), (0.6, 2)):
        some = candidates.told_runs(placed.withColumn("limit", F.lit(9)), 2, 6, share, span, "limit").collect()
        assert some and sorted(some) == sorted(x for x in every if x["consistency"] >= share and (span is None or x["end"] - x["start"] <= span) and x["total"] <= 9)
    made, write = [], candidates.materialise
    monkeypatch.setattr(candidates, "materialise", lambda df, tag: (made.append(write(df, tag)), made[-1])[1] if tag == "told-runs" else write(df, tag))
    got = candidates.window_groups(bank, ledger, bank_most=6, ledger_most=4, keep=20)
    want = candidates.measured(candidates.window_groups(bank, ledger, bank_most=6, ledger_most=4, keep=None), bank, ledger).orderBy(*[c for c in candidates.many_order() if "score" not in str(c)]).limit(20)
    assert [x["banks"] + x["ledgers"] for x in got.collect()] == [x["banks"] + x["ledgers"] for x in want.collect()]
    assert len(made) == 2 and made[0].count() + made[1].count() < len(every) / 2


def test_small_blocks_share_tasks(spark, tmp_path):
    """20,000 blocks of a file are read in few tasks, and a line over many blocks is looked through once."""
    (tmp_path / "book").mkdir()
    (tmp_path / "book" / "a.csv").write_text("".join(f"{k},xy\n" for k in range(30_000)) + "z" * 50_000 + "\n1,2\n")
    found = records.blocks(spark, str(tmp_path), block_bytes=16)
    assert found.count() > 10_000
    reader = records._BlockReader({"paths": f'["{tmp_path}"]', "blockbytes": "16"})
    assert len(reader.partitions()) == 1
    assert records._spread(found).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = records.read_cells(spark, str(tmp_path), block_bytes=16)
    assert got.count() == 30_002 and [r["cells"] for r in got.where("row_no in (7, 30000, 30002)").orderBy("row_no").collect()] == [["6", "xy"], ["29999", "xy"], ["1", "2"]]


def _dense(spark):
    r = random.Random(5)
    drawn = lambda p, n: [(f"{p}{k}", r.choice(["", "1", "2"]), r.randint(1, 4), r.choice([1, 2, 9, 10, 30]), r.choice(["Acme", "Acme 7", "Bolt"])) for k in range(n)]
    return _records(spark, drawn("b", 150)), _records(spark, drawn("l", 130))


def test_scores_of_cells_are_those_of_rows(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PIECE", 2)
    bank, ledger = _dense(spark)
    want = pairs.scored(pairs.pair_candidates(bank, ledger)).select("b_id", "l_id", "score")
    got = pairs.pair_scores(bank, ledger)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(b_ids") < plan.index("ratios(")  # rows are told after cells have met


@pytest.mark.parametrize("held", [1_000_000, 60, 0])
def test_one_to_one_of_cells_is_the_sequential_result(spark, monkeypatch, held):
    monkeypatch.setattr(pairs, "HELD", held)
    bank, ledger = _dense(spark)
    edges = pairs.scored(pairs.pair_candidates(bank, ledger)).select("score", "b_ord", "l_ord", "b_id", "l_id").where("score >= 0.58").collect()
    used, want = set(), []
    for e in sorted(edges, key=lambda e: (-e["score"], e["b_ord"], e["l_ord"])):
        if not {e["b_id"], e["l_id"]} & used:
            used |= {e["b_id"], e["l_id"]}
            want.append((e["b_id"], e["l_id"], e["score"]))
    made, write = [], pairs.materialise
    monkeypatch.setattr(pairs, "materialise", lambda df, tag: (made.append(tag), write(df, tag))[1])
    assert sorted(map(tuple, pairs.one_to_one(bank, ledger).collect())) == sorted(want) and len(want) > 50
    assert held < 1_000_000 or "pairs-edges" not in made


def test_manual_subsets_are_measured_where_they_are_found(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 9)
    r = random.Random(6)
    drawn = lambda p, n, high: [(f"{p}{k}", r.choice(["", "1", "2"]), r.randint(1, 28), r.randint(1, high), r.choice(["Acme", "Bolt", "Cord"])) for k in range(n)]
    bank, ledger = _records(spark, drawn("b", 90, 300)), _records(spark, drawn("l", 60, 900))
    found = candidates.manual_subsets(bank, ledger, pool=12, steps=1000)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython")[0].split("FlatMapGroupsInPandas")[0]
    near = candidates.measured(found.drop("score").withColumn("score", F.lit(0.0)), bank, ledger).select("cid", "banks", "ledgers", "banks_consistency", F.date_diff("banks_last", "banks_first").alias("span"), "ledgers_first")
    days = near.select("cid", F.explode("banks").alias("id"), "ledgers_first").join(bank.select("id", "day"), "id").groupBy("cid").agg(F.avg(F.abs(F.date_diff("day", "ledgers_first"))).alias("far"))
    want = near.join(days, "cid").select("banks", "ledgers", F.round(0.55 * F.col("banks_consistency") + 0.30 / (1 + F.col("far")) + 0.15 / (1 + F.col("span")), 4).alias("score"))
    got = found.select("banks", "ledgers", "score").collect()
    assert len(got) > 20 and sorted(map(str, got)) == sorted(map(str, want.collect()))
