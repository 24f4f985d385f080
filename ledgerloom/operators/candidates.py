"""Review candidates for what the rules leave: pairs, periods, subsets, time windows and monthly balances.

A candidate: match_type, banks, ledgers, bank_cents, ledger_cents, score, period_start, period_end.
"""

from __future__ import annotations

import datetime
from bisect import insort
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import counterparty_key, infer_period, join_unique_array, normalize_text
from ..functions.similarity import ratio, ratios, text_similarity
from ..functions.subset import consistency, normalized, pool_subsets, subset_sum, unique_joined
from .ordered import best_rows, universes
from .pairs import joined_by_bucket, pair_candidates, record_text
from .scratch import materialise

# Words and periods of entries that stand for several payments.
GROUP_WORDS = ("手续费", "银行代扣", "银行已扣费", "银行手续费", "食堂", "二维码", "POS", "商户", "社保", "医保", "税务", "税收", "汇缴")
GROUP_PERIODS = (r"\d{1,2}\s*[.月/]\s*\d{1,2}\s*(?:-|~|至|到|—)\s*\d{1,2}\s*[.月/]\s*\d{1,2}", r"\d{4}年\d{1,2}\s*月|\d{1,2}\s*月份")
_EPOCH = datetime.date(1970, 1, 1).toordinal()
COLUMNS = ["match_type", "banks", "ledgers", "bank_cents", "ledger_cents", "score", "period_start", "period_end"]
GROUP = "match_type string, banks array<string>, ledgers array<string>, bank_cents long, ledger_cents long, score double, period_start date, period_end date"


def looks_grouped(said) -> Column:
    """Whether a record's text names a period or one of the words."""
    said = said if isinstance(said, Column) else F.col(said)
    words = [F.lower(said).contains(w.lower()) for w in GROUP_WORDS]
    return reduce(lambda a, b: a | b, [*words, *[said.rlike(p) for p in GROUP_PERIODS]])


def _members(groups: DataFrame, records: DataFrame, ids: str) -> DataFrame:
    """Per group ``cid`` of one side: texts joined, first, last and mean day, rows, and the largest share of a counterparty."""
    rows = groups.select("cid", F.posexplode(ids).alias("pos", "id")).join(records.select("id", "day", record_text(records).alias("said"), counterparty_key("counterparty_name", "summary").alias("cp")), "id")
    told = F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"])
    out = rows.groupBy("cid").agg(
        join_unique_array(told).alias("said"), F.min("day").alias("first"), F.max("day").alias("last"), F.avg(F.unix_date("day")).alias("centre"), F.count(F.lit(1)).alias("n"), F.collect_list("cp").alias("cps"),
    )
    shares = F.transform(F.array_distinct("cps"), lambda c: F.size(F.filter("cps", lambda x: x == c)))
    named = out.withColumn("consistency", F.array_max(shares) / F.size("cps")).drop("cps")
    return named.select("cid", *[F.col(c).alias(f"{ids}_{c}") for c in named.columns if c != "cid"])


def measured(groups: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds what the scores of groups are made of: similarity, consistency, span in days, gap of the mean days, members, exact."""
    keyed = materialise(groups.withColumn("cid", F.monotonically_increasing_id()), "groups")
    both = keyed.join(_members(keyed, bank, "banks"), "cid").join(_members(keyed, ledger, "ledgers"), "cid")
    return both.withColumns({
        "similarity": text_similarity("banks_said", "ledgers_said"), "consistency": F.least("banks_consistency", "ledgers_consistency"),
        "span": F.date_diff(F.greatest("banks_last", "ledgers_last"), F.least("banks_first", "ledgers_first")),
        "gap": F.abs(F.col("banks_centre") - F.col("ledgers_centre")), "members": F.col("banks_n") + F.col("ledgers_n"),
        "exact": (F.abs(F.col("bank_cents") - F.col("ledger_cents")) <= 1).cast("int"),
    })


def heuristic_score() -> Column:
    return F.round(0.7 * F.col("exact") + 0.3 * F.col("similarity"), 4)


def many_score() -> Column:
    return F.round(0.65 * F.col("consistency") + 0.25 / (1 + F.col("span")) + 0.10 / (1 + F.col("members")), 4)


def balance_score() -> Column:
    amount = F.when(F.col("bank_cents") == F.col("ledger_cents"), 1.0).otherwise(0.98)
    return F.round(0.45 * amount + 0.25 * F.col("similarity") + 0.20 * F.col("consistency") + 0.10 / (1 + F.col("span")), 4)


def scored_groups(groups: DataFrame, bank: DataFrame, ledger: DataFrame, score: Column) -> DataFrame:
    return measured(groups, bank, ledger).withColumn("score", score).select(*COLUMNS)


def exact_pairs(bank: DataFrame, ledger: DataFrame, tolerance: int = 1, window: int = 45, most: int = 8) -> DataFrame:
    """Same bucket, equal amounts, days within the entry's period and ``window``: the first ``most`` banks of each entry.

    Bank rows that agree in month, flow, account and amount suit the same entries, so of them only the first ``most`` count;
    they are listed for each amount that an entry may have, and entries meet lists, not rows.
    """
    slim = lambda d, *more: d.select("id", "ord", "month", "flow", "account", "cents", "day", normalize_text(record_text(d)).alias("said"), *more)
    bank, ledger = slim(bank), slim(_dated(ledger), "first", "last")
    alike = ["month", "flow", "account", "cents"]
    cut = lambda d, key: d.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("ord", "id"))).where(F.col("_k") <= most).drop("_k")
    if window < 31:  # else all days of a month are in reach
        edges = _in_reach(pair_candidates(cut(bank, [*alike, "day"]), ledger, tolerance, 31), window)
        ranked = edges.withColumn("_k", F.row_number().over(Window.partitionBy("l_id").orderBy("b_ord", "b_id"))).where(F.col("_k") <= most)
    else:
        met = universes(ledger, cut(bank, alike), ["month", "flow", "account"], "account")
        near = met.withColumn("at", F.explode(F.sequence(F.col("cents") - tolerance, F.col("cents") + tolerance)))
        key = ["month", "flow", "account", "at"]
        listed = F.slice(F.array_sort(F.collect_list(F.struct("ord", "id", "cents", "day", "said"))), 1, most)
        lists = cut(near, key).groupBy(*key).agg(listed.alias("b"))
        entries = ledger.select("month", "flow", "account", F.col("cents").alias("at"), *[F.col(c).alias(f"l_{c}") for c in ("id", "cents", "day", "said")])
        pairs = entries.join(lists, key).select("l_id", "l_cents", "l_day", "l_said", F.explode("b").alias("b"))
        ranked = pairs.select("*", *[F.col(f"b.{c}").alias(f"b_{c}") for c in ("id", "cents", "day", "said")])
    same = (F.abs(F.col("b_cents") - F.col("l_cents")) <= 1).cast("int")
    score = F.round(0.7 * same + 0.3 * ratios(F.col("b_said"), F.col("l_said")), 4)
    return ranked.select(
        F.lit("one_to_one").alias("match_type"), F.array("b_id").alias("banks"), F.array("l_id").alias("ledgers"), F.col("b_cents").alias("bank_cents"), F.col("l_cents").alias("ledger_cents"),
        score.alias("score"), F.least("b_day", "l_day").alias("period_start"), F.greatest("b_day", "l_day").alias("period_end"),
    )


def _dated(ledger: DataFrame) -> DataFrame:
    """Adds the period that an entry's text tells: first, last."""
    return ledger.withColumn("p", infer_period("summary", "day")).withColumns({"first": F.col("p.start"), "last": F.col("p.end")}).drop("p")


def _in_reach(pairs: DataFrame, window: int) -> DataFrame:
    low, high = F.least("l_first", F.date_sub("l_day", window)), F.greatest("l_last", F.date_add("l_day", window))
    return pairs.where(F.col("b_day").between(low, high))


def _pools(bank: DataFrame, ledger: DataFrame, window: int = 45) -> DataFrame:
    """Bank rows of the bucket and reach of each entry; ``inside`` marks those in its period. One bucket's rows at most, entry by entry."""
    slim = lambda d, *more: d.select("id", "ord", "month", "flow", "account", "cents", "day", *more)
    dated = materialise(slim(_dated(ledger), "first", "last"), "dated-entries")
    met = _in_reach(joined_by_bucket(slim(bank), dated, [("month", "month"), ("flow", "flow")]), window)
    return met.withColumn("inside", F.col("b_day").between(F.col("l_first"), F.col("l_last")))


def grouped_entries(ledger: DataFrame) -> DataFrame:
    return ledger.where(looks_grouped(record_text(ledger)))


def _whole_periods(bank: DataFrame, ledger: DataFrame, tolerance: int = 1, most: int = 120) -> DataFrame:
    """The groups of :func:`period_groups`, not scored. Sums first: only the entries that agree gather their rows."""
    pool = _pools(bank, grouped_entries(ledger)).where("inside")
    sums = pool.groupBy("l_id").agg(F.count(F.lit(1)).alias("n"), F.sum("b_cents").alias("total"), F.first("l_cents").alias("want"))
    hits = sums.where((F.col("n") > 1) & (F.col("n") <= most) & (F.abs(F.col("total") - F.col("want")) <= tolerance)).select("l_id")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("b_ord", "b_id"))), lambda x: x["b_id"])
    firsts = [F.first(c).alias(n) for c, n in (("l_cents", "ledger_cents"), ("l_first", "period_start"), ("l_last", "period_end"))]
    out = pool.join(hits, "l_id").groupBy("l_id").agg(ids.alias("banks"), F.sum("b_cents").alias("bank_cents"), *firsts)
    return out.select(F.lit("many_to_one").alias("match_type"), "banks", F.array("l_id").alias("ledgers"), "bank_cents", "ledger_cents", F.lit(None).cast("double").alias("score"), "period_start", "period_end")


def period_groups(bank: DataFrame, ledger: DataFrame, tolerance: int = 1, most: int = 120) -> DataFrame:
    """Entries that look grouped against all bank rows of their period, if the totals agree."""
    return scored_groups(_whole_periods(bank, ledger, tolerance, most), bank, ledger, heuristic_score())


#: Rows of a bucket, in the order of their amounts, that one task goes through.
BLOCK = 2000
_FIELDS = ["cents", "day", "ord", "id", "cp"]
_ROW = "cents long, day int, ord long, id string, cp string"


def _earliest_subsets(bank: DataFrame, ledger: DataFrame, bucket: list[str], window: int, pool: int, tolerance: int, most: int, steps: int, kind: str) -> DataFrame:
    """For each entry the first subset that sums to it of the ``pool`` earliest rows of its bucket that are no larger than it,
    with its largest share of a counterparty, its mean distance to the entry and its span, in days: shared, far, span.

    Along rising amounts a row is only ever added to what may be chosen, so the earliest ``pool`` rows go along and entries
    never meet rows one by one. Blocks of :data:`BLOCK` rows are gone through in a task each, with the earliest rows of the
    blocks before them, which come from the earliest rows of each block. A blank account goes with all accounts.
    """
    slim = lambda d: d.select(*bucket, "cents", F.unix_date("day").alias("day"), "ord", "id", counterparty_key("counterparty_name", "summary").alias("cp"))
    entries, rows = slim(ledger), slim(bank)
    if window < 31:  # within a month all days are nearer than that: else what an entry may take depends on its day
        entries = entries.withColumn("a_day", F.col("day"))
        days = entries.select(*bucket, "a_day").distinct()
        met = universes(entries, rows, bucket, "account").join(days, bucket).where(F.abs(F.col("day") - F.col("a_day")) <= window)
        bucket = [*bucket, "a_day"]
    else:
        met = universes(entries, rows, bucket, "account")
    rows = met.select(*bucket, F.col("cents").alias("at"), F.lit(0).alias("entry"), *_FIELDS)
    marks = rows.unionByName(entries.select(*bucket, (F.col("cents") + tolerance).alias("at"), F.lit(1).alias("entry"), *_FIELDS))
    along = Window.partitionBy(*bucket).orderBy("at", "entry", "day", "ord", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.withColumns({"upto": F.sum(1 - F.col("entry")).over(along), "turn": F.sum("entry").over(along)}).where("upto > entry")
    placed = placed.withColumns({"block": F.floor((F.col("upto") - 1) / BLOCK), "part": F.floor((F.col("turn") - F.col("entry")) / BLOCK)})
    placed = materialise(placed.drop("upto", "turn"), "subset-rows")
    rows, entries = placed.where("entry = 0").drop("part"), placed.where("entry = 1")
    first = F.row_number().over(Window.partitionBy(*bucket, "block").orderBy("day", "ord", "id"))
    tops = rows.withColumn("_k", first).where(F.col("_k") <= pool).select(*bucket, "block", *_FIELDS)
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema if f.name in bucket}

    def carry(group: pd.DataFrame) -> pd.DataFrame:
        """What each block but the first gets from those before it."""
        before: list[tuple] = []
        out = []
        for block, some in group.groupby("block", sort=True):
            out += [(block, *r) for r in before]
            before = sorted([*before, *((r.cents, r.day, r.ord, r.id, r.cp) for r in some.itertuples(index=False))], key=lambda r: r[1:])[:pool]
        told = pd.DataFrame(out, columns=["block", *_FIELDS])
        return told.assign(**{c: group[c].iloc[0] for c in bucket})

    before = tops.groupBy(*bucket).applyInPandas(carry, ", ".join(f"{c} {t}" for c, t in kinds.items()) + f", block long, {_ROW}")
    parts = entries.select(*bucket, "block", "part").distinct()
    known = rows.select(*bucket, "block", "at", "entry", *_FIELDS).unionByName(before.select(*bucket, "block", F.lit(0).cast("long").alias("at"), F.lit(0).alias("entry"), *_FIELDS))
    both = known.join(parts, [*bucket, "block"]).select(*placed.columns).unionByName(entries)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        near: list[tuple] = []  # the earliest rows so far: day, ord, id, cents, cp
        out, last, found = [], None, []
        for r in group.sort_values(["at", "entry", "day", "ord", "id"]).itertuples(index=False):
            if not r.entry:
                row = (r.day, r.ord, r.id, r.cents, r.cp)
                if len(near) < pool or row < near[-1]:
                    insort(near, row)
                    del near[pool:]
                    last = None
                continue
            if last != r.cents:
                last, found = r.cents, [near[p] for p in subset_sum([b[3] for b in near], r.cents, tolerance, most, 2, steps)]
            if found:
                days = [b[0] for b in found]
                low, high = min(days), max(days)
                told = consistency([b[4] for b in found]), sum(abs(d - r.day) for d in days) / len(days), high - low
                ends = (datetime.date.fromordinal(_EPOCH + d) for d in (low, high))
                out.append((kind, [b[2] for b in found], [r.id], sum(b[3] for b in found), r.cents, None, *ends, *told))
        return pd.DataFrame(out, columns=[*COLUMNS, "shared", "far", "span"])

    return both.groupBy(*bucket, "block", "part").applyInPandas(run, f"{GROUP}, shared double, far double, span int")


def _told(records: DataFrame) -> DataFrame:
    """What pools need of records: texts normalised once a record, days as numbers."""
    said = normalize_text(record_text(records)).alias("said")
    extra = [c for c in ("first", "last") if c in records.columns]
    days = [F.unix_date(c).alias(c) for c in ("day", *extra)]
    return records.select("month", "flow", "account", "id", "ord", "cents", said, *days, F.lit("").alias("label"))


def _first_of_lists(lists: DataFrame, tolerance: int, most: int, steps: int, kind: str) -> DataFrame:
    """For each anchor the first subset of its list that sums to it, as a candidate."""
    pools = lists.groupBy("anchor").agg(F.first("a_cents").alias("cents"), F.array_sort(F.collect_list(F.struct("k", "id", "cents", "day"))).alias("near"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g in batch.itertuples(index=False):
                found = [g.near[p] for p in subset_sum([int(b["cents"]) for b in g.near], int(g.cents), tolerance, most, 2, steps)]
                if found:
                    days = [datetime.date.fromordinal(_EPOCH + int(b["day"])) for b in found]
                    out.append((kind, [b["id"] for b in found], [g.anchor], sum(int(b["cents"]) for b in found), int(g.cents), None, min(days), max(days)))
            yield pd.DataFrame(out, columns=COLUMNS)

    return pools.mapInPandas(run, GROUP)


def grouped_pools(bank: DataFrame, ledger: DataFrame, pool: int = 22, window: int = 45) -> DataFrame:
    """The ``pool`` bank rows of the period (of the reach, if the period has none) of each entry that looks grouped, the most
    alike first, then the nearest amount. Texts are compared once for each text of entries and each of bank rows."""
    entries = _told(_dated(grouped_entries(ledger)))

    def within(met: DataFrame) -> DataFrame:
        reach = F.col("day").between(F.least("a_first", F.col("a_day") - window), F.greatest("a_last", F.col("a_day") + window))
        inside = F.col("day").between(F.col("a_first"), F.col("a_last"))
        has = F.max(inside).over(Window.partitionBy("class"))
        return met.where(reach).withColumn("_has", has).where(inside | ~F.col("_has"))

    return best_rows(entries, _told(bank), ["month", "flow", "account"], ["said", "day"], lambda d: ratios(d["a_said"], d["said"]), pool, wild="account", own=("first", "last"), within=within)


def _period_subsets(bank: DataFrame, ledger: DataFrame, tolerance: int = 1, pool: int = 22, most: int = 40, steps: int = 100_000) -> DataFrame:
    """The groups of :func:`grouped_subsets`, not scored."""
    return _first_of_lists(grouped_pools(bank, ledger, pool), tolerance, most, steps, "many_to_one")


def grouped_subsets(bank: DataFrame, ledger: DataFrame, tolerance: int = 1, pool: int = 22, most: int = 40, steps: int = 100_000) -> DataFrame:
    """Entries that look grouped against a subset of the bank rows of their period (of their reach, if the period has none), the most alike first."""
    return scored_groups(_period_subsets(bank, ledger, tolerance, pool, most, steps), bank, ledger, heuristic_score())


def relaxed_pools(bank: DataFrame, ledger: DataFrame, pool: int = 32, tolerance: int = 1, window: int = 90) -> DataFrame:
    """The ``pool`` bank rows of each entry that are no larger than it, the most alike first, then the nearest day, then the largest."""
    # A likeness is a fraction of two lengths, so a day, a billionth, never outweighs one.
    rank = lambda d: ratios(d["a_said"], d["said"]) - F.abs(d["day"] - d["a_day"]) * 1e-9
    return best_rows(_told(ledger), _told(bank), ["month", "flow", "account"], ["said", "day"], rank, pool, wild="account", days=window, below=tolerance)


def _relaxed_subsets(bank: DataFrame, ledger: DataFrame, tolerance: int = 1, window: int = 90, pool: int = 32, most: int = 10, steps: int = 200_000) -> DataFrame:
    """The groups of :func:`subset_groups`, not scored."""
    lists = relaxed_pools(bank, ledger, pool, tolerance, window)
    return _first_of_lists(lists, tolerance, most, steps, "amount_group_many_to_one")


def subset_groups(bank: DataFrame, ledger: DataFrame, tolerance: int = 1, window: int = 90, pool: int = 32, most: int = 10, steps: int = 200_000) -> DataFrame:
    """Each entry against a subset of its ``pool`` smaller bank rows that are most alike, then nearest in time, then largest."""
    return scored_groups(_relaxed_subsets(bank, ledger, tolerance, window, pool, most, steps), bank, ledger, heuristic_score())


def manual_subsets(bank: DataFrame, ledger: DataFrame, tolerance: int = 1, window: int = 365, pool: int = 80, most: int = 60, steps: int = 100_000, same_flow: bool = True) -> DataFrame:
    """Each entry against a subset of the ``pool`` earliest smaller bank rows of its month and account (and flow, if asked for)."""
    bucket = ["month", "flow", "account"] if same_flow else ["month", "account"]
    groups = _earliest_subsets(bank, ledger, bucket, window, pool, tolerance, most, steps, "manual_time_window_many_to_one")
    score = F.round(0.55 * F.col("shared") + 0.30 / (1 + F.col("far")) + 0.15 / (1 + F.col("span")), 4)
    return groups.withColumn("score", score).select(*COLUMNS)


def runs(df: DataFrame, least: int, most: int, limit: str | None = None) -> DataFrame:
    """Runs of ``least`` to ``most`` rows that follow each other in a bucket (account, month, flow) by day and order:
    first and last place and the sum, from running sums; members are not copied. Rows grow by ``most`` per row, or by as
    many runs as have a sum up to that of column ``limit``; each row sees the sums behind it, so runs are not moved."""
    key = ["account", "month", "flow"]
    along = Window.partitionBy(*key).orderBy("day", "ord")
    own = [] if limit is None else [limit]
    placed = df.select(*key, *own, "day", "ord", F.row_number().over(along).alias("pos"), F.sum("cents").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "cents")
    behind = F.collect_list(F.struct(F.col("pos").alias("last"), F.col("upto"), F.col("day").alias("period_end"))).over(along.rowsBetween(least - 1, most - 1))
    before = F.col("upto") - F.col("cents")
    starts = placed.select(*key, F.col("pos").alias("first"), before.alias("before"), F.col("day").alias("period_start"), *own, behind.alias("ends"))
    ends = F.col("ends") if limit is None else F.filter("ends", lambda x: x["upto"] - F.col("before") <= F.col(limit))
    spread = starts.select(*key, "first", "before", "period_start", F.explode(ends).alias("e"))
    return spread.select(*key, "first", "e.last", (F.col("e.upto") - F.col("before")).alias("total"), "period_start", "e.period_end")


def _told_members(df: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs with the ids of their members and the largest share of a counterparty."""
    key = ["account", "month", "flow"]
    said = counterparty_key("counterparty_name", "summary").alias("cp")
    placed = df.select(*key, "id", said, F.row_number().over(Window.partitionBy(*key).orderBy("day", "ord")).alias("pos"))
    rows = spans.select(*key, "first", "last", F.explode(F.sequence("first", "last")).alias("pos")).join(placed, [*key, "pos"])
    told = rows.groupBy(*key, "first", "last").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("ids"), F.collect_list("cp").alias("cps"))
    shares = F.transform(F.array_distinct("cps"), lambda c: F.size(F.filter("cps", lambda x: x == c)))
    told = told.select(*key, "first", "last", F.transform("ids", lambda x: x["id"]).alias("ids"), (F.array_max(shares) / F.size("cps")).alias("consistency"))
    return spans.join(told, [*key, "first", "last"])


def _all_windows(bank: DataFrame, ledger: DataFrame, tolerance: int, bank_most: int, ledger_least: int, ledger_most: int, kind: str) -> DataFrame:
    """All pairs of runs with equal totals. Runs larger than any of the other side's are never made, members are joined to
    the runs that meet any, and runs with their members meet last, so no pair is moved."""
    key = ["account", "month", "flow"]
    g = materialise(runs(ledger, ledger_least, ledger_most), "ledger-runs")
    top = g.groupBy(*key).agg((F.max("total") + tolerance).alias("limit"))
    near = g.withColumn("sum", F.explode(F.sequence(F.col("total") - tolerance, F.col("total") + tolerance)))
    b = runs(bank.join(top, key), 2, bank_most, "limit").withColumn("sum", F.col("total"))
    b = materialise(b.join(near.select(*key, "sum"), [*key, "sum"], "left_semi"), "bank-runs")
    near = materialise(near.join(b.select(*key, "sum").distinct(), [*key, "sum"], "left_semi"), "ledger-sums")
    sides = []
    for d, spans, p in ((bank, b, "banks"), (ledger, near, "ledgers")):
        whole = _told_members(d, spans.drop("sum").distinct() if p == "ledgers" else spans.drop("sum"))
        at = F.col("total") if p == "banks" else F.explode(F.sequence(F.col("total") - tolerance, F.col("total") + tolerance))
        sides.append(whole.select(*key, at.alias("sum"), *[F.col(c).alias(f"{p}_{c}") for c in whole.columns if c not in key]))
    met = sides[0].join(sides[1], [*key, "sum"]).withColumns({
        "period_start": F.least("banks_period_start", "ledgers_period_start"), "period_end": F.greatest("banks_period_end", "ledgers_period_end"),
        "consistency": F.least("banks_consistency", "ledgers_consistency"), "members": F.size("banks_ids") + F.size("ledgers_ids"),
    }).withColumn("span", F.date_diff("period_end", "period_start"))
    return met.select(
        F.lit(kind).alias("match_type"), F.col("banks_ids").alias("banks"), F.col("ledgers_ids").alias("ledgers"), F.col("banks_total").alias("bank_cents"), F.col("ledgers_total").alias("ledger_cents"),
        many_score().alias("score"), "period_start", "period_end",
    )


def _run_members(placed: DataFrame, spans: DataFrame, ids: str) -> DataFrame:
    key = ["account", "month", "flow"]
    wanted = spans.select("wid", *key, F.explode(F.sequence(f"{ids}_first", f"{ids}_last")).alias("pos"))
    return wanted.join(placed.select(*key, "pos", "id"), [*key, "pos"]).groupBy("wid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias(ids))


#: Places of a bucket whose runs are told in one task.
STRETCH = 1000


#: Least share of one counterparty and most days between first and last record of the pairs of runs that are looked for,
#: in turn until there are enough of them: the best pairs rank by just these two first.
LEVELS = ((1.0, 0), (1.0, None), (0.0, None))


def _placed(df: DataFrame) -> DataFrame:
    """Rows with their place in their bucket: account, month, flow, id, cents, at (the day), cp, pos."""
    key = ["account", "month", "flow"]
    said = counterparty_key("counterparty_name", "summary").alias("cp")
    return df.select(*key, "id", "cents", F.unix_date("day").cast("long").alias("at"), said, F.row_number().over(Window.partitionBy(*key).orderBy("day", "ord")).alias("pos"))


def told_runs(placed: DataFrame, least: int, most: int, share: float = 0.0, span: int | None = None, limit: str | None = None) -> DataFrame:
    """The runs of :func:`runs` among placed rows with what ranks groups of them: account, month, flow, first, n, total, start, end, days (sum),
    consistency, and ``name``, the first id, which sorts like the ids joined by ``|``. Only those of at least ``share``
    consistency, within ``span`` days and with a total up to that of column ``limit``; runs that cannot get there are not gone on with.

    Stretches of a bucket, with what the last runs reach into, are told in a task each, member by member.
    """
    key = ["account", "month", "flow"]
    placed = placed.withColumn("top_sum", F.lit(None).cast("long") if limit is None else F.col(limit))
    stretch = F.floor((F.col("pos") - 1) / STRETCH)
    # A row also belongs to the stretch before, if runs that begin there reach it.
    late = (F.col("pos") - 1) % STRETCH < most - 1
    dealt = placed.withColumn("stretch", F.explode(F.when(late & (stretch > 0), F.array(stretch - 1, stretch)).otherwise(F.array(stretch))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group.sort_values("pos").itertuples(index=False))
        out, end = [], (rows[0].stretch + 1) * STRETCH
        wide = float("inf") if span is None else span
        high = float("inf") if limit is None else int(rows[0].top_sum)
        for k, first in enumerate(rows):
            if first.pos > end:
                break
            counts: dict[str, int] = {}
            total = days = top = 0
            for n in range(1, min(most, len(rows) - k) + 1):
                r = rows[k + n - 1]
                total, days = total + r.cents, days + r.at
                counts[r.cp] = counts.get(r.cp, 0) + 1
                top = max(top, counts[r.cp])
                if total > high or r.at - first.at > wide or top + most - n < share * most:
                    break
                if n >= least and top / n >= share:
                    out.append((first.pos, n, total, first.at, r.at, days, top / n, first.id + "|" * (n > 1)))
        told = pd.DataFrame(out, columns=["first", "n", "total", "start", "end", "days", "consistency", "name"])
        return told.assign(**{c: rows[0]._asdict()[c] for c in key})

    schema = "first long, n long, total long, start long, end long, days long, consistency double, name string, account string, month string, flow string"
    return dealt.groupBy(*key, "stretch").applyInPandas(run, schema)


def _best_windows(b: DataFrame, g: DataFrame, tolerance: int, keep: int) -> DataFrame:
    """The ``keep`` best pairs of told runs with equal totals: account, month, flow, and first and n of either side.

    Runs that agree in all that ranks them are a class, and classes meet, not runs: of the ``keep`` best pairs of classes, by
    their ranks and first names, the first runs are all that can be among the best.
    """
    key = ["account", "month", "flow"]
    same = [*key, "total", "n", "start", "end", "days", "consistency"]
    classes = [materialise(d.groupBy(*same).agg(F.min("name").alias("name")), "run-classes") for d in (b, g)]
    one = classes[0].select(*key, *[F.col(c).alias(f"b_{c}") for c in (*same[3:], "name")], F.col("total").alias("sum"))
    spread = F.explode(F.sequence(F.col("total") - tolerance, F.col("total") + tolerance))
    two = classes[1].select(*key, *[F.col(c).alias(f"l_{c}") for c in (*same[3:], "name")], spread.alias("sum"))
    rank = [
        F.desc(F.least("b_consistency", "l_consistency")), F.asc(F.greatest("b_end", "l_end") - F.least("b_start", "l_start")),
        F.asc(F.abs(F.col("b_days") / F.col("b_n") - F.col("l_days") / F.col("l_n"))), F.asc(F.col("b_n") + F.col("l_n")), F.asc("b_name"), F.asc("b_n"), F.asc("l_name"), F.asc("l_n"),
    ]
    best = materialise(one.join(two, [*key, "sum"]).orderBy(*rank).limit(keep), "best-classes")

    def firsts(d: DataFrame, p: str) -> DataFrame:
        wanted = best.select(*key, *[F.col(f"{p}_{c}").alias(c) for c in same[3:]]).distinct()
        place = F.row_number().over(Window.partitionBy(*same).orderBy("name"))
        few = d.join(F.broadcast(wanted), same, "left_semi").withColumn("_k", place).where(F.col("_k") <= keep)  # ``keep`` classes
        return few.select(*key, *[F.col(c).alias(f"{p}_{c}") for c in (*same[3:], "name", "first")])

    pairs = best.drop("b_name", "l_name", "sum").join(firsts(b, "b"), [*key, *[f"b_{c}" for c in same[3:]]]).join(firsts(g, "l"), [*key, *[f"l_{c}" for c in same[3:]]])
    return pairs.orderBy(*rank).limit(keep)


def window_groups(bank: DataFrame, ledger: DataFrame, tolerance: int = 1, bank_most: int = 80, ledger_least: int = 2, ledger_most: int = 12, keep: int | None = 50) -> DataFrame:
    """Runs of bank rows against runs of entries of the same bucket with equal totals; the ``keep`` best of the job: one
    counterparty first, then the shortest span, the nearest means, the fewest members; all without ``keep``.

    With ``keep``, runs that rank alike meet as one, so a bucket of equal amounts does not meet itself run by run, and runs
    are told level by level (:data:`LEVELS`): pairs of a level rank before all others, so once a level has ``keep`` of them
    no other run is made. With ``ledger_least`` = ``ledger_most`` = 1 these are runs against single entries.
    """
    key = ["account", "month", "flow"]
    shared = lambda b, g: b.select(*key).distinct().join(g.select(*key).distinct(), key)
    kind = "manual_time_window_many_to_many" if ledger_most > 1 else "contiguous_many_to_one"
    if keep is None:
        bank, ledger = (d.join(shared(bank, ledger), key, "left_semi") for d in (bank, ledger))
        return _all_windows(bank, ledger, tolerance, bank_most, ledger_least, ledger_most, kind)
    banks, entries = (materialise(_placed(d), "placed") for d in (bank, ledger))
    both = materialise(shared(banks, entries), "buckets")
    for share, span in LEVELS:
        g = materialise(told_runs(entries.join(both, key, "left_semi"), ledger_least, ledger_most, share, span), "told-runs")
        top = g.groupBy(*key).agg((F.max("total") + tolerance).alias("limit"))
        b = materialise(told_runs(banks.join(top, key), 2, bank_most, share, span, "limit"), "told-runs")
        met = materialise(_best_windows(b, g, tolerance, keep), "best-windows")
        apart = F.greatest("b_end", "l_end") - F.least("b_start", "l_start")
        if (share, span) == LEVELS[-1] or met.where(apart <= span if span is not None else F.lit(True)).count() == keep:
            break
    met = met.select(
        *key, *[x for p, s in (("b", "banks"), ("l", "ledgers")) for x in (F.col(f"{p}_first").alias(f"{s}_first"), (F.col(f"{p}_first") + F.col(f"{p}_n") - 1).alias(f"{s}_last"), F.col(f"{p}_total").alias(f"{s}_total"))],
        F.date_from_unix_date(F.least("b_start", "l_start").cast("int")).alias("start"), F.date_from_unix_date(F.greatest("b_end", "l_end").cast("int")).alias("end"),
    )
    met = materialise(met.withColumn("wid", F.monotonically_increasing_id()), "windows")
    groups = met.join(_run_members(banks, met, "banks"), "wid").join(_run_members(entries, met, "ledgers"), "wid").select(
        F.lit(kind).alias("match_type"), "banks", "ledgers", F.col("banks_total").alias("bank_cents"), F.col("ledgers_total").alias("ledger_cents"), F.lit(None).cast("double").alias("score"), F.col("start").alias("period_start"), F.col("end").alias("period_end"),
    )
    out = measured(groups, bank, ledger).withColumn("score", many_score())
    return out.orderBy(*many_order()).limit(keep).select(*COLUMNS)  # a feature: the best `keep`


def many_order() -> list[Column]:
    """Groups of both sides, best first."""
    return [F.desc("consistency"), F.asc("span"), F.asc("gap"), F.asc("members"), F.desc("score"), F.asc(F.concat_ws("|", "banks")), F.asc(F.concat_ws("|", "ledgers"))]


def entry_runs(entries: list, longest: int = 8, most: int = 180) -> list[list]:
    """The first ``most`` runs of up to ``longest`` entries, those of one counterparty first, then the fewest members, the
    fewest days, the largest sum. Entries have cp, day and cents."""
    found = [entries[at : at + n] for at in range(len(entries)) for n in range(1, min(longest, len(entries) - at) + 1)][:most]
    rank = lambda es: (consistency([e.cp for e in es]), -len(es), -(max(e.day for e in es) - min(e.day for e in es)).days, sum(e.cents for e in es))
    return sorted(found, key=rank, reverse=True)


def bank_subsets(banks: list, entries: list, tolerance: int, results: int, most: int = 40, steps: int = 200_000) -> list[list]:
    """Up to ``results`` subsets of the bank rows that sum to the entries, the first that the search finds, best first.

    The pool is ranked by similarity to the entries' text, nearness to their mean day, agreement of counterparties and the
    smaller amount; subsets by similarity, counterparties, span and members.
    """
    target = sum(e.cents for e in entries)
    told = normalized(unique_joined(e.said for e in entries))
    centre = sum(e.day.toordinal() for e in entries) / len(entries)
    cps = [e.cp for e in entries]
    pool = [b for b in banks if 0 < b.cents <= target + tolerance]
    pool = sorted(pool, key=lambda b: (ratio(normalized(b.said), told), -abs(b.day.toordinal() - centre), consistency([b.cp, *cps]), -b.cents), reverse=True)
    found, _ = pool_subsets([b.cents for b in pool], target, tolerance, most, results, steps)

    def rank(bs: list) -> tuple:
        days = [r.day for r in (*bs, *entries)]
        alike = ratio(normalized(unique_joined(b.said for b in bs)), told)
        return alike, min(consistency([b.cp for b in bs]), consistency(cps)), -(max(days) - min(days)).days, -(len(bs) + len(entries))

    return sorted(([pool[k] for k in places] for places in found), key=rank, reverse=True)


def monthly_balances(bank: DataFrame, ledger: DataFrame, tolerance: int = 1, most: int = 120, bank_pool: int = 90, ledger_pool: int = 30, each: int = 8, keep: int = 80, subsets: bool = True) -> DataFrame:
    """Buckets (account, month, flow) whose first ``bank_pool`` and ``ledger_pool`` rows have equal totals: as a whole, up
    to ``most`` records, and in parts: runs of up to 8 entries (the first 180 runs) against subsets of the bank rows. Runs of
    one counterparty come first, then the shortest; for each, the bank rows are ranked anew by text and nearness, and
    subsets are searched in that order.

    The ``each`` best of a bucket and the first ``keep`` of the job, by bucket, stay. Totals are compared first, so only
    buckets that agree gather their rows, and of those no more than both pools.
    """
    key = ["account", "month", "flow"]
    first = lambda d, k: d.where("flow in ('in', 'out')").withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("day", "ord", "id"))).where(F.col("_k") <= k)
    b, g = first(bank, bank_pool), first(ledger, ledger_pool)
    sums = [d.groupBy(*key).agg(F.sum("cents").alias(f"s{p}")) for d, p in ((b, "b"), (g, "l"))]
    hits = sums[0].join(sums[1], key).where(F.abs(F.col("sb") - F.col("sl")) <= tolerance).select(*key)
    said, cp = record_text(bank).alias("said"), counterparty_key("counterparty_name", "summary").alias("cp")
    rows = [d.join(hits, key, "left_semi").select(*key, F.lit(side).alias("side"), "_k", "id", "cents", "day", said, cp) for d, side in ((b, "bank"), (g, "ledger"))]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "_k"])
        banks, entries = (list(x.itertuples(index=False)) for x in (group[group.side == "bank"], group[group.side == "ledger"]))
        made: dict[tuple, tuple] = {}

        def add(bs: list, es: list) -> None:
            if len(bs) + len(es) > 2:
                days = [r.day for r in (*bs, *es)]
                made.setdefault((frozenset(r.id for r in bs), frozenset(r.id for r in es)), ("manual_monthly_balance_many_to_many", [r.id for r in bs], [r.id for r in es], sum(r.cents for r in bs), sum(r.cents for r in es), None, min(days), max(days)))

        for es in entry_runs(entries) if subsets else []:
            if len(made) >= each:
                break
            for bs in bank_subsets(banks, es, tolerance, each - len(made)):
                add(bs, es)
                if len(made) >= each:
                    break
        if len(banks) + len(entries) <= most:
            add(banks, entries)
        return pd.DataFrame(list(made.values()), columns=COLUMNS).assign(**{c: group[c].iloc[0] for c in key})

    groups = rows[0].unionByName(rows[1]).groupBy(*key).applyInPandas(run, f"{GROUP}, account string, month string, flow string")
    best = Window.partitionBy(*key).orderBy(F.desc("score"), F.abs(F.size("banks") - F.size("ledgers")), "members", "span", F.desc("bank_cents"), F.concat_ws("|", "banks"), F.concat_ws("|", "ledgers"))
    chosen = measured(groups, bank, ledger).withColumn("score", balance_score()).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= each)
    return chosen.orderBy(*key, "_k").limit(keep).select(*COLUMNS)  # a feature: the first `keep`


def signature(df: DataFrame) -> DataFrame:
    return df.withColumn("candidate_signature", F.concat_ws(":", "match_type", F.concat_ws("|", "banks"), F.concat_ws("|", "ledgers")))


def same_bucket(candidates: DataFrame, bank: DataFrame, ledger: DataFrame, strict: bool = True, key: str | None = None) -> DataFrame:
    """Candidates whose members are of one month and flow, and of one account where both sides name any (if strict).

    ``key`` is a column that tells candidates apart, if they have one that is shorter than their signature.
    """
    signed, by = (signature(candidates), "candidate_signature") if key is None else (candidates, key)
    side = lambda ids, d, p: signed.select(by, F.explode(ids).alias("id")).join(d.select("id", "month", "flow", "account"), "id").groupBy(by).agg(F.collect_set(F.struct("month", "flow")).alias(f"{p}k"), F.collect_set(F.nullif("account", F.lit(""))).alias(f"{p}a"))
    told = side("banks", bank, "b").join(side("ledgers", ledger, "l"), by)
    one = (F.size(F.array_union("bk", "lk")) == 1) & ((F.size("ba") == 0) | (F.size("la") == 0) | (F.size(F.array_union("ba", "la")) == 1) | F.lit(not strict))
    out = signed.join(told.where(one).select(by), by, "left_semi")
    return out.drop(by) if key is None else out


#: Kinds from the one that is kept first.
PRIORITY = (
    "manual_monthly_balance_many_to_many", "manual_time_window_many_to_many", "manual_time_window_many_to_one", "amount_group_many_to_one",
    "many_to_one", "one_to_many", "contiguous_many_to_one", "one_to_one",
)


def policy(candidates: DataFrame) -> DataFrame:
    """Anything but one to one is for review only."""
    group = F.col("match_type") != "one_to_one"
    return candidates.withColumns({"review_only": group, "llm_review": group})


def dedupe(candidates: DataFrame) -> DataFrame:
    """Of candidates with the same members the one of the first kind, then for review only, then the best score, then the fewest records."""
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("match_type"))
    best = Window.partitionBy(F.sort_array("banks"), F.sort_array("ledgers")).orderBy(place, F.desc("review_only"), F.desc("score"), F.size("banks") + F.size("ledgers"), "period_start")
    return candidates.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def ranked(candidates: DataFrame, most: int = 160) -> DataFrame:
    """The first ``most`` candidates, groups before pairs, best first, numbered C00001 and on."""
    order = [F.desc("review_only"), F.desc("score"), F.abs(F.col("bank_cents") - F.col("ledger_cents")), F.concat_ws("|", "banks"), F.concat_ws("|", "ledgers"), F.col("match_type")]
    top = candidates.orderBy(*order).limit(most)
    return top.withColumn("candidate_id", F.format_string("C%05d", F.row_number().over(Window.orderBy(*order))))  # `most` rows


def duplicate_info(candidates: DataFrame) -> DataFrame:
    """Adds duplicate_info: whether bank rows, ledger entries, both or none of a candidate are in another one too."""
    signed = signature(candidates)

    def shared(ids: str) -> DataFrame:
        one = signed.select("candidate_signature", F.explode(ids).alias("id"))
        often = one.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        return one.join(often, "id").groupBy("candidate_signature").agg((F.max("n") > 1).alias(ids + "_twice"))

    out = signed.join(shared("banks"), "candidate_signature").join(shared("ledgers"), "candidate_signature")
    b, g = F.col("banks_twice"), F.col("ledgers_twice")
    return out.withColumn("duplicate_info", F.when(b & g, "both").when(b, "bank").when(g, "ledger").otherwise("none")).drop("banks_twice", "ledgers_twice", "candidate_signature")


def without_overlap(candidates: DataFrame) -> DataFrame:
    """The candidates for outside review that share no member with another of them."""
    asked = candidates.where("llm_review or not review_only")
    return duplicate_info(asked).where("duplicate_info = 'none'").drop("duplicate_info")


def hold_ids(candidates: DataFrame, bank: DataFrame, ledger: DataFrame, top: int = 50) -> DataFrame:
    """Members of the first ``top`` review-only groups of both sides, which block automatic acceptance: side, id."""
    groups = candidates.where("review_only and size(banks) > 1 and size(ledgers) > 1")
    best = measured(groups, bank, ledger).withColumn("score", many_score()).orderBy(*many_order()).limit(top)
    return best.select(F.lit("bank").alias("side"), F.explode("banks").alias("id")).unionByName(best.select(F.lit("ledger").alias("side"), F.explode("ledgers").alias("id"))).distinct()


def counterparty_consistency(candidates: DataFrame, bank: DataFrame) -> DataFrame:
    """Adds the largest share of one counterparty among a candidate's bank rows."""
    signed = signature(candidates)
    rows = signed.select("candidate_signature", F.explode("banks").alias("id")).join(bank.select("id", counterparty_key("counterparty_name", "summary").alias("cp")), "id")
    counts = rows.groupBy("candidate_signature", "cp").agg(F.count(F.lit(1)).alias("n"))
    share = counts.groupBy("candidate_signature").agg(F.round(F.max("n") / F.sum("n"), 4).alias("counterparty_consistency"))
    return signed.join(share, "candidate_signature")


def build_candidates(bank: DataFrame, ledger: DataFrame, tolerance: int = 1, most: int = 160) -> DataFrame:
    """All kinds over unused records, checked, deduplicated, ranked and labelled."""
    # Records and kinds are written one by one: a plan of all of them would not fit a small driver.
    bank, ledger = materialise(bank, "bank-records"), materialise(ledger, "ledger-records")
    made = lambda make: materialise(make(bank, ledger, tolerance).select(*COLUMNS), "candidates")
    alike = reduce(DataFrame.unionByName, [made(make) for make in (_whole_periods, _period_subsets, _relaxed_subsets)])
    scored = materialise(scored_groups(alike, bank, ledger, heuristic_score()), "candidates")
    every = reduce(DataFrame.unionByName, [scored, *[made(make) for make in (exact_pairs, manual_subsets, window_groups, monthly_balances)]])
    return duplicate_info(materialise(ranked(dedupe(policy(same_bucket(every, bank, ledger))), most), "ranked"))
