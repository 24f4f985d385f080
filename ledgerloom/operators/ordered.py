"""Passes in which anchors choose in turn, each from a short list of its own.

Sequential rule: anchors go in order, each looks at the best rows of its bucket that are still free, and what it takes
is gone for those after it. Here every anchor first gets its best rows of all, found without comparing each anchor with
each row. Then all anchors choose at once, and what they take is told to the lists of those after them, until nothing
changes: the first anchor is right from the start, whoever depends on it in the next round, and so on. Only anchors
whose lists hold a row that changed hands choose again, and only a list (of bounded length) reaches a Python helper.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

#: Parts that the lists of one bucket are dealt over while anchors meet cells.
DEALT = 8
_TAKEN = "id string, at long"


def universes(anchors: DataFrame, rows: DataFrame, bucket: list[str], wild: str | None) -> DataFrame:
    """``rows`` once for each bucket of anchors that may take them. With ``wild`` (a column of the bucket) a blank there, on
    either side, meets all values."""
    if wild is None:
        return rows.join(anchors.select(*bucket).distinct(), bucket, "left_semi")
    fixed = [c for c in bucket if c != wild]
    buckets = anchors.select(*bucket).distinct()
    named = rows.where(F.col(wild) != "")
    named = named.withColumn("_u", F.explode(F.array(F.col(wild), F.lit("")))).drop(wild).withColumnRenamed("_u", wild)
    blank = rows.where(F.col(wild) == "").drop(wild).join(buckets, fixed)
    return named.join(buckets, bucket, "left_semi").select(*rows.columns).unionByName(blank.select(*rows.columns))


def best_rows(
    anchors: DataFrame, rows: DataFrame, bucket: list[str], alike: list[str], score: Callable[[DataFrame], Column], most: int,
    by_amount: bool = True, wild: str | None = None, near: tuple[int, Callable[[DataFrame], Column]] | None = None, days: int | None = None,
    own: tuple[str, ...] = (), within: Callable[[DataFrame], DataFrame] | None = None, below: int | None = None,
) -> DataFrame:
    """The first ``most`` rows of each anchor: anchor, a_ord, a_cents, a_day, a_label, k, id, cents, day, label.

    Rows of a bucket that agree in ``alike`` are a cell, and all anchors that agree in it are a class; ``score`` of a class
    and a cell (columns a_… and those of the cell) ranks the cells of a class, highest first. Cells are taken until those
    before them hold enough rows. Within a cell the rows nearest in amount come first, or with ``by_amount`` off the first
    in order; they are found by their places in the sorted cell. ``near`` = (tolerance, score) ranks rows whose amount is
    within the tolerance by a score of their own, which is never below the one of their cell. Ties go to the nearer amount
    (if ``by_amount``), then to the order of the rows. ``own`` columns of anchors are part of their class, and ``within`` picks
    the cells that a class may take. With ``below`` only rows of amounts up to the anchor's and ``below`` more count, the
    largest first: cells then hold rows of one size (a power of two), so that of smaller ones all rows count for sure.
    """
    if below is not None:
        size = lambda extra: F.floor(F.log2(F.col("cents") + extra)).cast("int")
        anchors, rows = anchors.withColumn("size", size(below)), rows.withColumn("size", size(0))
        alike = [*alike, "size"]
    rows = universes(anchors, rows, bucket, wild)
    cell_key = [*bucket, *alike]
    cells = materialise(rows.groupBy(*cell_key).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.monotonically_increasing_id()), "cells")
    base = materialise(rows.join(cells.select(*cell_key, "cell"), cell_key), "cell-rows")
    place = lambda *order: F.row_number().over(Window.partitionBy("cell").orderBy(*order))
    if by_amount or below is not None:
        placed = base.withColumns({"up": place("cents", "ord"), "down": place(F.desc("cents"), "ord")})
    else:
        placed = base.withColumn("up", place("ord"))
    placed = materialise(placed.select("cell", "id", "ord", "cents", "day", "label", *(["up", "down"] if by_amount or below is not None else ["up"])), "cell-places")
    said = [F.col(c).alias(f"a_{c}") for c in (*alike, *own)]
    classes = materialise(anchors.select(*bucket, *said).distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    # Classes of one bucket are dealt over several tasks; cells, which are fewer than rows, go to all of them.
    dealt = classes.withColumn("_deal", F.pmod("class", F.lit(DEALT)))
    met = dealt.join(cells.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))), [*bucket, "_deal"])
    if days is not None:
        met = met.where(F.abs(F.col("day") - F.col("a_day")) <= days)
    if below is not None:
        met = met.where(F.col("size") <= F.col("a_size"))
    if within is not None:
        met = within(met)
    sure = F.col("n") if below is None else F.when(F.col("size") < F.col("a_size"), F.col("n")).otherwise(F.lit(0))
    graded = met.withColumn("score", score(met)).select("class", "cell", "n", sure.alias("sure"), "score")
    above = F.sum("sure").over(Window.partitionBy("class").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    level = F.sum("sure").over(Window.partitionBy("class", "score"))
    kept = graded.withColumns({"_above": above, "_level": level}).where(F.col("_above") - F.col("_level") < most)
    known = anchors.select(*bucket, F.col("id").alias("anchor"), F.col("ord").alias("a_ord"), F.col("cents").alias("a_cents"), F.col("day").alias("a_day"), F.col("label").alias("a_label"), *[F.col(c).alias(f"_{c}") for c in (*alike, *own)])
    told = ["anchor", "a_ord", "a_cents", "a_day", "a_label"]
    mine = known.join(classes, [*(known[c] == classes[c] for c in bucket), *(known[f"_{c}"].eqNullSafe(classes[f"a_{c}"]) for c in (*alike, *own))])
    mine = materialise(mine.select(*[known[c] for c in told], *[known[c] for c in bucket], *[F.col(f"_{c}") for c in alike], "class"), "anchors")
    wanted = mine.select(*told, "class").join(kept.select("class", "cell", "n", "score"), "class").drop("class")
    found = ["id", "ord", "cents", "day", "label"]
    if by_amount or below is not None:
        # The place of the anchor's amount (with ``below``: of what lies just above all that counts).
        limit = F.col("a_cents") if below is None else F.col("a_cents") + below + 1
        marks = placed.select("cell", F.col("cents").alias("at"), F.lit(1).alias("row"), *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in (*told, "n", "score")])
        marks = marks.unionByName(wanted.select("cell", limit.alias("at"), F.lit(0).alias("row"), *told, "n", "score"))
        before = F.sum("row").over(Window.partitionBy("cell").orderBy("at", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        spots = materialise(marks.withColumn("below", before).where("row = 0"), "spots")
        up = spots.where("below < n").withColumn("up", F.explode(F.sequence(F.col("below") + 1, F.least("n", F.col("below") + most))))
        down = spots.where("below > 0").withColumn("down", F.explode(F.sequence(F.col("n") - F.col("below") + 1, F.least("n", F.col("n") - F.col("below") + most))))
        pieces = [p.join(placed, ["cell", side]).select(*told, "score", *found) for p, side in ((up, "up"), (down, "down"))]
        out = pieces[0].unionByName(pieces[1]) if below is None else pieces[1]
    else:
        out = wanted.withColumn("up", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(most).cast("long"))))).join(placed, ["cell", "up"]).select(*told, "score", *found)
    apart = F.abs(F.col("cents") - F.col("a_cents"))
    if near is not None:
        tolerance, own_score = near
        reach = mine.withColumn("at", F.explode(F.sequence(F.col("a_cents") - tolerance, F.col("a_cents") + tolerance)))
        close = reach.join(base.withColumnRenamed("cents", "at"), [*bucket, "at"]).withColumn("cents", F.col("at"))
        if days is not None:
            close = close.where(F.abs(F.col("day") - F.col("a_day")) <= days)
        close = close.select(*told, *[F.col(f"_{c}").alias(f"a_{c}") for c in alike if c != "day"], *found, *[c for c in alike if c not in found])
        out = out.where(apart > tolerance).unionByName(close.withColumn("score", own_score(close)).select(*told, "score", *found))
    order = [F.desc("score"), *([F.desc("cents")] if below is not None else [apart] if by_amount else []), F.asc("ord")]
    ranked = out.withColumn("k", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("k") <= most)
    return ranked.select(*told, "k", "id", "cents", "day", "label")


def settled(lists: Callable[[DataFrame | None, int], DataFrame], limit: int, choose: Callable, tag: str) -> DataFrame:
    """(anchor, ord, members, score) of all anchors that find something, as if they had chosen one after the other.

    ``lists(anchors, most)`` gives the first ``most`` rows of the anchors named in the table (column anchor; None for all), as
    :func:`best_rows` does; an anchor chooses from the first ``limit`` of them that are free. ``choose`` gets the anchor's
    row (anchor, ord, cents, day, label, near) and returns (members, score) or None. A list that runs out, though there may
    be more rows, is made twice as long.
    """
    most = 2 * limit
    pools = materialise(lists(None, most).withColumn("most", F.lit(most)), f"{tag}-lists")
    taken = materialise(pools.sparkSession.createDataFrame([], _TAKEN), f"{tag}-taken")
    now, found = None, None
    while True:
        while True:
            mine = pools if now is None else pools.join(now, "anchor", "left_semi")
            cut = materialise(_free(mine, taken, limit), f"{tag}-free")
            short = cut.where((F.col("had") >= F.col("most")) & (F.col("left") < limit)).select("anchor", "most").distinct()
            longest = short.agg(F.max("most")).first()[0]
            if longest is None:
                break
            # Few anchors, in crowded cells: their lists are made anew, all twice as long as the longest of them.
            some = materialise(short.select("anchor"), f"{tag}-short")
            longer = lists(some, 2 * longest).withColumn("most", F.lit(2 * longest))
            pools = materialise(pools.join(some, "anchor", "left_anti").unionByName(longer), f"{tag}-lists")
        new = _chosen(cut.where("not gone"), choose)
        if found is not None:
            new = new.unionByName(found.join(now, "anchor", "left_anti"))
        found = materialise(new, f"{tag}-found")
        told = found.select(F.explode("members").alias("id"), F.col("ord").alias("at")).groupBy("id").agg(F.min("at").alias("at"))
        told = materialise(told, f"{tag}-taken")
        both = told.join(taken.select("id", F.col("at").alias("was")), "id", "full")
        changed = both.where(~F.col("at").eqNullSafe(F.col("was"))).select("id")
        now = materialise(pools.join(changed, "id", "left_semi").select("anchor").distinct(), f"{tag}-again")
        if now.isEmpty():
            return found
        taken = told


def _free(pools: DataFrame, taken: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each list that no earlier anchor takes, and of every list its first row, ``gone`` or not;
    with the rows that the list had and that are left."""
    gone = F.coalesce(F.col("at") < F.col("a_ord"), F.lit(False))
    whole = Window.partitionBy("anchor")
    upto = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = pools.join(taken, "id", "left").withColumn("gone", gone)
    free = (~F.col("gone")).cast("int")
    told = told.withColumns({"had": F.count(F.lit(1)).over(whole), "left": F.sum(free).over(whole), "place": F.sum(free).over(upto)})
    return told.where((~F.col("gone") & (F.col("place") <= limit)) | (F.col("k") == 1)).drop("at", "place")


def _chosen(lists: DataFrame, choose: Callable) -> DataFrame:
    near = F.array_sort(F.collect_list(F.struct("k", "id", "cents", "day", "label"))).alias("near")
    anchor = [F.first(f"a_{c}").alias(c) for c in ("ord", "cents", "day", "label")]
    pools = lists.groupBy("anchor").agg(*anchor, near)  # ``limit`` rows each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                got = choose(r)
                if got:
                    out.append((r.anchor, r.ord, *got))
            yield pd.DataFrame(out, columns=["anchor", "ord", "members", "score"])

    return pools.mapInPandas(run, "anchor string, ord long, members array<string>, score double")
