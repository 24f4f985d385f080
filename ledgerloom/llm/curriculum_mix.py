"""Mixing sources to target weights along a time-varying curriculum.

Sources get word targets by water-filling; each source's weight schedule over the training run is integrated and its
cumulative demand inverted, so that every occurrence of a document gets a training position; documents are range-sorted
by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, materialise, numbered, running, wrapped

WEIGHTS = (5, 2, 1)
#: Knots (time, rate) for the sources of each weight; rates are scaled to mean 1. Heavy sources lead, light ones follow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
MAX_REPEATS = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, kind (place in the weights), target: one row per source.

    All sizes together are shared by weight; a target stops at ``cap`` times its source's size and the excess is
    shared again by weight until none is above. In the order of cap to weight the capped sources come first, so
    running sums find the level of the others in one pass over the sources.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("kind", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1)).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    levels = ranked.select(
        "*",
        F.row_number().over(by_level).alias("place"),
        (
            (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            / F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
        ).alias("level"),
    )
    open_place = F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("place"))
    level = F.min_by("level", open_place).over(whole)
    return levels.select("source", "source_size", F.col("kind").cast("int").alias("kind"), F.least(F.col("most"), F.coalesce(level * F.col("w"), F.col("most"))).alias("target"))


def position(share: Column, kind: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which a source of this kind has met ``share`` (0 to 1) of its demand.

    Between knots the rate is linear, so the demand met so far is quadratic in time and is solved for it.
    """
    out = share
    for k, knots in enumerate(schedules):
        area = sum((t2 - t1) * (r1 + r2) / 2 for (t1, r1), (t2, r2) in zip(knots, knots[1:]))
        solved, met = None, 0.0
        for (t1, r1), (t2, r2) in zip(knots, knots[1:]):
            a, slope = r1 / area, (r2 - r1) / area / (t2 - t1)
            rest = F.greatest(share - F.lit(met), F.lit(0.0))
            here = F.lit(t1) + 2 * rest / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(1e-12))))
            solved = here if solved is None else F.when(share >= met, here).otherwise(solved)
            met += (t2 - t1) * (r1 + r2) / 2 / area
        out = F.when(kind == k, F.least(solved, F.lit(1.0))).otherwise(out)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, cap: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, size, source_size, target, taken, first_position.

    A source's documents stand in a fixed random order that is read over and over until the target is met: whole
    passes, then a part of one. ``taken`` counts the words read, the last document's only as far as the target goes, so
    a source takes its target to the word and no document more than ``cap`` times its size. ``first_position`` (0 to 1)
    is the training time of the first reading, null where nothing is taken. Null text has size 0; a null source is a
    source of its own, last in order; rows that repeat are documents of their own; empty tables give no rows.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialise(numbered(sized).withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "op9-sizes")
    placed = running(sized, ["source"], "h", ["doc_id", "text_hash", "row"], F.col("size"), "start")
    targets = source_targets(sized, weights, cap).withColumnRenamed("source", "_source")
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    words = F.least(F.round("target").cast("long"), cap * F.col("source_size"))
    passes = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long"))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("passes") * F.col("source_size") - F.col("start")))
    joined = joined.withColumn("words", words).withColumn("passes", passes).withColumn("taken", (F.col("passes") * F.col("size") + rest).cast("long"))
    first = F.when(F.col("taken") > 0, position(F.col("start") / F.col("words"), F.col("kind"), schedules))
    return joined.select("doc_id", "text_hash", "size", "source_size", "target", "taken", first.alias("first_position"), "start", "words", "kind")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: tuple = SCHEDULES, **options) -> DataFrame:
    """``docs`` as the training run reads them: each row once for each whole reading, range-sorted by training position.

    A last reading that the target cuts short counts if at least half of the document is read, so texts stay whole.
    Documents without words are read never. Of rows that share id and text each has its own readings.
    """
    plan = mix(docs, id_col, text_col, source_col, schedules=schedules, **options)
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    plan = plan.where("taken > 0").withColumn("copies", copies).where("copies > 0")
    # Rows that share id and text, few or none, are told apart by a number: which of them takes which turn makes no difference.
    turn = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("start", "copies"))
    plan = materialise(plan.withColumn("turn", turn).select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "text_hash", "turn", "copies", "start", "words", "source_size", "kind")]), "op9-plan")
    repeats = materialise(plan.where("_turn = 2").select(F.col("_doc_id").alias("_id"), F.col("_text_hash").alias("_hash")), "op9-repeats")
    rows = wrapped(docs, id=F.col(id_col), hash=F.xxhash64(F.col(text_col)))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    told = rows.join(repeats, same, "left_semi").withColumn("turn", F.row_number().over(Window.partitionBy("id", "hash").orderBy("id")))
    rows = rows.join(repeats, same, "left_anti").withColumn("turn", F.lit(1)).unionByName(told)
    rows = rows.join(plan, F.col("id").eqNullSafe(F.col("_doc_id")) & (F.col("hash") == F.col("_text_hash")) & (F.col("turn") == F.col("_turn")))
    rows = rows.withColumn("_reading", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    share = (F.col("_start") + F.col("_reading") * F.col("_source_size")) / F.col("_words")
    rows = rows.withColumn("_position", position(F.least(share, F.lit(1.0)), F.col("_kind"), schedules))
    return rows.orderBy("_position", "id", "hash").select("doc.*")
