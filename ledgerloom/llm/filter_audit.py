"""Interaction audit of filters: which filter removes what, in every order that the filters can be applied in.

A filter fails a document by the document alone (A to D) or by the rest of the table (E: a document with a smaller id
has the same text). E is an existential self-join: documents that share a text hash meet the documents that were first
with that very text, in a left-semi join on hash, exact text and a smaller id. The ids it finds are united with those
that fail the other filters and become one bit set a document. Documents are counted by bit set, and all orders are
played on these few counts, never on documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, materialise

FILTERS = "ABCDE"
#: Limits of the filters: words at least; distinct words, in per cent of words, at least; capitals, in per cent of code points, at most.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"
#: Copies of one text that meet the first of them in one task; larger groups are dealt out over several.
TOGETHER = 1000

_KEY = ["doc_id", "part", "hash", "length"]


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that ``text`` (not null) fails; bit 0 is A."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    # A struct keeps the words, so that they are cut once.
    seen = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(s: Column) -> Column:
        failed = [
            s["n"] < LEAST_WORDS,
            100 * s["distinct"].cast("long") < LEAST_DISTINCT * s["n"].cast("long"),
            100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
            text.rlike(SYMBOLS),
        ]
        out = F.lit(0)
        for k, f in enumerate(failed):
            out = out.bitwiseOR(F.when(f, F.lit(1 << k)).otherwise(F.lit(0)))
        return out

    return F.transform(F.array(seen), bits)[0]


def _base(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    return docs.select(F.col(id_col).alias("doc_id"), part, F.xxhash64(text).alias("hash"), F.length(text).alias("length"), text.alias("text"))


def later_copies(base: DataFrame, noted: DataFrame) -> DataFrame:
    """Keys of the rows of ``base`` whose very text a row with a smaller id holds (a row as often as it is there).

    ``noted`` has the keys of ``base`` without texts: they tell which hashes more than one id has, and only rows with
    such a hash move with their texts. The first holder of a text stands for all of its group, and goes to as many tasks
    as the group's size asks for.
    """
    on = ["hash", "length"]
    shared = noted.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    dealt = F.ceil(F.col("n") / TOGETHER).cast("int").alias("dealt")
    shared = materialise(shared.select(*[F.col(c).alias(f"_{c}") for c in on], dealt), "op11-shared")
    met = base.join(shared, (F.col("hash") == F.col("_hash")) & (F.col("length") == F.col("_length"))).drop("_hash", "_length")
    met = met.withColumn("deal", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("dealt")).cast("int"))
    first = met.groupBy(*on, "text").agg(F.min("doc_id").alias("first"), F.first("dealt").alias("dealt"))
    first = first.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)))
    first = first.select(*[F.col(c).alias(f"_{c}") for c in (*on, "deal", "text")], "first")
    same = [F.col(c) == F.col(f"_{c}") for c in (*on, "deal", "text")]
    return met.join(first, [*same, F.col("first") < F.col("doc_id")], "left_semi").select(*_KEY)


def failure_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, hash, length, fails, documents): the bit set of the filters that documents fail.

    Rows that agree in id, part and text are one row with their number in ``documents``. Null texts are empty. A row
    without an id has no smaller id and is none.
    """
    base = _base(docs, id_col, text_col, part_col)
    noted = materialise(base.select(*_KEY, own_failures(F.col("text")).alias("fails")), "op11-noted")
    others = noted.withColumn("documents", F.lit(1).cast("long"))
    copies = later_copies(base, noted.select(*_KEY)).withColumns({"fails": F.lit(1 << FILTERS.index("E")), "documents": F.lit(0).cast("long")})
    return others.unionByName(copies).groupBy(*_KEY).agg(F.bit_or("fails").alias("fails"), F.sum("documents").alias("documents"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step and long counts of documents.

    ``kept`` are left after the step, ``removed`` go at it, ``redundant`` fail its filter but went earlier,
    ``unique_fails`` fail its filter alone, ``good_lost`` and ``toxic_lost`` are the removed ones with quality or toxic
    of 1 in ``labels``, and ``shapley`` is what the filter removes in all orders together. Of repeated labels of a
    document the highest holds; documents without a label, or with a null one, count as unlabelled. Rows that repeat
    count each. A null part is the empty string. An empty table gives no rows.
    """
    marks = labels.select(F.col(id_col).alias("_id"), "quality", "toxic").groupBy("_id")
    marks = marks.agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("bad"))
    sets = failure_sets(docs, id_col, text_col, part_col).join(marks, F.col("doc_id") == F.col("_id"), "left")
    counted = {
        "n": F.sum("documents"),
        "good": F.sum(F.when(F.col("good"), F.col("documents")).otherwise(F.lit(0))),
        "bad": F.sum(F.when(F.col("bad"), F.col("documents")).otherwise(F.lit(0))),
    }
    # At most 32 rows a part.
    combinations = materialise(sets.groupBy("part", "fails").agg(*[v.alias(k) for k, v in counted.items()]), "op11-sets")
    return in_all_orders(combinations)


def in_all_orders(combinations: DataFrame) -> DataFrame:
    """Play all orders of the filters on counts of documents by part and bit set (columns part, fails, n, good, bad)."""
    steps = []
    for order in permutations(FILTERS):
        gone = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bit).alias("bit"), F.lit(gone).alias("gone")))
            gone |= bit
    # The 600 steps of the 120 orders are a fixed list.
    played = combinations.select("part", "fails", "n", "good", "bad", F.explode(F.array(*steps)).alias("s")).select("part", "fails", "n", "good", "bad", "s.*")
    fails = F.col("fails")
    failed, earlier = fails.bitwiseAND(F.col("bit")) > 0, fails.bitwiseAND(F.col("gone")) > 0
    # Of the orders of all filters, the failing filter comes before the document's other failures in one of so many.
    share = F.lit(factorial(len(FILTERS))) / F.bit_count(fails)

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")

    return played.groupBy("part", "filter_order", "step").agg(
        total(~failed & ~earlier, F.col("n")).alias("kept"),
        total(failed & ~earlier, F.col("n")).alias("removed"),
        total(failed & earlier, F.col("n")).alias("redundant"),
        total(fails == F.col("bit"), F.col("n")).alias("unique_fails"),
        total(failed & ~earlier, F.col("good")).alias("good_lost"),
        total(failed & ~earlier, F.col("bad")).alias("toxic_lost"),
        total(failed, F.col("n") * share.cast("long")).alias("shapley"),
    )


def without_failures(docs: DataFrame, filters: str = FILTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that fail one of ``filters``; columns stay as they are, extra ones included.

    Rows that agree in id and text stay or go together.
    """
    from ._common import wrapped

    bits = sum(1 << FILTERS.index(f) for f in filters)
    part = docs.withColumn("_no_part", F.lit(""))
    gone = failure_sets(part, id_col, text_col, "_no_part").where(F.col("fails").bitwiseAND(F.lit(bits)) > 0)
    gone = gone.select(F.col("doc_id").alias("_doc_id"), F.col("hash").alias("_hash"), F.col("length").alias("_length"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = wrapped(docs, _id=F.col(id_col), hash=F.xxhash64(text), length=F.length(text))
    same = F.col("_id").eqNullSafe(F.col("_doc_id")) & (F.col("hash") == F.col("_hash")) & (F.col("length") == F.col("_length"))
    return rows.join(gone, same, "left_anti").select("doc.*")
