"""Exact deduplication by content-defined chunk recipes.

A text is cut into chunks at places that its own content selects. Each distinct chunk is stored once and gets a
verified identifier: its 64-bit hash, with a serial number where two different chunks share a hash. A document is
then the ordered list of its chunks' identifiers, and two documents are equal exactly if the lists are. Chunk text
moves once, already deduplicated on the map side; documents are grouped and joined by their lists alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, materialise, numbered, wrapped

#: A chunk runs to the first blank or stop before one of a few letters after MIN characters, or to MAX characters.
MIN_CHARS, MAX_CHARS = 256, 1024
CUT = r"(?:[\x20.,!?](?=[a-dA-D])|[аеио的是、。]|\z)"
#: Shared hashes that may go to every task; with more of them every document is numbered anew.
MOST_SHARED = 10_000
CHUNK = rf"(?s).{{{MIN_CHARS - 1},{MAX_CHARS - 1}}}?{CUT}|.{{1,{MAX_CHARS}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(norm: Column) -> Column:
    """The chunks of a text; put together they are the text again, and an empty text has none."""
    return F.filter(F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0)), lambda c: c != "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one blank; null is the empty text.
    Of equal texts the row with the smallest id stays (null ids last; of rows that repeat an id, one stays).
    An empty table gives no rows. Other columns are not looked at, whatever their names. A text may have any length: it
    moves in chunks of at most MAX_CHARS characters, and only where a chunk hash is shared does its own row hold it again.
    ``chunk_hash`` may be any hash to a bigint: equality never rests on it.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    occurrences = base.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    store = occurrences.select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = store.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    shared = materialise(shared, "op7-shared-hashes")
    digests = numbered(base).select("row", "doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), lambda c: chunk_hash(c)).alias("recipe"), "norm")
    if shared.isEmpty():  # every hash stands for one chunk text: it is the verified identifier
        digests = digests.drop("norm")
    else:
        digests = _renumbered(digests, store, shared, chunk_hash)
    digests = materialise(digests, "op7-recipes")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    groups = digests.groupBy("recipe").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = digests.join(groups.withColumnRenamed("recipe", "_recipe"), F.col("recipe") == F.col("_recipe"), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def _touched(digests: DataFrame, shared: DataFrame) -> DataFrame:
    """``digests`` with texts (``norm``) only where the recipe holds one of the hashes that different chunks share.

    The hashes go to all tasks if there are MOST_SHARED of them at most; a few thousand are to be expected of 1e11 chunks.
    """
    if shared.limit(MOST_SHARED + 1).count() > MOST_SHARED:
        return digests
    held = shared.agg(F.collect_set("h").alias("_shared"))  # one row
    text = F.when(F.arrays_overlap("recipe", "_shared"), F.col("norm"))
    return digests.crossJoin(F.broadcast(held)).withColumn("norm", text).drop("_shared")


def _renumbered(digests: DataFrame, store: DataFrame, shared: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """Recipes with identifiers told apart where chunks share a hash: hash and serial number in turn.

    Only documents with such a chunk are cut again. Their lists hold a shared hash and those of the others don't, so
    lists of both forms are never equal.
    """
    serial = Window.partitionBy("h").orderBy("chunk")
    twins = store.join(shared, "h", "left_semi").withColumn("serial", F.row_number().over(serial).cast("long"))
    digests = materialise(_touched(digests, shared), "op7-digests")
    held = digests.where("norm is not null").select("row", F.posexplode(chunks(F.col("norm"))).alias("pos", "chunk"))
    parts = held.withColumn("h", chunk_hash(F.col("chunk")))
    told = parts.join(twins, ["h", "chunk"], "left").select("row", F.struct("pos", "h", F.coalesce("serial", F.lit(1)).alias("serial")).alias("part"))
    lists = told.groupBy("row").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    verified = lists.select("row", F.flatten(F.transform("parts", lambda p: F.array(p["h"], p["serial"].cast("long")))).alias("verified"))
    return digests.join(verified, "row", "left").select("row", "doc_id", "text_sha256", F.coalesce("verified", "recipe").alias("recipe"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns; rows that repeat id and text count once."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    marked = wrapped(docs, sha=F.sha2(normalised(F.col(text_col)), 256), id=F.col(id_col))
    joined = marked.join(kept, F.col("sha").eqNullSafe(F.col("_kept_sha")) & F.col("id").eqNullSafe(F.col("_kept_id")), "left_semi")
    return joined.dropDuplicates(["sha", "id"]).select("doc.*")
