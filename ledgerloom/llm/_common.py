"""Shared pieces: distributed numbering, samples, small text constants; scratch tables as the rest of the library writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import materialise  # noqa: F401  (the operators take it from here)

#: ASCII white space and its complement, as Java and Python regular expressions read them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def wrapped(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``doc``, and ``more`` beside it: no name of theirs can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(n) for n, c in more.items()])


def numbered(df: DataFrame) -> DataFrame:
    """Add ``row``, a number of the row; only stable once materialised."""
    return df.withColumn("row", F.monotonically_increasing_id())


def running(df: DataFrame, group: list[str], order_hash: str, ties: list[str], value: Column, out: str, bits: int = 12) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, in the order of ``order_hash`` (a bigint hash) then ``ties``.

    A group may hold any share of the rows: each is cut into ``2**bits`` ranges of the hash, ranges are summed
    with map-side aggregation, their offsets added up (one row a range), and only rows of one range meet in a task.
    """
    cut = df.withColumn("_range", F.shiftright(F.col(order_hash), 64 - bits)).withColumn("_value", value)
    on = [*group, "_range"]
    sums = cut.groupBy(*on).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_{c}") for c in on], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*on).orderBy(order_hash, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    joined = local.join(offsets, on=match, how="inner")
    return joined.withColumn(out, F.col("_offset") + F.col("_local")).drop("_value", "_local", "_offset", "_range", *[f"_{c}" for c in on])


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int, most_labels: int, seed: int = 11) -> DataFrame:
    """At most ``per_label`` rows of each label, chosen by a hash of ``key``, so that reruns choose the same.

    Rows beyond a hash threshold, set from the counts so that a little more than enough pass, drop out on the map
    side; only those that pass are ranked. Labels with few rows are taken whole. Of more than ``most_labels`` labels the
    most frequent are sampled, so that the counts, which go to all tasks, have a bound.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), label).limit(most_labels)
    share = F.least(F.lit(1.0), (F.lit(1.3 * per_label + 100)) / F.col("_n"))
    spin = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("_spin")
    passed = rows.select("*", spin).join(F.broadcast(counts.select(F.col(label).alias("_label"), share.alias("_share"))), F.col(label) == F.col("_label")).where("_spin < _share")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_spin", key))
    return passed.withColumn("_rank", rank).where(F.col("_rank") <= per_label).drop("_spin", "_share", "_label", "_rank")


def runs_of(batches, keys: int):
    """Whole groups of a sorted partition: (table, starts, ends) with rows that agree in the first ``keys`` columns together.

    The last group of a batch waits for the next one, so a group is never cut; callers bound the size of groups.
    """
    import numpy as np
    import pyarrow as pa

    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.cast(pa.schema([(f.name, pa.large_string() if pa.types.is_string(f.type) else f.type) for f in table.schema]))  # a run's texts may pass 2 GB
        table = (table if waiting is None else pa.concat_tables([waiting, table])).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(np.r_[True, new[1:]])
        last = int(starts[-1])
        if last:
            yield table, starts[:-1], np.r_[starts[1:-1], last]
        waiting = table.slice(last)
    if waiting is not None and waiting.num_rows:
        yield waiting.combine_chunks(), np.array([0]), np.array([waiting.num_rows])


def smallest_reachable(n: int, a, b):
    """For nodes 0..n-1 with links a-b: the smallest node that each one reaches (arrays)."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
