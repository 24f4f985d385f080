"""Merkle manifest of a dataset: a tree of digests over each source, a tree over the sources, and proofs for documents.

Every node has up to ``ARITY`` children, and a level's last node may have fewer. Leaves are numbered within their source
by ranges and cut into aligned blocks of ``ARITY**HEIGHT``. A builder takes one block and appends each node to its log
as soon as the node's last child is there, that is in postorder. Where a node stands in such a log follows from the
sizes of the subtrees before it, so nothing but the log is kept: its last entry is the block's node in the next tier,
and a proof reads the siblings at their computed places. Tiers are built until each source has one node, each tier a
table of 1/``ARITY**HEIGHT`` of the rows of the one below, and paths come down the tiers again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

ARITY = 3
#: Levels that a builder completes: blocks of 729 leaves.
HEIGHT = 6
#: What is digested of a document, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<before:string,after:string>>"
_STEPS_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of the columns' values, each with its length in bytes before it; ``-`` for null."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*fields), 256)


def level_sizes(n: int, levels: int | None = None, arity: int = ARITY) -> list[int]:
    """Nodes of each level over ``n`` leaves, up to one node or, if given, for so many levels above the leaves."""
    out = [n]
    while len(out) <= levels if levels is not None else out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def postorder_place(level: int, index: int, n: int, levels: int, arity: int = ARITY) -> int:
    """Place in the log of the node ``index`` of ``level`` over ``n`` leaves: what is complete before it.

    The node ends with leaf ``end``. Before it come all nodes of its own level and below that end there or earlier, and
    of each higher level those that end earlier.
    """
    end = min((index + 1) * arity**level, n)
    same = sum(-(-end // arity**k) for k in range(level + 1))
    return same + sum((end - 1) // arity**k for k in range(level + 1, levels + 1)) - 1


def append_log(leaves: list[str], levels: int, arity: int = ARITY) -> list[str]:
    """The digests of all nodes over ``leaves`` in the order in which they are complete."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]  # children of each level's unfinished node
    for k, leaf in enumerate(leaves):
        last, node, level = k == len(leaves) - 1, leaf, 0
        log.append(node)
        while level < levels:
            open_[level].append(node)
            if len(open_[level]) < arity and not last:
                break
            node, open_[level] = digest(*open_[level]), []
            log.append(node)
            level += 1
    return log


def paths_down(n: int, levels: int, log: list[str], arity: int = ARITY) -> list[list[tuple[str, str]]]:
    """For each leaf, the siblings before and after of each level from the leaf to the top, read from the log.

    A node's way up is its parent's with one step before it, so every node is looked at once.
    """
    sizes = level_sizes(n, levels, arity)
    ways: list[list[tuple[str, str]]] = [[]]
    for level in range(levels - 1, -1, -1):
        width = sizes[level]
        nodes = [log[postorder_place(level, k, n, levels, arity)] for k in range(width)]
        below = []
        for k in range(width):
            first = k // arity * arity
            below.append([("".join(nodes[first:k]), "".join(nodes[k + 1 : first + arity])), *ways[k // arity]])
        ways = below
    return ways


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The digest at the top that ``leaf`` and the siblings of ``path`` lead to."""
    for before, after in path:
        leaf = digest(before, leaf, after)
    return leaf


def levels_in_block(size: int, arity: int, height: int) -> int:
    """Levels that a builder completes over a block of a tree of ``size`` leaves."""
    return height if size > arity**height else len(level_sizes(size, None, arity)) - 1


def _numbered(nodes: DataFrame, order: list[str], tag: str) -> DataFrame:
    """Add ``place`` (from 0) within ``tree`` in the given order, and ``size``, the nodes of the tree.

    Rows are sorted by ranges of tree and order, so a tree of any size lies over many tasks; what meets by tree is one
    row for each task that holds some of it.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    ordered = materialise(ordered.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), f"op12-{tag}-sorted")
    counts = ordered.groupBy("tree", "_task").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("tree").orderBy("_task")
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_n").over(Window.partitionBy("tree"))
    starts = counts.select(F.col("tree").alias("_tree"), F.col("_task").alias("_in"), "_from", before.alias("_before"), whole.alias("size"))
    placed = ordered.join(starts, (F.col("tree") == F.col("_tree")) & (F.col("_task") == F.col("_in")))
    return placed.withColumn("place", F.col("_at") - F.col("_from") + F.col("_before")).drop("_tree", "_in", "_task", "_at", "_from", "_before")


def _build(nodes: DataFrame, tag: str, arity: int, height: int) -> DataFrame:
    """One row per block of ``nodes`` (tree, size, place, label, altered, leaf): its members and its log."""
    label = nodes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, leaves = batch.column("size").to_pylist(), batch.column("leaves").to_pylist()
            logs = [append_log(x, levels_in_block(n, arity, height), arity) for n, x in zip(sizes, leaves)]
            yield batch.drop_columns(["leaves"]).append_column("log", pa.array(logs, pa.list_(pa.string())))

    # A block has ARITY**HEIGHT members at most.
    members = F.array_sort(F.collect_list(F.struct("place", "label", "altered", "leaf"))).alias("m")
    blocks = nodes.groupBy("tree", "size", F.floor(F.col("place") / arity**height).alias("block")).agg(members)
    blocks = blocks.select("tree", "size", F.col("block").alias("place"), F.col("m.label").alias("labels"), F.col("m.altered").alias("altered"), F.col("m.leaf").alias("leaves"))
    schema = f"tree string, size long, place long, labels array<{label}>, altered array<string>, log array<string>"
    return materialise(blocks.mapInArrow(run, schema), f"op12-{tag}-log")


def _tiers(nodes: DataFrame, tag: str, arity: int, height: int) -> list[DataFrame]:
    """Logs over numbered ``nodes``, then over the tops of their blocks, until every tree has one block.

    How many there are follows from the size of the largest tree; a tree that has its top goes through the rest as it is.
    """
    block, tiers, level = arity**height, [], nodes
    while True:
        tiers.append(_build(level, f"{tag}-{len(tiers)}", arity, height))
        if (tiers[-1].agg(F.max("size")).first()[0] or 0) <= block:
            return tiers
        none = F.lit(None).cast("string")
        level = tiers[-1].select(
            "tree", F.ceil(F.col("size") / block).alias("size"), "place", none.alias("label"), none.alias("altered"), F.element_at("log", -1).alias("leaf")
        )


@dataclass
class Manifest:
    """Logs of the trees over documents and of the tree over sources, tier by tier."""

    documents: list[DataFrame]
    sources: list[DataFrame]
    arity: int
    height: int

    def subroots(self) -> DataFrame:
        """(tree, subroot): the top of each source's tree; ``tree`` is ``=`` and the source, or empty for null."""
        return self.documents[-1].select("tree", F.element_at("log", -1).alias("subroot"))

    def root(self) -> DataFrame:
        """(root): one row, none for an empty dataset."""
        return self.sources[-1].select(F.element_at("log", -1).alias("root"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", arity: int = ARITY, height: int = HEIGHT) -> Manifest:
    """Build the trees of ``docs``. Extra columns don't count; the order within a source is that of ids, then digests.

    Leaves of altered documents ride along: where 2 divides the crc32 of the id, the digest without the text's line
    breaks, if it has any.
    """
    digested = leaf_digest([F.col(c) for c in fields])
    bare = leaf_digest([F.regexp_replace(F.col(c), "\n", "") if c == text_col else F.col(c) for c in fields])
    touched = (F.crc32(F.col(id_col).cast("string")) % 2 == 0) & F.col(text_col).contains("\n")
    tree = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("label"), digested.alias("leaf"), F.when(touched, bare).alias("altered"))
    documents = _tiers(_numbered(leaves, ["label", "leaf"], "leaves"), "documents", arity, height)
    tops = documents[-1].select(F.lit("").alias("tree"), F.col("tree").alias("label"), F.lit(None).cast("string").alias("altered"), F.element_at("log", -1).alias("leaf"))
    return Manifest(documents, _tiers(_numbered(tops, ["label"], "sources"), "sources", arity, height), arity, height)


def _ways(m: Manifest):
    """For the rows of a batch of blocks with the way ``up`` from each: (row, labels, altered, leaves, ways to the root)."""
    arity, height = m.arity, m.height

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        names = ("size", "labels", "altered", "log", "up")
        for k, (size, labels, altered, log, up) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
            n, levels = len(labels), levels_in_block(size, arity, height)
            leaves = [log[postorder_place(0, i, n, levels, arity)] for i in range(n)]
            above = [(s["before"], s["after"]) for s in up]
            yield k, labels, altered, leaves, [w + above for w in paths_down(n, levels, log, arity)]

    return each


def _descended(m: Manifest, tier: DataFrame, above: DataFrame) -> DataFrame:
    """The ways up from the members of ``tier``'s blocks, given those from the blocks (tree, place, up, subroot, root)."""
    each, block = _ways(m), m.arity**m.height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, labels, _, leaves, ways in each(batch):
                n, said = len(labels), {c: batch.column(c)[k].as_py() for c in ("tree", "place", "subroot", "root")}
                steps = [[{"before": b, "after": a} for b, a in w] for w in ways]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([said["tree"]] * n, pa.string()), pa.array([said["place"] * block + i for i in range(n)], pa.int64()), pa.array(labels, pa.string()), pa.array(leaves, pa.string()),
                        pa.array(steps, _STEPS_ARROW), pa.array([said["subroot"]] * n, pa.string()), pa.array([said["root"]] * n, pa.string()),
                    ],
                    ["tree", "place", "label", "leaf", "up", "subroot", "root"],
                )

    schema = f"tree string, place long, label string, leaf string, up {_STEPS}, subroot string, root string"
    return tier.join(above, ["tree", "place"]).mapInArrow(run, schema)


def _above(m: Manifest) -> DataFrame:
    """(tree, place, up, subroot, root) for every block of documents: the siblings from its top to the root."""
    wanted = ["tree", "place", "up", "subroot", "root"]
    none = F.lit(None).cast("string")
    ways = m.sources[-1].select("tree", "place", F.expr(f"cast(array() as {_STEPS})").alias("up"), none.alias("subroot"), F.element_at("log", -1).alias("root"))
    for tier in reversed(m.sources[1:]):
        ways = _descended(m, tier, ways).select(*wanted)
    ways = _descended(m, m.sources[0], ways)  # its members are the sources
    ways = ways.select(F.col("label").alias("tree"), F.lit(0).cast("long").alias("place"), "up", F.col("leaf").alias("subroot"), "root")
    for tier in reversed(m.documents[1:]):
        ways = _descended(m, tier, ways).select(*wanted)
    return ways


def proofs(m: Manifest) -> DataFrame:
    """(doc_id, leaf, altered, subroot, root, proof): for each document the siblings of each level on its way to the root."""
    return _proved(m, f"proof {_STEPS}", lambda leaf, altered, way: ([{"before": b, "after": a} for b, a in way],), [_STEPS_ARROW])


def _proved(m: Manifest, more: str, make, kinds: list) -> DataFrame:
    each, label = _ways(m), m.documents[0].schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["doc_id", "leaf", "altered", "subroot", "root", *(f.split()[0] for f in more.split(", "))]
            kind = batch.schema.field("labels").type.value_type
            for k, labels, altered, leaves, ways in each(batch):
                made = zip(*(make(leaf, a, w) for leaf, a, w in zip(leaves, altered, ways)))
                same = [pa.array([batch.column(c)[k].as_py()] * len(labels), pa.string()) for c in ("subroot", "root")]
                own = [pa.array(labels, kind), pa.array(leaves, pa.string()), pa.array(altered, pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *same, *(pa.array(x, t) for x, t in zip(made, kinds))], names)

    schema = f"doc_id {label}, leaf string, altered string, subroot string, root string, {more}"
    return m.documents[0].join(_above(m), ["tree", "place"]).mapInArrow(run, schema)


def audited(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` digests the siblings from the leaf to the root; ``folded_root`` is what the leaf of the altered
    document, where it was altered, leads to with these siblings, and ``verified`` tells whether that is the root. Nulls
    in any column have a digest of their own, as have empty texts; texts may have any length. Rows that repeat an id
    stand in the order of their digests; rows that repeat wholly have the same digest at places of their own. A null
    source is a source, the first. An empty table gives no rows.
    """

    def make(leaf: str, altered: str | None, way: list[tuple[str, str]]) -> tuple[str, str]:
        return digest(*(x for step in way for x in step)), folded(altered or leaf, way)

    out = _proved(manifest(docs, **options), "proof_sha256 string, folded_root string", make, [pa.string(), pa.string()])
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
