"""Similarity join of documents on their word n-grams by chosen paths.

Documents with the same n-gram set are one class. Classes go down random trees: at a node a few coordinates of the
min-hash signature are sampled, about 1/similarity of them, and the classes that share the sampled token go on
together; nodes that are small, dense (alike on average, as large groups of near copies are) or at the last level are
leaves, where all pairs are compared by their signatures.
Runs with other samples are added until a pair at the threshold is met with the target recall. A pair that several
leaves hold belongs to the first of them, so a class's text goes to the leaves that have a likely partner of it that it
meets nowhere earlier, mostly one or two, and there such pairs are decided exactly on the n-gram sets. Large leaves are
cut into parts that meet pairwise, each meeting in a task of its own, and a task returns counts and each class's
smallest partner, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, numbered, runs_of, smallest_reachable, wrapped
from .components import components

N = 5
SIMILARITY = 0.8
RECALL = 0.995
COORDINATES = 128
#: Nodes up to this size are leaves; after LEVELS levels all are, however large, and are compared in parts.
LEAF, LEVELS = 256, 4
#: So are nodes whose members are as alike as this on average, told from about SEEN of them: splitting would not make them smaller.
DENSE, SEEN = 0.9 * SIMILARITY, 64
#: Classes of a leaf, and n-grams of those of a leaf with likely partners, that meet those of another part in one task.
PART, PART_GRAMS = 1024, 4_000_000
#: Bytes of a text that are hashed at once, and n-grams of a meeting that are compared at once.
BLOCK, SLICE = 1 << 20, 500_000
#: Signatures may fall short of the threshold by so much (4 standard deviations) and still be looked at exactly.
MARGIN = 4 * (SIMILARITY * (1 - SIMILARITY) / COORDINATES) ** 0.5
SEED = 97

_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for one block."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[_U(1), np.full(BLOCK - 1, _BASE, np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[_U(1), np.full(BLOCK - 1, pow(_BASE, -1, 2**64), np.uint64)], dtype=np.uint64)
    return up, down


def window_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` values in a row, block by block."""
    up, down = _powers()
    n, step = len(values) - length + 1, BLOCK - length
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, n, step):
            part = values[at : at + step + length - 1]
            sums = np.r_[_U(0), np.cumsum(part * up[: len(part)], dtype=np.uint64)]
            here = len(part) - length + 1
            out[at : at + here] = mixed((sums[length:] - sums[:-length]) * down[:here])
    return out


def word_hashes(text: str, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run of other than ASCII white space), and if asked for the words' byte starts and ends.

    Blocks are hashed one by one; a word that goes on in the next one takes its sum and its power along, so a text, or a
    word, may have any length and needs little more than its words' hashes.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    up, down = _powers()
    found: list[np.ndarray] = []
    spots: list[tuple[np.ndarray, np.ndarray]] = []
    sum_, length, began = 0, 0, 0  # of the word that is open where a block begins
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        inside = np.r_[False, ~_IS_SPACE[part], False]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        if length and (not len(starts) or starts[0]):  # the open word ended with the block before
            found.append(mixed(np.array([(sum_ + length) % 2**64], np.uint64)))
            spots.append((np.array([began]), np.array([began + length])))
            length = 0
        if not len(starts):
            continue
        with np.errstate(over="ignore"):
            sums = np.r_[_U(0), np.cumsum(_BYTES[part] * up[: len(part)], dtype=np.uint64)]
            own = (sums[ends] - sums[starts]) * down[starts]
            sizes = (ends - starts).astype(np.uint64)
        firsts, lasts = starts + at, ends + at
        if length:
            own[0] = (sum_ + pow(_BASE, length, 2**64) * int(own[0])) % 2**64
            sizes[0] += _U(length)
            firsts[0] = began
        whole = len(own)
        length = 0
        if ends[-1] == len(part) and at + BLOCK < len(raw):
            whole -= 1
            sum_, length, began = int(own[-1]), int(sizes[-1]), int(firsts[-1])
        with np.errstate(over="ignore"):
            found.append(mixed(own[:whole] + sizes[:whole]))
        if places:
            spots.append((firsts[:whole], lasts[:whole]))
    if length:
        found.append(mixed(np.array([(sum_ + length) % 2**64], np.uint64)))
        spots.append((np.array([began]), np.array([began + length])))
    none = np.zeros(0, np.int64)
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return hashes, *((np.concatenate([s[k] for s in spots]) if places and spots else none) for k in (0, 1))


def ngram_hashes(words: np.ndarray, n: int = N) -> np.ndarray:
    """A hash of every n words in a row; a text of fewer words is one n-gram, one without words has none."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            out = out * _U(_STEP) + words[k : len(words) - n + 1 + k]
        return mixed(out + _U(n))


def ngram_set(text: str | None, n: int = N) -> np.ndarray:
    return np.unique(ngram_hashes(word_hashes(text or "")[0], n))


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        twice = mixed(grams + _U(_STEP))
        return int(grams.sum(dtype=np.uint64).view(np.int64)), int(twice.sum(dtype=np.uint64).view(np.int64))


@lru_cache(maxsize=1)
def _hashers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + 1)
    return rng.integers(0, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)


def signature(grams: np.ndarray) -> np.ndarray:
    times, turn = _hashers()
    low, out = (grams >> _U(32)).astype(np.uint32), np.full(COORDINATES, 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 1024):
            h = (low[at : at + 1024, None] ^ turn) * times
            np.minimum(out, (h ^ (h >> np.uint32(15))).min(0), out=out)
    return out.view(np.int32)


def roots_of(run: int) -> int:
    """Tokens that a run samples at the root: one, and two in every fourth run, 1/SIMILARITY on average."""
    return 2 if run % 4 == 3 else 1


def runs_for(recall: float = RECALL, levels: int = LEVELS) -> int:
    """Runs until a pair at the threshold shares a leaf with probability ``recall``, if nodes split to the last level.

    Below the root such a pair has one common child on average, so a run keeps it together with the probability that a
    branching process with mean 1 lives on from one of the root's tokens that both share.
    """
    alive = 1.0
    for _ in range(levels - 1):
        alive = 1 - exp(-alive)
    runs, missed = 0, 1.0
    while missed > 1 - recall:
        missed *= (1 - SIMILARITY * alive) ** roots_of(runs)
        runs += 1
    return runs


def _signed(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                grams = ngram_set(t.as_py(), n)
                rows.append((len(grams), *fingerprint(grams), signature(grams)))
            size, one, two, sig = zip(*rows) if rows else ([], [], [], [])
            signatures = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(sig) if sig else [], pa.int32()), COORDINATES).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), signatures], ["doc_id", "h", "size", "f1", "f2", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, size long, f1 long, f2 long, sig array<int>")


def mean_similarity(sig: np.ndarray) -> float:
    """Mean over all pairs of rows of the share of coordinates that agree."""
    n = len(sig)
    if n < 2:
        return 0.0
    equal = 0
    for c in range(sig.shape[1]):
        counts = np.unique(sig[:, c], return_counts=True)[1].astype(np.int64)
        equal += int((counts * (counts - 1)).sum())
    return equal / (n * (n - 1) * sig.shape[1])


def _dense(large: DataFrame, classes: DataFrame) -> DataFrame:
    """(node): the nodes of ``large`` (node, n, cls) whose members are alike on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [mean_similarity(sigs.values.flatten().to_numpy().reshape(len(sigs), -1)) for sigs in batch.column(1)]
            keep = pa.array([t >= DENSE for t in told], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], ["node"])

    share = F.pmod(F.xxhash64("cls", "node", F.lit(23)), F.lit(1 << 30)) < F.lit(SEEN * 2.0**30) / F.col("n")
    seen = materialise(large.where(share).select("node", "cls"), "op1-seen")
    sigs = seen.join(classes.select("cls", "sig"), "cls").groupBy("node").agg(F.collect_list("sig").alias("sigs"))  # about SEEN a node
    return sigs.mapInArrow(run, "node long").select(F.col("node").alias("_node"), F.lit(True).alias("dense"))


def _leaves(classes: DataFrame, runs: int, leaf: int) -> DataFrame:
    """(node, cls, n): the leaves with two classes at least, of all runs."""
    rng = np.random.default_rng(SEED + 2)
    roots = [(r, int(c)) for r in range(runs) for c in rng.choice(COORDINATES, roots_of(r), replace=False)]
    spots = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(c).alias("c"), F.col("sig")[c].alias("token")) for r, c in roots])).alias("s")
    level = classes.select("cls", spots).select(F.xxhash64("s.run", "s.c", "s.token").alias("node"), "cls")
    share = round(1024 / (SIMILARITY * COORDINATES))
    leaves = None
    for depth in range(1, LEVELS + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        level = materialise(level.join(sizes, "node"), "op1-level")
        large = level.where(F.col("n") > leaf)
        if depth == LEVELS or large.isEmpty():
            return level if leaves is None else leaves.unionByName(level)
        dense = _dense(large, classes)
        # What there is to split: one row a node.
        split = large.select("node").distinct().join(dense, F.col("node") == F.col("_node"), "left_anti")
        sampled = F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda i: F.pmod(F.xxhash64("node", i), F.lit(1024)) < share)
        picks = materialise(split.select("node", sampled.alias("picked")), "op1-picks")  # the same for all classes of a node
        done = level.join(picks.select("node"), "node", "left_anti")
        leaves = done if leaves is None else leaves.unionByName(done)
        if picks.isEmpty():
            return leaves
        level = large.select("node", "cls").join(picks, "node").withColumn("c", F.explode("picked")).drop("picked")
        level = level.join(classes.select("cls", "sig"), "cls")
        level = level.select(F.xxhash64("node", "c", F.expr("sig[c]")).alias("node"), "cls").distinct()
    return leaves


def _in_parts(groups: DataFrame, parts) -> DataFrame:
    """Each row once for every meeting of its part with a part of its group: adds left, right, part."""
    cut = groups.withColumn("parts", F.ceil(parts).cast("int")).withColumn("part", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cut.withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other")).drop("parts", "other")


def _pairs(hits: np.ndarray, part: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of the group) that ``hits`` marks and that this meeting of parts has to decide."""
    if left == right:
        return np.nonzero(np.triu(hits, 1))
    a, b = np.nonzero(hits)
    mine = (part[a] == left) & (part[b] == right)
    return a[mine], b[mine]


def _lowest(cls: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.argsort(cls, kind="stable")
    place = np.empty(len(cls), np.int64)
    place[order] = np.arange(len(cls))
    return cls[order][smallest_reachable(len(cls), place[a], place[b])[place]]


def _met_earlier(nodes: list[np.ndarray], node: int) -> np.ndarray:
    """Which rows of a meeting of ``node`` share a node below it too (a matrix); ``nodes`` are the rows' lists of leaves."""
    own = [x[x < node] for x in nodes]
    met = np.zeros((len(own), len(own)), bool)
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    at, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_inverse=True, return_counts=True)[1:]
    shared = n > 1
    keep = shared[at]
    rows, at = rows[keep], (np.cumsum(shared) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    rows, at, width = rows[order], at[order], 512
    for low in range(0, int(shared.sum()), width):
        span = slice(*np.searchsorted(at, [low, low + width]))
        m = np.zeros((len(own), width), np.float32)
        m[rows[span], at[span] - low] = 1
        met |= m @ m.T > 0
    return met


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of each leaf that have a likely partner there, by signatures and sizes, that they meet in no earlier leaf.

    Rows: node, left, right, part, cls, size, sig, nodes.
    """
    need = SIMILARITY - MARGIN
    for table, starts, ends in runs_of(batches, 3):
        node, left, right, part, cls, size = (table.column(c).to_numpy() for c in ("node", "left", "right", "part", "cls", "size"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        nodes, found = _lists(table.column("nodes")), []
        for s, e in zip(starts, ends):
            if e - s < 2:
                continue
            x, n = sig[s:e], size[s:e]
            same = np.zeros((e - s, e - s), np.uint8)
            for c in range(COORDINATES):
                same += x[:, c][:, None] == x[:, c]
            hits = (same >= need * COORDINATES) & (np.minimum.outer(n, n) >= SIMILARITY * np.maximum.outer(n, n))
            a, b = _pairs(hits, part[s:e], left[s], right[s])
            if len(a):
                fresh = ~_met_earlier(nodes[s:e], node[s])[a, b]
                hit = np.unique(np.r_[a[fresh], b[fresh]])
                found.append((np.full(len(hit), node[s]), cls[s:e][hit]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["node", "cls"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sorted sets, by products of their incidence matrix.

    Tokens are taken a range of values at a time, about SLICE of them, so memory does not grow with the sets.
    """
    out = np.zeros((len(sets), len(sets)), np.float32)
    parts = max(1, -(-sum(map(len, sets)) // SLICE))
    cuts = [_U(k * (2**64 // parts)) for k in range(1, parts)]
    ends = [np.r_[0, np.searchsorted(x, cuts), len(x)].astype(np.int64) for x in sets]
    for k in range(parts):
        held = [x[e[k] : e[k + 1]] for x, e in zip(sets, ends)]
        tokens, at, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in held])
        shared = n > 1
        place = np.cumsum(shared) - 1
        keep = shared[at]
        rows, at = rows[keep], place[at[keep]]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        width = 4096
        for low in range(0, int(shared.sum()), width):
            span = slice(*np.searchsorted(at, [low, low + width]))
            m = np.zeros((len(sets), width), np.float32)
            m[rows[span], at[span] - low] = 1
            out += m @ m.T
    return out


def _decided(n: int, similarity: float):
    """Decide exactly the pairs of each meeting that meet in no earlier leaf; rows: node, left, right, part, cls, many, f1, f2, nodes, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in runs_of(batches, 3):
            node, left, right, part, cls, many, one, two = (table.column(c).to_numpy() for c in ("node", "left", "right", "part", "cls", "many", "f1", "f2"))
            text, nodes = table.column("text"), _lists(table.column("nodes"))
            found = []
            for s, e in zip(starts, ends):
                sets, rows = [], []
                for r in range(s, e):
                    if rows and cls[r] == cls[rows[-1]]:
                        continue  # a row that repeats wholly
                    grams = ngram_set(text[r].as_py(), n)
                    if fingerprint(grams) == (one[r], two[r]):
                        sets.append(grams)
                        rows.append(r)
                if len(rows) < 2:
                    continue
                rows = np.array(rows)
                common = overlaps(sets)
                size = np.array([len(x) for x in sets], np.float64)
                hits = common >= similarity * (size[:, None] + size - common) - 1e-6
                hits &= ~_met_earlier([nodes[r] for r in rows], node[s])
                a, b = _pairs(hits, part[rows], left[s], right[s])
                if not len(a):
                    continue
                w = many[rows].astype(np.float64)
                links = np.bincount(a, w[b], len(rows)) + np.bincount(b, w[a], len(rows))
                hit = np.flatnonzero(links > 0)
                found.append((cls[rows][hit], links[hit].astype(np.int64), _lowest(cls[rows], a, b)[hit]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["cls", "links", "low"])

    return run


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, component_id, n_links, kept.

    Words are runs of other than ASCII white space; a document's set is its distinct ``n`` words in a row (a document of
    fewer words is one n-gram). Documents with equal sets are a class, named by its smallest id; documents with a
    Jaccard similarity of 0.8 or more are linked, and ``n_links`` counts them, copies included. ``component_id`` is the
    smallest id reachable, and the document with that id is kept. Null or blank texts have no set and link with
    nothing. Rows that repeat an id count as documents of their own. Ids are whole numbers. An empty table gives no rows.
    A text may have any length: it is hashed block by block, and what stays is a hash of 8 bytes for each word. A pair at
    the threshold is found with a probability of ``recall`` at least, if nodes of more than ``leaf`` classes split to the
    last level; one that is found is decided exactly.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialise(numbered(_signed(base, n)), "op1-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "h"))
    classes = rows.where("size > 0").groupBy("size", "f1", "f2").agg(first.alias("first"), F.count(F.lit(1)).alias("many"))
    classes = classes.select("size", "f1", "f2", F.col("first.row").alias("cls"), F.col("first.doc_id").alias("class_id"), F.col("first.h").alias("h"), "many")
    classes = materialise(classes, "op1-classes")
    signed = materialise(classes.select("cls", "size").join(rows.select(F.col("row").alias("cls"), "sig"), "cls"), "op1-class-signatures")
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as rows are few for the work they make
    leaves = _leaves(signed, runs_for(recall), leaf)
    # A class is in a few leaves of each run.
    lists = materialise(leaves.groupBy("cls").agg(F.sort_array(F.collect_set("node")).alias("nodes")), "op1-nodes")
    told = signed.join(lists, "cls")
    meetings = _in_parts(leaves, F.col("n") / PART).join(told, "cls").select("node", "left", "right", "part", "cls", "size", "sig", "nodes")
    meeting = ["node", "left", "right"]
    likely = meetings.repartition(tasks, *meeting).sortWithinPartitions(*meeting).mapInArrow(_alike, "node long, cls long")
    likely = materialise(likely.distinct(), "op1-likely").join(classes.drop("class_id"), "cls")
    sizes = likely.groupBy(F.col("node").alias("_node")).agg(F.greatest(F.count(F.lit(1)) / PART, F.sum("size") / PART_GRAMS).alias("share"))
    members = _in_parts(likely.join(materialise(sizes, "op1-shares"), F.col("node") == F.col("_node")), F.col("share")).drop("_node", "share")
    # Texts are found by id and hash: rows without an id, or with one that repeats, are not each other's.
    held = classes.select("cls", F.col("class_id").alias("_id"), F.col("h").alias("_h")).join(likely.select("cls").distinct(), "cls", "left_semi")
    texts = held.join(base.where("text is not null"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.xxhash64("text"))).select("cls", "text")
    full = members.join(lists, "cls").join(texts, "cls").select("node", "left", "right", "part", "cls", "many", "f1", "f2", "nodes", "text")
    linked = materialise(full.repartition(tasks, *meeting).sortWithinPartitions(*meeting, "cls").mapInArrow(_decided(n, SIMILARITY), "cls long, links long, low long"), "op1-links")
    counts = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = components(linked.select(F.col("cls").alias("a"), F.col("low").alias("b")), "op1").withColumnRenamed("node", "cls")
    lowest = classes.select("cls", "class_id").join(parts, "cls").groupBy("component").agg(F.min("class_id").alias("component_id"))
    known = classes.join(counts, "cls", "left").join(parts.join(lowest, "component").select("cls", "component_id"), "cls", "left")
    known = known.select(*[F.col(c).alias(f"_{c}") for c in ("size", "f1", "f2", "cls", "class_id", "many", "links", "component_id")])
    out = rows.select("row", "doc_id", "size", "f1", "f2").join(known, (F.col("size") == F.col("_size")) & (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")), "left")
    component = F.coalesce("_component_id", "_class_id", "doc_id")
    stays = F.col("_cls").isNull() | ((F.col("row") == F.col("_cls")) & (F.col("_class_id") == component))
    links = (F.coalesce("_links", F.lit(0)) + F.coalesce("_many", F.lit(1)) - 1).cast("long")
    return out.select("doc_id", F.coalesce("_class_id", "doc_id").alias("class_id"), component.alias("component_id"), links.alias("n_links"), F.coalesce(stays, F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of similar ones, the one with the smallest id; columns stay as they are.

    Rows that share an id stay or go together; rows without an id stay.
    """
    gone = similar_documents(docs, id_col, text_col).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("_gone"))
    return wrapped(docs, id=F.col(id_col)).join(gone, F.col("id") == F.col("_gone"), "left_anti").select("doc.*")
