"""Passages that repeat across documents, by a sparse suffix array over words.

Suffixes are retained at minimisers: positions whose 8-word hash is the least of 16 in a row. Every stretch of
``min_words`` words has one such position among its first 16, picked by its own words, so all documents that hold the
stretch retain a suffix there, ``min_words - 15`` of whose words (its prefix) lie in the stretch. Suffixes whose prefix
occurs in one document only drop out. The others are sorted by the words that follow; neighbours of other documents
bound how far a match can go on to the right, and with what lies to the left the match is extended there too, always
against the same partner: a stretch counts if all of its words, left and right, are those of another document.

The sort is by range, so a prefix may have any number of suffixes, and a task compares a bounded piece of a range at a
time. Where a prefix goes on beyond the piece, what a smaller id holds in the piece is decided there; for each other
stretch the piece sends its smallest and greatest holder on, by the hash of its words. Nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, wrapped
from .ngram_join import mixed, window_hashes, word_hashes

MIN_WORDS = 50
GRAM, SPAN = 8, 16
#: Words looked at on either side of a prefix: a stretch begins at most so many before its suffix.
REACH = SPAN - 1
#: Rows of a range that are compared at once.
PIECE = 65_536

_ROW = "h long, doc_id long, pos int, lo int, hi int, context binary"
_NAMES = ["h", "doc_id", "pos", "lo", "hi", "context"]


def leading(words: np.ndarray, min_words: int) -> np.ndarray:
    """For each place where a stretch of ``min_words`` words can begin, its minimiser: the least GRAM hash of SPAN in a row."""
    places = len(words) - min_words + 1
    if places <= 0:
        return np.zeros(0, np.int64)
    grams = window_hashes(words, GRAM)
    return np.lib.stride_tricks.sliding_window_view(grams, SPAN)[:places].argmin(1) + np.arange(places)


def _suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """(h, doc_id, pos): hash of the prefix, and place, of each retained suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d, p = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = word_hashes(text.as_py() or "")[0]
                at = np.unique(leading(words, min_words))
                if len(at):
                    h.append(window_hashes(words, min_words - REACH)[at].view(np.int64))
                    d.append(np.full(len(at), doc, np.int64))
                    p.append(at.astype(np.int32))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (h, d, p)], ["h", "doc_id", "pos"])

    return docs.mapInArrow(run, "h long, doc_id long, pos int")


def _contexts(texts: DataFrame, min_words: int) -> DataFrame:
    """For each shared suffix the words after its prefix and, backwards, before it, as big-endian hashes in one string.

    The stretches that belong to the suffix begin ``lo`` to ``hi`` words before it. Where the text ends the words are 0;
    the stretches stay within the text.
    """
    prefix = min_words - REACH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for doc, text, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = word_hashes(text.as_py() or "")[0]
                first = leading(words, min_words)
                if not len(first):
                    continue
                pos, h = (shared.values.field(k).to_numpy() for k in ("pos", "h"))
                hashes = window_hashes(words, prefix).view(np.int64)
                fits = pos < len(hashes)
                fits[fits] = hashes[pos[fits]] == h[fits]  # another row may have the same id
                pos, h = pos[fits].astype(np.int64), h[fits]
                low, high = np.searchsorted(first, pos), np.searchsorted(first, pos, "right")
                mine = high > low
                pos, h, hi, lo = pos[mine], h[mine], (pos - low)[mine], (pos - high + 1)[mine]
                if not len(pos):
                    continue
                short = np.r_[np.zeros(REACH, np.uint32), (words >> np.uint64(32)).astype(np.uint32), np.zeros(REACH, np.uint32)]
                behind = short[pos[:, None] + REACH + prefix + np.arange(REACH)]
                before = short[pos[:, None] + REACH - 1 - np.arange(REACH)]
                for column, value in zip(out, (h, np.full(len(pos), doc, np.int64), pos, lo, hi, np.c_[behind, before].astype(">u4"))):
                    column.append(value)
            if out[0]:
                yield _rows(*(np.concatenate(c) for c in out))

    return texts.mapInArrow(run, _ROW)


def _rows(h, doc, pos, lo, hi, context: np.ndarray) -> pa.RecordBatch:
    width = 8 * REACH
    flat = pa.py_buffer(np.ascontiguousarray(context.astype(">u4")).tobytes())
    ends = pa.py_buffer(np.arange(len(h) + 1, dtype=np.int32) * np.int32(width))
    binary = pa.BinaryArray.from_buffers(pa.binary(), len(h), [None, ends, flat])
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), *(pa.array(x, pa.int32()) for x in (pos, lo, hi)), binary], _NAMES)


def _read(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of ``_rows`` as arrays."""
    context = batch.column(5)
    if isinstance(context, pa.ChunkedArray):
        context = context.combine_chunks()
    at = context.offset * 8 * REACH
    flat = np.frombuffer(context.buffers()[2], np.uint8)[at : at + 8 * REACH * len(context)] if len(context) else np.zeros(0, np.uint8)
    return [*(batch.column(k).to_numpy() for k in range(5)), flat.view(">u4").astype(np.uint32).reshape(len(context), 2 * REACH)]


def right_matches(h: np.ndarray, doc: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """For sorted rows, how many words after the prefix agree with a neighbour of another document, at most; -1 without one."""
    n = len(h)
    best = np.full(n, -1)
    turns = np.flatnonzero((h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) + 1
    first, last = np.r_[0, turns], np.r_[turns, n]
    run = np.repeat(np.arange(len(first)), last - first)
    for near in (first[run] - 1, last[run]):
        held = (near >= 0) & (near < n)
        rows, other = np.flatnonzero(held), near[held]
        same = h[rows] == h[other]
        rows, other = rows[same], other[same]
        best[rows] = np.maximum(best[rows], np.cumprod(behind[rows] == behind[other], axis=1).sum(1))
    return best


def stretch_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, words to the left, hash) of every stretch: the words to the left, the prefix, and those to the right that make it full."""
    with np.errstate(over="ignore"):
        sides = []
        for words in (context[:, REACH:], context[:, :REACH]):
            so_far = [np.zeros(len(h), np.uint64)]
            for k in range(REACH):
                so_far.append(mixed(so_far[-1] + words[:, k].astype(np.uint64) + np.uint64(k + 1)))
            sides.append(np.stack(so_far))
        rows, lefts, keys = [], [], []
        for left in range(REACH + 1):
            at = np.flatnonzero((lo <= left) & (left <= hi))
            rows.append(at)
            lefts.append(np.full(len(at), left))
            keys.append(mixed(h.view(np.uint64)[at] + sides[0][left, at] * np.uint64(3) + mixed(sides[1][REACH - left, at]) + np.uint64(left)))
    return np.concatenate(rows), np.concatenate(lefts), np.concatenate(keys)


_SEEN = "doc_id long, start int, end int, first boolean, stretch long, low long, high long"


def _seen(doc, start, end, first, stretch, low, high) -> pa.RecordBatch:
    """Rows of ``_SEEN``; an undecided one has ``stretch``, with the least and the greatest holder met so far."""
    n = len(doc)
    columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(np.full(n, first)), *(pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (stretch, low, high))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "first", "stretch", "low", "high"])


def compared(rows: list[np.ndarray], whole: bool, min_words: int) -> Iterator[pa.RecordBatch]:
    """The shared stretches of sorted suffixes.

    A stretch that a document with a smaller id holds too is decided; others are, if the prefixes are here as a
    ``whole``, and else stay undecided: one row for each stretch and place of its smallest holder here.
    """
    h, doc, pos, lo, hi, context = rows
    if not len(h):
        return
    right = right_matches(h, doc, context[:, :REACH])
    if not whole:  # neighbours of the outermost rows may be elsewhere
        turns = np.flatnonzero((h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        right[: turns[0] + 1 if len(turns) else len(h)] = REACH
        right[turns[-1] + 1 if len(turns) else 0 :] = REACH
    lo = np.maximum(lo, REACH - right)  # what a neighbour does not match on the right no partner does
    row, left, key = stretch_hashes(h, lo, hi, context)
    if not len(row):
        return
    order = np.argsort(key, kind="stable")
    row, left, key = row[order], left[order], key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[starts, len(key)])
    low, high = (np.repeat(f.reduceat(doc[row], starts), n) for f in (np.minimum, np.maximum))
    later = low < doc[row]
    parts = [(False, later)] + ([(True, ~later & (low < high))] if whole else [])
    for first, chosen in parts:
        at = np.flatnonzero(chosen)
        if len(at):  # stretches of one suffix overlap and are joined
            at = at[np.argsort(row[at], kind="stable")]
            turns = np.flatnonzero(np.r_[True, row[at][1:] != row[at][:-1]])
            suffix = row[at][turns]
            yield _seen(doc[suffix], pos[suffix] - np.maximum.reduceat(left[at], turns), pos[suffix] - np.minimum.reduceat(left[at], turns) + min_words, first, None, None, None)
    if not whole and not later.all():
        at = ~later
        start = pos[row[at]] - left[at]
        yield _seen(doc[row[at]], start, start + min_words, False, key[at].view(np.int64), low[at], high[at])


def _shared_stretches(suffixes: DataFrame, min_words: int, piece: int) -> DataFrame:
    """(doc_id, start, end, first) of the shared stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut: int | None = None  # the prefix whose suffixes are not all in one piece: the range's first, or a larger one
        waiting: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _read(batch)
            rows = rows if waiting is None else [np.concatenate(x) for x in zip(waiting, rows)]
            cut = int(rows[0][0]) if cut is None else cut
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # where the last prefix begins, which may go on
            waiting = None
            if len(rows[0]) < piece:
                waiting = rows
                continue
            if last == 0:
                cut = int(rows[0][0])
            known = int(np.searchsorted(rows[0], cut, "right")) if rows[0][0] == cut else 0
            yield from compared([x[:known] for x in rows], False, min_words)
            yield from compared([x[known:last] for x in rows], True, min_words)
            waiting = [x[max(known, last) :] for x in rows]
        if waiting is not None and len(waiting[0]):
            h = waiting[0]
            known = int(np.searchsorted(h, cut, "right")) if h[0] == cut else 0
            last = max(known, int(np.searchsorted(h, h[-1])))
            yield from compared([x[:known] for x in waiting], False, min_words)
            yield from compared([x[known:last] for x in waiting], True, min_words)
            yield from compared([x[last:] for x in waiting], False, min_words)

    tasks = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes.repartitionByRange(tasks, "h", "context", "doc_id", "pos").sortWithinPartitions("h", "context", "doc_id", "pos")
    seen = materialise(ordered.mapInArrow(run, _SEEN), "op8-compared")
    decided, open_rows = seen.where("stretch is null"), seen.where("stretch is not null")
    holders = open_rows.groupBy("stretch").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).where("_low <> _high")
    settled = open_rows.join(materialise(holders, "op8-holders"), "stretch").withColumn("first", F.col("_low") == F.col("doc_id"))
    columns = ["doc_id", "start", "end", "first"]
    return decided.select(columns).unionByName(settled.select(columns))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage of a document: doc_id, start_word, end_word, n_words, first.

    A stretch is ``min_words`` (23 at least) words in a row that another document holds too. ``first`` says whether no
    document with a smaller id holds it, and a passage is a union of stretches with the same answer that overlap or
    touch. So a passage that is not first can be cut without losing text, and a document may have a first and a later
    passage that overlap. Words are runs of other than ASCII
    white space, counted from 0, the end is exclusive.

    Repeats inside one document do not count, nor do rows that repeat an id; rows whose id is null are left out. Null,
    short and unrepeated texts give no rows, nor does an empty table. A text may have any length that a string holds.
    """
    if min_words < GRAM + SPAN - 1:
        raise ValueError(f"passages of under {GRAM + SPAN - 1} words can lie between retained suffixes")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    found = materialise(_suffixes(base, min_words), "op8-suffixes")
    shared = found.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("h")
    kept = found.join(materialise(shared, "op8-shared"), "h")  # written first, so a common prefix is split between tasks
    by_doc = kept.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "h")).alias("shared"))
    texts = base.join(by_doc.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "shared")
    suffixes = materialise(_contexts(texts, min_words), "op8-contexts")
    spans = _shared_stretches(suffixes, min_words, PIECE)
    along = Window.partitionBy("doc_id", "first").orderBy("start", "end")
    opens = (F.col("start") > F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    islands = spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "first", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the passages that a document with a smaller id holds; what is left of a text stays as it was.

    Of any stretch the document with the smallest id keeps its copy, so no text is lost from the corpus.
    """
    later = repeated_passages(docs, id_col, text_col, min_words).where("not first").groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("_spans"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, cuts):
            if text is None or cuts is None:
                return text
            raw = text.encode("utf-8", "surrogatepass")
            _, starts, ends = word_hashes(text, places=True)
            out, at = [], 0
            for cut in cuts:
                if cut["end_word"] > len(ends):
                    continue  # another row with the same id
                out.append(raw[at : starts[cut["start_word"]]])
                at = ends[cut["end_word"] - 1]
            return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")

        return pd.Series([one(t, c) for t, c in zip(texts, spans)])

    joined = wrapped(docs, id=F.col(id_col)).join(later, F.col("id") == F.col("_doc"), "left")
    return joined.select(F.col("doc").withField(text_col, without(F.col(f"doc.{text_col}"), F.col("_spans"))).alias("doc")).select("doc.*")
