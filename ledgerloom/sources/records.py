"""Delimited text of any size: files cut into byte blocks, records told apart across blocks, encodings decided by all of a file.

A block begins behind a line break, which is a character of its own in every encoding here, so blocks are decoded one by
one and a file has an encoding if all its blocks have. Whether a line break ends a record depends on the quotes before
it. Seen from a block, there are two cases, so a first pass notes for each block how it ends and how many records end in
it in either case. These notes are put in order by windows over one row a block, which gives every block its state, its
first record's number and its file's encoding, and a second pass reads the records. Only what is needed to finish a
block's last record is read beyond the block.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
import sys
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.scratch import materialise

#: Bytes of a block, and of the blocks that one task reads at least; what opening a file costs, in bytes.
BLOCK_BYTES, OPENING = 32 << 20, 1 << 16
# Encodings in the order in which they are tried; the last one reads anything.
ENCODINGS = ("utf-8", "gbk", "gb18030", "latin-1")

_BODY = re.compile(rb'(?:[^"]++|"")*+("?)')
_FILLED = re.compile(rb'[^\s,"]')
_FIELD_START = (-1, 0x2C, 0x0A, 0x0D)  # nothing, a comma, line ends


def opened(path: str):
    """(file system, path in it) of a local path or of a URI that Arrow's file systems know."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(path)


def listed(paths: list[str], ending: str) -> list[tuple[str, int]]:
    """Files (path, size) that are named, and those below the folders that are named, by path."""
    from pyarrow import fs

    out = []
    for given in paths:
        system, path = opened(given)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            out.append((given, info.size))
            continue
        root = given.rstrip("/")
        for x in system.get_file_info(fs.FileSelector(path, recursive=True)):
            if x.type == fs.FileType.File and x.base_name.lower().endswith(ending) and not x.base_name.startswith(("~$", "_", ".")):
                out.append((root + x.path[len(path.rstrip("/")) :], x.size))
    return sorted(out)


def quoted_spans(raw: bytes, inside: bool) -> Iterator[tuple[int, int, bool]]:
    """Stretches of ``raw`` within quotes, and whether each is closed; only the last one may not be. A quote opens only
    where a field begins."""
    at = 0
    if inside:
        m = _BODY.match(raw)
        yield 0, m.end(), bool(m[1])
        if not m[1]:
            return
        at = m.end()
    while (at := raw.find(b'"', at)) >= 0:
        if (raw[at - 1] if at else -1) not in _FIELD_START:
            at += 1
            continue
        m = _BODY.match(raw, at + 1)
        yield at, m.end(), bool(m[1])
        if not m[1]:
            return
        at = m.end()


def records_ended(raw: bytes, inside: bool, last: bool) -> tuple[int, bool, int]:
    """(records that end in ``raw``, whether it ends within quotes, place behind the first of them or -1).

    At the end of a file the last record may end without a line break.
    """
    n, open_, first, at = raw.count(b"\n"), False, -1, 0
    for a, b, closed in quoted_spans(raw, inside):
        n -= raw.count(b"\n", a, b)
        if first < 0 and (found := raw.find(b"\n", at, a)) >= 0:
            first = found + 1
        at, open_ = b, not closed
    if first < 0 and (found := raw.find(b"\n", at)) >= 0:
        first = found + 1
    if last and raw and (open_ or not raw.endswith(b"\n")):
        n += 1
        first = len(raw) if first < 0 else first
    return n, open_, first


def _line_start(f, size: int, at: int) -> int:
    """The first place from ``at`` on that begins a line."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    f.seek(at - 1)
    while chunk := f.read(1 << 16):
        if (k := chunk.find(b"\n")) >= 0:
            return f.tell() - len(chunk) + k + 1
    return size


def _readable(raw: bytes, encoding: str) -> bool:
    told, size = codecs.getincrementaldecoder(encoding)(), 1 << 20
    try:
        for at in range(0, len(raw), size):
            told.decode(raw[at : at + size], at + size >= len(raw))
    except UnicodeDecodeError:
        return False
    return True


class _Blocks(InputPartition):
    """Stretches of files, each of some blocks: path, size, number of the first block and of the one behind the last."""

    def __init__(self, stretches: list[tuple[str, int, int, int]]):
        self.stretches = stretches


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.ending = json.loads(options["paths"]), options.get("ending", ".csv")
        self.size = int(options.get("blockbytes", BLOCK_BYTES))

    def partitions(self) -> list[InputPartition]:
        packs, pack, full = [], [], 0
        for path, size in listed(self.paths, self.ending):
            k, count = 0, max(1, -(-size // self.size))
            while k < count:
                # Opening a small file costs as much as reading some of a large one, and a task as much as reading many blocks.
                upto = min(count, k + max(1, (max(self.size, BLOCK_BYTES) - full - OPENING) // self.size))
                pack.append((path, size, k, upto))
                full, k = full + (upto - k) * self.size + OPENING, upto
                if full + self.size + OPENING > max(self.size, BLOCK_BYTES):
                    packs.append(pack)
                    pack, full = [], 0
        return [_Blocks(p) for p in ([*packs, pack] if pack or not packs else packs)]

    def read(self, partition: _Blocks) -> Iterator[tuple]:
        for path, size, first, upto in partition.stretches:
            system, name = opened(path)
            with system.open_input_file(name) as f:
                end = _line_start(f, size, first * self.size)
                for k in range(first, upto):
                    high = min((k + 1) * self.size, size)
                    start, end = end, end if high <= end else _line_start(f, size, high)
                    if start < end or not k:  # else one line covers all of the block
                        yield self._told(f, path, size, k, start, end)

    @staticmethod
    def _told(f, path: str, size: int, k: int, start: int, end: int) -> tuple:
        f.seek(start)
        raw = f.read(end - start)
        last = end == size
        n_out, open_out, head = records_ended(raw, False, last)
        n_in, open_in, _ = records_ended(raw, True, last) if b'"' in raw or k else (n_out, open_out, head)
        if b'"' not in raw and k:
            n_in, open_in = int(last and bool(raw)), True
        plain = raw.isascii()
        fits = [plain or _readable(raw, e) for e in ENCODINGS[:-1]]
        return path, k, start, end, fits, open_out, open_in, n_out, n_in, bool(_FILLED.search(raw)), raw[: max(head, 0)] if not k else None


class RecordBlocks(DataSource):
    """Blocks of delimited files with what a scan tells of them; options paths (JSON list), ending, blockBytes."""

    @classmethod
    def name(cls) -> str:
        return "record_blocks"

    def schema(self) -> str:
        return (
            "path string, block int, start long, end long, fits array<boolean>, open_outside boolean, open_inside boolean, "
            "ended_outside long, ended_inside long, filled boolean, head binary"
        )

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options)


def blocks(spark: SparkSession, paths: list[str] | str, ending: str = ".csv", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: path, block, start, end, inside (it begins within quotes), encoding, row (records that end before
    it), ended, filled, head (the file's first record). An empty file has one block."""
    spark.dataSource.register(RecordBlocks)
    given = json.dumps([paths] if isinstance(paths, str) else list(paths))
    found = spark.read.format("record_blocks").option("paths", given).option("ending", ending).option("blockBytes", block_bytes).load()
    found = materialise(found, "blocks")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    # A block ends alike in either case, or keeps the state, or turns it.
    alike = F.when(F.col("open_outside") == F.col("open_inside"), F.col("open_outside"))
    turns = (F.col("open_outside") & ~F.col("open_inside")).cast("int")
    turned = F.coalesce(F.sum(turns).over(earlier), F.lit(0))
    noted = found.withColumns({"_alike": alike, "_turned": turned})
    since = F.coalesce(F.last(F.when(F.col("_alike").isNotNull(), F.col("_turned")), True).over(earlier), F.lit(0))
    known = F.coalesce(F.last("_alike", True).over(earlier), F.lit(False))
    noted = noted.withColumn("inside", known != ((F.col("_turned") - since) % 2 == 1))
    noted = noted.withColumn("ended", F.when(F.col("inside"), F.col("ended_inside")).otherwise(F.col("ended_outside")))
    fits = [F.min(F.col("fits")[k]).over(whole) for k in range(len(ENCODINGS) - 1)]
    encoding = F.coalesce(*[F.when(f, e) for f, e in zip(fits, ENCODINGS)], F.lit(ENCODINGS[-1]))
    head, row = F.max("head").over(whole), F.coalesce(F.sum("ended").over(earlier), F.lit(0))
    return noted.select("path", "block", "start", "end", "inside", encoding.alias("encoding"), row.alias("row"), "ended", "filled", head.alias("head"))


def _decoded(raw: bytes, encoding: str) -> str:
    return re.sub("\r(?!\n)", " ", raw.decode(encoding))


def parsed(text: str) -> list[list[str]]:
    """The records of ``text``; a line break within quotes belongs to its cell, a blank line is a record without cells."""
    csv.field_size_limit(sys.maxsize)
    return list(csv.reader(io.StringIO(text, newline="")))


def block_records(path: str, start: int, end: int, inside: bool, encoding: str) -> Iterator[list[str]]:
    """The records that begin in the block, the last of them whole; one by one, so that no more than its bytes is held."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        size = f.size()
        f.seek(start)
        raw, more = f.read(end - start), 1 << 20
        if inside:
            _, _, behind = records_ended(raw, True, end == size)
            if behind < 0:
                return  # all of it belongs to a record of an earlier block
            raw = raw[behind:]
        tail, open_ = 0, False  # the last quote, and whether it is still open
        for at, _, closed in quoted_spans(raw, False):
            tail, open_ = at, not closed
        while open_ and f.tell() < size:
            raw += f.read(more)
            more *= 2
            _, still, behind = records_ended(raw[tail:], False, f.tell() >= size)
            if behind >= 0:
                raw, open_ = raw[: tail + behind], False
    csv.field_size_limit(sys.maxsize)
    lines = io.BytesIO(raw.removeprefix(b"\xef\xbb\xbf") if start == 0 else raw)
    del raw
    yield from csv.reader(_decoded(line, encoding) for line in lines)


def _spread(table: DataFrame) -> DataFrame:
    """A task for each block of :data:`BLOCK_BYTES`, or for as many smaller ones, if there are more of them than cores."""
    n, total = table.agg(F.count(F.lit(1)), F.sum(F.col("end") - F.col("start"))).first()
    tasks = max(-(-(total or 0) // BLOCK_BYTES), table.sparkSession.sparkContext.defaultParallelism)
    return table.repartition(max(1, min(n, tasks, 100_000)), "path", "block")


def cells_of(table: DataFrame, carried: list[str]) -> DataFrame:
    """(carried columns, path, row_no, cells) of all records of the blocks of ``table``; records count from 1 after ``row``."""
    kinds = [f"`{c}` {table.schema[c].dataType.simpleString()}" for c in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            cells: list[list[str]] = []
            own: list[int] = []  # the block of each row

            def told() -> pa.RecordBatch:
                same = [batch.column(c).take(pa.array(own, pa.int32())) for c in (*carried, "path")]
                made = pa.RecordBatch.from_arrays([*same, pa.array(rows, pa.int64()), pa.array(cells, pa.list_(pa.string()))], [*carried, "path", "row_no", "cells"])
                for held in (rows, cells, own):
                    held.clear()
                return made

            for k in range(batch.num_rows):
                at = {c: batch.column(c)[k].as_py() for c in ("path", "start", "end", "inside", "encoding", "row")}
                found = block_records(*(at[c] for c in ("path", "start", "end", "inside", "encoding")))
                first = at["row"] + at["inside"] + 1
                while part := list(islice(found, 10_000 - len(rows))):
                    rows += range(first, first + len(part))
                    cells += part
                    own += [k] * len(part)
                    first += len(part)
                    if len(rows) >= 10_000:
                        yield told()
            if rows:
                yield told()

    return _spread(table).mapInArrow(run, ", ".join([*kinds, "path string", "row_no long", "cells array<string>"]))


def read_cells(spark: SparkSession, paths: list[str] | str, sheet: str | None = None, every: bool = False, naming: str = r"([^/]+)/([^/]+)\.csv$", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Sheets without headers, exported as delimited text: source_file, source_sheet, sheet_ord, row_no, cells.

    ``naming`` finds workbook and sheet in a file's path (its two groups); several files of one sheet follow each other by
    path. The sheet that is named, or else each workbook's first one with anything in it (the first of all if there is
    none), or with ``every`` all sheets. Rows count from 1, blank ones included; a line break within quotes stays in its
    cell. Files may have any size; an empty folder gives no rows.
    """
    found = blocks(spark, paths, block_bytes=block_bytes).withColumns({c: F.regexp_extract("path", naming, k + 1) for k, c in enumerate(("source_file", "source_sheet"))})
    key = ["source_file", "source_sheet"]
    before = Window.partitionBy(*key).orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    found = materialise(found.withColumn("row", F.coalesce(F.sum("ended").over(before), F.lit(0))), "grid")
    order = F.row_number().over(Window.partitionBy("source_file").orderBy("_path"))
    sheets = found.groupBy(*key).agg(F.min("path").alias("_path"), F.max("filled").alias("_filled")).withColumn("sheet_ord", order).drop("_path")
    if sheet is not None:
        sheets = sheets.where(F.col("source_sheet") == sheet)
    elif not every:
        first = F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("_filled"), "sheet_ord"))
        sheets = sheets.withColumn("_k", first).where("_k = 1").drop("_k")
    chosen = materialise(found.join(sheets.drop("_filled"), key), "sheets")
    out = cells_of(chosen, ["source_file", "source_sheet", "sheet_ord"])
    return out.select("source_file", "source_sheet", "sheet_ord", F.col("row_no").cast("int").alias("row_no"), "cells")
