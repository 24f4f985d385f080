"""Input listing, CSV families with differing headers and encodings, and result sinks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import month_from_filename, month_from_path, text
from ..operators.scratch import materialise
from .records import BLOCK_BYTES, _decoded, _spread, block_records, blocks, parsed

EXTENSIONS = ("xlsx", "xls", "xlsm", "csv")


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path``: path, name, stem, ext, size, relative, top; lock files are left out, contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    root = path.rstrip("/").split(":")[-1].replace("//", "/")
    relative = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/"), f"^.*{root.lstrip('/')}/", "")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), F.col("length").alias("size"), relative.alias("relative"))
    top = F.when(F.col("relative").contains("/"), F.split("relative", "/")[0]).otherwise("")
    return out.where(F.col("ext").isin(*EXTENSIONS) & ~F.col("name").startswith("~$")).withColumn("top", top)


def standard_name(header: str) -> str:
    return header.lstrip("﻿").strip().lower().replace(" ", "_")


def probe_files(spark: SparkSession, paths: list[str] | str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per file: path, encoding (the first that reads all of it), the first line, and the names in it. Empty files included."""
    firsts = blocks(spark, paths, block_bytes=block_bytes).where("block = 0").select("path", "encoding", "head")

    @F.pandas_udf("struct<head:string,names:array<string>>")
    def told(heads: pd.Series, encodings: pd.Series) -> pd.DataFrame:
        text = [_decoded(bytes(h).removeprefix(b"\xef\xbb\xbf"), e).strip("\r\n") for h, e in zip(heads, encodings)]
        return pd.DataFrame({"head": text, "names": [(parsed(t) or [[]])[0] for t in text]})

    return firsts.select("path", "encoding", told("head", "encoding").alias("t")).select("path", "encoding", "t.head", "t.names")


def read_settlement_csv(spark: SparkSession, paths: list[str] | str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """CSV files with differing headers and encodings as one table: names in lower case with _, the first of repeated
    names, cells trimmed, nan and None blank, and the file in ``source_file`` and ``source_path``.

    Files and folders may hold any number of bytes: a file's encoding is that of all its blocks, line breaks within
    quotes stay in their cells, and blank lines are no rows. Cells that a row lacks are blank, cells beyond the names are
    left out, names that a file lacks are null. Only distinct headers pass the driver; files are read once for encodings
    and quotes and once for their rows.
    """
    table = materialise(blocks(spark, paths, block_bytes=block_bytes), "csv")
    headers = table.where("block = 0").select("encoding", "head").distinct().collect()  # a row for each kind of file
    heads: dict[tuple[bytes, str], list[str]] = {}
    for r in headers:
        first = parsed(_decoded(bytes(r["head"] or b"").removeprefix(b"\xef\xbb\xbf"), r["encoding"]))
        names = [standard_name(n) for n in first[0]] if first else []
        if any(names):
            heads[bytes(r["head"]), r["encoding"]] = names
    union = sorted({n for names in heads.values() for n in names})
    if not union:
        return spark.createDataFrame([], "source_file string, source_path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                names = heads.get((r["head"], r["encoding"]))
                if names is None:
                    continue  # nothing to name the columns by
                found = block_records(r["path"], r["start"], r["end"], r["inside"], r["encoding"])
                rows = (x for x in islice(found, int(r["start"] == 0), None) if x)
                place = {n: k for k, n in reversed(list(enumerate(names)))}
                while part := list(islice(rows, 10_000)):
                    told = [[x[place[n]] if place[n] < len(x) else "" for x in part] if n in place else [None] * len(part) for n in union]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in told), pa.array([r["path"]] * len(part))], [*union, "source_path"])

    raw = _spread(table).mapInArrow(run, ", ".join([*(f"`{n}` string" for n in union), "source_path string"]))
    cell = lambda n: F.when(F.col(f"`{n}`").isNull(), F.lit(None)).when(text(f"`{n}`").isin("nan", "None"), "").otherwise(text(f"`{n}`"))
    return raw.select(*[cell(n).alias(n) for n in union], F.element_at(F.split("source_path", "/"), -1).alias("source_file"), "source_path")


def load_clean(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cleaned CSV table with the given schema; no rows where the path does not exist."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_result(df: DataFrame, path: str, kind: str = "parquet", by: str | None = None) -> None:
    out = df.write.mode("overwrite")
    out = out.partitionBy(by) if by else out
    out.parquet(path) if kind == "parquet" else out.option("header", True).csv(path)


def file_index(rows: DataFrame, probes: DataFrame, default_year: int = 2022) -> DataFrame:
    """Per file: month told by its path, type told by its columns, rows, and an error where there is nothing to read.

    ``rows`` have source_path; ``probes`` (path, head, names) come from :func:`probe_files`.
    """
    from ..operators.layout import settlement_class

    counts = rows.groupBy(F.col("source_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    names = F.transform("names", lambda c: F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")))
    told = probes.join(counts, "path", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "header": names})
    blank = ~F.exists("names", lambda c: F.trim(c) != "")
    kind = F.when(blank, "error").otherwise(settlement_class("header", "n"))
    return told.select("path", month_from_path("path", default_year).alias("month"), kind.alias("type"), "n", F.when(blank, "no header").otherwise("").alias("error"))


def sheet_index(rows: DataFrame, sheets: DataFrame, default_year: int = 2022) -> DataFrame:
    """Per sheet of ``sheets`` (source_file, source_sheet): kind told by its name, month told by the file's, and the rows taken from it."""
    from ..operators.layout import sheet_class

    key = ["source_file", "source_sheet"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    told = sheets.select(*key).distinct().join(counts, key, "left")
    return told.select(*key, sheet_class("source_sheet").alias("kind"), month_from_filename("source_file", default_year).alias("month"), F.coalesce("n", F.lit(0)).alias("n"))
