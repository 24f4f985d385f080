"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

A vector is padded, rotated at random and stored as the signs of its components, with the inner product of the vector
and its code as correction factor. Codes do three things: bands of their bits are bucket keys (enough bands for the
target recall); codes alone go to the buckets first, and a vector follows only where its code is near another one; there
a code gives an unbiased estimate of each inner product with a confidence bound, and only pairs whose upper bound
reaches the threshold are computed exactly, in double precision. Equal vectors are one class from the start. A pair is
counted in the first band that brings it together, so nothing is counted twice and pairs never leave the task: a task
returns counts and each vector's smallest partner.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, lgamma, log, log1p, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, numbered, runs_of, smallest_reachable
from .components import components

CODE_BITS = 512
#: Bounds of the estimate in units of its error: a pair beyond is missed with a probability below 1e-6.
BOUND = 5.0
RECALL = 0.9995
#: Rows of a bucket that meet rows of another part of it in one task.
PART = 1024
SEED = 20240


@lru_cache(maxsize=8)
def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """The first ``dim`` columns of a random rotation of ``bits`` dimensions (of ``dim``, if that is more)."""
    side = max(bits, dim)
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((side, side)))
    return (q * np.sign(np.diag(r)))[:, :dim].astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def missed(k: int, bands: int, cosine: float, bits: int = CODE_BITS) -> float:
    """Chance that a pair of this cosine meets in no band of ``k`` bits: all bands draw on the same code, so it is
    averaged over the number of code bits in which the pair differs."""
    far = np.arccos(cosine) / pi
    differ = np.arange(bits + 1)
    chance = np.array([exp(lgamma(bits + 1) - lgamma(d + 1) - lgamma(bits - d + 1) + d * log(far) + (bits - d) * log1p(-far)) for d in differ])
    agree = np.prod(np.maximum(bits - differ[:, None] - np.arange(k), 0) / (bits - np.arange(k)), axis=1)
    return float((chance * (1 - agree) ** bands).sum())


def banding(n: int, threshold: float, recall: float = RECALL, bits: int = CODE_BITS) -> np.ndarray:
    """Bits of each band: longer bands for more vectors, so buckets stay small, and as many as the recall takes."""
    k = min(28, max(8, ceil(log2(max(2, n) / 8))))
    bands = most = 1
    if threshold < 1:
        enough = lambda b: missed(k, b, threshold, bits) <= 1 - recall
        while not enough(most):
            most *= 2
        bands = bisect_left(range(most), True, lo=1, key=enough)
    rng = np.random.default_rng(SEED)
    return np.array([rng.choice(bits, k, replace=False) for _ in range(bands)])


def band_keys(signs: np.ndarray, bands: np.ndarray, dim: int) -> np.ndarray:
    """The bucket key of each band of each code; vectors of another length have other keys."""
    powers = 1 << np.arange(bands.shape[1], dtype=np.int64)
    return (signs[:, bands] * powers).sum(2) * (1 << 20) + dim


def far_apart(threshold: float, bits: int = CODE_BITS) -> int:
    """Bits in which codes at the threshold differ at most, but for BOUND standard deviations."""
    share = np.arccos(threshold) / pi
    return ceil(bits * share + BOUND * (bits * share * (1 - share)) ** 0.5)


def _coded(classes: DataFrame, bands: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column(1)])
            for dim in np.unique(dims):
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = unit(np.asarray(rows.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(len(rows), dim))
                turn = rotation(int(dim), CODE_BITS)
                o = x.astype(np.float32) @ turn.T
                signs = o > 0
                factor = np.abs(o).sum(1) / np.sqrt(o.shape[1])
                keys = band_keys(signs, bands, int(dim))
                code = np.packbits(signs, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor.astype(np.float64)), pa.array(list(keys), pa.list_(pa.int64()))], ["cls", "code", "factor", "keys"]
                )

    return classes.select("cls", "vec").mapInArrow(run, "cls long, code binary, factor double, keys array<long>")


def _near_codes(threshold: float):
    """The rows of a meeting whose code is near one of the other part; rows: band, key, left, right, part, cls, code."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in runs_of(batches, 4):
            left, right, part = (table.column(c).to_numpy() for c in ("left", "right", "part"))
            code = table.column("code").combine_chunks()
            keep = []
            for s, e in zip(starts, ends):
                if e - s < 2:
                    continue
                signs = np.unpackbits(np.stack([np.frombuffer(code[r].as_py(), np.uint8) for r in range(s, e)]), axis=1).astype(np.float32) * 2 - 1
                near = signs @ signs.T >= signs.shape[1] - 2 * far_apart(threshold, signs.shape[1])
                np.fill_diagonal(near, False)
                if left[s] != right[s]:
                    near &= part[s:e, None] != part[None, s:e]
                keep.append(s + np.flatnonzero(near.any(1)))
            if keep:
                yield from table.select(["band", "key", "left", "right", "part", "cls"]).take(pa.array(np.concatenate(keep))).to_batches()

    return run


def _links_in_parts(threshold: float, bands: np.ndarray):
    """Count links within the parts of buckets; rows: band, key, left, right, part, cls, many, factor, code, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in runs_of(batches, 4):
            band = table.column("band").to_numpy()
            left, right, part = (table.column(c).to_numpy() for c in ("left", "right", "part"))
            cls, many, factor = (table.column(c).to_numpy() for c in ("cls", "many", "factor"))
            vec, code = (table.column(c).combine_chunks() for c in ("vec", "code"))
            dims = np.diff(vec.offsets.to_numpy())
            values, at = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts, ends):
                if e - s < 2:
                    continue
                dim, same = int(dims[s]), np.arange(s, e)
                x = unit(np.stack([values[at[r] : at[r + 1]] for r in same]))
                bits = np.stack([np.frombuffer(code[int(r)].as_py(), np.uint8) for r in same])
                turn = rotation(dim, CODE_BITS)
                o = x.astype(np.float32) @ turn.T
                width = o.shape[1]
                positive = np.unpackbits(bits, axis=1)[:, :width]
                signs = positive.astype(np.float32) * 2 - 1
                f = factor[same]
                estimate = (signs @ o.T) / (np.sqrt(width) * f[:, None])
                error = np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(width - 1)
                hopeful = estimate + BOUND * error[:, None] >= threshold
                one = np.flatnonzero(part[same] == left[s])
                two = one if left[s] == right[s] else np.flatnonzero(part[same] == right[s])
                k = int(band[s])
                mine = band_keys(positive, bands[:k], dim)
                open_pairs = hopeful[np.ix_(one, two)]
                if left[s] == right[s]:
                    open_pairs = np.triu(open_pairs, 1)
                many_open = open_pairs.sum() > 4096
                for earlier in range(k if many_open else 0):
                    open_pairs &= mine[one, earlier][:, None] != mine[two, earlier]
                a, b = np.nonzero(open_pairs)
                a, b = one[a], two[b]
                for earlier in range(0 if many_open else k):
                    if not len(a):
                        break
                    fresh = mine[a, earlier] != mine[b, earlier]
                    a, b = a[fresh], b[fresh]
                if not len(a):
                    continue
                exact = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
                a, b = a[exact >= threshold], b[exact >= threshold]
                if not len(a):
                    continue
                w = many[same].astype(np.float64)
                n = np.bincount(a, w[b], len(same)) + np.bincount(b, w[a], len(same))
                order = np.argsort(cls[same], kind="stable")
                place = np.empty(len(same), np.int64)
                place[order] = np.arange(len(same))
                low = smallest_reachable(len(same), place[a], place[b])
                hit = np.flatnonzero(n > 0)
                found.append((cls[same][hit], n[hit].astype(np.int64), cls[same][order][low[place[hit]]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["cls", "links", "low"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Two vectors are linked if their cosine is ``threshold`` or more; all vectors are compared, whatever other columns
    say. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length. ``component_id`` is the smallest id reachable. Rows that repeat an id are vectors of their own,
    linked if they are alike. An empty table gives no rows.
    """
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    sound = F.coalesce(finite, F.lit(False))
    base = base.withColumn("vec", F.when(sound, F.col("vec")))
    classes = base.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("many"))
    classes = materialise(numbered(classes).withColumnRenamed("row", "cls"), "op2-classes")
    bands = banding(classes.count(), threshold)
    coded = materialise(classes.join(_coded(classes, bands), "cls"), "op2-codes")
    spots = coded.select("cls", F.posexplode("keys").alias("band", "key"))
    sizes = spots.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spots = spots.join(sizes, ["band", "key"]).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    spots = spots.withColumn("part", F.pmod(F.xxhash64("cls", "band"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spots = spots.select("cls", "band", "key", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part")
    group = ["band", "key", "left", "right"]
    tasks = 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as rows are few for the work they make
    met = lambda rows: rows.repartition(tasks, *group).sortWithinPartitions(*group)
    codes = met(spots.join(coded.select("cls", "code"), "cls").select(*group, "part", "cls", "code"))
    near = materialise(codes.mapInArrow(_near_codes(threshold), "band int, key long, left int, right int, part int, cls long"), "op2-near")
    rows = met(near.join(coded.select("cls", "many", "factor", "code", "vec"), "cls").select(*group, "part", "cls", "many", "factor", "code", "vec"))
    found = materialise(rows.mapInArrow(_links_in_parts(threshold, bands), "cls long, links long, low long"), "op2-links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("cls").alias("a"), F.col("low").alias("b")), "op2").withColumnRenamed("node", "cls")
    reached = classes.select("cls", "first").join(parts, "cls").groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = classes.join(counts, "cls", "left").join(parts.join(reached, "component").select("cls", "component_id"), "cls", "left")
    by_class = by_class.select(F.col("vec").alias("_vec"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    joined = base.join(by_class, F.col("vec") == F.col("_vec"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
