"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic and one on windows of ordinary text: each holds the
windows that set its class apart, by document frequency, after a stock of frequent windows that both share. A window is
a run of characters between blanks, in a fixed frame that is long enough for the compressor to work on; longer runs, as
of scripts without blanks, are read in overlapping windows. How many bytes the toxic dictionary saves on a document's
windows against the ordinary one is turned into a probability by thresholds calibrated on labelled documents that the
dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_sample, materialise

#: Labelled documents of each class to learn from; all that is fitted is bounded by this.
PER_CLASS = 1500
#: Segments of a dictionary, and the shared stock of windows.
SEGMENTS, STOCK = 400, 120
#: Characters of a window; a longer run is read in windows that begin STEP apart.
WIDTH, STEP = 16, 8
#: A word's segments are its beginnings, from STEM characters on; a longer run's are all its pieces of PIECE characters.
STEM, PIECE = 4, range(2, STEP + 1)
#: A segment sets a class apart if it is in so many of its documents and its share there stands out so clearly.
MIN_DOCUMENTS, MIN_Z, MIN_RATIO = 5, 5.0, 4.0
BEFORE, AFTER = b" the ", b" of and in that is of the"
STEPS = (2, 3, 4, 5, 6, 8)
KNOWN_WINDOWS = 400_000
TRIM = ".,;:!?\"'()[]{}<>*-_%&#"


def runs_of_text(text: str) -> list[str]:
    return [w.strip(TRIM) for w in text.lower().split()]


def windows_of(text: str) -> list[str]:
    """The windows of a text: each piece of up to STEP characters of it lies whole in one."""
    return [r[k : k + WIDTH] for r in runs_of_text(text) for k in range(0, max(1, len(r) - WIDTH + STEP), STEP)]


def segments_of(text: str) -> set[str]:
    """What a dictionary can learn of a text, each once: beginnings of words, whole short words, and pieces of longer runs."""
    out: set[str] = set()
    for r in set(runs_of_text(text)):
        if len(r) <= WIDTH:
            out.update(r[:k] for k in range(min(STEM, len(r)), len(r) + 1))
        else:
            out.update(r[at : at + k] for k in PIECE for at in range(len(r) - k + 1))
    out.discard("")
    return out


def window(word: str) -> bytes:
    return BEFORE + word.encode("utf-8", "surrogatepass") + AFTER


class Distance:
    """Bytes that the toxic dictionary saves on a window, remembered for windows that recur."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        params = z.ZstdCompressionParameters(window_log=13, hash_log=11, chain_log=11, search_log=6, min_match=3, target_length=64, strategy=z.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0)

        def sized(content: bytes):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            c = z.ZstdCompressor(compression_params=params, dict_data=d)
            return c.compress

        self.toxic, self.ordinary, self.known = sized(toxic), sized(ordinary), {}

    def _gain(self, word: str) -> int:
        w = window(word)
        g = self.known[word] = len(self.ordinary(w)) - len(self.toxic(w))
        return g

    def features(self, text: str) -> list[float]:
        """How many windows save so many bytes at least (log scale), and the highest savings."""
        if len(self.known) > KNOWN_WINDOWS:
            self.known.clear()
        get, gain = self.known.get, self._gain
        gains = np.array([g if (g := get(w)) is not None else gain(w) for w in windows_of(text)] or [0], dtype=np.int32)
        counts = [np.log1p(np.count_nonzero(gains >= s)) for s in STEPS]
        most = np.partition(gains, -3)[-3:] if len(gains) > 3 else gains
        return [*counts, float(most.max()), float(most.mean()), float(counts[3] - np.log1p(len(gains)))]


def _dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """Train both dictionaries: document frequencies of segments are counted in Spark, the best few hundred come back."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = list(segments_of(text.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], ["segment", "toxic"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1):
                found = list(set(windows_of(text.as_py() or "")))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])

    learn = sample.where("not calibrates").select("toxic", "text")
    n = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return b"", b""
    counts = learn.mapInArrow(emit, "segment string, toxic int").groupBy("segment").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    p1, p0, p = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1), (F.col("a") + F.col("b")) / (n1 + n0)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    scored = materialise(counts.where(F.greatest("a", "b") >= MIN_DOCUMENTS).select("segment", "a", "b", z.alias("z"), (p1 / p0).alias("ratio")), "op5-segments")

    def best(sign: int, support: str) -> list[str]:
        ratio = F.col("ratio") if sign > 0 else 1 / F.col("ratio")
        top = scored.where((sign * F.col("z") > MIN_Z) & (ratio > MIN_RATIO) & (F.col(support) >= MIN_DOCUMENTS)).orderBy(sign * -F.col("z"), "segment").limit(SEGMENTS).collect()
        have = {r["segment"]: r[support] for r in top}
        return [s for s in have if not any(o != s and s in o and have[o] >= 0.8 * have[s] for o in have)]

    frequent = [r["word"] for r in learn.where("toxic = 0").mapInArrow(common, "word string").groupBy("word").count().orderBy(F.desc("count"), "word").limit(STOCK + SEGMENTS).collect()]
    stock = b"".join(map(window, frequent[:STOCK]))
    toxic = b"".join(map(window, reversed(best(1, "a"))))
    ordinary = b"".join(map(window, frequent[STOCK:] + best(-1, "b")))
    return stock + toxic, stock + ordinary[-max(len(toxic), 64) :]


def _measured(docs: DataFrame, toxic: bytes, ordinary: bytes, carried: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(toxic, ordinary)
        for batch in batches:
            features = [distance.features(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.list_(pa.float64()))], ["carried", "features"])

    kind = docs.schema[carried].dataType.simpleString()
    return docs.select(carried, "text").mapInArrow(run, f"carried {kind}, features array<double>")


def calibrated(features: np.ndarray, labels: np.ndarray, prior: float, ridge: float = 0.003, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights by Newton's method on standardised features, moved from the sample's share of 1s to ``prior``."""
    mean, spread = features.mean(0), features.std(0) + 1e-6
    x = np.c_[(features - mean) / spread, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6] * len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep), x.T @ (labels - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    w[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return mean, spread, w


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), saved_bytes.

    Learns from at most ``per_class`` labelled documents of each class whose crc32(id) mod 5 is not 0: two thirds train
    the dictionaries, a third the thresholds. Null and empty texts are scored as texts without windows. Labels that are
    null, or of documents that are not there, teach nothing; of repeated labels of a document the highest holds. With
    no labelled document of either class every score is 0. Rows that repeat get the same score each, a text may have any
    length, and an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    remainder = lambda c: F.crc32(F.col(c).cast("string")) % 5
    learnable = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1)").where(remainder("label_id") != 0)
    learnable = learnable.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    rates = learnable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    n = {r["toxic"]: r["n"] for r in rates.collect()}  # two rows
    chosen = bounded_sample(learnable, "toxic", "label_id", per_class, 2)
    # At most 2 x per_class ids: the broadcast has a fixed size.
    sample = base.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "toxic", "text", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("calibrates"))
    sample = materialise(sample, "op5-sample")
    toxic, ordinary = _dictionaries(sample)
    held = F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out")
    if not toxic:
        return base.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("saved_bytes"))
    judged = _measured(sample.where("calibrates"), toxic, ordinary, "toxic").collect()  # at most 2 x per_class rows
    y = np.array([r["carried"] for r in judged], dtype=float)
    if len(set(y)) < 2:
        judged = _measured(sample, toxic, ordinary, "toxic").collect()
        y = np.array([r["carried"] for r in judged], dtype=float)
    mean, spread, w = calibrated(np.array([r["features"] for r in judged]), y, n.get(1, 0) / max(1, sum(n.values())))
    scored = _measured(base, toxic, ordinary, "doc_id").withColumnRenamed("carried", "doc_id")
    scale, shift = w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())
    logit = F.lit(shift)
    for k, s in enumerate(scale):
        logit = logit + F.lit(float(s)) * F.col("features")[k]
    score = (1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))).alias("score")
    out = scored.select("doc_id", held, score, F.col("features")[len(STEPS)].alias("saved_bytes"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "saved_bytes")
