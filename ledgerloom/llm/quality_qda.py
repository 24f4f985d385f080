"""Quality by regularised quadratic discriminant analysis of document statistics.

Each class of labelled documents is a normal distribution of the transformed statistics of a text. Its covariance is
shrunk twice: the correlations towards none, by the share that minimises the expected error of a correlation (which
follows from second and fourth moments), and the variances towards the pooled ones, by a share that falls with the
class's size. A document's score is the difference of its log densities, each a Mahalanobis distance through the
class's Cholesky factor, which is inverted once; two numbers fitted on labelled documents turn it into a probability.
All sums run over all labelled documents in Spark; what comes back is a fixed number of moments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, materialise
from .toxicity import calibrated

#: Labelled documents of each class that the last two numbers are fitted on; they bound nothing else.
PER_CLASS = 3000
#: Documents that the pooled variances weigh as much as in a class's own.
POOLED = 50.0
#: Variance that every statistic has at least, in units of its pooled variance: some never vary in a class.
FLOOR = 0.02
#: From this score on a document is of good quality.
THRESHOLD = 0.3

#: Statistics in the order of the feature vector.
STATISTICS = ("words", "word_length", "distinct_words", "capitals", "symbols", "stressed", "digits", "other_letters", "repeated_lines", "line_length")


def statistics(text: Column) -> Column:
    """The transformed statistics of ``text`` (not null) as an array of doubles.

    Counts go through logarithms and shares through square roots, so that their distributions are nearer to normal and
    no share that is zero for most documents is out of bounds.
    """
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\\n"), lambda x: F.trim(x) != "")
    counts = lambda a: F.struct(F.size(a).cast("double").alias("all"), F.size(F.array_distinct(a)).cast("double").alias("distinct"))
    w, x = F.transform(F.array(words), counts)[0], F.transform(F.array(lines), counts)[0]

    def many(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("double")

    def of(s: Column) -> Column:
        chars = F.greatest(s["letters"] + s["others"], F.lit(1.0))
        share = lambda part, whole: F.sqrt(part / F.greatest(whole, F.lit(1.0)))
        w, x = s["w"], s["x"]
        return F.array(
            F.log1p(w["all"]),
            F.log1p((s["letters"] + s["others"]) / F.greatest(w["all"], F.lit(1.0))),
            F.log1p(w["distinct"]) - F.log1p(w["all"]),
            share(s["capitals"], s["letters"]),
            share(s["symbols"], chars),
            share(s["stressed"], w["all"]),
            share(s["digits"], chars),
            share(s["others"], chars),
            share(x["all"] - x["distinct"], x["all"]),
            F.log1p((s["letters"] + s["others"]) / F.greatest(x["all"], F.lit(1.0))),
        )

    counted = F.struct(
        w.alias("w"), x.alias("x"), many(r"[^\p{L}]+").alias("letters"), many(r"[\p{L}\s]+").alias("others"), many(r"[^\p{Lu}]+").alias("capitals"),
        many(r"[\p{L}\p{M}\p{N}\s.,;:!?'\"()-]+").alias("symbols"), many(r"[^!?]+").alias("stressed"), many(r"[^\p{N}]+").alias("digits"),
    )
    return F.transform(F.array(counted), of)[0]


@dataclass
class Gaussian:
    """A class: prior, mean, and the inverse of the covariance's Cholesky factor with the log of its determinant."""

    log_prior: float
    mean: np.ndarray
    whitener: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whitener.T
        return self.log_prior - 0.5 * (z * z).sum(1) - 0.5 * self.log_det


def shrunk(n: float, sums: np.ndarray, products: np.ndarray, squares: np.ndarray, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance, share of shrinkage of the correlations) from a class's moments about the pooled mean.

    ``products`` are sums of x_i x_j and ``squares`` sums of their squares; the variance of a correlation's estimate is
    taken from both, as if the class's mean were the pooled one.
    """
    mean = sums / n
    raw = products / n
    cov = raw - np.outer(mean, mean)
    variance = (n * np.diag(cov) + POOLED * pooled) / (n + POOLED)
    variance = np.maximum(variance, FLOOR * pooled)
    spread = np.sqrt(np.maximum(np.diag(raw), 1e-12))
    noise = np.maximum(squares / n - raw**2, 0) / np.outer(spread, spread) ** 2 / n
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    correlation = cov / np.outer(scale, scale)
    off = ~np.eye(len(mean), dtype=bool)
    strength = (correlation[off] ** 2).sum()
    share = float(min(1.0, noise[off].sum() / strength)) if strength > 0 else 1.0
    correlation = np.where(off, (1 - share) * correlation, 1.0)
    # Statistics that do not vary in the class have no correlation.
    flat = np.diag(cov) < 1e-10
    correlation[(flat[:, None] | flat) & off] = 0
    return mean, correlation * np.sqrt(np.outer(variance, variance)), share


def gaussian(n: float, total: float, mean: np.ndarray, cov: np.ndarray) -> Gaussian:
    factor = np.linalg.cholesky(cov + 1e-9 * np.eye(len(cov)) * np.trace(cov) / len(cov))
    return Gaussian(float(np.log(n / total)), mean, np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum()))


@dataclass
class Model:
    """Standardisation, both classes, and the two numbers of the calibration."""

    centre: np.ndarray
    scale: np.ndarray
    good: Gaussian
    poor: Gaussian
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        return self.good.log_density(x) - self.poor.log_density(x)

    def scores(self, features: np.ndarray) -> np.ndarray:
        # Far from both classes the difference grows with the square of the distance; its root tells as much.
        return 1 / (1 + np.exp(-np.clip(self.slope * tamed(self.log_odds(features)) + self.shift, -30, 30)))


def tamed(odds: np.ndarray) -> np.ndarray:
    return np.sign(odds) * np.log1p(np.abs(odds))


def moments(rows: DataFrame, centre: np.ndarray, scale: np.ndarray) -> dict[int, tuple]:
    """For each label: (n, sums, sums of products, sums of squared products) of the standardised ``features``.

    Tasks send one array a label, and these are added up by place: a few hundred rows come back, whatever the input.
    """
    d = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column("label").to_numpy()
            x = (batch.column("features").flatten().to_numpy().reshape(-1, d) - centre) / scale
            for k in np.unique(label):
                own = x[label == k]
                sums = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel(), ((own**2).T @ own**2).ravel()])
                totals[int(k)] = totals.get(int(k), 0) + sums
        for k, sums in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums], pa.list_(pa.float64()))], ["label", "sums"])

    parts = rows.select("label", "features").mapInArrow(run, "label int, sums array<double>").select("label", F.posexplode("sums").alias("at", "value"))
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["label"], np.zeros(1 + d + 2 * d * d))[r["at"]] = r["value"]
    return {k: (v[0], v[1 : d + 1], v[d + 1 : d + 1 + d * d].reshape(d, d), v[d + 1 + d * d :].reshape(d, d)) for k, v in out.items()}


def learn(rows: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fit a model on ``rows`` (label 0 or 1, features, spin); None where a label has fewer than two documents."""
    d = len(STATISTICS)
    rough = moments(rows, np.zeros(d), np.ones(d))
    if any(rough.get(k, (0,))[0] < 2 for k in (0, 1)):
        return None
    total = rough[0][0] + rough[1][0]
    centre = (rough[0][1] + rough[1][1]) / total
    variance = np.diag(rough[0][2] + rough[1][2]) / total - centre**2
    scale = np.sqrt(np.maximum(variance, 1e-8))
    fine = moments(rows, centre, scale)
    within = sum(np.diag(p) - s**2 / n for n, s, p, _ in fine.values()) / total
    pooled = np.maximum(within, 1e-3)
    classes = {k: gaussian(n, total, *shrunk(n, s, p, q, pooled)[:2]) for k, (n, s, p, q) in fine.items()}
    model = Model(centre, scale, classes[1], classes[0])
    # ``per_class`` of either label at most, by a hash of the id.
    judged = [r for k in (0, 1) for r in rows.where(F.col("label") == k).orderBy("spin").limit(per_class).select("label", "features").collect()]
    y = np.array([r["label"] for r in judged], dtype=float)
    odds = tamed(model.log_odds(np.array([r["features"] for r in judged])))
    mean, spread, w = calibrated(odds[:, None], y, fine[1][0] / total)
    model.slope = float(max(w[0] / spread[0], 0.0))
    model.shift = float(w[1] - model.slope * mean[0])
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD`` on), log_odds.

    Learns from all labelled documents whose crc32(id) mod 5 is not 0; ``per_class`` bounds only what the calibration's
    two numbers are fitted on. Null texts are empty, and empty texts have statistics like any other. Labels that are
    null or of documents that are not there teach nothing; of repeated labels of a document the highest holds, and a
    document that repeats teaches as often. With fewer than two documents of a label every score is the share of good
    labels (0 without any). Rows that repeat get the same score each; an empty table gives no rows.
    """
    measured = materialise(docs.select(F.col(id_col).alias("doc_id"), statistics(F.coalesce(F.col(text_col), F.lit(""))).alias("features")), "op13-features")
    remainder = lambda c: F.crc32(F.col(c).cast("string")) % 5
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").where(remainder("label_id") != 0)
    known = known.groupBy("label_id").agg(F.max("label").alias("label"))
    rows = measured.join(known, F.col("doc_id") == F.col("label_id")).select("label", "features", F.xxhash64("doc_id", F.lit(13)).alias("spin"))
    rows = materialise(rows, "op13-labelled")
    model = learn(rows, per_class)
    held = F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out")
    if model is None:
        share = float(rows.agg(F.avg("label")).first()[0] or 0.0)
        return measured.select("doc_id", held, F.lit(share).alias("score"), F.lit(int(share >= THRESHOLD)).alias("predicted"), F.lit(0.0).alias("log_odds"))
    kind = measured.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            if not batch.num_rows:
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x)), pa.array(model.log_odds(x))], ["doc_id", "score", "log_odds"])

    scored = measured.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double, log_odds double")
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "log_odds")
