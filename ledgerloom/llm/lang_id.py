"""Language identification by hierarchical discrimination.

The language family is predicted first, then one-versus-one linear support vector machines tell the languages of that
family apart. Features are hashed byte trigrams of the whole text; each machine is trained in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_sample, materialise, wrapped

# Families of languages by code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi ur bn mr ne gu pa",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Labelled documents of each language to learn from.
PER_LANGUAGE = 700
FEATURES = 4096
#: Bytes of a model that may go to every task: 32,000 machines, for 250 languages of as many families or more in fewer.
#: More is refused with an error; no language is left out.
MOST_BYTES = 512 << 20
UNDETERMINED = "und"


def features_of(text: str) -> np.ndarray:
    """Square roots of hashed byte-trigram counts of the whole lower-case text, scaled to length 1."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if len(b) < 3:
        b = np.concatenate([b, np.full(3 - len(b), 32, np.uint8)])
    x = b.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    counts = np.sqrt(np.bincount((h >> np.uint32(7)) % np.uint32(FEATURES), minlength=FEATURES).astype(np.float32))
    return counts / np.linalg.norm(counts)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def support_vector_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights (bias last) of the squared-hinge linear machine by accelerated gradient, and the slope of its margins' odds.

    Both sides count alike however many rows they have.
    """
    x = np.c_[x, np.ones(len(x), np.float32)]
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1 / (2 * 2 + penalty)
    for k in range(steps):
        short = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (penalty * v - 2 * x.T @ (share * y * short))
        v, w = new + (k / (k + 3)) * (new - w), new
    margin = y * (x @ w)
    slope = 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(slope * margin, -30, 30)))
        slope += float(((share * p * margin).sum() - 1e-3 * slope) / ((share * p * (1 - p) * margin**2).sum() + 1e-3))
        slope = min(max(slope, 0.1), 20.0)
    return w, slope


def _pairs(languages: list[str]) -> tuple[dict[str, list[str]], list[tuple[str, str, str]]]:
    """Languages by family, and the machines to train: (level, one side, other side)."""
    families: dict[str, list[str]] = {}
    for code in sorted(languages):
        families.setdefault(FAMILY_OF.get(code, code), []).append(code)
    pairs = [("family", a, b) for a, b in combinations(sorted(families), 2)]
    return families, pairs + [("language", a, b) for members in families.values() for a, b in combinations(members, 2)]


class Model:
    """All machines; small enough to go with each task (two families of two languages: three machines of 4097 weights)."""

    def __init__(self, families: dict[str, list[str]], machines: dict[tuple[str, str, str], tuple[np.ndarray, float]]):
        self.families = families
        self.keys = list(machines)
        self.weights = np.array([machines[k][0] for k in self.keys], np.float32).reshape(len(self.keys), FEATURES + 1)
        self.slopes = np.array([machines[k][1] for k in self.keys], np.float32)

    def _shares(self, level: str, names: list[str], odds: dict) -> dict[str, float]:
        said = {n: 0.0 for n in names}
        for a, b in combinations(names, 2):
            t = float(np.clip(odds[level, a, b], -30, 30))
            said[a] -= np.log1p(np.exp(-t))
            said[b] -= np.log1p(np.exp(t))
        top = max(said.values())
        weight = {n: float(np.exp(s - top)) for n, s in said.items()}
        return {n: w / sum(weight.values()) for n, w in weight.items()}

    def predict(self, text: str | None) -> tuple[str, str | None, float]:
        if not text or not self.families or not has_letter(text):
            return UNDETERMINED, None, 0.0
        margins = self.slopes * (self.weights[:, :-1] @ features_of(text) + self.weights[:, -1])
        odds = dict(zip(self.keys, margins))
        by_family = self._shares("family", sorted(self.families), odds)
        family = max(by_family, key=by_family.get)
        by_language = self._shares("language", self.families[family], odds)
        language = max(by_language, key=by_language.get)
        return language, family, by_family[family] * by_language[language]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_bytes: int = MOST_BYTES) -> Model:
    """Train on at most ``per_language`` documents of each language with crc32(id) mod 3 not 1 and a text.

    All languages are learnt, one machine a task. If their machines would take more than ``most_bytes``, a ValueError says
    so. Without labelled documents nothing is learnt, and every text is ``und``.
    """
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    labelled = labelled.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    # Codes that are not listed have machines for every two of them: with more languages than these there are too many.
    enough = len(FAMILY_OF) + 2 + int((2 * most_bytes / (4 * (FEATURES + 1))) ** 0.5)
    found = [r["lang"] for r in labelled.select("lang").distinct().limit(enough).collect()]
    families, pairs = _pairs(found)
    if 4 * (FEATURES + 1) * len(pairs) > most_bytes:
        raise ValueError(f"{len(found)} languages or more take {len(pairs)} machines, more than {most_bytes} bytes hold: give a larger most_bytes or group languages into families")
    if not pairs:
        return Model(families, {})
    chosen = bounded_sample(labelled.select("doc_id", "lang"), "lang", "doc_id", per_language, len(found))
    # At most per_language ids a language, and languages have a bound: the broadcast has one, too.
    ids = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct())
    sample = labelled.join(ids, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = pa.array([features_of(t.as_py()).tobytes() for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), features], ["doc_id", "lang", "features"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    sample = materialise(sample.mapInArrow(measured, f"doc_id {kind}, lang string, features binary"), "op4-sample")
    sides = [(level, a, b, side, code) for level, a, b in pairs for side, name in ((1, a), (-1, b)) for code in (families[name] if level == "family" else [name])]
    table = sample.sparkSession.createDataFrame(sides, "level string, a string, b string, side int, code string")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "doc_id"], kind="stable")
        x = np.frombuffer(b"".join(group["features"]), np.float32).reshape(len(group), FEATURES)
        w, slope = support_vector_machine(x, group["side"].to_numpy(np.float32))
        return pd.DataFrame({"level": group["level"].iloc[:1], "a": group["a"].iloc[:1], "b": group["b"].iloc[:1], "w": [w.tobytes()], "slope": [slope]})

    trained = sample.join(F.broadcast(table), F.col("lang") == F.col("code")).groupBy("level", "a", "b").applyInPandas(train, "level string, a string, b string, w binary, slope double").collect()
    return Model(families, {(r["level"], r["a"], r["b"]): (np.frombuffer(r["w"], np.float32), r["slope"]) for r in trained})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Predictions for every row: doc_id, held_out, lang_pred, score, family; with ``keep`` the row as ``doc`` and the prediction as ``p``.

    A null text, or one without a letter, is ``und`` with score 0. A text may have any length: its trigrams are counted
    in a fixed number of places. Rows that repeat get the same answer each, of equally likely languages the first by
    code is told, and an empty table gives no rows. The model goes to the tasks once, as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,family:string,score:double>")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        predict = shared.value.predict
        return pd.DataFrame([predict(t) for t in texts], columns=["lang_pred", "family", "score"])

    if keep:
        return wrapped(docs, p=predicted(F.col(text_col)))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    out = docs.select(F.col(id_col).alias("doc_id"), held, predicted(F.col(text_col)).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.family")


def reject_undetermined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of ``min_score`` at least, unchanged.

    Rejected are texts that are null, have no letter, or lie between languages; columns stay as they are.
    """
    model = learn(docs, id_col, text_col, lang_col)
    marked = identify(docs, model, id_col, text_col, keep=True)
    return marked.where((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= min_score)).select("doc.*")
