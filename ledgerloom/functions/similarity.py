"""Text similarity: twice the longest common subsequence over both lengths, of normalised text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .scalars import normalize_text


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one number."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 2.0 * common_subsequence(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of texts that are normalised; each pair of texts of a batch is compared once."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def text_similarity(a, b) -> Column:
    """0 to 1; 0 if either text is blank after normalising."""
    return ratios(normalize_text(a), normalize_text(b))
