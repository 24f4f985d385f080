"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Every whole text is read once, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, and how long group 2 or the match must be.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex")

#: Candidate strings of the entropy scan: runs of key characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
#: Bits a character that a window must reach, by the class of its characters. A window of 20 can reach 4.32 bits.
MIN_BITS = {"hex": 3.0, "alnum": 3.55, "base64": 3.7}
#: Not secrets: candidates of a fixed form, and windows that touch a word of sample values.
ALLOWED = (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", r"[0-9/_.-]+", r"[=_+/-]+")
SAMPLE_WORDS = r"example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token)|xxxx|0123456789|abcdefgh|test[_-]?key"

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII).finditer
_access = re.compile(ACCESS).finditer
_hex = re.compile(HEX).finditer
_candidate = re.compile(CANDIDATE).finditer
_allowed = re.compile("|".join(f"(?:{p})" for p in ALLOWED)).fullmatch
_sample_words = re.compile(SAMPLE_WORDS, re.IGNORECASE | re.ASCII).finditer
_keyword = re.compile(r"passw|secret|token|api_?key").search
_digit = re.compile(r"[0-9]").search
_letter = re.compile(r"[A-Za-z]").search

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long, entropy_bits double"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base patterns, leftmost non-overlapping within each kind."""
    found = []
    if _keyword(text.lower()):
        found += [(m.start(), 0, m.end()) for m in _assign(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _hex(text)]
    return sorted(found)


def character_class(run: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    return "alnum" if run.isalnum() else "base64"


def entropy_spans(run: str, window: int = WINDOW, min_bits: dict[str, float] = MIN_BITS) -> list[tuple[int, int, float]]:
    """Stretches of ``run`` that windows at or above the entropy of its class cover: (start, end, highest bits).

    Moving the window by one changes two counts, so the sum of n log n is kept up to date instead of counted anew.
    Windows that overlap a sample word do not count; the rest of the run does.
    """
    if len(run) < window or _allowed(run):
        return []
    least = min_bits[character_class(run)]
    term = [0.0] + [n * log2(n) for n in range(1, window + 2)]  # the new character comes before the old one goes
    counts: dict[str, int] = {}
    total, out = 0.0, []
    words = [m.span() for m in _sample_words(run)]
    word = 0
    for at, new in enumerate(run):
        n = counts.get(new, 0)
        counts[new] = n + 1
        total += term[n + 1] - term[n]
        if at >= window:
            old = run[at - window]
            n = counts[old]
            counts[old] = n - 1
            total += term[n - 1] - term[n]
        if at >= window - 1:
            bits = log2(window) - total / window
            start, end = at - window + 1, at + 1
            while word < len(words) and words[word][1] <= start:
                word += 1
            if word < len(words) and words[word][0] < end:
                continue
            part = run[start:end]
            if bits >= least and _digit(part) and _letter(part):
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], end, max(out[-1][2], bits))
                else:
                    out.append((start, end, bits))
    return out


def scan(text: str) -> tuple[int, int, int, str, str, int, float]:
    base = base_spans(text)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
    extra, best = [], 0.0
    for m in _candidate(text):
        if not _digit(m[0]):
            continue
        for a, b, bits in entropy_spans(m[0]):
            best = max(best, bits)
            extra.append((m.start() + a, len(KINDS), m.start() + b))
    every = said if not extra else ",".join(f"{(*KINDS, 'entropy')[k]}:{a}:{b}" for a, k, b in sorted(base + extra))
    return (*counts, hashlib.sha256(said.encode()).hexdigest(), every, len(extra), best)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts and digest of the base spans, all spans, and the entropy spans' number.

    ``spans`` lists kind:start:end by start, then kind (assign, access, hex, entropy); places count code points, the
    end is exclusive. Null text is empty; a text without secrets has an empty list. A text may have any length; rows that
    repeat are scanned as often, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy", "entropy_bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mask``; overlapping spans are masked as one. Null stays null."""

    @F.pandas_udf("string")
    def masked(texts):
        def one(text):
            if text is None:
                return None
            out, end = [], 0
            spans = sorted((int(a), int(b)) for a, b in (x.split(":")[1:] for x in scan(text)[4].split(",") if x))
            for a, b in spans:
                if a >= end:
                    out += [text[end:a], mask]
                end = max(end, b)
            return "".join(out) + text[end:]

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text_col, masked(F.col(text_col)))
