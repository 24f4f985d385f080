"""Cases in which operators once did less than the whole job."""

import random

import numpy as np

from ledgerloom.llm import embed_dedup, suffix_dedup


def _covered(rows, doc):
    return {j for r in rows if r["doc_id"] == doc for j in range(r["start_word"], r["end_word"])}


def test_passage_that_one_document_repeats_across_ranges(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    words, want = [], set()
    for _ in range(90):
        words += [word() for _ in range(30)]
        want |= set(range(len(words), len(words) + 60))
        words += passage
    other = [word() for _ in range(30)] + passage + [word() for _ in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        rows = suffix_dedup.repeated_passages(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    assert _covered(rows, 1) == want and _covered(rows, 2) == set(range(30, 90))


def test_long_least_passage(spark):
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**6)}"
    long, short = [word() for _ in range(120)], [word() for _ in range(90)]
    texts = [[*long, *(word() for _ in range(30)), *short], [*(word() for _ in range(20)), *short, *(word() for _ in range(20)), *long]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = suffix_dedup.repeated_passages(docs, min_words=100).collect()
    assert _covered(rows, 0) == set(range(120)) and _covered(rows, 1) == set(range(130, 250))


def _recall(n, low, high, pairs=40_000, dim=64):
    """Share of pairs with a cosine of ``low`` to ``high`` that the bands for a table of ``n`` vectors bring together."""
    rng = np.random.default_rng(14)
    bands, turn, met = embed_dedup.banding(n, 0.95), embed_dedup.rotation(dim, embed_dedup.CODE_BITS), 0
    for _ in range(pairs // 2000):
        x, y = embed_dedup.unit(rng.standard_normal((2000, dim))), rng.standard_normal((2000, dim))
        y = embed_dedup.unit(y - (x * y).sum(1, keepdims=True) * x)
        cosine = rng.uniform(low, high, (2000, 1))
        differ = ((x @ turn.T) > 0) != (((cosine * x + np.sqrt(1 - cosine**2) * y) @ turn.T) > 0)
        met += np.any([~differ[:, b].any(1) for b in bands], axis=0).sum()
    return met / pairs


def test_recall_at_the_threshold_at_several_sizes():
    for n in (10**5, 10**6, 10**7):
        assert _recall(n, 0.95, 0.95) >= 0.999, n
