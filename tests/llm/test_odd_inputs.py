"""Every operator and stage on odd tables: nulls, empty and very long texts, repeated rows, clashing column names, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import binpack, curriculum_mix, embed_dedup, exact_dedup, lang_id, ngram_join, pii, secret_scan, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, kept boolean, h long, _hash long"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()


def _rows():
    text = " ".join(WORDS * 6)
    long = " ".join(f"{w}{k}" for k in range(1500) for w in WORDS[:8])
    texts = [None, "", "   \n", text, text, text + " tail", "12345 67890", "à é́ 😀 ñ", long, text.upper(), "a"]
    rows = [(k, t, None if k == 3 else "en", None if k == 4 else f"s{k % 2}", 0, 9, 9, True, 1, 1) for k, t in enumerate(texts)]
    return rows + [rows[3], (None, text, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (3, None), (3, 1), (99, 1)], "doc_id long, toxic int")


OPERATORS = {
    "op1": lambda d, lb: ngram_join.similar_documents(d),
    "op3": lambda d, lb: secret_scan.secrets(d),
    "op4": lambda d, lb: lang_id.identify(d, lang_id.learn(d)),
    "op5": lambda d, lb: toxicity.toxicity(d, lb),
    "op6": lambda d, lb: pii.personal_data(d),
    "op7": lambda d, lb: exact_dedup.exact_groups(d),
    "op9": lambda d, lb: curriculum_mix.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(odd, labels, name):
    out = OPERATORS[name](odd, labels).collect()
    assert len(out) == len(_rows())
    assert OPERATORS[name](odd.where("false"), labels).count() == 0


def test_pack_and_repeats(odd):
    packed = binpack.pack(odd).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all() and len(packed) >= len(_rows())
    assert binpack.pack(odd.where("false")).count() == 0
    spans = suffix_dedup.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in spans} == {(3, 0, 90), (4, 0, 90), (5, 0, 90)}
    assert suffix_dedup.repeated_passages(odd.where("false")).count() == 0
    left = {r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeats(odd.where("doc_id in (3, 5)")).collect()}
    assert left[5].strip() == "tail"


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (0, [1.0, 0.1]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cls", F.lit(1))
    got = sorted((r["vec_id"] is None, r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(df).collect() if r["vec_id"] is not None)
    assert got == sorted((False, v, n, c) for v, n, c in [(0, 3, 0), (0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10)])
    assert embed_dedup.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, odd, name, stage):
    out = stage(spark, odd, "")
    assert out.columns == odd.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect())
    if name == "exact_dedup":
        assert ids == [0, 2, 3, 5, 6, 7, 8, 9, 10]  # one blank is not the empty text
    if name == "language_id":
        assert not {0, 1, 2, 6} & set(ids)
    if name == "near_dedup":
        assert {0, 1, 2, 3, 8} <= set(ids) and not {4, 5} & set(ids)
    if name != "source_mix":
        assert {r["_hash"] for r in out.collect()} <= {1, None}  # a column of theirs under a name of ours
    assert stage(spark, odd.where("false"), "").count() == 0


def test_packing_stage(spark, odd):
    name, stage = corpus_pipeline.STAGES[-1]
    out = stage(spark, odd, "").toPandas()
    assert name == "packing" and out.groupby("sequence_id").length.sum().max() <= 2048
    assert stage(spark, odd.where("false"), "").count() == 0


def test_pipeline_end_to_end(spark, tmp_path):
    """What the stages do to a small corpus, told by plain Python."""
    import random

    rng = random.Random(31)
    prose = lambda n: " ".join(rng.choice("the and that with this from have there would about garden river stone".split()) + str(rng.randrange(30)) for _ in range(n))
    texts = [prose(60) for _ in range(12)]
    near = texts[0].split()
    near[30] = "changed"
    texts += [texts[1].replace(" ", "  "), " ".join(near) + " and more", "1234 5678", "", None]
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = set(range(12))  # 12 is a copy of 1, 13 is near 0, 14 to 16 have no letters
    assert set(out.doc_id) <= kept
    sizes = {k: len(texts[k].split()) for k in kept}
    assert all(out[out.piece == 0].doc_id.value_counts().max() <= 3 for _ in [0])
    assert sum(sizes[k] for k in out[out.piece == 0].doc_id) >= 0.9 * sum(sizes.values())
    assert out.groupby("sequence_id").length.sum().max() <= 2048


def test_texts_of_megabytes(spark):
    """Two near copies of 3 MB, and a text with thousands of matches."""
    long = " ".join(f"word{k % 5003} part{k}" for k in range(150_000))
    many = " ".join(f"user{k}@mail.example.com token={k:024x}" for k in range(3000))
    docs = spark.createDataFrame([(0, long, "a", "en"), (1, long + " end", "b", "en"), (2, many, "a", "en"), (3, long, "b", "en")], "doc_id long, text string, source string, lang string")
    similar = {r["doc_id"]: r["n_links"] for r in ngram_join.similar_documents(docs).collect()}
    assert similar == {0: 2, 1: 2, 2: 0, 3: 2}
    groups = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs).collect()}
    assert groups == {0: 0, 1: 1, 2: 2, 3: 0}
    spans = {(r["doc_id"], r["start_word"], r["end_word"], r["first"]) for r in suffix_dedup.repeated_passages(docs).collect()}
    assert spans == {(0, 0, 300_000, True), (1, 0, 300_000, False), (3, 0, 300_000, False)}
    found = {r["doc_id"]: (r["n_assign"], r["n_hex"]) for r in secret_scan.secrets(docs).collect()}
    assert found[2] == (3000, 3000) and found[0] == (0, 0)
    assert {r["doc_id"]: r["n_email"] for r in pii.personal_data(docs.where("doc_id = 2")).collect()} == {2: 3000}
    pieces = binpack.pack(docs).toPandas()
    assert pieces.groupby("doc_id").piece.max().to_dict()[0] > 100 and pieces.groupby("sequence_id").length.sum().max() <= 2048
