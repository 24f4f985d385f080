"""Filter audit, Merkle manifest and quality classifier against plain loops, and on odd tables."""

import hashlib
import itertools
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import filter_audit, merkle_manifest, quality_qda, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, part string, tree string, label string"
WORDS = "ab cd ef gh ij kl mn op qr st".split()


def _rows():
    rng = random.Random(5)
    plain = " ".join(f"w{k}" for k in range(210))
    texts = [None, "", "", plain, plain, plain + " $", " ".join(WORDS * 25), plain.upper(), "\n".join(WORDS), "é\n😀", "x" * 300_000, plain + "\n" * 3]
    rows = [(k, t, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None]), k, 1, "z", "t", "l") for k, t in enumerate(texts)]
    rows += [rows[4], (4, plain + " other", "en", "a", 1, 1, "z", "t", "l"), (None, plain, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [(200 + k, "a\nb" * k, "en", "b", 1, 1, "z", "t", "l") for k in range(6)]
    return rows + [(100 + k, rng.choice(texts[:8]), "en", "hot", 3, 1, "z", "t", "l") for k in range(60)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


def _words(text):
    out = text
    for c in "\t\n\x0b\f\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def _fails(row, rows):
    t = row[1] or ""
    w = _words(t)
    return {
        "A": len(w) < 200,
        "B": 100 * len(set(w)) < 50 * len(w),
        "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
        "D": any(c in "#$%&*|" for c in t),
        "E": row[0] is not None and any(r[0] is not None and r[0] < row[0] and (r[1] or "") == t for r in rows),
    }


def test_audit_equals_playing_every_order(spark, odd):
    rows = _rows()
    marks = {k: (k % 2, int(k % 3 == 0)) for k in range(0, 160, 2)}
    labels = spark.createDataFrame([(k, q, t) for k, (q, t) in marks.items()] + [(3, None, None), (5, 0, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    marks[5] = (1, 1)
    failed = [(r, _fails(r, rows)) for r in rows]
    want, shapley = {}, defaultdict(int)
    for part in {r[2] or "" for r in rows}:
        own = [(r, f) for r, f in failed if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [(r, f) for r, f in left if f[x]]
                left = [(r, f) for r, f in left if not f[x]]
                mark = [marks.get(r[0], (0, 0)) for r, _ in gone]
                alone = sum(f[x] and sum(f.values()) == 1 for _, f in own)
                want[part, "".join(order), k + 1] = [len(left), len(gone), sum(f[x] for _, f in own) - len(gone), alone, sum(m[0] for m in mark), sum(m[1] for m in mark)]
                shapley[part, x] += len(gone)
    got = filter_audit.audit(odd, labels).collect()
    assert len(got) == len(want) == 600 * 3
    for r in got:
        key = r["part"], r["filter_order"], r["step"]
        assert [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")] == want[key]
        assert r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]
    assert filter_audit.audit(odd.where("false"), labels).count() == 0
    kept = filter_audit.without_failures(odd, "E")
    assert kept.columns == odd.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r, (_, f) in zip(odd.collect(), failed) if not f["E"])


def test_large_groups_of_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "TOGETHER", 10)
    docs = spark.createDataFrame([(k, f"text {k % 7 if k % 3 else 0}") for k in range(300)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    base = filter_audit._base(docs, "doc_id", "text", "lang")
    later = {r["doc_id"] for r in filter_audit.later_copies(base, base.drop("text")).collect()}
    first = {}
    for k in range(300):
        first.setdefault(k % 7 if k % 3 else 0, k)
    assert later == set(range(300)) - set(first.values())


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    told = [str(v) if v is not None else None for v in (row[0], row[3], row[2], row[4], text)]
    return _h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in told))


def _plain_tree(leaves):
    """(top, path of each leaf) by going up level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, p in enumerate(paths):
            run = at[k] // 3 * 3
            p.append((level[run : at[k]], level[at[k] + 1 : run + 3]))
        level = [_h(*level[k : k + 3]) for k in range(0, len(level), 3)]
        at = [k // 3 for k in at]
    return level[0], paths


def _plain_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    tops, inside = [], []
    for s in names:
        mine = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        top, paths = _plain_tree([_leaf(r, r[1]) for r in mine])
        tops.append(top)
        inside.append((mine, paths))
    root, above = _plain_tree(tops)
    out = []
    for (mine, paths), top, high in zip(inside, tops, above):
        for r, p in zip(mine, paths):
            steps = p + high
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = _leaf(r, r[1].replace("\n", "") if even and r[1] else r[1])
            for before, after in steps:
                at = _h(*before, at, *after)
            out.append((r[0], _leaf(r, r[1]), top, root, _h(*(x for b, a in steps for x in b + a)), at, at == root))
    return out


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_level_by_level(spark, odd, height):
    got = merkle_manifest.audited(odd, height=height).collect()
    want = _plain_manifest(_rows())
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r["verified"] for r in got} == {True, False}
    assert merkle_manifest.audited(odd.where("false"), height=height).count() == 0


def test_one_document_is_its_own_root(spark, odd):
    r = merkle_manifest.audited(odd.where("doc_id = 8")).first()
    assert r["root"] == r["subroot"] == r["leaf"] and r["proof_sha256"] == _h() and r["verified"] == (r["folded_root"] == r["root"])


def test_places_in_the_log():
    for n in range(1, 90):
        for levels in (len(merkle_manifest.level_sizes(n)) - 1, 6):
            leaves = [str(k) for k in range(n)]
            log = merkle_manifest.append_log(leaves, levels)
            level = leaves
            for k in range(levels + 1):
                assert [log[merkle_manifest.postorder_place(k, i, n, levels)] for i in range(len(level))] == level
                level = [_h(*level[i : i + 3]) for i in range(0, len(level), 3)]
            assert len(log) == sum(merkle_manifest.level_sizes(n, levels))


def test_proofs_fold_to_the_root(odd):
    for r in merkle_manifest.proofs(merkle_manifest.manifest(odd, height=2)).collect():
        assert merkle_manifest.folded(r["leaf"], [(s["before"], s["after"]) for s in r["proof"]]) == r["root"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest"])
def test_query_equals_sql(spark, name):
    import duckdb

    for t in ("documents", "labels"):
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = duckdb.sql(queries.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.select(*names).fetchall())


def test_statistics_of_a_text(spark):
    text = "Ab ab\nAB! 12\n\nAb ab"
    got = spark.range(1).select(quality_qda.statistics(F.lit(text))).first()[0]
    letters, others = 10, 3
    log = np.log1p
    want = [log(6), log((letters + others) / 6), log(4) - log(6), (4 / 10) ** 0.5, 0, (1 / 6) ** 0.5, (2 / 13) ** 0.5, (others / 13) ** 0.5, (1 / 3) ** 0.5, log(13 / 3)]
    assert np.allclose(got, want)


def test_moments_and_densities(spark):
    rng = np.random.default_rng(3)
    d = len(quality_qda.STATISTICS)
    mix = rng.normal(size=(d, d))
    x = {0: rng.normal(size=(400, d)) @ mix + 1, 1: rng.normal(size=(900, d)) * 0.3}
    rows = spark.createDataFrame([(k, [float(v) for v in r], int(rng.integers(1 << 40))) for k, m in x.items() for r in m], "label int, features array<double>, spin long").repartition(7)
    got = quality_qda.moments(rows, np.full(d, 0.5), np.full(d, 2.0))
    for k, m in x.items():
        z = (m - 0.5) / 2
        n, s, p, q = got[k]
        assert n == len(m) and np.allclose(s, z.sum(0)) and np.allclose(p, z.T @ z) and np.allclose(q, (z**2).T @ z**2)
        mean, cov, share = quality_qda.shrunk(n, s, p, q, np.ones(d))
        assert 0 <= share <= 1 and np.linalg.eigvalsh(cov).min() > 0
        g = quality_qda.gaussian(n, 1300, mean, cov)
        direct = np.log(n / 1300) - 0.5 * np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean) - 0.5 * np.linalg.slogdet(cov)[1]
        assert np.allclose(g.log_density(z), direct, atol=1e-4)
    model = quality_qda.learn(rows)
    assert (model.scores(x[1]) > 0.5).mean() > 0.95 and (model.scores(x[0]) < 0.5).mean() > 0.95
    assert quality_qda.learn(rows.where("label = 1")) is None


def test_quality_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)] + [(3, None), (999, 1)], "doc_id long, quality int")
    out = quality_qda.quality(odd, labels).collect()
    assert len(out) == len(_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] is None}) <= 2
    assert quality_qda.quality(odd.where("false"), labels).count() == 0
    one = quality_qda.quality(odd, labels.where("quality = 1")).collect()
    assert {r["score"] for r in one} == {1.0}
    none = quality_qda.quality(odd, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.0} and {r["predicted"] for r in none} == {0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_quality_of_documents_that_are_held_out(spark):
    folder = SF.replace("0.001", "0.01")
    found = queries.op13_quality_classifier(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good = [r["predicted"] for r in found if r["quality"] == 1]
    poor = [r["predicted"] for r in found if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(poor) / len(poor) < 0.1
