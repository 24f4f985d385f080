"""Weak supervision of personal data: the estimates, the classifier and what is added, against plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pii


def _votes(votes):
    return sum(3**j * v for j, v in enumerate(votes + [pii.NONE] * (pii.LABELERS - len(votes))))


def _card(rng, prefix):
    d = [int(c) for c in prefix] + [rng.randrange(10) for _ in range(15 - len(prefix))]
    total = sum(x if i % 2 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(d))
    return "".join(map(str, d)) + str(-total % 10)


def _iban(rng):
    body = "".join(str(rng.randrange(10)) for _ in range(18))
    return f"DE{98 - int(body + '131400') % 97:02d}{body}"


def _planted():
    """Texts with (kind, span) of what is personal data beyond the base patterns, and ones with what only looks like it."""
    rng = random.Random(5)
    num = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    local = lambda: f"{rng.randrange(2, 8)}{num(2)}-{rng.randrange(2, 10)}{num(2)}-{num(4)}"
    rows = []

    def put(before, what, kind, after=" and so on"):
        at = len(before)
        rows.append((before + what + after, (kind, at, at + len(what)) if kind else None))

    for k in range(40):
        put(f"Please call me at {k} or call ", f"({rng.randrange(2, 8)}{num(2)}) {rng.randrange(2, 10)}{num(2)}-{num(4)}", "local")
        put("Write to ", f"jo{k}.doe [at] mail{k} [dot] org", "email")
        put("my social security number is ", f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", "ssn")
        put("transfer to IBAN ", _iban(rng), "iban")
        put("She lives at ", f"{rng.randrange(2, 999)} {rng.choice(['Oak', 'Mill', 'Garden'])} Street", "street")
        put(f"paid with card 99999999999999{num(5)} ", _card(rng, "45"), "card")
        put("phone ", f"+1 (415) 555-{num(4)}", "phone", f" {num(16)} and so on")
        put("we met at noon; look at ", f"example{k}.com", None)
        put("order ", local(), None)
        put("invoice ", f"{num(4)} {num(4)} {num(4)} {num(4)} {num(4)}", None)
        put("part no ", f"{rng.randrange(900, 999)}-{num(2)}-{num(4)}", None)
        put("code ", f"DE00{num(18)}", None)
        put(f"mail user{k}@example.com from 81.2.69.{k} ", "", None)
    return rows


@pytest.fixture(scope="module")
def planted(spark):
    rows = _planted()
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    return rows, docs, {r["doc_id"]: r for r in pii.personal_data(docs).collect()}


def test_planted_personal_data(planted):
    rows, _, got = planted
    found = [(k, x) for k, r in got.items() for x in r["spans"].split(",") if x]
    base = {k: sum(got[k][f"n_{kind}"] for kind in pii.KINDS[: pii.BASE_KINDS]) for k in got}
    truth = {(k, ":".join(map(str, span))) for k, (_, span) in enumerate(rows) if span}
    assert all(base[k] == 0 for k, _ in truth)  # nothing of it is the base patterns' work
    added = sum(r["n_added"] for r in got.values())
    hits = len(truth & set(found))
    assert hits / len(truth) >= 0.95
    assert hits / added >= 0.95


def test_added_spans_against_plain_python(planted):
    """EM candidate by candidate and naive Bayes in numpy, from the candidates alone."""
    rows, docs, got = planted
    spans = [(r["doc_id"], s) for r in docs.select("doc_id", pii.candidates(F.col("text")).alias("s")).collect() for s in r["s"]]
    want = {k: set() for k in got}
    for kind, name in enumerate(pii.KINDS):
        mine = [(k, s) for k, s in spans if pii.KIND_OF[s["proposal"]] == kind]
        if not mine:
            continue
        votes = np.array([[s["votes"] // 3**j % 3 for j in range(pii.LABELERS)] for _, s in mine])
        valid = np.array([s["valid"] for _, s in mine])
        proposal = np.array([s["proposal"] for _, s in mine])
        one, zero = np.full(pii.LABELERS, 0.8), np.full(pii.LABELERS, 0.2)
        share = dict.fromkeys(proposal.tolist(), 0.5)
        varied = [{0, 1} <= set(votes[:, j]) for j in range(pii.LABELERS)]
        for _ in range(100):
            logit = np.array([math.log(share[p] / (1 - share[p])) for p in proposal])
            for j in (j for j in range(pii.LABELERS) if varied[j] or not any(varied)):
                logit += np.where(votes[:, j] == 1, max(0, np.log(one[j] / zero[j])), np.where(votes[:, j] == 0, min(0, np.log((1 - one[j]) / (1 - zero[j]))), 0))
            q = np.where(valid, 1 / (1 + np.exp(-np.clip(logit, -50, 50))), 0)
            for p in share:
                share[p] = (q[proposal == p].sum() + 1) / ((proposal == p).sum() + 2)
            for j in range(pii.LABELERS):
                if varied[j]:
                    yes, no = votes[:, j] == 1, votes[:, j] == 0
                    one[j] = (8 + q[yes].sum()) / (10 + q[yes | no].sum())
                    zero[j] = (2 + (1 - q)[yes].sum()) / (10 + (1 - q)[yes | no].sum())
        surface = np.zeros(len(mine))
        for g in range(pii.FEATURE_GROUPS):
            value = np.array([s["features"][g] for _, s in mine])
            for x in set(value):
                surface[value == x] += np.log((q[value == x].sum() + 0.5) / (q.sum() + 1)) - np.log(((1 - q)[value == x].sum() + 0.5) / ((1 - q).sum() + 1))
        score = np.log((q + 1e-9) / (1 - q + 1e-9)) + surface
        for (k, s), ok, x in zip(mine, valid, score):
            if ok and (s["proposal"] < pii.BASE_KINDS or x > 1e-6):
                want[k].add((s["proposal"] >= pii.BASE_KINDS, kind, s["start"], s["end"]))
    for k, taken in want.items():
        meets = lambda a, b: a[2] < b[3] and b[2] < a[3]
        left = [a for a in taken if not a[0] or not any(meets(a, b) and (not b[0] or b[1] < a[1]) for b in taken)]
        assert got[k]["spans"] == ",".join(f"{pii.KINDS[a[1]]}:{a[2]}:{a[3]}" for a in sorted(left, key=lambda a: a[1:])), rows[k]


def test_reliabilities_are_recovered():
    """Votes drawn with known reliabilities: EM finds them, also where one labeler knows nothing."""
    rng = random.Random(8)
    right = [0.9, 0.8, 0.7, 0.5]
    patterns: dict[int, int] = {}
    truth: dict[int, list[int]] = {}
    for _ in range(40_000):
        c = int(rng.random() < 0.4)
        votes = [pii.NONE if rng.random() < 0.2 else c if rng.random() < p else 1 - c for p in right]
        patterns[_votes(votes)] = patterns.get(_votes(votes), 0) + 1
        truth.setdefault(_votes(votes), []).append(c)
    post, reliable = pii.estimate([(1, v, True, n) for v, n in patterns.items()])
    for (zero, one), p in zip(reliable[pii.KIND_OF[1]], right):
        assert abs(one - p) < 0.03 and abs(zero - (1 - p)) < 0.03
    assert sum(n * post[1, v] for v, n in patterns.items()) / 40_000 == pytest.approx(0.4, abs=0.02)
    known = lambda v: math.log(0.4 / 0.6) + sum({pii.FOR: 1, pii.AGAINST: -1, pii.NONE: 0}[pii.vote(v, j)] * math.log(p / (1 - p)) for j, p in enumerate(right))
    hits = sum((post[1, v] > 0.5) == bool(c) for v, cs in truth.items() for c in cs)
    best = sum((known(v) > 0) == bool(c) for v, cs in truth.items() for c in cs)  # by who knows the reliabilities
    assert hits >= 0.995 * best


def test_checks_are_hard_and_uniform_tables_defined(spark):
    texts = ["call me at 415-555-2671", "card 4111 1111 1111 1112 here", "+1 (415) 555-2671 4012888888881882"] * 20
    got = [r["spans"] for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["local:11:23", "", "phone:0:17"] * 20
    assert pii.estimate([]) == ({}, {})


def test_bank_account_check(spark):
    rng = random.Random(9)
    good = [_iban(rng) for _ in range(30)] + ["GB82 WEST 1234 5698 7654 32"]
    bad = [x[:-1] + str((int(x[-1]) + 1) % 10) for x in good]
    rows = spark.createDataFrame([(x,) for x in good + bad], "m string").select(pii.passes("iban", F.col("m")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True] * len(good) + [False] * len(bad)


def test_long_texts_take_linear_time(spark):
    """Runs that each pattern could go through again from every place."""
    runs = ["a" * 300_000 + " at ", "1234 " * 60_000, "DE12 " + "ABCD " * 60_000, "12 " + "Oak " * 60_000, "a@b" + ".c" * 100_000, "x at y" + " dot z" * 50_000, "+1 " * 60_000, "123-45-" * 40_000]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")).collect()}
    assert got[4]["n_email"] == 1 and len(got) == len(runs)
    assert re.fullmatch(r"email:0:\d+", got[4]["spans"])
