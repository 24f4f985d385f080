"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans: the four base patterns, and further ones for what these miss (numbers that stand beside
others, addresses spelled out, local numbers, bank accounts, streets). Each kind has labelers of its own that vote for,
against or not at all; checks (Luhn, modulo 97, ranges) are no votes, as a candidate that fails one is never personal
data. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler of a kind is, its
posteriors train a span classifier on surface features, and that decides on what is added. The counts have a fixed number
of rows whatever the input, so they alone pass the driver; texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

KINDS = ("email", "ip", "card", "phone", "local", "ssn", "iban", "street")
BASE_KINDS = 4


class Proposal(NamedTuple):
    """A pattern of a kind, and a cheap test that a text without matches mostly fails."""

    kind: str
    pattern: str
    hint: str


# The patterns. Repeats are possessive or bounded and starts are pinned to the start of a run or the end of
# the match before, so no text takes more than linear time. The first four find what the plain base patterns find. A group of
# a pattern is the third one, after what stands before the match and the match itself.
PROPOSALS = (
    Proposal("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    Proposal("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Proposal("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9](?:[\x20-]?[0-9]){12}"),
    Proposal("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    Proposal("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++", r"[\[({]at[\])}]|\x20at\x20[A-Za-z0-9-]+(?:\.[A-Za-z0-9]|\x20dot\x20)"),
    Proposal("card", r"(?<![0-9])(?:[0-9]{4}([\x20-])[0-9]{4}\3[0-9]{4}\3[0-9]{4}|[0-9]{13,19})(?![0-9])", r"[0-9]{13}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}"),
    Proposal("phone", r"(?:\+1[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}|\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3})(?![0-9])", r"\+[0-9]"),
    Proposal("local", r"(?<![0-9+)(-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
    Proposal("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]{4}"),
    Proposal("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    Proposal("street", r"(?<![A-Za-z0-9])[0-9]{1,5}[a-z]?\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace|Way)(?![A-Za-z])", r"[0-9][a-z]?\x20[A-Z]"),
)
KIND_OF = tuple(KINDS.index(p.kind) for p in PROPOSALS)

# Gazetteers.
COMMON_TLDS = "com|org|net|edu|gov|io|co|info|de|fr|es|it|nl|eu|uk|us|example|test"
PLAIN_WORDS = "a|an|and|are|arrive|available|be|found|here|is|it|live|look|me|meet|not|now|or|out|see|shop|there|us|visit|was|work"
CALLING_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|351|352|353|354|358|420|421"
CARD_PREFIXES = "4|5[1-5]|2[2-7]|34|37|6011|65|35|30|36|38"
PRIVATE_NETS = r"0\.|10\.|127\.|169\.254\.|192\.168\.|255\."
FREE_NUMBERS = "800|833|844|855|866|877|888|900"
SAMPLE_SSNS = ("078051120", "219099999", "123456789")
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
STREET_NAMES = "Main|High|Church|Park|Oak|Elm|Maple|Cedar|Pine|Mill|Station|King|Queen|Victoria|Washington|Lincoln|First|Second|Third|Lake|Hill|North|South|East|West"
CONTEXT_WORDS = {
    "email": "mail|contact|write|reach|reply|from",
    "ip": "ip|host|server|address|login|client|from",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "tel|phone|call|fax|mobile|cell|text|dial|contact|reach",
    "local": "tel|phone|call|fax|mobile|cell|text|dial|contact|reach",
    "ssn": "ssn|social|security|taxpayer",
    "iban": "iban|account|transfer|bank",
    "street": "address|live|lives|ship|home|reside|resides|office|visit",
}
AGAINST_WORDS = "version|release|isbn|order|invoice|part|section|chapter|ref|reference|tracking|serial|build|v"
CONTEXT_CHARS = 40
LABELERS = 4

FOR, AGAINST, NONE = 1, 0, 2


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _modulo_97(m: Column) -> Column:
    """Whether letters and digits, the first four put last and letters read as 10 to 35, leave 1 when divided by 97."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4))), "(?!^)(?!$)")
    step = lambda rest, c: F.when(c.rlike("[0-9]"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(turned, F.lit(0), step) == 1


def passes(kind: str, m: Column) -> Column:
    """The check of a kind: for base kinds, whether a match is a base span."""
    d, n = _digits(m), F.length(_digits(m))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")),
        "card": lambda: n.between(13, 19) & F.call_function("luhn_check", d),
        "phone": lambda: n.between(9, 15),
        "local": lambda: d.rlike("^[2-9][0-9]{2}[2-9]"),
        "ssn": lambda: ~d.rlike("^(?:000|666|9|[0-9]{3}00)|0000$"),
        "iban": lambda: _modulo_97(m),
        "street": lambda: F.lit(True),
    }[kind]()


def _says(condition: Column, other: int = NONE) -> Column:
    return F.when(condition, FOR).otherwise(other)


def labelers(kind: str, m: Column, gap: Column) -> list[Column]:
    """Votes of the kind's labelers on match ``m`` that follows ``gap``: form, gazetteer, what it names, context."""
    d = _digits(m)
    words = rf"(?i)(?<![a-z])(?:{CONTEXT_WORDS[kind]})[a-z]{{0,4}}(?:[^A-Za-z0-9]{{1,3}}[A-Za-z]{{1,6}}){{0,3}}[^A-Za-z0-9]{{0,3}}$"
    context = F.when(gap.rlike(rf"(?i)(?<![a-z])(?:{AGAINST_WORDS})(?:\x20(?:no|number))?[^A-Za-z0-9]{{0,3}}$") | gap.rlike("[A-Za-z0-9/=#$_]$"), AGAINST).when(gap.rlike(words), FOR).otherwise(NONE)
    own: dict[str, Callable[[], list[Column]]] = {
        "email": lambda: [
            F.when(m.contains("@"), _says(m.rlike(r"^[A-Za-z0-9].*@[^.-].*[A-Za-z]{2}$"), AGAINST)).otherwise(_says(m.rlike(r"[\[({]|\x20dot\x20"), AGAINST)),
            _says(m.rlike(rf"[.\x20\])}}](?:{COMMON_TLDS})$")),
            F.when(m.rlike(rf"(?i)^(?:{PLAIN_WORDS})[\x20\[({{@]"), AGAINST).otherwise(_says(m.rlike(r"^[A-Za-z0-9]+[._+-]?[A-Za-z0-9]*[0-9._][A-Za-z0-9]*[\x20\[({@]"))),
        ],
        "ip": lambda: [_says(~m.rlike(r"(?:^|\.)0[0-9]"), AGAINST), _says(~m.rlike(rf"^(?:{PRIVATE_NETS})"), AGAINST)],
        "card": lambda: [_says(m.rlike(r"^(?:[0-9]{4}\x20?){3}[0-9]{4}$|^(?:[0-9]{4}-){3}[0-9]{4}$|^3[0-9]{14}$"), AGAINST), _says(d.rlike(f"^(?:{CARD_PREFIXES})"), AGAINST), _says(~d.rlike(r"([0-9])\1{6}"), AGAINST)],
        "phone": lambda: [_says(m.rlike(r"^\+[0-9]{1,3}[\x20(.-]"), AGAINST), _says(d.rlike(f"^(?:{CALLING_CODES})"), AGAINST), _says(~d.rlike(r"([0-9])\1{6}"), AGAINST)],
        "local": lambda: [_says(m.rlike(r"^\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}$|^[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}$"), AGAINST), F.when(d.rlike(f"^(?:{FREE_NUMBERS})"), AGAINST).otherwise(NONE)],
        "ssn": lambda: [F.when(d.isin(*SAMPLE_SSNS), AGAINST).otherwise(NONE)],
        "iban": lambda: [_says(m.rlike(r"^[A-Z0-9]+$|^(?:[A-Z0-9]{4}\x20)+[A-Z0-9]{1,4}$"), AGAINST), _says(F.concat_ws("", F.left(m, F.lit(2)), F.length(F.replace(m, F.lit(" "), F.lit("")))).isin(*[f"{c}{n}" for c, n in IBAN_LENGTHS.items()]), AGAINST)],
        "street": lambda: [_says(m.rlike(r"^[1-9][0-9]{0,3}[a-z]?\x20"), AGAINST), _says(m.rlike(rf"\x20(?:{STREET_NAMES})\x20")), F.when(m.rlike(r"^(?:1[89]|20)[0-9]{2}\x20"), AGAINST).otherwise(NONE)],
    }
    return [*own[kind](), context]


def _packed(votes: list[Column]) -> Column:
    out = F.lit(0)
    for j in range(LABELERS):
        out = out + 3**j * (votes[j] if j < len(votes) else F.lit(NONE))
    return out


#: Groups of surface features: of each group a candidate has one.
FEATURE_GROUPS = 3


def _features(m: Column, gap: Column) -> Column:
    """A match's length, its digits, and what stands before it."""
    before = F.when(gap == "", 0).when(gap.rlike("[ ]$"), 1).when(gap.rlike("[A-Za-z0-9]$"), 2).otherwise(3)
    return F.array(F.least((F.length(m) / 3).cast("int"), F.lit(15)), 20 + F.least(F.length(_digits(m)), F.lit(20)), 50 + before)


SPOT = "struct<start:int,end:int,gap:string,m:string>"
#: Matches placed at once: an array that grows by one is copied each time, so long lists are put together from blocks.
BLOCK = 64


def _placed(pairs: Column) -> Column:
    """Places of the matches of an array of (text before, match)."""
    width = lambda x: F.length(x["g"]) + F.length(x["m"])

    def spot(at: Column, x: Column) -> Column:
        return F.struct((at + F.length(x["g"])).alias("start"), (at + width(x)).alias("end"), F.right(x["g"], F.lit(CONTEXT_CHARS)).alias("gap"), x["m"].alias("m"))

    def within(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.expr(f"cast(array() as array<{SPOT}>)").alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct((acc["at"] + width(x)).alias("at"), F.concat(acc["out"], F.array(spot(acc["at"], x))).alias("out")), lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPOT}>>)").alias("out"))
    whole = F.aggregate(
        blocks, start,
        lambda acc, block: F.struct((acc["at"] + F.aggregate(block, F.lit(0), lambda n, x: n + width(x))).alias("at"), F.concat(acc["out"], F.array(within(block, acc["at"]))).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(F.size(pairs) > 0, whole).otherwise(F.expr(f"cast(array() as array<{SPOT}>)"))


def candidates(text: Column) -> Column:
    """All matches of all proposals: array of (proposal, start, end, valid, votes, features); places count code points."""
    found = []
    for k, p in enumerate(PROPOSALS):
        gapped = F.lit(rf"(?s)\G(.*?)({p.pattern})")
        pairs = F.arrays_zip(F.regexp_extract_all(text, gapped, F.lit(1)).alias("g"), F.regexp_extract_all(text, gapped, F.lit(2)).alias("m"))
        spots = F.when(text.rlike(p.hint), _placed(pairs)).otherwise(F.expr(f"cast(array() as array<{SPOT}>)"))
        found.append(F.transform(spots, _judge(k)))
    return F.concat(*found)


def _judge(k: int) -> Callable[[Column], Column]:
    kind = PROPOSALS[k].kind

    def judged(x: Column) -> Column:
        votes = _packed(labelers(kind, x["m"], x["gap"]))
        return F.struct(F.lit(k).alias("proposal"), x["start"].alias("start"), x["end"].alias("end"), F.coalesce(passes(kind, x["m"]), F.lit(False)).alias("valid"), votes.alias("votes"), _features(x["m"], x["gap"]).alias("features"))

    return judged


#: What is held of a labeler before any candidate is seen: it is right eight times in ten, as if seen so on ten candidates of each class.
STARTS = ((8.0, 2.0), (2.0, 8.0))  # by class: votes against, votes for


def vote(votes: int, labeler: int) -> int:
    return votes // 3**labeler % 3


def estimate(patterns: list[tuple[int, int, bool, int]], steps: int = 100) -> tuple[dict[tuple[int, int], float], dict[int, list[tuple[float, float]]]]:
    """Expectation-maximisation over (proposal, votes, passes the check, count).

    Gives the posterior of the candidates with a vote pattern that pass their check, and P(vote for | class, voted) of each
    kind's labelers. Each proposal has a share of its own of class 1, while labelers belong to the kind. What fails a check
    is of class 0 for sure. An abstention says nothing, and a vote for never speaks against. A labeler that votes alike on
    all candidates of a kind tells none of them apart: it counts, with its start, only where all labelers of the kind do so.
    """
    post: dict[tuple[int, int], float] = {}
    reliable: dict[int, list[tuple[float, float]]] = {}
    for kind in sorted({KIND_OF[p] for p, *_ in patterns}):
        mine = [x for x in patterns if KIND_OF[x[0]] == kind]
        chance = [tuple(s[1] / sum(s) for s in STARTS)] * LABELERS
        varied = [len({vote(v, j) for _, v, *_ in mine} - {NONE}) == 2 for j in range(LABELERS)]
        heard = [j for j in range(LABELERS) if varied[j] or not any(varied)]
        share = {p: 0.5 for p, *_ in mine}
        for _ in range(steps):
            weight = [{FOR: max(0.0, log(one / zero)), AGAINST: min(0.0, log((1 - one) / (1 - zero))), NONE: 0.0} for zero, one in chance]
            for p, v, ok, _ in mine:
                if ok:
                    odds = log(share[p] / (1 - share[p])) + sum(weight[j][vote(v, j)] for j in heard)
                    post[p, v] = 1 / (1 + exp(-max(-50.0, min(50.0, odds))))
            soft = [(p, v, post[p, v] if ok else 0.0, n) for p, v, ok, n in mine]
            for p in share:
                share[p] = (sum(q * n for x, _, q, n in soft if x == p) + 1) / (sum(n for x, _, _, n in soft if x == p) + 2)
            for j in range(LABELERS):
                if varied[j]:
                    seen = [list(s) for s in STARTS]
                    for _, v, q, n in soft:
                        if vote(v, j) != NONE:
                            seen[0][vote(v, j)] += n * (1 - q)
                            seen[1][vote(v, j)] += n * q
                    chance[j] = tuple(s[1] / sum(s) for s in seen)
        reliable[kind] = chance
    return post, reliable


def surface_weights(counts: list[tuple[int, int, bool, int, int]], post: dict[tuple[int, int], float]) -> dict[tuple[int, int], float]:
    """Naive Bayes over (proposal, votes, passes, feature, count): log ratio of each kind's features, from the posteriors."""
    sums: dict[tuple[int, int], list[float]] = {}
    totals: dict[int, list[float]] = {}
    for proposal, v, ok, feature, n in counts:
        kind, q = KIND_OF[proposal], post[proposal, v] if ok else 0.0
        for into in (sums.setdefault((kind, feature), [0.0, 0.0]), totals.setdefault(kind, [0.0, 0.0])):
            into[0] += n * (1 - q)
            into[1] += n * q
    # Each candidate counts once in every group of features.
    return {(k, f): log((yes + 0.5) / (totals[k][1] / FEATURE_GROUPS + 1)) - log((no + 0.5) / (totals[k][0] / FEATURE_GROUPS + 1)) for (k, f), (no, yes) in sums.items()}


def _lookup(values: dict[int, float]) -> Column:
    if not values:
        return F.lit(None).cast("map<int,double>")
    return F.expr("map(" + ", ".join(f"{k}, {float(v)!r}D" for k, v in sorted(values.items())) + ")")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    ``spans`` lists kind:start:end by kind (as in ``KINDS``), then start: all base spans, and what the trained classifier
    takes of the further proposals, unless a base span or a taken one of an earlier kind overlaps it. Nothing that fails
    its kind's check is added. Null text is empty; texts of any length are read whole. A table without candidates trains
    nothing and adds nothing; in a table of few or uniform candidates the labelers' starting reliabilities decide, and
    what has as much for it as against it is not added. Rows that repeat are judged as often, other columns are not
    read, and an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = materialise(docs.select(F.col(id_col).alias("doc_id"), candidates(text).alias("spans")), "op6-candidates")
    kind_of = F.array(*[F.lit(k) for k in KIND_OF])
    kind = lambda s: F.element_at(kind_of, s["proposal"] + 1)
    one = spans.select(F.explode("spans").alias("s")).select("s.proposal", "s.votes", "s.valid", F.explode("s.features").alias("feature"))
    # At most 11 proposals x 81 votes x 2 x 41 features.
    counts = [(r["proposal"], r["votes"], r["valid"], r["feature"], r["n"]) for r in one.groupBy("proposal", "votes", "valid", "feature").agg(F.count(F.lit(1)).alias("n")).collect()]
    patterns: dict[tuple[int, int, bool], int] = {}
    for p, v, ok, feature, n in counts:
        if feature < 20:  # one a candidate
            patterns[p, v, ok] = patterns.get((p, v, ok), 0) + n
    post, _ = estimate([(*key, n) for key, n in sorted(patterns.items())])
    by_votes = _lookup({p * 81 + v: log((q + 1e-9) / (1 - q + 1e-9)) for (p, v), q in post.items()})
    by_feature = _lookup({k * 100 + f: w for (k, f), w in surface_weights(sorted(counts), post).items()})

    def taken(s: Column) -> Column:
        surface = F.aggregate(s["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(by_feature, kind(s) * 100 + f), F.lit(0.0)))
        return F.element_at(by_votes, s["proposal"] * 81 + s["votes"]) + surface > 1e-6

    place = lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda s: (s["proposal"] < BASE_KINDS) & s["valid"]), place)
    more = F.transform(F.filter("spans", lambda s: (s["proposal"] >= BASE_KINDS) & s["valid"] & F.coalesce(taken(s), F.lit(False))), place)
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    out = spans.select("doc_id", base.alias("base"), more.alias("more"))
    free = F.filter("more", lambda s: ~F.exists("base", lambda b: meets(s, b)) & ~F.exists("more", lambda o: (o["kind"] < s["kind"]) & meets(s, o)))
    out = out.select("doc_id", F.array_sort("base").alias("base"), free.alias("added"))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "added"))
    return out.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
