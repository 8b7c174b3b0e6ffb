"""Personal data in texts by weak supervision: labelers vote, EM weighs them, a span classifier decides.

DataFrame functions only. Every candidate span, base or further, gets a vote of 1, 0 or -1 (abstains) from each labeler:
strict regex, gazetteer, context words, clean boundaries. Besides, it has FEATURES of its surroundings, on which no labeler
votes. How often each combination of kind, votes and features occurs in the whole corpus, at most KINDS x 3**4 x 2**4 rows, is
what the driver sees. Expectation-maximisation on these counts estimates each labeler's reliability and each kind's share of
true spans (Dawid and Skene); a logistic span classifier over kind, votes and features is then trained on the posteriors and
compiled to a column expression. Base spans always stay; further spans count if the classifier says so.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import materialize
from talkgrain.llm.spans import find, listing

#: fixed values: the base kinds; lookbehinds only spare starts that can't match
BASE = [
    ("email", "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"),
    ("ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"),
    ("card", "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){12,18}+(?![\\x20-]?[0-9])"),
    ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]"),
]
MORE = [
    ("local_phone", "(?<![0-9+(.-])\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("ssn", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", "(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){3,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
]
KINDS = [k for k, _ in BASE + MORE]
LABELERS = ["strict", "gazetteer", "context", "boundary"]
#: of the text before (up to NEAR characters, and not over another span of the kind) and the character after: a colon or equals sign leads to the span, it begins a
#: line, a capitalised word is before it, punctuation or the end of the line closes it
FEATURES = {"led": "[:=]\\s*$", "begins": "(?:^|[\\r\\n])\\s*$", "named": "\\b[A-Z][a-z]+[\\s,(<]*$", "closed": "^(?:$|[\\s,.;:!?)>\\]])"}
#: gazetteers, fixed values: top-level domains, calling codes of countries, countries with IBANs
DOMAINS = (
    "com org net edu gov mil int info biz name pro io co ai app dev me tv eu uk de fr es it nl be lu ch at li pl cz sk hu ro bg gr pt ie se dk no fi is "
    "ee lv lt ua ru tr il in pk cn jp kr tw hk sg my th vn id ph au nz ca us mx br ar cl pe za ng ke eg ma ae sa"
).split()
CALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 423 852 853 886 961 962 965 966 968 971 972 973 974"
).split()
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM TN TR UA VA".split()
#: strict forms and gazetteers: fixed values
STRICT = {
    "email": "^[A-Za-z0-9][^@]*@[A-Za-z0-9][A-Za-z0-9.-]*\\.[A-Za-z]{2,24}$",
    "ip": "^[1-9][0-9]{0,2}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}$",
    "card": "^(?:[0-9]{13,19}|[0-9]{4}([\\x20-])[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7})$",
    "phone": "^\\+[0-9]{1,3}[\\x20.-]?\\(?[0-9]{2,4}\\)?(?:[\\x20.-]?[0-9]{2,4}){2,4}$",
    "local_phone": "^\\(?[2-9][0-9]{2}\\)?[\\x20.-][2-9][0-9]{2}[.-][0-9]{4}$",
    "ssn": "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": "^[A-Z]{2}(?!00|01|99)[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\\x20[A-Z0-9]{4}){2,7}(?:\\x20[A-Z0-9]{1,3})?)$",
}
GAZETTEER = {
    "email": f"(?i)\\.(?:{'|'.join(DOMAINS)})$",
    "ip": "^(?!0\\.|127\\.|255\\.|22[4-9]\\.|23[0-9]\\.)",
    "card": "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": f"^\\+(?:{'|'.join(CALLING)})",
    "local_phone": "^\\(?(?!555)",
    "ssn": "^(?!123-45|111-11|078-05)",
    "iban": f"^(?:{'|'.join(IBAN_COUNTRIES)})",
}
CONTEXT = {
    "email": "mail|contact|write|@",
    "ip": "\\bip\\b|host|server|address|login",
    "card": "card|visa|master|credit|debit|pay",
    "phone": "phone|call|tel|mobile|fax|contact",
    "local_phone": "phone|call|tel|mobile|fax|contact",
    "ssn": "ssn|social|security",
    "iban": "iban|bank|account|konto",
}
NEAR = 32
ROUNDS = 50


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn sum."""
    d = F.split(F.reverse(digits(x)), "")
    twice = lambda v: F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)
    worth = F.transform(F.filter(d, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, v: a + v) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.substring(bare, 1, 3).cast("int") <= 255)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, "\\."), _small)
    if kind == "card":
        return luhn(x)
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def _candidates(text: Column, k: int, kind: str, pattern: str) -> Column:
    def voted(x):
        before, after = x["before"], x["after"]
        bare = x["value"] if kind != "card" else digits(x["value"])
        votes = [
            F.when(x["value"].rlike(STRICT[kind]), 1).otherwise(0),
            F.when(bare.rlike(GAZETTEER[kind]), 1).otherwise(0),
            F.when(F.lower(before).rlike(CONTEXT[kind]), 1).otherwise(-1),
            F.when(before.rlike("[A-Za-z0-9._-]$") | after.rlike("[A-Za-z0-9_]"), 0).otherwise(1),
        ]
        seen = [(after if name == "closed" else before).rlike(p).cast("int").alias(name) for name, p in FEATURES.items()]
        return F.struct(F.lit(k).alias("k"), x["start"], F.lit(kind).alias("kind"), x["end"], *[v.alias(n) for v, n in zip(votes, LABELERS, strict=True)], *seen)

    return F.transform(F.filter(find(text, pattern, near=NEAR), lambda x: _valid(kind, x["value"])), voted)


def reliabilities(counts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """EM over (k, votes..., features..., n): each labeler's log odds by vote, as (labelers, 3), and each row's posterior."""
    k = np.array([c[0] for c in counts])
    votes = np.array([c[1 : 1 + len(LABELERS)] for c in counts])
    n = np.array([c[-1] for c in counts], float)
    post = np.clip((votes == 1).sum(1) / np.maximum((votes >= 0).sum(1), 1), 0.05, 0.95)
    odds = np.zeros((len(LABELERS), 3))
    for _ in range(ROUNDS):
        for j in range(len(LABELERS)):
            for v in (-1, 0, 1):
                seen = votes[:, j] == v
                yes = ((post * n)[seen].sum() + 1) / ((post * n).sum() + 3)
                no = (((1 - post) * n)[seen].sum() + 1) / (((1 - post) * n).sum() + 3)
                odds[j, v + 1] = math.log(yes / no)
        share = np.array([((post * n)[k == x].sum() + 2) / (n[k == x].sum() + 4) for x in range(len(KINDS))])
        z = np.log(share / (1 - share))[k] + odds[np.arange(len(LABELERS)), votes + 1].sum(1)
        post = 1 / (1 + np.exp(-z))
    return odds, post


def classifier(counts: list[tuple], post: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier on kind, votes and features, fitted to the posteriors by Newton steps with a ridge."""
    x = np.array([_features(c[0], c[1 : 1 + len(LABELERS)], c[1 + len(LABELERS) : -1]) for c in counts])
    n = np.array([c[-1] for c in counts], float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (n * p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (n * (post - p)) - w)
    return w


def _features(k: int, votes: tuple, seen: tuple) -> list[float]:
    return [float(k == i) for i in range(len(KINDS))] + [float(v == s) for v in votes for s in (0, 1)] + [float(x) for x in seen]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and all: arrays of spans with kind, start, end and score.

    `docs` needs doc_id and text; other columns are not looked at. Null or empty texts have no spans; null and repeated
    doc_ids give a row per row; an empty table gives an empty result. Positions are code points, ends exclusive.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    each = [_candidates(F.col("text"), k, *x) for k, x in enumerate(BASE + MORE)]
    found = materialize(own.select("doc_id", F.concat(*each).alias("spans")), "candidates")
    votes = found.where(F.size("spans") > 0).select(F.explode("spans").alias("x")).groupBy("x.k", *[f"x.{v}" for v in [*LABELERS, *FEATURES]])
    counts = sorted(tuple(r) for r in votes.agg(F.count("*").alias("n")).collect())  # at most KINDS x 3**4 x 2**4 rows
    weights = classifier(counts, reliabilities(counts)[1]) if counts else np.zeros(len(KINDS) + 2 * len(LABELERS) + len(FEATURES))

    def scored(x):
        z = F.element_at(F.array(*[F.lit(float(w)) for w in weights[: len(KINDS)]]), x["k"] + 1)
        for j, name in enumerate(LABELERS):
            no, yes = (float(w) for w in weights[len(KINDS) + 2 * j :][:2])
            z = z + F.when(x[name] == 1, yes).when(x[name] == 0, no).otherwise(0.0)
        for w, name in zip(weights[len(KINDS) + 2 * len(LABELERS) :], FEATURES, strict=True):
            z = z + F.when(x[name] == 1, float(w)).otherwise(0.0)
        return F.struct(x["k"], x["start"], x["kind"], x["end"], (1 / (1 + F.exp(-z))).alias("score"))

    scores = F.array_sort(F.transform("spans", scored))
    held = found.select("doc_id", scores.alias("all")).withColumn("base", F.filter("all", lambda x: x["k"] < len(BASE)))
    # a further span counts if the classifier says so and no base span covers part of it
    alone = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return held.select("doc_id", "base", F.filter("all", lambda x: (x["k"] < len(BASE)) | ((x["score"] >= 0.5) & alone(x))).alias("all"))


def summary(scanned: DataFrame) -> DataFrame:
    """The digest columns of `scan`: counts by kind, hash of the base spans, all spans."""
    is_kind = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("base", is_kind(kind))).cast("long").alias(f"n_{kind}") for kind, _ in BASE]
    return scanned.select("doc_id", *counts, F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(F.col("all")).alias("spans"))
