"""Text quality by a sparse rule ensemble.

Statistics of a text are split by small boosted trees; every path of every tree is a conjunctive rule over statistics. A
lasso logistic regression over the rules (proximal gradient) leaves a few with a weight, and those are compiled into one
Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: most labelled rows that the trees and the lasso see, least hash first
SAMPLE = 20_000
TREES, DEPTH, BINS, SHRINK, LEAST = 40, 3, 32, 0.3, 20
LASSO, STEPS = 0.002, 400
STATISTICS = [
    "chars", "words", "word_chars", "letters", "upper", "digits", "spaces", "newlines", "punctuation", "symbols", "other_bytes",
    "bars", "marks", "distinct_words", "repeated_words", "top_word", "short_words", "long_words", "lines", "repeated_lines",
    "line_chars", "upper_words", "sentence_words", "bits",
]
_SYMBOLS = np.frombuffer(b"#$%&*@^~`<>{}[]\\=+_/", np.uint8)
_MARKS = np.frombuffer(b"!?", np.uint8)
_PUNCTUATION = np.frombuffer(b".,;:'\"()-", np.uint8)


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a text; all 0 for a null or empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    n = len(data)
    words = data.split()
    if words:
        unique: dict[bytes, int] = {}
        for w in words:
            unique[w] = unique.get(w, 0) + 1
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        k = len(words)
        own = [float(k), sizes.mean(), len(unique) / k, 1 - sum(1 for v in unique.values() if v == 1) / k, max(unique.values()) / k, (sizes <= 3).mean(), (sizes >= 12).mean(), sum(map(bytes.isupper, words)) / k]
    else:
        own = [0.0] * 8
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = count[count > 0] / n
    rate = lambda what: float(count[what].sum() / n)
    upper, lower = slice(65, 91), slice(97, 123)
    stops = count[[46, 33, 63]].sum()
    return [
        float(len(text)), own[0], own[1], rate(upper) + rate(lower) + rate(slice(192, 256)), rate(upper), rate(slice(48, 58)), rate([32, 9]), rate([10]), rate(_PUNCTUATION), rate(_SYMBOLS), rate(slice(128, 256)),
        rate([124]), rate(_MARKS), own[2], own[3], own[4], own[5], own[6], float(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)), own[7], own[0] / max(1.0, stops), float(-(p * np.log2(p)).sum()),
    ]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        table = np.array([statistics(t) for t in pdf["text"]]).reshape(-1, len(STATISTICS))
        yield pd.concat([pdf[["doc_id"]], pd.DataFrame(table, columns=STATISTICS, index=pdf.index)], axis=1)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of its text, a row per row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInPandas(_measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]


def _tree(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """Grow one regression tree on gradients; every node but the root is a rule."""
    if path:
        rules.append(path)
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-3, -1, 0)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST:
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            c = codes[rows, f]
            gs, hs, ns = (np.bincount(c, w, len(cuts[f]) + 1).cumsum()[:-1] for w in (grad[rows], hess[rows], None))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = -1
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], f, j)
    if best[1] < 0:
        out[rows] = -g / (h + 1)
        return
    _, f, j = best
    left = codes[rows, f] <= j
    for side, keep in ((True, left), (False, ~left)):
        _tree(x, codes, cuts, grad, hess, rows[keep], (*path, (f, side, float(cuts[f][j]))), rules, out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] <= cut) == low for f, low, cut in rule])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, weighted rules) for statistics x and labels y."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return start, []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z, rules = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        out = np.zeros(len(y))
        _tree(x, codes, cuts, p - y, p * (1 - p), np.arange(len(y)), (), rules, out)
        z += SHRINK * out
    rules = list(dict.fromkeys(rules))
    if not rules:
        return start, []
    r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(np.float32)
    scale = np.maximum(r.std(axis=0), 0.02)
    r = (r - r.mean(axis=0)) / scale
    w, b = np.zeros(r.shape[1], np.float32), start
    rate = 4.0 / max(float(np.linalg.eigvalsh(r.T @ r / len(y))[-1]), 1.0)
    v, t = w.copy(), 1.0
    for _ in range(STEPS):  # FISTA
        p = 1 / (1 + np.exp(-(r @ v + b)))
        step = v - rate * (r.T @ (p - y) / len(y))
        new = np.sign(step) * np.maximum(np.abs(step) - rate * LASSO, 0)
        b -= 4 * float((p - y).mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    kept = [(float(a / s), rule) for a, s, rule in zip(w, scale, rules, strict=True) if abs(a) > 1e-4]
    mean = {rule: float(holds(rule, x).mean()) for _, rule in kept}
    return b - sum(a * mean[rule] for a, rule in kept), kept


def compiled(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    """The ensemble's probability as a column over the STATISTICS."""
    z = F.lit(intercept)
    for weight, rule in rules:
        test = F.lit(True)
        for f, low, cut in rule:
            c = F.col(STATISTICS[f])
            test = test & ((c <= cut) if low else (c > cut))
        z = z + F.when(test, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) for every row; learnt from labels.quality of documents for which `train` (over doc_id) holds.

    `docs` needs doc_id and text, `labels` doc_id and quality; other columns are not looked at. Null and empty texts are
    scored by statistics of 0. Null labels are left out; without labels every score is one half. Null and repeated doc_ids give a
    row per row; an empty table gives an empty result.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null").where(train)
    chosen = known.orderBy(F.xxhash64("doc_id"), "y").limit(sample)  # the documented bound, taken as a distributed top-k
    table = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = measured(table.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"))
    fitted = rows.join(F.broadcast(chosen), "doc_id").select(*STATISTICS, "y", "doc_id").toPandas().sort_values(["doc_id", *STATISTICS])
    intercept, rules = fit(fitted[STATISTICS].to_numpy(float), fitted["y"].to_numpy(float)) if len(fitted) else (0.0, [])
    return measured(table).select("doc_id", compiled(intercept, rules).alias("score"))
