"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded texts.

Folding: compatibility forms and look-alike letters of other scripts become Latin ones, digits and signs beside letters
become the letters they stand for, zero-width characters go. An entry of the lexicon is a word, the beginning of words, or
a phrase; of the entries that match at one place the longest counts, so that a longer entry of no weight is an exception
("trash can" to "trash", a harmless word to a beginning that toxic words share). Weights are log odds learnt from labels, those of a longer
entry shrunk towards its beginning's. A logistic function of the summed weights, alone and divided by length, is the score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: most labelled rows that are learnt from, least hash first
SAMPLE = 20_000
#: lengths of beginnings that may be entries
SHORTEST, LONGEST = 4, 12
#: pseudo-documents of the beginning's rate in a longer entry's, documents an entry needs, documents that a given word counts as
SHRINK, LEAST, GIVEN = 2.0, 3, 2
#: entries that a task counts before it passes them on
KEYS = 500_000
#: an entry counts up to so often in a text, so that one repeated word is not a sermon
OFTEN = 8
#: fixed values: words known without labels, and phrases in which they are harmless
WORDS = ["bastard", "clown", "disgusting", "dumbass", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "retard", "scum", "stupid", "trash", "worthless"]
EXCEPTIONS = ["trash can", "trash bin", "garbage can", "garbage collection", "garbage truck", "clown fish", "class clown", "circus clown", "loser bracket"]
#: fixed values: letters of other scripts that look like Latin ones
_ALIKE = "аa вb еe зe ѕs іi јj кk мm нh оo рp сc тt уy хx һh ԁd ԛq ԝw ҽe ӏl αa βb εe ηn ιi κk νv οo ρp τt υu χx ωw γy ıi ɑa ɡg ɩi ʟl оo օo հh ոn սu".split()
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_FOLD = {ord(a[0]): a[1] for a in _ALIKE} | {ord(a[0].upper()): a[1] for a in _ALIKE if len(a[0].upper()) == 1 and not a[0].upper().isascii()} | _HIDDEN
#: fixed values: digits and signs that stand for letters
_DIGITS = str.maketrans("0134578@$!|", "oieastbasil")
_SIGN = re.compile(r"(?<=[^\W\d_])[0134578@$]+|[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[!|]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
_ACCENTED = re.compile(r"<[a-z]*[^<>\x00-\x7f][^<>]*>")


def fold(text: str) -> str:
    """`text` in lower case with look-alikes, digits beside letters and hidden characters folded; accents stay."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_FOLD)
    return _SIGN.sub(lambda m: m[0].translate(_DIGITS), text.lower())


def marked(text: str | None) -> tuple[str, int]:
    """The folded words of a text as <word><word>..., and how many there are."""
    words = _WORD.findall(fold(text or ""))
    return ("<" + "><".join(words) + ">" if words else ""), len(words)


def plain(text: str) -> str:
    """`text` without accents."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def entries(text: str | None) -> set[str]:
    """The words <w> of a text and the beginnings <p of its words."""
    words = set(_WORD.findall(fold(text or "")))
    return {f"<{w}>" for w in words} | {f"<{w[:k]}" for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each label with each entry, added up by task until KEYS entries are held."""
    toxic, clean = Counter(), Counter()
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            (toxic if y else clean).update(entries(text))
            if len(toxic) + len(clean) > KEYS:
                yield from _emptied(toxic, clean)
    yield from _emptied(toxic, clean)


def _emptied(toxic: Counter, clean: Counter) -> Iterator[pd.DataFrame]:
    keys = list(toxic.keys() | clean.keys())
    for i in range(0, len(keys), 20_000):
        own = keys[i : i + 20_000]
        yield pd.DataFrame({"entry": own, "pos": [toxic[k] for k in own], "neg": [clean[k] for k in own]})
    toxic.clear()
    clean.clear()


class Lexicon:
    """Entries with documents by label, and what follows from them: weights, the automaton, features of a text."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.counts, self.toxic, self.clean = counts, toxic, clean
        self.base = (toxic + 1) / (toxic + clean + 2)
        self.given = {f"<{w}>" for w in WORDS}
        keys = list(dict.fromkeys([*counts, *self.given, *("".join(f"<{w}>" for w in p.split()) for p in EXCEPTIONS)]))
        self.weights = {k: self.weight(k) for k in keys}
        self.all, self.ascii = ahocorasick.Automaton(), ahocorasick.Automaton()
        for k in keys:
            self.all.add_word(k, k)
            if k.isascii():
                self.ascii.add_word(k, k)
        self.all.make_automaton()
        self.ascii.make_automaton()

    def rate(self, entry: str, less: tuple[int, int]) -> float:
        """Share of toxic documents among those with the entry but for one of them, shrunk towards its longest beginning's."""
        parents = [entry[:k] for k in range(len(entry) - 1, SHORTEST, -1)]
        known = next((p for p in parents if p in self.counts), None)
        pos, neg = self.counts.get(entry, (0, 0))
        more = GIVEN if entry in self.given else 0
        above = self.rate(known, less) if known else self.base
        return (pos - less[0] + more + SHRINK * above) / max(pos + neg - sum(less) + more + SHRINK, SHRINK)

    def weight(self, entry: str, less: tuple[int, int] = (0, 0)) -> float:
        if "><" in entry:
            return 0.0
        p = min(max(self.rate(entry, less), 1e-3), 1 - 1e-3)
        return max(float(np.log(p / (1 - p)) - np.log(self.base / (1 - self.base))), 0.0)

    def found(self, text: str | None) -> tuple[Counter, int]:
        """How often each entry matches in a text, of those at one place the longest; words of the text."""
        line, n = marked(text)
        hits = Counter(k for _, k in self.all.iter_long(line)) if line else Counter()
        if not line.isascii():  # accents may hide a plain word
            for word, c in Counter(_ACCENTED.findall(line)).items():
                if next(self.all.iter_long(word), None) is None:
                    hits.update({k: c for _, k in self.ascii.iter_long(plain(word))})
        return hits, n

    def summed(self, hits: Counter, n: int, label: int | None = None) -> list[float]:
        """Features of a text of n words with these hits; with its label, weights without the text's own part in them."""
        less = None if label is None else (label, 1 - label)
        own = [(self.weights[k] if less is None or k not in self.counts else self.weight(k, less), min(c, OFTEN)) for k, c in hits.items()]
        total = sum(w * c for w, c in own)
        return [np.log1p(total), np.log1p(100 * total / (n + 10)), max((w for w, _ in own), default=0.0), np.log1p(sum(w > 0 for w, _ in own))]


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lexicon(rows: DataFrame, toxic: int, clean: int) -> Lexicon:
    """Entries that the labels of `rows` (text, y) single out, and the longer ones that begin like them."""
    counted = rows.mapInPandas(_counted, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counted = counted.where(F.col("pos") + F.col("neg") >= LEAST).cache()  # lost parts are computed anew; bounded by the sample
    n, base = counted.count(), (toxic + 1) / (toxic + clean + 2)
    both = F.col("pos") + F.col("neg")
    term = lambda a, p: F.when(a > 0, a * F.log(a / (both * p))).otherwise(0.0)
    gain = 2 * (term(F.col("pos"), base) + term(F.col("neg"), 1 - base))
    chosen = [r.entry for r in counted.where((F.col("pos") > 2 * base * both) & (gain >= 2 * np.log(n + 1))).select("entry").collect()]
    seeds = [f"<{w}" for w in WORDS] + [k for k in chosen if not k.endswith(">")]
    lengths = sorted({len(k) for k in seeds})
    begins = F.lit(False)
    for k in lengths:
        begins = begins | F.substring("entry", 1, k).isin([s for s in seeds if len(s) == k])
    found = counted.where(begins | F.col("entry").isin(chosen)).collect() if chosen or seeds else []
    counted.unpersist()
    return Lexicon({r.entry: (r.pos, r.neg) for r in sorted(found, key=lambda r: r.entry)}, toxic, clean)


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and regression weights from labels.toxic of documents for which `train` (over doc_id) holds.

    At most `sample` labelled rows are used, least hash first. Null labels and ids are left out. Without labels, or with one class only,
    the given words alone count, with fixed weights of the regression.
    """
    known = labels.select(F.col("doc_id").cast("long"), (F.col("toxic") > 0).cast("int").alias("y")).where("doc_id is not null and y is not null").where(train)
    chosen = known.orderBy(F.xxhash64("doc_id"), "y").limit(sample)  # the documented bound, taken as a distributed top-k
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    sizes = dict(rows.groupBy("y").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, toxic, clean), np.array([0.0, 1.0, 0.5, 0.0, -3.0])
    lexicon = _lexicon(rows, toxic, clean)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon.counts)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lexicon(shared.value, toxic, clean)
        for pdf in batches:
            x = [own.summed(*own.found(t), int(y)) for t, y in zip(pdf["text"], pdf["y"], strict=True)]
            yield pd.DataFrame(np.array(x).reshape(-1, 4), columns=list("abcd")).assign(y=pdf["y"].to_numpy(), doc_id=pdf["doc_id"].to_numpy())

    table = rows.mapInPandas(measure, "a double, b double, c double, d double, y int, doc_id long").toPandas().sort_values(["doc_id", "a", "b", "c", "d", "y"])
    return lexicon, regression(table[list("abcd")].to_numpy(), table["y"].to_numpy(float))


def judged(docs: DataFrame, model: tuple[Lexicon, np.ndarray]) -> Column:
    """Score of the text of each row, as a column of `docs`."""
    lexicon, weights = model
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.counts, lexicon.toxic, lexicon.clean, weights))  # entries learnt from a bounded sample

    @F.pandas_udf("score double, n_hits long, n_words long")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts, toxic, clean, w = shared.value
        own = Lexicon(counts, toxic, clean)
        for texts in batches:
            rows = []
            for t in texts:
                hits, n = own.found(t)
                z = float(np.dot(own.summed(hits, n), w[:-1]) + w[-1])
                rows.append((1 / (1 + np.exp(-z)), sum(hits[k] for k in hits if own.weights[k] > 0), n))
            yield pd.DataFrame(rows, columns=["score", "n_hits", "n_words"])

    return score(F.col("text").cast("string"))


def score(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, n_hits, n_words) for every row of `docs`; learnt from labels.toxic where `train` (over doc_id) holds.

    `docs` needs doc_id and text, `labels` doc_id and toxic; other columns are not looked at. Null and empty texts have no hits and no
    words. Null and repeated doc_ids give a row per row, as they are scored by their own texts; an empty table gives an
    empty result.
    """
    found = judged(docs, fit(docs, labels, train, sample))
    return docs.select(F.col("doc_id").cast("long"), found.alias("x")).select("doc_id", "x.*")
