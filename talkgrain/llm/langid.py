"""Language identification by word-first backoff.

A word that the model knows scores the log of its relative frequency in each language. An unseen word is scored by its
longest known character n-grams instead: all of its 4-grams that are known, else 3-grams, 2-grams, single characters. The
language with the largest sum is predicted; the score is its softmax share of the mean per word. Words are runs of letters
(Unicode category L); numerals such as fractions and Roman numerals are none.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import discard, materialize

#: labelled rows that are learnt from (about, by hash of doc_id); all their words and n-grams are kept
SAMPLE = 20_000
LONGEST = 4
SMOOTH = 0.5
#: mean log-likelihoods per word are multiplied by this before the softmax
SHARP = 4.0
#: unseen words that a task remembers, and words of a text that are looked up together
REMEMBERED, AT_ONCE = 100_000, 20_000
UNKNOWN = "und"


#: runs of letters and of numerals other than decimal digits
_WORD = re.compile(r"[^\W\d_]+")


@cache
def _letters() -> re.Pattern:
    """Runs of letters: what str.isalpha says, whereas \\w takes other numerals too. Slow, for texts that have such numerals."""
    numerals = [chr(i) for i in range(128, sys.maxunicode + 1) if (c := chr(i)).isalnum() and not c.isalpha() and not c.isdecimal()]
    return re.compile(rf"[^\W\d_{''.join(numerals)}]+")


class Table:
    """Log frequencies by language of words or n-grams, which are known by their 64-bit hashes."""

    def __init__(self, hashes: np.ndarray, langs: np.ndarray, counts: np.ndarray, width: int):
        self.keys, row = np.unique(hashes.astype(np.int64), return_inverse=True)
        table = np.zeros((len(self.keys), width))
        np.add.at(table, (row, langs), counts)
        self.values = np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * max(1, len(table))))

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word, or -1."""
        if not len(self.keys):
            return np.full(len(words), -1)
        h = np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in words), np.uint64, len(words)).view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)


#: what Spark's xxhash64 begins with
_SEED = 42


def fit(labelled: DataFrame) -> dict:
    """Model from (doc_id, text, lang): word and n-gram log frequencies by language.

    About SAMPLE labelled rows are learnt from, by hash of doc_id, and nothing of theirs is left out: the model holds 8 bytes and
    8 a language for each of their words and n-grams. Languages are those of all labelled rows. Null texts and languages are left out; without any the model knows no language.
    """
    langs = sorted(r.lang for r in labelled.where("lang is not null").select("lang").distinct().collect())
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    total = labelled.where("lang is not null").count()
    if total > SAMPLE:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(total)) < SAMPLE)
    split = F.split(F.regexp_replace(F.lower("text"), "[^\\p{L}]+", " "), " ")
    words = rows.select("lang", F.explode(split).alias("t")).where("t <> ''").groupBy("lang", "t").agg(F.count("*").alias("n"))
    words = materialize(words, "words")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - k + 1, F.lit(1))), lambda i: F.substring(F.col("w"), i, k))))
    padded = words.select("lang", "n", F.concat(F.lit("<"), "t", F.lit(">")).alias("w"))
    grams = padded.select("lang", "n", F.explode(grams).alias("t")).groupBy("lang", "t").agg(F.sum("n").alias("n"))
    model = {"langs": langs}
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1 if langs else F.lit(0).cast("long")
    for name, df in (("words", words), ("grams", grams)):
        found = df.select(F.xxhash64("t").alias("h"), number.cast("int").alias("lang"), "n").toArrow()
        model[name] = Table(*(found[c].to_numpy() for c in ("h", "lang", "n")), len(langs))
    discard(words)
    return model


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    return found if not found or "".join(found).isalpha() else _letters().findall(text.lower())


class Scorer:
    """Scores texts; words are looked up together, and remembered with their scores while there is room."""

    def __init__(self, model: dict):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.known: dict[str, int] = {}
        self.table = np.zeros((REMEMBERED + AT_ONCE, len(self.langs)))

    def backoff(self, word: str) -> np.ndarray:
        """Mean of the longest n-grams of an unseen word that are known."""
        padded = f"<{word}>"
        for k in range(LONGEST, 0, -1):
            own = self.grams.rows([padded[i : i + k] for i in range(len(padded) - k + 1)])
            own = own[own >= 0]
            if len(own):
                return self.grams.values[own].mean(axis=0)
        return np.zeros(len(self.langs))

    def learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        for w, row in zip(new, self.words.rows(new).tolist(), strict=True):
            self.table[len(self.known)] = self.words.values[row] if row >= 0 else self.backoff(w)
            self.known[w] = len(self.known)

    def total(self, words: list[str]) -> np.ndarray:
        self.learn(words)
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.langs:
            return UNKNOWN, 0.0
        mean = np.zeros(len(self.langs))
        for i in range(0, len(words), AT_ONCE):
            mean += self.total(words[i : i + AT_ONCE]) / len(words)
        share = np.exp(SHARP * (mean - mean.max()))
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum())


def judge(docs: DataFrame, model: dict) -> Column:
    """struct<lang_pred, score> of the text of each row, as a column of `docs`; see `predict`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("lang_pred string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer(t) for t in texts], columns=["lang_pred", "score"])

    return judged(F.col("text").cast("string"))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    `docs` needs doc_id and text; other columns are not looked at. A text that is null or has no letter, and every text if
    the model knows no language, is 'und' with score 0. Null and repeated doc_ids give a row per row; an empty table
    gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), judge(docs, model).alias("x")).select("doc_id", "x.*")


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of doc_id as text leaves `fold` on division by `folds`; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
