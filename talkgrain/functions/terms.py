"""Counts, weights and ranks of the words of many documents at once: numpy over Arrow arrays, inside tasks.

A document is a row here, with its words as an array (or an array of sentences, each an array of words), so nothing of it is
shuffled. Documents are taken in parts of about AT_ONCE words, one document at least, so that a task's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

AT_ONCE = 500_000


def with_arrays(df: DataFrame, name: str, kind: str, work: Callable[..., pa.Array], *inputs: str) -> DataFrame:
    """`df` with a column `name`, which `work` makes of the Arrow arrays of `inputs`, in place of these; row by row, without a shuffle."""
    rest = [c for c in df.columns if c not in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), work(*(b.column(c) for c in inputs))], names=[*rest, name])

    made = StructType.fromDDL(f"{name} {kind}").fields
    return df.mapInArrow(run, StructType([*df.select(*rest).schema.fields, *made]))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _list(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def in_parts(docs: pa.Array, nested: bool, work: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """`work` on parts of `docs` of about AT_ONCE words each."""
    sizes = _lengths(docs)
    if nested:
        ends = np.concatenate([[0], np.cumsum(_lengths(docs.flatten()))])
        at = np.concatenate([[0], np.cumsum(sizes)])
        sizes = ends[at[1:]] - ends[at[:-1]]
    part = (np.cumsum(sizes) - sizes) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(docs)]
    found = [work(docs.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return pa.concat_arrays(found).cast(kind) if found else pa.array([], kind)


def _coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each word, and the words by number."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class Sentences:
    """Term counts of the sentences of documents: an entry is a term of a sentence."""

    def __init__(self, docs: pa.Array):
        sentences = docs.flatten()
        words = _lengths(sentences)
        code, names = _coded(sentences.flatten())
        #: by document, its sentences; by sentence, its words, its document and that one's sentences
        self.sizes, self.words = _lengths(docs), words
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)
        self.n = self.sizes[self.doc]
        width = max(len(names), 1)
        cell, count = np.unique(np.repeat(np.arange(len(words)), words) * width + code, return_counts=True)
        #: by entry, its sentence, its count, and its term among those of all documents
        self.row, self.tf = cell // width, count.astype(float)
        own, self.term = np.unique(self.doc[self.row] * width + cell % width, return_inverse=True)
        self.terms = len(own)

    def tf_idf(self) -> np.ndarray:
        """Sum of tf / length * ln(n / df) by sentence, as a share of the document's largest."""
        df = np.bincount(self.term, minlength=self.terms)[self.term]
        raw = np.bincount(self.row, self.tf / self.words[self.row] * np.log(self.n[self.row] / df), len(self.doc))
        top = np.full(len(self.sizes), -np.inf)
        np.maximum.at(top, self.doc, raw)
        top = top[self.doc]
        return np.where(top > 0, raw / np.where(top > 0, top, 1.0), 0.0)

    def ranks(self, damping: float, rounds: int, tolerance: float) -> np.ndarray:
        """Power iteration on cosine similarities of term counts, each document until it changes by less than `tolerance`.

        Similarities are products of the sentences' unit vectors of terms, so a round multiplies by these vectors and their
        transpose, in proportion to the entries and without a matrix of sentences. Rows without neighbours leak their mass.
        """
        size, doc, n = len(self.doc), self.doc, self.n
        unit = self.tf / np.sqrt(np.bincount(self.row, self.tf**2, size))[self.row]
        row, term = self.row, self.term
        linked = np.bincount(row, np.bincount(term, minlength=self.terms)[term] > 1, size) > 0

        def weighed(x: np.ndarray) -> np.ndarray:
            """Sums of x over the other sentences of the document by their similarity."""
            own = unit * x[row]
            return np.bincount(row, unit * (np.bincount(term, own, self.terms)[term] - own), size)

        total = np.where(linked, weighed(np.ones(size)), 1.0)
        score, active = 1 / n, np.ones(len(self.sizes), bool)
        for _ in range(rounds):
            new = (1 - damping) / n + damping * weighed(np.where(linked, score / total, 0.0))
            change = np.bincount(doc, np.abs(new - score), len(self.sizes))
            score = np.where(active[doc], new, score)
            active &= change >= tolerance
            kept = active[doc[row]]
            if not kept.any():
                break
            if kept.mean() < 0.5:  # documents that are done need no more rounds
                row, term, unit = row[kept], term[kept], unit[kept]
        return np.where(n > 1, score, 1.0)


def scores_of(docs: pa.Array, scores: Callable[[Sentences], np.ndarray]) -> pa.Array:
    """A number for each sentence of documents given as array<array<array of words>>."""

    def work(part: pa.Array) -> pa.Array:
        s = Sentences(part)
        return _list(s.sizes, pa.array(scores(s) if len(s.doc) else np.zeros(0), pa.float64()))

    return in_parts(docs, True, work, pa.list_(pa.float64()))


class Keywords:
    """The `k` most frequent words of documents, `extra` words counted twice; words of one letter and stop words are left out."""

    def __init__(self, docs: pa.Array, k: int, stop: list[str], extra: pa.Array | None = None):
        own = docs.flatten()
        self.docs, n_own = len(docs), len(own)
        doc = np.repeat(np.arange(len(docs)), _lengths(docs))
        if extra is not None:
            doc = np.concatenate([doc, np.repeat(np.arange(len(docs)), _lengths(extra))])
            own = pa.concat_arrays([own, extra.flatten().cast(own.type)])
        code, self.names = _coded(own)
        long = pc.greater_equal(pc.utf8_length(self.names), 2).to_numpy(zero_copy_only=False)
        stopped = pc.is_in(self.names, pa.array(stop, self.names.type)).to_numpy(zero_copy_only=False)
        kept = long[code] & ~(stopped[code] & (np.arange(len(code)) < n_own))
        weight = np.where(np.arange(len(code)) < n_own, 1, 2)[kept]
        #: the words that count, in the order of the text
        self.doc, self.code = doc[kept], code[kept]
        self.width = max(len(self.names), 1)
        cells, back = np.unique(self.doc * self.width + self.code, return_inverse=True)
        n = np.bincount(back, weight, len(cells)).astype(np.int64)
        #: the place of each word in the order of strings
        self.order = np.empty(len(self.names), np.int64)
        self.order[pc.sort_indices(self.names).to_numpy(zero_copy_only=False)] = np.arange(len(self.names))
        of, word = cells // self.width, cells % self.width
        by = np.lexsort((self.order[word], -n, of))
        place = np.arange(len(by)) - np.searchsorted(of[by], of[by])
        by = by[place < k]
        #: top words, by document and place
        self.top_doc, self.top_word, self.top_n, self.place = of[by], word[by], n[by], place[place < k]
        #: for each word that counts, its place among its document's top words, or -1
        ranks = np.full(len(cells), -1)
        ranks[by] = self.place
        self.at = ranks[back]
        self.sizes = np.bincount(self.top_doc, minlength=self.docs)

    def top(self) -> pa.Array:
        return _list(self.sizes, pa.StructArray.from_arrays([self.names.take(pa.array(self.top_word)).cast(pa.string()), pa.array(self.top_n)], ["word", "n"]))

    def near(self, k: int, reach: int) -> np.ndarray:
        """By document, a matrix of which top words stand within `reach` of each other in the stream of top words."""
        met = np.zeros((self.docs, k, k), bool)
        own = self.at >= 0
        doc, at = self.doc[own], self.at[own]
        for step in range(1, min(reach, len(doc) - 1) + 1):
            same = doc[step:] == doc[:-step]
            if not same.any():
                break
            met[doc[step:][same], at[:-step][same], at[step:][same]] = True
        return met | met.transpose(0, 2, 1)


def top_of(docs: pa.Array, k: int, stop: list[str], extra: pa.Array | None = None) -> pa.Array:
    """array<struct<word, n>> of the top words, in their order; `extra` has rows as `docs` has."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
    start = 0

    def work(part: pa.Array) -> pa.Array:
        nonlocal start
        more = None if extra is None else extra.slice(start, len(part))
        start += len(part)
        return Keywords(part, k, stop, more).top()

    return in_parts(docs, False, work, kind)


def pairs_of(docs: pa.Array, k: int, reach: int, stop: list[str]) -> pa.Array:
    """array<struct<a, b>>, a before b as strings, of the top words that stand within `reach` of each other."""

    def work(part: pa.Array) -> pa.Array:
        words = Keywords(part, k, stop)
        doc, x, y = np.nonzero(np.triu(words.near(k, reach), 1))
        first = np.cumsum(words.sizes) - words.sizes
        x, y = words.top_word[first[doc] + x], words.top_word[first[doc] + y]
        turned = words.order[x] > words.order[y]
        a, b = np.where(turned, y, x), np.where(turned, x, y)
        values = pa.StructArray.from_arrays([words.names.take(pa.array(c)).cast(pa.string()) for c in (a, b)], ["a", "b"])
        return _list(np.bincount(doc, minlength=len(part)), values)

    return in_parts(docs, False, work, pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())])))


def topics_of(docs: pa.Array, k: int, most: int, reach: int, stop: list[str]) -> pa.Array:
    """array<struct<label, members, weight>>: a top word that is in no cluster yet takes all such words that stand near it."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("members", pa.list_(pa.string())), ("weight", pa.float64())]))

    def cluster(names: list[str], counts: list[int], near: np.ndarray) -> Iterator[tuple[str, list[str], int]]:
        free = list(range(len(names)))
        while free:
            word, mates = free[0], near[free[0]]
            own = [w for w in free if w == word or mates[w]]
            yield names[word], [names[w] for w in own], sum(counts[w] for w in own)
            free = [w for w in free if w != word and not mates[w]]

    def work(part: pa.Array) -> pa.Array:
        words = Keywords(part, k, stop)
        near, out, start = words.near(k, reach), [], 0
        names = words.names.take(pa.array(words.top_word)).to_pylist()
        counts = words.top_n.tolist()
        for doc, size in enumerate(words.sizes.tolist()):
            found = list(cluster(names[start : start + size], counts[start : start + size], near[doc]))
            top = max((total for *_, total in found), default=1)
            out.append([{"label": label, "members": own, "weight": total / top} for label, own, total in found[:most]])
            start += size
        return pa.array(out, kind)

    return in_parts(docs, False, work, kind)


def places_of(docs: pa.Array) -> pa.Array:
    """array<struct<term, places>>: the places of each distinct word of a document, from 0 and ascending."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(pa.int32()))]))

    def work(part: pa.Array) -> pa.Array:
        lengths = _lengths(part)
        code, names = _coded(part.flatten())
        doc = np.repeat(np.arange(len(part)), lengths)
        place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        width = max(len(names), 1)
        cell = doc * width + code
        by = np.argsort(cell, kind="stable")
        cells, counts = np.unique(cell, return_counts=True)
        values = pa.StructArray.from_arrays([names.take(pa.array(cells % width)).cast(pa.string()), _list(counts, pa.array(place[by], pa.int32()))], ["term", "places"])
        return _list(np.bincount(cells // width, minlength=len(part)), values)

    return in_parts(docs, False, work, kind)
