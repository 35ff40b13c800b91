"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its character-class bigrams (the classes keep every ASCII sign apart and put letters together), its
words, hashed, and how much it repeats itself. Up to EXAMPLES labelled texts, the first by a hash of their ids, give the
terms' weights and, by a truncated singular value decomposition, the latent space. Their vectors are broadcast; a block
of documents is one matrix product with all of them, so the cosines are exact, and the nearest NEIGHBOURS vote with
weights that rise with similarity.

The fit is bounded by EXAMPLES rows of SAMPLE_BYTES in all; scoring is one pass over the texts without a shuffle. Nulls: a
null or empty text has no terms and gets the share of label 1 among the examples; so does every text if there are no
labels. Labelled ids that are null or have a null label are not learnt from; of several labels of an id the greatest
counts, of several texts the first. Of equally near examples all that tie with the last neighbour vote. Very long texts
are scored whole. Repeated rows are scored alike. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

FOLDS, HELD_OUT = 4, 2
EXAMPLES, SAMPLE_BYTES = 4000, 64 << 20
RANK = 48
NEIGHBOURS, SHARPNESS = 25, 8
THRESHOLD = 0.7
WORD_TERMS = 1024
CLASSES = 64
MARKS = 3
TERMS = CLASSES * CLASSES + WORD_TERMS + MARKS
CACHE_WORDS = 60_000

#: Byte -> class: bytes of non-ASCII letters and small letters 1, capitals 2, digits 3, white space and signs each its own.
BYTE_CLASS = np.full(256, 1, np.int64)
BYTE_CLASS[np.arange(65, 91)] = 2
BYTE_CLASS[np.arange(48, 58)] = 3
BYTE_CLASS[:32] = 4
for _k, _b in enumerate([10, 32, *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]):
    BYTE_CLASS[_b] = 5 + _k


class WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = zlib.crc32(word)
        return i


_WORDS = WordIds()


def term_counts(text: bytes | None) -> np.ndarray:
    """How often a text has each term."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    c = BYTE_CLASS[np.frombuffer(text, np.uint8)]
    out[: CLASSES * CLASSES] = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    words = common.words_of(text)
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    out[CLASSES * CLASSES : CLASSES * CLASSES + WORD_TERMS] = np.bincount((ids % WORD_TERMS).astype(np.int64), minlength=WORD_TERMS)
    if len(ids) > 3:
        triples = ids[:-2] * np.uint64(0x9E3779B97F4A7C15) + ids[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + ids[2:]
        out[-3] = 20 * np.count_nonzero(ids[1:] == ids[:-1]) / len(ids)
        out[-2] = 20 * (1 - len(np.unique(triples)) / len(triples))
    lines = text.split(b"\n")
    out[-1] = 20 * (1 - len(set(lines)) / len(lines))
    return out


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of term counts as unit vectors of log frequency times weight, each kind of term normalised on its own."""
    x = np.log1p(counts) * weights
    for a, b, share in ((0, CLASSES * CLASSES, 1.0), (CLASSES * CLASSES, CLASSES * CLASSES + WORD_TERMS, 0.3)):
        x[:, a:b] *= share / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    x[:, -MARKS:] *= 0.5
    return x


class Model:
    """Term weights, latent space and labelled vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        n = len(counts)
        self.weights = np.log((1 + n) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + 0.1
        self.weights[-MARKS:] = 1
        x = weighted(counts, self.weights)
        rng = np.random.default_rng(7)
        q = rng.standard_normal((x.shape[1], min(rank + 8, max(n, 1)))).astype(np.float32)
        for _ in range(4):  # subspace iteration
            q, _r = np.linalg.qr(x.T @ (x @ q))
        small = x @ q
        _u, _s, vt = np.linalg.svd(small, full_matrices=False)
        self.space = (q @ vt[:rank].T).astype(np.float32)
        self.vectors = self.latent(x)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.space
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosines = self.latent(weighted(counts, self.weights)) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        last = np.partition(cosines, -k, axis=1)[:, -k, None]
        weight = np.where(cosines >= last, np.maximum(cosines, 1e-6).astype(np.float64) ** SHARPNESS, 0)
        score = np.clip(weight @ self.labels / weight.sum(axis=1), 0, 1)
        return np.where(counts.any(axis=1), score, self.prior)


def train(docs: DataFrame, labels: DataFrame, label: str, examples: int = EXAMPLES, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from up to `examples` labelled rows outside the held-out fold, with texts of up to `most_bytes` in all."""
    sample = common.labelled_sample(docs, labels, label, FOLDS, HELD_OUT, examples, most_bytes)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, y, text in zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), common.utf8_column(batch, "text"), strict=True):
                    c = term_counts(text)
                    at = np.flatnonzero(c)
                    yield doc_id, y, at.astype(np.int32), c[at]

        yield from common.emit(schema, rows(), lambda row: 8 * len(row[2]))

    found = sample.mapInArrow(count, "doc_id long, label int, terms array<int>, counts array<float>").toArrow().sort_by("doc_id")
    counts = np.zeros((len(found), TERMS), np.float32)
    for i, (at, c) in enumerate(zip(found["terms"], found["counts"], strict=True)):
        counts[i, at.values.to_numpy()] = c.values.to_numpy()
    return Model(counts, found["label"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), score."""
    common.prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.utf8_column(batch, "text")
            scores = [held.value.score(np.stack([term_counts(t) for t in texts[at : at + 256]])) for at in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "text_key", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string")).mapInArrow(vote, "doc_id long, text_key long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, text_key, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, label))
    return scored.select("doc_id", "text_key", common.held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, in their own columns, whose score reaches the threshold; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    common.prepare(docs.sparkSession)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.utf8_column(batch, "text")
            for at in range(0, len(texts), 256):
                scores = held.value.score(np.stack([term_counts(t) for t in texts[at : at + 256]]))
                yield batch.slice(at, len(scores)).filter(pa.array(scores >= threshold))

    return docs.mapInArrow(passing, docs.schema)


def op3_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("text_key")
