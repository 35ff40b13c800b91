"""LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Tokens are A-Z-lowered words and one end a text. The model's units are the most frequent words, one unit for each hash of
a rarer word's ending, and the end. A unit's score after a context unit is bilinear: context vector, scaled by a diagonal,
times target vector, plus a bias. Noise-contrastive estimation fits it to the pair counts of the whole training corpus, in
full batches: the expectation over noise is summed, not sampled. A matrix product over all contexts, normalised, gives the
table of log-probabilities that scoring looks up; a rarer word's share of its unit is its smoothed share of the unit's
count.

What grows with the corpus stays distributed: the table of word counts and the look-up of rare words, by join. The driver
gets up to FREQUENT of the most frequent words, at most UNITS^2 pair counts and the units' totals. Passes over the texts: counting,
pair counting and scoring.

Nulls: a null text is empty, so it is one end; a null doc_id counts as the empty text when folds are dealt. Repeated rows
count and are scored each. With no training rows every count is 0, and the model is uniform over its units. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

FOLDS, HELD_OUT = 10, 0
WORD_UNITS, ENDINGS, ENDING_BYTES = 768, 255, 3
UNITS = WORD_UNITS + ENDINGS + 1
END = UNITS - 1
#: Words whose counts every worker holds; the others are looked up by a join.
FREQUENT = 200_000
DIMENSIONS, NOISE, STEPS, RATE = 32, 20, 200, 0.05
SMOOTH = 0.1


def ending_unit(word: bytes) -> int:
    return WORD_UNITS + zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


class Units(dict):
    """Frequent word -> its number; any other word -> -1 - its unit."""

    def __missing__(self, word: bytes) -> int:
        return -1 - ending_unit(word)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts; the end is the empty word."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in common.utf8_column(batch, "text"):
                held.update(common.words_of(text))
            held[b""] += len(batch)
            if len(held) > 400_000:
                yield from common.emit(schema, ((w.decode("utf-8", "replace"), n) for w, n in held.items()), most=20_000)
                held = Counter()
        yield from common.emit(schema, ((w.decode("utf-8", "replace"), n) for w, n in held.items()), most=20_000)

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, lexicon) -> np.ndarray:
    """How often each unit follows each unit, over all texts; a text begins after an end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = lexicon.value
        total = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            codes = []
            for text in common.utf8_column(batch, "text"):
                units = x.units(x.codes(common.words_of(text)))
                codes.append(np.append(END, units) * UNITS + np.append(units, END))
            if codes:
                total += np.bincount(np.concatenate(codes), minlength=UNITS * UNITS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["pair", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(UNITS * UNITS)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(UNITS, UNITS)


def fit(pairs: np.ndarray, dimensions: int = DIMENSIONS, noise: int = NOISE, steps: int = STEPS) -> np.ndarray:
    """log10 P(unit | context unit), normalised, from pair counts (rows: contexts)."""
    n = max(pairs.sum(), 1.0)
    data = pairs / n
    unigram = (pairs.sum(axis=0) + 0.5) / (n + 0.5 * UNITS)
    contexts = data.sum(axis=1)
    noise_mass = noise * contexts[:, None] * unigram[None, :]
    shift = np.log(noise * unigram)
    rng = np.random.default_rng(11)
    p = {"r": rng.normal(0, 0.3, (UNITS, dimensions)), "c": np.ones(dimensions), "q": rng.normal(0, 0.3, (UNITS, dimensions)), "b": np.log(unigram)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    scale = 1 / np.sqrt(contexts + 1e-7)[:, None]  # rows of frequent contexts do not drown the others
    for step in range(1, steps + 1):
        rc = p["r"] * p["c"]
        odds = 1 / (1 + np.exp(-(rc @ p["q"].T + p["b"] - shift)))  # that a unit is data, not noise
        g = (data * (1 - odds) - noise_mass * odds) * scale
        gr = g @ p["q"]
        grad = {"r": gr * p["c"], "c": (gr * p["r"]).sum(axis=0), "q": g.T @ rc, "b": g.sum(axis=0)}
        rate = RATE * (1 - step / (steps + 1))
        for k, v in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] = p[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-12)
    scores = (p["r"] * p["c"]) @ p["q"].T + p["b"]
    scores -= scores.max(axis=1, keepdims=True)
    return ((scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)).astype(np.float32)


class Lexicon:
    """Frequent words with their counts, and every unit's totals of words that are not units themselves."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int, ends: int, unit_counts: np.ndarray, unit_words: np.ndarray):
        self.numbers = Units({w: i for i, w in enumerate(words)})
        self.unit = np.array([i if i < WORD_UNITS else ending_unit(w) for i, w in enumerate(words)], np.int64)
        self.base_total = np.log10(n + SMOOTH * (v + 1))
        self.unit_total = np.log10(unit_counts + SMOOTH * (unit_words + 1))
        self.log_count = np.log10(counts + SMOOTH)
        self.inside = np.where(np.arange(len(words)) < WORD_UNITS, 0.0, self.log_count - self.unit_total[self.unit])
        self.n, self.ends = n, ends

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def units(self, codes: np.ndarray) -> np.ndarray:
        known = codes >= 0
        out = -1 - codes
        out[known] = self.unit[codes[known]]
        return out


def train(docs: DataFrame) -> tuple[DataFrame, object, np.ndarray]:
    """Word counts (settled), the broadcast lexicon, and the table of log-probabilities."""
    spark = common.prepare(docs.sparkSession)
    counts = common.settle(word_counts(docs))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = sum(r.n for r in counts.where("word = ''").collect())
    # the least count of which there are no more words than FREQUENT, from how many words have each count; words that tie
    # below it are looked up like all others
    least, room = 1, FREQUENT
    for r in counts.where("word <> ''").groupBy(F.col("n").alias("times")).count().orderBy(F.desc("times")).toLocalIterator():
        room -= r["count"]
        if room < 0:
            least = r.times + 1
            break
    top = counts.where((F.col("word") != "") & (F.col("n") >= least)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words = [w.encode() for w in top["word"].to_pylist()]
    frequency = top["n"].to_numpy()
    # totals of the endings' units, over all words but those that are units themselves: these are subtracted again
    raw = F.col("word").cast("binary")
    ending = F.when(F.length(raw) > ENDING_BYTES, F.substring(raw, -ENDING_BYTES, ENDING_BYTES)).otherwise(raw)
    totals = counts.where("word <> ''").groupBy((F.crc32(ending) % ENDINGS).alias("e")).agg(F.sum("n"), F.count("*")).collect()
    unit_counts, unit_words = np.zeros(UNITS), np.zeros(UNITS)
    for e, m, k in totals:
        unit_counts[WORD_UNITS + e], unit_words[WORD_UNITS + e] = m, k
    for w, m in zip(words[:WORD_UNITS], frequency, strict=False):
        unit_counts[ending_unit(w)] -= m
        unit_words[ending_unit(w)] -= 1
    lexicon = spark.sparkContext.broadcast(Lexicon(words, frequency, n, v, ends, unit_counts, unit_words))
    return counts, lexicon, fit(pair_counts(docs, lexicon))


def score(docs: DataFrame, counts: DataFrame, lexicon, table: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    table_ = docs.sparkSession.sparkContext.broadcast(table)
    rare = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("rare", rare)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, after = lexicon.value, table_.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.utf8_column(batch, "text"), strict=True):
                    words = common.words_of(text)
                    codes = x.codes(words)
                    units = x.units(codes)
                    known = codes[codes >= 0]
                    others = np.flatnonzero(codes < 0)
                    seldom = Counter([words[i] for i in others])
                    base = x.log_count[known].sum() + np.log10(x.ends + SMOOTH) - (len(words) + 1) * x.base_total
                    model = after[np.append(END, units), np.append(units, END)].sum(dtype=np.float64) + x.inside[known].sum() - x.unit_total[units[others]].sum()
                    yield doc_id, len(words) + 1, len(known) + (x.ends > 0), x.n, base, model, [(w.decode("utf-8", "replace"), n) for w, n in seldom.items()]

        yield from common.emit(schema, rows(), lambda row: 40 * len(row[6]))

    types = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, rare array<struct<word: string, n: bigint>>"
    first = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measure, types)
    first = common.settle(first.withColumn("_row", F.monotonically_increasing_id()))
    seldom = first.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", F.col("r.n").alias("times"))
    looked_up = seldom.join(counts, "word", "left").groupBy("_row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("_logs"))
    whole = first.drop("rare").join(looked_up, "_row", "left")
    logs = F.coalesce("_logs", F.lit(0.0))
    return whole.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), "train_tokens", (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = common.held_out(F.col("doc_id"), FOLDS, HELD_OUT)
    scored = score(docs, *train(docs.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
