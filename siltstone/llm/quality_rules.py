"""Quality rules: plain rules first, then robust multivariate outliers.

Five statistics of a text that passes the plain rules make a vector: ln(1 + words), ln of the mean word length,
ln(1 + symbols a word), the share of repeated lines and the share of words in repeated three-word windows. For every
language and source, every language, and the whole, a minimum-covariance-determinant estimate gives their place and
scatter: from two deterministic starts, the rows nearest to the current estimate (three quarters of the group) give the
next one, as long as the determinant falls; the best estimate of the two starts counts. A group's estimate leans on its
language's as if that brought PRIOR rows of its own, and a language's on the whole's, so that small groups do not judge
by themselves and no size is treated apart. A text farther than CUTOFF by Mahalanobis distance is rejected.

All rows of all groups take part in every step. A step is a join to the groups' small table and two aggregations with
partial sums, so a group with a third of all rows is no burden; the table of groups itself stays distributed, and groups
whose determinant falls no more rest. The cut at three quarters is an approximate percentile with bounded memory. A
scatter never falls below FLOORS, so that a statistic which is constant in a group does not reject everything else.

Nulls: a null text is empty and fails the plain rules; a null language or source is a group of its own. Ties at the cut
are all inside. Very long texts are measured whole, one at a time. Repeated rows count as often as they occur. An empty
table gives no rows. The result carries the columns asked for; a column of an added name is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Least standard deviation of each transformed statistic.
FLOORS = (0.5, 0.06, 0.04, 0.12, 0.08)
SUBSET = 0.75
#: For normal data in five dimensions: 0.75 / P(chi2 with 7 degrees of freedom <= its 0.75 quantile with 5).
CONSISTENCY = 1.412
CUTOFF = 6.0
#: Rows that a group's language, and a language's whole, weigh in its estimate; the least fall of a log determinant.
PRIOR, LEAST_FALL = 50, 1e-3
#: Groups (of about 1 KB each) up to which their table is broadcast.
BROADCAST_GROUPS = 20_000
DIMENSIONS = len(FLOORS)
PAIRS = list(combinations_with_replacement(range(DIMENSIONS), 2))


def statistics(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word) of a UTF-8 text."""
    words = text.split() if text else []
    if not words:
        return 0, 0, sum(text.count(s) for s in SYMBOLS) if text else 0, 0, 0, 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        end = 0
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(b"".join(words).decode("utf-8", "replace")), sum(text.count(s) for s in SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines)


def _measured(docs: DataFrame) -> DataFrame:
    common.prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [statistics(text) for text in common.utf8_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(schema.field(i).type) for i in range(4)] + [pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)] if numbers else [pa.array([], t) for t in schema.types], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    types = "doc_id long, text_key long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    return rows.mapInArrow(measure, types).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _vector() -> Column:
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return F.array(F.log1p(n), F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(F.col("n_symbols") / n), F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / n)


def _levels(rows: DataFrame) -> DataFrame:
    """The rows with their group `g` and the wider ones `g1` (the language) and `g0` (the whole)."""
    lang, source = F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))
    return rows.withColumns({"g": F.concat_ws("\1", lang, source), "g1": F.concat(F.lit("\2"), lang), "g0": F.lit("\3")})


def _distance2() -> Column:
    """Squared Mahalanobis distance of `x` from `centre` under `inverse` (flat, symmetric)."""
    off = [F.col("x")[i] - F.col("centre")[i] for i in range(DIMENSIONS)]
    return sum((1 if i == j else 2) * F.col("inverse")[i * DIMENSIONS + j] * off[i] * off[j] for i, j in PAIRS)


def _estimates(moments: DataFrame, scale: float) -> DataFrame:
    """g, start, n, centre, scatter, inverse, logdet from a group's count, sums and sums of products."""

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.diag(np.square(FLOORS))
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                n, sums = float(r.n), np.array(r.sums, float)
                mean = sums / n
                second = np.zeros((DIMENSIONS, DIMENSIONS))
                for (i, j), v in zip(PAIRS, r.products, strict=True):
                    second[i, j] = second[j, i] = v / n
                scatter = scale * (second - np.outer(mean, mean)) + floor
                rows.append((r.g, r.start, int(r.n), mean.tolist(), scatter.ravel().tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
            yield pd.DataFrame(rows, columns=["g", "start", "n", "centre", "scatter", "inverse", "logdet"])

    return moments.mapInPandas(fit, "g string, start int, n long, centre array<double>, scatter array<double>, inverse array<double>, logdet double")


def _moments(rows: DataFrame) -> DataFrame:
    """Of rows (g, start, x): n, sums, products."""
    sums = F.array(*[F.sum(F.col("x")[i]) for i in range(DIMENSIONS)])
    products = F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in PAIRS])
    return rows.groupBy("g", "start").agg(F.count("*").alias("n"), sums.alias("sums"), products.alias("products"))


def estimates(vectors: DataFrame) -> DataFrame:
    """g, centre, inverse for every group of the vectors (g, x)."""
    half = [0.25, 0.5, 0.75]
    quartiles = vectors.groupBy("g").agg(*[F.percentile_approx(F.col("x")[i], half, 10_000).alias(f"q{i}") for i in range(DIMENSIONS)])
    centre = F.array(*[F.col(f"q{i}")[1] for i in range(DIMENSIONS)])
    spread = F.array(*[F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2 for i in range(DIMENSIONS)])
    robust = common.settle(quartiles.select("g", centre.alias("centre"), spread.alias("spread")))
    # the rows meet the groups' table in every step; while that is small it is broadcast, so that they are not shuffled
    few = robust.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    small = F.broadcast if few else lambda frame: frame
    diagonal = lambda of: F.array(*[of(i) if i == j else F.lit(0.0) for i in range(DIMENSIONS) for j in range(DIMENSIONS)])
    first = robust.select("g", F.lit(0).alias("start"), F.lit(0).cast("long").alias("n"), "centre", diagonal(lambda i: F.col("spread")[i]).alias("scatter"), diagonal(lambda i: 1 / F.col("spread")[i]).alias("inverse"), F.lit(1e300).alias("logdet"))
    # the second start: rows pulled in to three robust deviations, so that scatter between statistics shows
    pulled = vectors.join(small(robust), "g").select("g", F.lit(1).alias("start"), F.array(*[F.col("centre")[i] + 3 * F.sqrt(F.col("spread")[i]) * F.tanh((F.col("x")[i] - F.col("centre")[i]) / (3 * F.sqrt(F.col("spread")[i]))) for i in range(DIMENSIONS)]).alias("x"))
    second = _estimates(_moments(pulled), 1.0).withColumn("logdet", F.lit(1e300))
    falling, rest = common.settle(first.unionByName(second)), []
    while falling.limit(1).count():
        near = vectors.join(small(falling), "g").select("g", "start", "x", _distance2().alias("d2"))
        cut = near.groupBy("g", "start").agg(F.percentile_approx("d2", SUBSET, 10_000).alias("cut"))
        inside = near.join(small(cut), ["g", "start"]).where(F.col("d2") <= F.col("cut"))
        new = _estimates(_moments(inside), CONSISTENCY)
        old = falling.select("g", "start", F.struct("n", "centre", "scatter", "inverse", "logdet").alias("_old"))
        both = new.join(old, ["g", "start"]).select("g", "start", F.struct("n", "centre", "scatter", "inverse", "logdet").alias("_new"), "_old")
        both = common.settle(both.withColumn("_fell", F.col("_old.logdet") - F.col("_new.logdet") > LEAST_FALL))
        better = F.when(F.col("_new.logdet") < F.col("_old.logdet"), F.col("_new")).otherwise(F.col("_old"))
        rest.append(both.where(~F.col("_fell")).select("g", "start", better.alias("_e")).select("g", "start", "_e.*"))
        falling = both.where("_fell").select("g", "start", "_new.*")
    if not rest:
        rest = [falling]
    every = reduce(DataFrame.unionByName, rest)
    return common.settle(every.groupBy("g").agg(F.min_by(F.struct("centre", "scatter", "inverse"), F.struct("logdet", "start")).alias("_e")).select("g", "_e.*"))


def _leaning(groups: DataFrame) -> DataFrame:
    """g, centre, inverse of rows (g, n, and the estimates c2 c1 c0, s2 s1 s0 from the narrowest out; n1 rows of the language)."""

    def lean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                share1, share2 = r.n1 / (r.n1 + PRIOR), r.n / (r.n + PRIOR)
                mix = lambda a, b, c: share2 * np.array(a, float) + (1 - share2) * (share1 * np.array(b, float) + (1 - share1) * np.array(c, float))  # noqa: B023, E731
                rows.append((r.g, mix(r.c2, r.c1, r.c0).tolist(), np.linalg.inv(mix(r.s2, r.s1, r.s0).reshape(DIMENSIONS, DIMENSIONS)).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["g", "centre", "inverse"])

    return groups.mapInPandas(lean, "g string, centre array<double>, inverse array<double>")


def group_estimates(passed: DataFrame) -> DataFrame:
    """g, centre, inverse for every group of rows (g, g1, g0, x): its own estimate, leaning on the wider ones."""
    vectors = passed.select(F.explode(F.array("g", "g1", "g0")).alias("g"), "x")
    found = estimates(vectors).select("g", "centre", "scatter")
    sizes = common.settle(passed.groupBy("g", "g1", "g0").agg(F.count("*").alias("n")))
    langs = sizes.groupBy("g1").agg(F.sum("n").alias("n1"))
    at = lambda name, k: found.select(F.col("g").alias(name), F.col("centre").alias(f"c{k}"), F.col("scatter").alias(f"s{k}"))
    groups = sizes.join(langs, "g1").join(at("g", 2), "g").join(at("g1", 1), "g1").join(at("g0", 0), "g0")
    return common.settle(_leaning(groups.select("g", "n", "n1", "c2", "c1", "c0", "s2", "s1", "s0")))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lang, source, the statistics, base_failed, distance (null if base_failed), kept."""
    rows = common.settle(_levels(_measured(docs)))
    found = group_estimates(rows.where(~F.col("base_failed")).select("g", "g1", "g0", _vector().alias("x")))
    few = found.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    judged = rows.withColumn("x", _vector()).join(F.broadcast(found) if few else found, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(_distance2()))).drop("x", "centre", "inverse", "g", "g1", "g0")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


def op6_covariance_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
