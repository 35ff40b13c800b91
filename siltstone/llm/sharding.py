"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

Law `rows`: shard sizes differ by one row at most. How many rows each input partition sends to each shard is drawn on
the driver, exactly as a uniform permutation would have it (a multivariate hypergeometric row per partition, without
replacement from what the shards still lack): partitions x shards integers, no rows. Each partition then deals its rows
to the shards in random order, the rows are exchanged, and each shard is permuted again by random keys. A shard is
ordered in blocks of a bounded number of rows, so neither a task nor the driver ever holds a whole shard.

Nulls: a null text has 8 bytes and the checksum of the empty text; a null doc_id is carried. Repeated rows are dealt each
on its own: under this law equal texts need not stay together. Ties do not matter, since keys are random. A very long
text counts like any other, as only rows are equal. An empty table gives no rows; added columns replace columns of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import common

SHARDS = 24
SEED = 20_240_601
#: Rows that one task orders at most, on average.
BLOCK_ROWS = 50_000


#: numpy's own sampler takes fewer rows than this.
NUMPY_ROWS = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many good ones are among `drawn` of good + bad, drawn without replacement; exact to double precision at any size.

    Beyond numpy's bound the distribution is laid out around its mode by the ratios of neighbouring probabilities, as far
    as they matter (twelve standard deviations), and inverted."""
    total = good + bad
    if total < NUMPY_ROWS:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn and good else 0
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    spread = int(12 * np.sqrt(drawn / total * (good / total) * (1 - good / total) * (total - drawn) + 1)) + 40
    first, last = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(first, last, dtype=np.float64)  # log P(k + 1) - log P(k)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(float(bad - drawn + 1) + k)
    log = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.exp(log - log.max())
    return first + int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right").clip(0, last - first))


def _draw(rng: np.random.Generator, lacking: np.ndarray, drawn: int) -> np.ndarray:
    """How many of `drawn` rows go to each shard, of what the shards still lack."""
    if int(lacking.sum()) < NUMPY_ROWS:
        return rng.multivariate_hypergeometric(lacking, drawn, method="marginals")
    out, rest = np.zeros(len(lacking), np.int64), int(lacking.sum())
    for j, n in enumerate(lacking.tolist()):
        rest -= n
        out[j] = hypergeometric(rng, n, rest, drawn)
        drawn -= int(out[j])
    return out


def communication_matrix(partition_rows: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Row i: how many rows partition i sends to each shard. Row sums are partition_rows, column sums the shard sizes.

    The partitions are halved again and again, and what each half sends is drawn, so that large totals meet few draws."""
    total = int(partition_rows.sum())
    lacking = np.full(shards, total // shards, np.int64)
    lacking[: total % shards] += 1
    rng = np.random.default_rng([seed, 0])
    out = np.zeros((len(partition_rows), shards), np.int64)
    todo = [(0, len(partition_rows), lacking)]
    while todo:
        lo, hi, lacking = todo.pop()
        if hi - lo == 1:
            out[lo] = lacking
        elif hi > lo:
            mid = (lo + hi) // 2
            left = _draw(rng, lacking, int(partition_rows[lo:mid].sum()))
            todo += [(mid, hi, lacking - left), (lo, mid, left)]
    return out


def shuffle(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows, each with its `shard` and its `slot` (gapless from 0 in every shard).

    The rows are settled first, since partitions and row numbers must not change between the passes; wide columns are
    best joined afterwards."""
    spark = rows.sparkSession
    rows = common.settle(rows.drop("shard", "slot").withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    per_part = dict(rows.groupBy("_part").count().collect())
    parts = sorted(per_part)
    counts = np.array([per_part[p] for p in parts], np.int64)
    matrix = spark.sparkContext.broadcast(dict(zip(parts, communication_matrix(counts, shards, seed), strict=True)))

    names = [c for c in rows.columns if c != "_part"]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "_part") + ", shard int"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] = (-1, np.empty(0, np.int32))
        for batch in batches:
            row = batch.column("_row").to_numpy()
            shard = np.empty(len(row), np.int32)
            for p in np.unique(row >> 33):
                if held[0] != p:
                    labels = np.repeat(np.arange(shards, dtype=np.int32), matrix.value[int(p)])
                    np.random.default_rng([seed, 1, int(p)]).shuffle(labels)
                    held = int(p), labels
                mine = row >> 33 == p
                shard[mine] = held[1][row[mine] & ((1 << 33) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(shard)], names=[*names, "shard"])

    blocks = max(1, -(-int(counts.sum()) // (shards * block_rows)))
    dealt = rows.drop("_part").mapInArrow(deal, schema).withColumn("_key", F.xxhash64(F.lit(seed), "_row"))
    dealt = dealt.withColumn("_block", F.floor((F.shiftrightunsigned("_key", 33) / float(1 << 31)) * blocks).cast("int"))
    in_block = Window.partitionBy("shard", "_block").orderBy(F.xxhash64(F.lit(seed + 1), "_row"), "_row")
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("shard", "_block").agg(F.count("*").alias("_n")).select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = dealt.withColumn("_k", F.row_number().over(in_block) - 1).join(bases, ["shard", "_block"])
    return placed.withColumn("slot", F.col("_base") + F.col("_k")).drop("_block", "_key", "_k", "_base", "_row")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle(rows, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(common.table(spark, sf_dir, "documents"))
