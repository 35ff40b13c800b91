"""Token-id output: fixed-width bit packing.

A written data set is a folder of Parquet parts whose rows are blocks. A block holds whole documents, about 64 Ki ids,
each id in the fewest bits that hold the vocabulary, back to back, lowest bit first:

    shard int, block int         place of the block; shards follow each other in doc_id order, blocks within them too
    start_in_shard long          ids of the shard before this block
    n_ids long, bits int         ids in the block, bits of each
    doc_ids array<long>          the documents, in order
    lengths array<int>           ids of each document
    payload binary               ceil(n_ids * bits / 8) bytes

Since bits are fixed, id i of a block starts at bit i * bits: any range is unpacked by numpy without reading the rest,
and Parquet's statistics on shard and start_in_shard find the block. Spark's writer commits the parts, so a lost
executor leaves no half-written shard, and any store that Spark writes to will do.

Nulls: a null text is empty (the end id alone); rows with a null doc_id come first. Rows with the same doc_id go by a hash of
their texts, so that equal inputs give equal files; many of them are dealt to several shards. A very long text makes a
longer block of its own. An empty table gives an empty data set; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common, token_ids

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
BLOCK_IDS = 1 << 16


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """The ids' lowest bits, back to back. An id that needs more of them is an error, never cut."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} does not fit {bits} bits")
    if bits % 8 == 0:
        return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """n ids from the start-th: gathers the bytes that hold each and shifts them into place."""
    first = np.arange(start, start + n, dtype=np.int64) * bits
    data = np.frombuffer(payload, np.uint8)
    at = first >> 3
    window = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        window |= data[np.minimum(at + k, max(len(data) - 1, 0))].astype(np.uint64) << np.uint64(8 * k)
    return (window >> (first & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype("<u4")


def write(docs: DataFrame, path: str, vocabulary_file: str, end_id: int, block_ids: int = BLOCK_IDS, control_as_text: bool = False) -> None:
    """Encode every document, with its end id, and write the data set in ascending doc_id order.

    One range shuffle of the texts, by id and a hash of the text; ids are made after it, so they are never shuffled."""
    common.prepare(docs.sparkSession)
    bits = bits_for(max(token_ids.encoder(vocabulary_file, control_as_text).size, end_id + 1))
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids.encoder(vocabulary_file, control_as_text)
        shard = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            held: list[np.ndarray] = []
            doc_ids: list[int | None] = []
            n = block = start = 0

            def close() -> tuple:
                return shard, block, start, n, bits, list(doc_ids), [len(x) for x in held], pack_bits(np.concatenate(held), bits)

            for batch in common.gathered(batches, "text"):
                every, ends = encoder.encode_batch([t or "" for t in batch.column("text").to_pylist()])
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), np.split(every, ends[:-1]), strict=True):
                    held.append(np.append(ids, np.uint32(end_id)))
                    doc_ids.append(doc_id)
                    n += len(ids) + 1
                    if n >= block_ids:
                        yield close()
                        held, doc_ids, n, block, start = [], [], 0, block + 1, start + n
            if held:
                yield close()

        yield from common.emit(schema, rows(), lambda row: len(row[7]))

    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("_text_key"), text.alias("text"))
    in_order = keyed.repartitionByRange("doc_id", "_text_key").sortWithinPartitions("doc_id", "_text_key").drop("_text_key")
    packed = in_order.mapInArrow(blocks, "shard int, block int, start_in_shard long, n_ids long, bits int, doc_ids array<bigint>, lengths array<int>, payload binary")
    packed.write.option("compression", "zstd").parquet(path)


def _blocks_with_start(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, with `block_start`: the ids of all blocks before. Sums run over one row a shard, not over documents."""
    blocks = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n")).select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return blocks.join(F.broadcast(shards), "shard").withColumn("block_start", F.col("_before") + F.col("start_in_shard")).drop("_before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary: little-endian unsigned 32-bit) of every document, read from the files."""
    common.prepare(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for block in batch.to_pylist():
                    ids, at = unpack_bits(block["payload"], block["bits"], 0, block["n_ids"]), 0
                    for doc_id, n in zip(block["doc_ids"], block["lengths"], strict=True):
                        yield doc_id, block["block_start"] + at, n, ids[at : at + n].tobytes()
                        at += n

        yield from common.emit(schema, rows(), lambda row: len(row[3]))

    blocks = _blocks_with_start(spark, path).select("block_start", "n_ids", "bits", "doc_ids", "lengths", "payload")
    return blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def read_range(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """Random access: n ids from the start-th of the whole data set; only blocks that hold them are read."""
    inside = (F.col("block_start") < start + n) & (F.col("block_start") + F.col("n_ids") > start)
    parts = []
    for b in _blocks_with_start(spark, path).where(inside).orderBy("block_start").select("block_start", "n_ids", "bits", "payload").toLocalIterator():
        first = max(start - b["block_start"], 0)
        parts.append(unpack_bits(bytes(b["payload"]), b["bits"], first, min(start + n - b["block_start"], b["n_ids"]) - first))
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


def op9_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "token-ids")
    write(common.table(spark, sf_dir, "documents"), path, token_ids.vocabulary_file(VOCABULARY), END_ID)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
