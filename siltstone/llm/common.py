"""What the operators share: reading tables, cutting lineage, splitting words, streaming Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.lineage import fresh_path, settled, shared_dir, swept  # noqa: F401  the operators take them from here

#: Rows and bytes that go to a Python worker at once, with Spark's defaults: 10,000 long texts would not fit its memory.
ARROW_BATCH = {"maxRecordsPerBatch": ("10000", "500"), "maxBytesPerBatch": ("67108864b", "8388608b")}
#: Bytes of binary values after which a Python function hands a batch back.
FLUSH_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    """Lower the Arrow batch sizes in rows and bytes, unless the user has chosen them."""
    for name, (default, ours) in ARROW_BATCH.items():
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", ours)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: what follows reads the same rows, with the same row
    numbers, even if executors are lost. The files stay until the folder is cleared, or until nothing refers to them where
    spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    return settled(df)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; for texts of ASCII alone, lower() does the same, faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: bytes | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text, A-Z lowered: bytes.lower() and bytes.split() know ASCII alone."""
    return text.lower().split() if text else []


def utf8_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int = FLUSH_BYTES // 2) -> Iterator[pa.Table]:
    """The rows in larger batches, closed once their texts reach so many bytes."""
    held, heavy = [], 0
    for batch in batches:
        held.append(batch)
        heavy += batch.column(text).nbytes
        if heavy >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, heavy = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def emit(schema: pa.Schema, rows: Iterator[tuple], weight: Callable[[tuple], int] = lambda _: 0, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches from rows, closed by number of rows or by weight in bytes."""
    held: list[tuple] = []
    heavy = 0
    for row in rows:
        held.append(row)
        heavy += weight(row)
        if len(held) >= most or heavy >= FLUSH_BYTES:
            yield _batch(schema, held)
            held, heavy = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Rows whose crc32(doc_id as text) leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most_rows: int, most_bytes: int) -> DataFrame:
    """doc_id, label, text of labelled documents outside the held-out fold: the first `most_rows` ids by a hash, and of these,
    in the same order, each whose text still fits `most_bytes` in all; a text that does not is passed over. An id counts
    once, with its greatest label and its first text. Labelled texts of which none fits are an error."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds, held))
    once = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # bounded, so it may be broadcast
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    single = settle(joined.groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    sizes = single.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most most_rows
    inside, left = [], most_bytes
    for r in sizes:
        if r.bytes <= left:
            inside.append((r.doc_id,))
            left -= r.bytes
    if sizes and not inside:
        raise ValueError(f"no labelled text is of {most_bytes} bytes or fewer")
    return single.join(F.broadcast(docs.sparkSession.createDataFrame(inside, "doc_id long")), "doc_id")


#: Rows from which on a key is hot, and hot keys up to which their rows are broadcast.
HOT_ROWS, HOT_KEYS = 2000, 20_000


def looked_up(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Rows of `many` with those of `one`, which is unique by the key and tells in `_n` how many rows of `many` have it.

    Hot keys are broadcast, so that their rows stay where they are and no task gets them all. Should there be more than
    HOT_KEYS, so that they spread over all tasks, the join is left to Spark, which splits large partitions."""
    hot = one.where(F.col("_n") > HOT_ROWS)
    plain = one.drop("_n")
    if not 0 < hot.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return many.join(plain, key)
    marked = many.join(F.broadcast(hot.drop("_n").withColumn("_hot", F.lit(True))), key, "left")
    rest = marked.where("_hot IS NULL").select(*many.columns).join(one.where(F.col("_n") <= HOT_ROWS).drop("_n"), key)
    return marked.where("_hot").drop("_hot").select(*rest.columns).unionByName(rest)


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents, in their own columns, whose (doc_id, text_key) is not among the rejected; nulls match nulls.

    Rejected keys that repeat count once. While they are few they are broadcast, so that no text is shuffled."""
    bad = rejected.select(F.col("doc_id").cast("long").alias("_id_"), F.col("text_key").alias("_text_")).distinct()
    keyed = docs.select(F.struct("*").alias("_doc_"), F.col("doc_id").cast("long").alias("_id_"), F.xxhash64(F.col("text").cast("string")).alias("_text_"))
    on = keyed["_id_"].eqNullSafe(bad["_id_"]) & keyed["_text_"].eqNullSafe(bad["_text_"])
    return keyed.join(bad, on, "left_anti").select("_doc_.*")
