"""A scan of files as they arrive: findings are numbered batch by batch and read by a cursor while the scan goes on.

Each batch of files is a folder of numbered findings and then an entry in the ledger: its first and last number. What is not
in the ledger is not there for readers. A batch that is repeated, because the stream was killed between the two or after
both, writes the same folder again or finds its entry and writes nothing, so numbers are given once, without gaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.lineage import dealt, settled
from siltstone.operators import report, rules

KEY = ("repo", "file")
LEDGER = "batch long, first long, last long"


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Rows (repo, file, source) of Parquet files that are put into a folder, as a stream."""
    return spark.readStream.schema("repo string, file string, source string").option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def ledger(spark: SparkSession, into: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{into}/ledger/*")
    except AnalysisException:  # no batch has ended yet
        return spark.createDataFrame([], LEDGER)


def take(files: DataFrame, batch: int, into: str, find: Callable[[DataFrame], DataFrame]) -> None:
    """One batch of the stream: number its findings after those of all batches before, write them, then the ledger's entry.

    Its files are dealt to all cores first: a batch of a few large files is read by as few tasks."""
    spark = files.sparkSession
    entries = ledger(spark, into)
    if entries.where(F.col("batch") == batch).limit(1).count():
        return
    base = entries.where(F.col("batch") < batch).agg(F.max("last")).first()[0] or 0
    found = settled(find(dealt(files)).withColumn("_id", F.monotonically_increasing_id()))
    # Batches that are repeated hold the same files, if not in the same order.
    ordered = F.struct(*(F.col(c) for c in found.columns if c != "_id"))
    keyed = found.withColumn("_key", F.to_json(ordered))
    numbered = report.numbered(keyed, "_key", "_id").withColumn("number", (F.col("number") + base).cast("long")).drop("_key", "_id")
    numbered.write.mode("overwrite").parquet(f"{into}/rows/batch={batch}")
    n = spark.read.parquet(f"{into}/rows/batch={batch}").count()
    enter(spark, batch, base, n, into)


def enter(spark: SparkSession, batch: int, base: int, n: int, into: str) -> None:
    spark.createDataFrame([(batch, base + 1, base + n)], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{into}/ledger/{batch}")


def run(files: DataFrame, into: str, checkpoint: str, find: Callable[[DataFrame], DataFrame] | None = None):
    """Scan all that has arrived, batch by batch, and end; a later call goes on. Gives the stream's query."""
    look = find or (lambda f: rules.detect(f, key=KEY))
    return files.writeStream.foreachBatch(lambda f, batch: take(f, batch, into, look)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, into: str, cursor: int = 0) -> tuple[DataFrame | None, int]:
    """The findings after the cursor, of batches that the ledger holds, and the next cursor. Only their folders are read."""
    entries = [r for r in ledger(spark, into).where(F.col("last") > cursor).orderBy("batch").collect() if r.last >= r.first]
    if not entries:
        return None, cursor
    rows = spark.read.option("basePath", f"{into}/rows").parquet(*[f"{into}/rows/batch={r.batch}" for r in entries])
    return rows.drop("batch").where(F.col("number") > cursor), max(r.last for r in entries)
