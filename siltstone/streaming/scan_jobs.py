"""Progress of scans: latest state, percentages, and results that are read by a cursor, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from siltstone.functions.lineage import settled

#: Percent at which the phases of reading files and of analysis begin, and how much each adds.
FILES, ANALYSIS = (25, 45), (70, 25)


def percent(done: Column, total: Column, phase: tuple[int, int]) -> Column:
    begin, more = phase
    return (F.lit(begin) + F.floor(done / F.greatest(total, F.lit(1)) * more)).cast("int")


def progress(events: DataFrame, job: str, order: str, phase: tuple[int, int] = FILES, partitions: int = 64) -> DataFrame:
    """Each event with how many of its job are done by then, and the percentage. Ranges of (job, order) are counted and ranked
    each on its own, so a job of many events is no single task's."""
    ranged = settled(events.repartitionByRange(partitions, job, order).withColumn("_part", F.spark_partition_id()))
    ranked = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part", job).orderBy(order)))
    counts = ranked.groupBy("_part", job).agg(F.count("*").alias("_n"))
    of_job = Window.partitionBy(job)
    before = of_job.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.col(job).alias("_job"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(of_job).alias("_total"))
    joined = ranked.alias("r").join(bases.alias("b"), (F.col("r._part") == F.col("b._part")) & F.col(job).eqNullSafe(F.col("_job")))
    done = F.col("_base") + F.col("_k")
    return joined.select(*[F.col(f"r.{c}") for c in events.columns], done.alias("done"), percent(done, F.col("_total"), phase).alias("percent"))


#: Percent of a job at the start of each step; the two with counts go on from there.
STEPS = {"queued": 0, "started": 2, "checked": 8, "downloaded": 15, "history": 18, "files": 25, "analysis": 70, "reports": 97, "summary": 99, "completed": 100}


def state(step: Column, done: Column, total: Column) -> Column:
    """struct(status, percent) of a job at a step: queued, running, completed or failed; a failed job keeps no percentage."""
    at = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])[step]
    reached = F.when(step == "files", percent(done, total, FILES)).when(step == "analysis", percent(done, total, ANALYSIS)).otherwise(at)
    return F.struct(F.when(step.isin("queued", "completed", "failed"), step).otherwise("running").alias("status"), reached.alias("percent"))


def latest(events: DataFrame, job: str, order: str, *state: str) -> DataFrame:
    """The last state of each job."""
    return events.groupBy(job).agg(F.max_by(F.struct(*state), order).alias("_s")).select(job, "_s.*")


def after(log: DataFrame, cursor: int, number: str = "number") -> DataFrame:
    """What was appended after the cursor, with the next cursor: the largest number there is when this is called."""
    last = log.agg(F.max(number)).first()[0]
    return log.where((F.col(number) > cursor) & (F.col(number) <= last)).withColumn("next_cursor", F.lit(last).cast(log.schema[number].dataType))


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Appended rows of a folder of Parquet files, as a stream."""
    reader: DataStreamReader = spark.readStream.schema(schema)
    return reader.parquet(path)


def drain(rows: DataFrame, into: str, checkpoint: str) -> None:
    """Write all there is of a stream to Parquet, once; a later call goes on from its checkpoint."""
    rows.writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
