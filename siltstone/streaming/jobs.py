"""States of jobs as a stream: events in any order, legal steps alone, jobs that stall.

A job's events carry their number in the job, `seq` from 0. A keyed state holds the number that is awaited, the step that the
job has reached and the events that came too early; an event is judged when all before it are there, so a stream of events
in any order, repeated ones too, gives the rows of `judged`, the same in batch.

A step is legal if it lies after the one reached, or is the same and counts on (files, analysis); nothing follows
`completed` or `failed`. An illegal event changes nothing and is reported. Nulls: events without a job, number or step are
left out. Ties: of events with one number of a job the first that comes counts, in batch the least step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from siltstone.streaming.scan_jobs import ANALYSIS, FILES, STEPS, state

RANKS = {**{s: k for k, s in enumerate(STEPS)}, "failed": len(STEPS)}
COUNTING = ("files", "analysis")
FINAL = ("completed", "failed")
OUT = "job string, seq long, step string, status string, percent int, problem string"
_ROW = Row("job", "seq", "step", "status", "percent", "problem")
_PHASES = {"files": FILES, "analysis": ANALYSIS}
#: Numbers of early events that are kept as one value.
BLOCK = 256
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_of(events: DataFrame) -> DataFrame:
    """job, seq, step, done, total of the events that can be judged."""
    rows = events.select(F.col("job").cast("string"), F.col("seq").cast("long"), F.col("step").cast("string"), F.coalesce(F.col("done").cast("long"), F.lit(0)).alias("done"), F.coalesce(F.col("total").cast("long"), F.lit(0)).alias("total"))
    return rows.where(F.col("job").isNotNull() & F.col("seq").isNotNull() & F.col("step").isin(list(RANKS)))


def _rank(step: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])[step]


def judged(events: DataFrame) -> DataFrame:
    """The batch answer: every event of a job up to the first gap in its numbers, with the job's status and percent after it,
    or, if it is illegal, why. An illegal step lies before the one reached, so the greatest so far is the one reached."""
    once = events_of(events).groupBy("job", "seq").agg(F.min(F.struct("step", "done", "total")).alias("e")).select("job", "seq", "e.*")
    by_job = Window.partitionBy("job").orderBy("seq")
    placed = once.withColumn("_k", F.row_number().over(by_job) - 1).where("_k = seq").withColumn("_rank", _rank(F.col("step")))
    before = F.max("_rank").over(by_job.rowsBetween(Window.unboundedPreceding, -1))
    rows = placed.withColumn("_before", before)
    final = [RANKS[s] for s in FINAL]
    legal = F.col("_before").isNull() | (~F.col("_before").isin(final) & ((F.col("_rank") > F.col("_before")) | ((F.col("_rank") == F.col("_before")) & F.col("step").isin(*COUNTING))))
    reached = F.element_at(F.array(*map(F.lit, RANKS)), F.col("_before") + 1)
    now = state(F.col("step"), F.col("done"), F.col("total"))
    return rows.select("job", "seq", "step", F.when(legal, now["status"]).alias("status"), F.when(legal, now["percent"]).alias("percent"), F.when(~legal, F.concat(F.lit("not after "), reached)).alias("problem"))


class JobStates(StatefulProcessor):
    """State of one job: `reached` (awaited number, step) and `early` (events that came too early, in blocks of BLOCK numbers,
    each read and written at once). `stalled_after`: seconds without an event after which a job that has not ended is
    reported; 0: never."""

    def __init__(self, stalled_after: float = 0):
        self.stalled_after = stalled_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reached = handle.getValueState("reached", StructType([StructField("awaited", LongType()), StructField("step", StringType())]))
        self.early = handle.getMapState("early", StructType([StructField("block", LongType())]), StructType([StructField("events", StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        awaited, step = self.reached.get() if self.reached.exists() else (0, None)
        early = _Early(self.early)
        for seq, *event in sorted((r.seq, r.step, r.done, r.total) for r in rows):
            if seq >= awaited:
                early.put(seq, event)
        while (event := early.take(awaited)) is not None:
            row, step = _judge(key[0], awaited, event, step)
            yield _ROW(*row)
            awaited += 1
        early.write()
        self.reached.update((awaited, step))
        if self.stalled_after:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if step not in FINAL:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.stalled_after))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        awaited, step = self.reached.get() if self.reached.exists() else (0, None)
        yield _ROW(key[0], awaited, step, None, None, "stalled")

    def close(self) -> None:
        pass


class _Early:
    """A job's early events by number, of which a block is read when first asked for, and written back if it has changed."""

    def __init__(self, state: MapState) -> None:
        self.state = state
        self.blocks: dict[int, dict[str, list]] = {}
        self.stored: set[int] = set()
        self.changed: set[int] = set()

    def _of(self, seq: int) -> dict[str, list]:
        k = seq // BLOCK
        if k not in self.blocks:
            there = self.state.containsKey((k,))
            self.blocks[k] = json.loads(self.state.getValue((k,))[0]) if there else {}
            self.stored |= {k} if there else set()
        return self.blocks[k]

    def put(self, seq: int, event: list) -> None:
        """Keep an event, unless its number has one."""
        block = self._of(seq)
        if str(seq) not in block:
            block[str(seq)] = event
            self.changed.add(seq // BLOCK)

    def take(self, seq: int) -> list | None:
        event = self._of(seq).pop(str(seq), None)
        if event is not None:
            self.changed.add(seq // BLOCK)
        return event

    def write(self) -> None:
        for k in self.changed:
            if self.blocks[k]:
                self.state.updateValue((k,), (json.dumps(self.blocks[k]),))
            elif k in self.stored:
                self.state.removeKey((k,))


def _judge(job: str, seq: int, event: list, reached: str | None) -> tuple[tuple, str]:
    step, done, total = event
    rank, before = RANKS[step], RANKS.get(reached, -1)
    if reached in FINAL or not (rank > before or (rank == before and step in COUNTING)):
        return (job, seq, step, None, None, f"not after {reached}"), reached
    begin, more = _PHASES.get(step, (STEPS.get(step), 0))
    percent = None if begin is None else begin + (int(done / max(total, 1) * more) if more else 0)
    return (job, seq, step, step if step in ("queued", *FINAL) else "running", percent, None), step


def states(events: DataFrame, stalled_after: float = 0) -> DataFrame:
    """The stream of judged events (columns of `judged`) of a stream of events. With `stalled_after`, batches go on for the
    timers' sake, so the trigger should be one of time and not `availableNow`. The session's state store must be RocksDB
    (`PROVIDER`, `ROCKS`)."""
    kind = StructType([StructField("job", StringType()), StructField("seq", LongType()), StructField("step", StringType()), StructField("status", StringType()), StructField("percent", IntegerType()), StructField("problem", StringType())])
    return events_of(events).groupBy("job").transformWithState(JobStates(stalled_after), outputStructType=kind, outputMode="append", timeMode="ProcessingTime" if stalled_after else "None")
