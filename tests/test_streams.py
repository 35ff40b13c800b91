"""Streams against their batch answers: job states out of order, live scans that are killed and repeated."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators import rules
from siltstone.streaming import jobs, live_scan

EVENTS = "job string, seq long, step string, done long, total long"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(jobs.PROVIDER)
    spark.conf.set(jobs.PROVIDER, jobs.ROCKS)
    yield spark
    spark.conf.set(jobs.PROVIDER, before)


def by_hand(events):
    """Every job's events in order of number, up to the first gap, one after another."""
    out, steps = set(), list(jobs.RANKS)
    for job in {e[0] for e in events}:
        reached, mine = None, {}
        for e in events:
            if e[0] == job and e[2] in jobs.RANKS and e[1] is not None:
                mine.setdefault(e[1], e)
        seq = 0
        while seq in mine:
            _, _, step, done, total = mine[seq]
            ok = reached not in ("completed", "failed") and (reached is None or steps.index(step) > steps.index(reached) or (step == reached and step in ("files", "analysis")))
            out.add((job, seq, step, not ok))
            reached = step if ok else reached
            seq += 1
    return out


def shuffled(rng, n):
    events = []
    for j in range(n):
        k = 0
        for seq in range(rng.randint(1, 12)):
            k = max(0, min(len(jobs.RANKS) - 1, k + rng.choice([0, 1, 1, 1, 2, -1])))
            events.append((f"j{j}", seq, list(jobs.RANKS)[k], rng.randint(0, 5), 5))
    gap = [e for e in events if e[0] == "j1" and e[1] != 2]
    events = [e for e in events if e[0] != "j1"] + gap + [(None, 0, "queued", 0, 0), ("j0", None, "queued", 0, 0), ("j0", 50, "odd", 0, 0)]
    rng.shuffle(events)
    return events


def test_states_out_of_order_equal_the_batch(rocks, tmp_path):
    spark, rng = rocks, random.Random(6)
    events = shuffled(rng, 15)
    batch = jobs.judged(spark.createDataFrame(events, EVENTS))
    assert {(r.job, r.seq, r.step, r.problem is not None) for r in batch.collect()} == by_hand([e for e in events if e[0]])
    for k in range(3):
        spark.createDataFrame(events[k::3] + events[:5], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.states(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).select(*batch.columns).collect())) == sorted(map(repr, batch.collect()))


def test_jobs_that_stall_are_reported(rocks, tmp_path):
    spark = rocks
    spark.createDataFrame([("a", 0, "queued", 0, 0), ("a", 1, "started", 0, 0), ("b", 0, "queued", 0, 0), ("b", 1, "failed", 0, 0)], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    query = jobs.states(source, stalled_after=0.5).writeStream.format("memory").queryName("stalls").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("stalls").where("problem = 'stalled'").count():
            time.sleep(0.5)
        assert {(r.job, r.step) for r in spark.table("stalls").where("problem = 'stalled'").collect()} == {("a", "started")}
    finally:
        query.stop()


def test_a_batch_that_is_killed_and_repeated_gives_the_same_numbers(spark, tmp_path, monkeypatch):
    folder, into, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    sources = [("r", f"f{i}.js", "var a;\nif (a == 1) debugger;" if i % 3 else "let x = 1;") for i in range(12)]
    add = lambda rows: spark.createDataFrame(rows, "repo string, file string, source string").coalesce(1).write.mode("append").parquet(folder)
    seen, cursor = [], 0

    def poll():
        nonlocal cursor
        rows, after = live_scan.results(spark, into, cursor)
        got = sorted(r.number for r in rows.collect()) if rows is not None else []
        assert got == list(range(cursor + 1, after + 1))
        seen.extend(got)
        cursor = after

    poll()
    add(sources[:4])
    live_scan.run(live_scan.arriving(spark, folder, 1), into, state).awaitTermination()
    poll()
    first = {r.number: (r.file, r.rule) for r in live_scan.results(spark, into)[0].collect()}
    add(sources[4:8])
    real = live_scan.enter
    monkeypatch.setattr(live_scan, "enter", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        live_scan.run(live_scan.arriving(spark, folder, 1), into, state).awaitTermination()
    poll()
    assert cursor == len(first)  # what is not in the ledger is not there
    monkeypatch.setattr(live_scan, "enter", real)
    add(sources[8:])
    live_scan.run(live_scan.arriving(spark, folder, 1), into, state).awaitTermination()
    poll()
    batch = rules.detect(spark.createDataFrame(sources, "repo string, file string, source string"), key=("repo", "file"))
    whole = live_scan.results(spark, into)[0]
    assert sorted((r.file, r.line_start, r.rule) for r in whole.collect()) == sorted((r.file, r.line_start, r.rule) for r in batch.collect())
    assert seen == list(range(1, batch.count() + 1)) and {r.number: (r.file, r.rule) for r in whole.where(F.col("number") <= len(first)).collect()} == first
    live_scan.take(spark.createDataFrame(sources[:1], "repo string, file string, source string"), 0, into, lambda f: rules.detect(f, key=live_scan.KEY))
    assert live_scan.results(spark, into)[0].count() == batch.count()


def test_a_batch_of_one_file_is_searched_by_all_cores(spark, tmp_path):
    rows = spark.range(400).selectExpr("'r' AS repo", "'f' || id || '.js' AS file", "'var a' || id AS source")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = lambda files: rules.detect(files, key=live_scan.KEY).withColumn("task", F.spark_partition_id())
    live_scan.take(spark.read.parquet(str(tmp_path / "in")), 0, str(tmp_path / "out"), found)
    got, last = live_scan.results(spark, str(tmp_path / "out"))
    shares = [r["count"] for r in got.groupBy("task").count().collect()]
    assert last == sum(shares) == 400 and len(shares) >= spark.sparkContext.defaultParallelism and max(shares) < 100


class _Counted(dict):
    """A map state that counts what it is asked."""

    calls = 0

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self[key]


def test_early_events_are_read_and_written_by_blocks():
    """The state is asked a few times a block of numbers, not for each event; what is kept is the first of each number."""
    held, n = _Counted(), 3 * jobs.BLOCK
    early = jobs._Early(held)
    for seq in range(1, n):
        early.put(seq, ["files", seq, n])
        early.put(seq, ["later", 0, 0])
    assert early.take(0) is None
    early.write()
    again = jobs._Early(held)
    again.put(5, ["later", 0, 0])
    again.put(0, ["queued", 0, 0])
    assert [again.take(seq) for seq in range(n + 1)] == [["queued", 0, 0], *(["files", seq, n] for seq in range(1, n)), None]
    again.write()
    assert not held and held.calls <= 20
