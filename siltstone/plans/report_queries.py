"""Queries of reports, progress and cursors, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.lineage import fresh_path
from siltstone.operators import report, retrieval
from siltstone.plans import scan
from siltstone.plans.code_queries import SCRIPTS, _scripts
from siltstone.plans.source_queries import query, table
from siltstone.sources import history
from siltstone.streaming import scan_jobs


def _explains(frames):
    """An analyzer for the scan's own test: a cause and a solution for each finding, and no code."""
    for frame in frames:
        yield frame.assign(cause="seen", solution="mend it", confidence="80", unavailable=False)


def q_scan_report(spark, sf_dir):
    """Flagship: all page scripts through detection, chunks, retrieval, analysis, repair and validation, summed up by rule."""
    files = _scripts(spark, sf_dir).select((F.col("page_id") % 20).cast("string").alias("repo"), "file", "source")
    known = table(spark, sf_dir, "benchmark").select(F.monotonically_increasing_id().alias("id"), F.col("text").alias("bug_description"), retrieval.hashed_vector(F.col("text")).alias("embedding"))
    # an issue is a whole conversation, turn by turn
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    said = turns.select((F.col("conv_id") % 20).cast("string").alias("repo"), F.col("conv_id").alias("number"), F.lit("issue").alias("artifact_type"), F.array_join(F.col("turns.text"), "\n").alias("body"), F.date_format(F.timestamp_seconds("conv_id"), "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), F.lit(False).alias("is_pull_request"))
    past = history.issues(said).withColumn("embedding", retrieval.hashed_vector(F.col("body")))
    found = scan.scan(files, known, past, _explains)
    return report.summary(found.withColumn("unavailable", F.col("unavailable") | (F.col("validation_status") != "valid")), "rule")


query(f"""
SELECT 'var_declaration' AS rule, count(*)::BIGINT AS bugs, 80 AS confidence, false AS any_unavailable, CASE WHEN count(*) <= 10 THEN 'Less Errors' WHEN count(*) <= 30 THEN 'Medium Errors' ELSE 'More Errors' END AS error_level, 'High' AS confidence_level
FROM {SCRIPTS} WHERE source LIKE 'var %' HAVING count(*) > 0""")(q_scan_report)


@query("""
SELECT lang, count(*)::BIGINT AS bugs, round_even(avg(CASE WHEN l.quality = 1 THEN 81 ELSE d.doc_id % 60 END), 0)::INT AS confidence, max(l.toxic) = 1 AS any_unavailable,
  CASE WHEN count(*) <= 10 THEN 'Less Errors' WHEN count(*) <= 30 THEN 'Medium Errors' ELSE 'More Errors' END AS error_level,
  CASE WHEN round_even(avg(CASE WHEN l.quality = 1 THEN 81 ELSE d.doc_id % 60 END), 0) >= 70 THEN 'High' ELSE 'Low' END AS confidence_level
FROM documents d JOIN labels l USING (doc_id) GROUP BY lang""")
def q_confidence_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return report.summary(rows.select("lang", F.when(F.col("quality") == 1, 81).otherwise(F.col("doc_id") % 60).alias("confidence"), (F.col("toxic") == 1).alias("unavailable")), "lang")


@query("""
SELECT user_id, count(*)::BIGINT AS errors, CASE WHEN count(*) <= 10 THEN 'Less Errors' WHEN count(*) <= 30 THEN 'Medium Errors' ELSE 'More Errors' END AS error_level FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id""")
def q_error_level(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("event_type"))  # one row
    return e.join(F.broadcast(first), "event_type").groupBy("user_id").agg(F.count("*").alias("errors")).withColumn("error_level", report.error_level(F.col("errors")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS number FROM orders")
def q_report_numbers(spark, sf_dir):
    return report.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", partitions=8).select("o_orderkey", F.col("number").cast("long").alias("number"))


@query("""
SELECT s_suppkey, s_nationkey AS provider, ((place - 2 + 1000000 * n) % n)::INT AS use FROM (
  SELECT *, row_number() OVER (ORDER BY turn, s_nationkey) - 1 AS place, count(*) OVER () AS n FROM (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn FROM supplier))""")
def q_key_rotation(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("provider"), F.col("s_suppkey").alias("number"), F.col("s_name").alias("value"))
    return report.rotated(s.unionByName(s), 2).select(F.col("number").alias("s_suppkey"), "provider", "use")


@query("""
SELECT event_id, done::BIGINT AS done, (25 + floor(done / total * 45))::INT AS percent FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events)""")
def q_progress(spark, sf_dir):
    return scan_jobs.progress(table(spark, sf_dir, "events"), "user_id", "event_id").select("event_id", "done", "percent")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def q_job_state(spark, sf_dir):
    return scan_jobs.latest(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "event_id")


@query("SELECT event_id, (SELECT max(event_id) FROM events) AS next_cursor FROM events WHERE event_id > 500")
def q_cursor(spark, sf_dir):
    return scan_jobs.after(table(spark, sf_dir, "events"), 500, "event_id").select("event_id", "next_cursor")


@query("SELECT user_id, count(*)::BIGINT AS n, max(event_id) AS last_id FROM events GROUP BY user_id")
def q_stream_cursor(spark, sf_dir):
    """The events as a stream of files, drained into a table; a second call finds nothing new."""
    events = table(spark, sf_dir, "events")
    shared = fresh_path(spark, "stream")
    log = f"{shared}/log"
    events.select("event_id", "user_id").write.parquet(log)
    for _ in range(2):
        scan_jobs.drain(scan_jobs.stream(spark, log, "event_id bigint, user_id bigint"), f"{shared}/out", f"{shared}/state")
    return spark.read.parquet(f"{shared}/out").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
