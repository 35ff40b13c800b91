"""Queries of lexing by language, Python's scopes and the streams, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions.lineage import fresh_path
from siltstone.operators import brackets, python_rules
from siltstone.plans.code_queries import _js
from siltstone.plans.scan_queries import _CASE, _pick
from siltstone.plans.source_queries import query, spread, table
from siltstone.streaming import jobs, live_scan, scan_jobs

#: Extension, what comes before a text and after it, what each line begins with, and the signs that would end it.
QUOTED = [
    ("php", "# ", "", "# ", "?>"), ("rb", "# ", "", "# ", ""), ("kt", 'x = """', '"""', "", '"$'), ("cs", 'x = @"', '"', "", '"'), ("rs", 'let x = r#"', '"#;', "", '"'),
    ("swift", "/* /* ", " */ */", "", "*/"), ("go", "x := `", "`", "", "`"), ("js", "x = `", "`", "", "`$\\"), ("java", 'x = """\n', '"""', "", '"\\'), ("cpp", 'x = R"y(', ')y"', "", ")"), ("rb", "x = <<~END_OF_IT\n", "\nEND_OF_IT", "", ""), ("ts", "/* ", "*/", "", "*"),
]


@query(f"""
SELECT 'd' || doc_id || '.' || {_CASE("doc_id", [q[0] for q in QUOTED])} AS file, (2 + length(text) - length(replace(text, chr(10), '')) + CASE doc_id % {len(QUOTED)} WHEN 8 THEN 1 WHEN 10 THEN 2 ELSE 0 END)::INT AS line_start, 'unclosed_bracket' AS rule
FROM documents WHERE text IS NOT NULL AND NOT contains(text, 'END_OF_IT')""")
def q_quoted_texts(spark, sf_dir):
    """Every document's text in a comment or a string of some language, with one bracket open after it: whatever stands in the
    text, that bracket is all that is found."""
    k = F.col("doc_id")
    clean = F.translate(F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), _pick(k, [q[3] for q in QUOTED]))), "\0", "")
    for i, q in enumerate(QUOTED):
        clean = F.when(k % len(QUOTED) == i, F.translate(clean, q[4], "") if q[4] else clean).otherwise(clean)
    source = F.concat(_pick(k, [q[1] for q in QUOTED]), clean, _pick(k, [q[2] for q in QUOTED]), F.lit("\nf("))
    rows = spread(table(spark, sf_dir, "documents")).where(F.col("text").isNotNull() & ~F.contains("text", F.lit("END_OF_IT")))
    return brackets.bracket_findings(rows.select(F.concat(F.lit("d"), k.cast("string"), F.lit("."), _pick(k, [q[0] for q in QUOTED])).alias("file"), source.alias("source")))


#: Source around a name (%s), and what is found in it: rules and lines.
SCOPED = [
    ("import %s", [("unused_import", 1)]), ("from %s import a\nprint(a)", []), ("from a import %s", [("unused_import", 1)]), ("def f(%s, %s): pass\nf(1, 1)", [("syntax_error", 1)]), ("return %s", [("syntax_error", 1), ("undefined_name", 1)]),
    ("def a():\n    %s = 1\n    return %s\ndef b():\n    return %s\na(b())", [("undefined_name", 5)]), ("def f():\n    %s = 1\nf()", [("unused_variable", 2)]), ("import %s\nimport %s\nprint(%s)", [("redefined_while_unused", 2)]), ("for %s in []: pass\nbreak", [("syntax_error", 2)]),
    ("x = {'%s': 1, '%s': 2}\nprint('%%s %%s' %% (x,))", [("duplicate_key", 1), ("format_arguments", 2)]), ("%s = [i for i in range(3)]\nprint(i)", [("undefined_name", 2)]), ("import %s\n__all__ = ['%s']", []), ("try:\n    import %s\nexcept ImportError:\n    %s = None\nprint(%s)", []),
    ("def f():\n    print(%s)\n    %s = 1\nf()", [("undefined_local", 2)]), ("def f(%s):\n    global %s\nf(1)", [("syntax_error", 2)]), ("def %s(): pass\ndef %s(): pass\n%s()", [("redefined_while_unused", 2)]), ("x = '{} {%s}'.format(1)\nprint(x is 'a')", [("format_arguments", 1), ("is_literal", 2)]),
]
_ROWS = " UNION ALL ".join(f"SELECT {i} AS k, '{rule}' AS rule, {line} AS line" for i, (_, found) in enumerate(SCOPED) for rule, line in found)


@query(f"SELECT p_partkey, rule, (line + p_size % 4)::INT AS line_start FROM part JOIN ({_ROWS}) ON p_partkey % {len(SCOPED)} = k")
def q_python_scopes(spark, sf_dir):
    k = F.col("p_partkey")
    named = F.replace(_pick(k, [s.replace("%%", "\0") for s, _ in SCOPED]), F.lit("%s"), F.concat(F.lit("n"), k.cast("string")))
    source = F.concat(F.repeat(F.lit("\n"), (F.col("p_size") % 4).cast("int")), F.replace(named, F.lit("\0"), F.lit("%")))
    made = spread(table(spark, sf_dir, "part")).select(F.format_string("%d.py", k).alias("file"), source.alias("source"))
    return python_rules.detect(made).select(F.substring_index("file", ".", 1).cast("long").alias("p_partkey"), "rule", "line_start")


_STEPS = list(scan_jobs.STEPS)


@query(f"""
WITH e AS (SELECT user_id::VARCHAR AS job, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
r AS (SELECT job, seq, event_id % 6 AS done, least(9, (seq + event_id % 3) // 2) AS rank FROM e),
b AS (SELECT *, max(rank) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
l AS (SELECT *, before IS NULL OR (before < 9 AND (rank > before OR (rank = before AND rank IN (5, 6)))) AS legal FROM b)
SELECT job, seq, {_STEPS}[rank + 1] AS step, CASE WHEN legal THEN CASE rank WHEN 0 THEN 'queued' WHEN 9 THEN 'completed' ELSE 'running' END END AS status,
  coalesce(CASE WHEN legal THEN CASE rank WHEN 5 THEN 25 + floor(done / 5 * 45)::INT WHEN 6 THEN 70 + floor(done / 5 * 25)::INT ELSE {list(scan_jobs.STEPS.values())}[rank + 1] END END::INT, -1) AS percent, CASE WHEN NOT legal THEN 'not after ' || {_STEPS}[before + 1] END AS problem FROM l""")
def q_job_stream(spark, sf_dir):
    """Users' events as steps of jobs, which arrive out of order in three files and are judged by keyed state."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rank = F.least(F.lit(9), F.floor((F.col("seq") + F.col("event_id") % 3) / 2)).cast("int")
    rows = table(spark, sf_dir, "events").withColumn("seq", seq.cast("long"))
    made = rows.select(F.col("user_id").cast("string").alias("job"), "seq", F.element_at(F.array(*map(F.lit, _STEPS)), rank + 1).alias("step"), (F.col("event_id") % 6).cast("long").alias("done"), F.lit(5).cast("long").alias("total"), ((F.col("event_id") * 7919) % 3).alias("_file"))
    shared, before = fresh_path(spark, "jobs"), spark.conf.get(jobs.PROVIDER)
    made.repartition(3, "_file").drop("_file").write.parquet(f"{shared}/log")
    source = spark.readStream.schema(made.drop("_file").schema).option("maxFilesPerTrigger", 1).parquet(f"{shared}/log")
    spark.conf.set(jobs.PROVIDER, jobs.ROCKS)
    try:
        jobs.states(source).writeStream.format("parquet").option("path", f"{shared}/out").option("checkpointLocation", f"{shared}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(jobs.PROVIDER, before)
    return spark.read.schema(jobs.OUT).parquet(f"{shared}/out").withColumn("percent", F.coalesce("percent", F.lit(-1)))


@query("""
SELECT file, rule, line_start::INT AS line_start, count(*) OVER () AS numbers, count(*) OVER () AS last_number FROM (
  SELECT 'f' || o_orderkey || '.js' AS file, unnest([
    CASE WHEN o_orderkey % 4 IN (0, 2) THEN {'rule': 'loose_equality', 'line_start': 1} END, CASE WHEN o_orderkey % 3 = 0 THEN {'rule': 'var_declaration', 'line_start': 2} END,
    CASE WHEN o_orderkey % 5 = 0 THEN {'rule': 'leftover_console_statement', 'line_start': 3} END, CASE WHEN o_orderkey % 2 = 0 THEN {'rule': 'leftover_debugger_statement', 'line_start': 5} END,
    CASE WHEN o_orderkey % 7 = 0 THEN {'rule': 'empty_catch_block', 'line_start': 6} END], recursive := true) FROM orders) WHERE rule IS NOT NULL""")
def q_live_scan(spark, sf_dir):
    """Files that arrive in three batches: their findings, how many numbers they got and the last of them."""
    shared = fresh_path(spark, "live")
    _js(spark, sf_dir).select(F.lit("r").alias("repo"), "file", "source").repartition(3).write.parquet(f"{shared}/in")
    live_scan.run(live_scan.arriving(spark, f"{shared}/in", 1), f"{shared}/out", f"{shared}/state").awaitTermination()
    rows, _ = live_scan.results(spark, f"{shared}/out")
    n = rows.agg(F.count_distinct("number").alias("n"), F.max("number").alias("last")).first()
    return rows.select("file", "rule", "line_start", F.lit(n.n).cast("long").alias("numbers"), F.lit(n.last).cast("long").alias("last_number"))
