"""Queries of the scan's parts, from detection to report rows, with their SQL for DuckDB."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunks, providers, repair, report, retrieval, review, rules, validation
from siltstone.plans.source_queries import query, spread, table
from siltstone.sources import files, history, knowledge
from siltstone.streaming import scan_jobs


def _pick(key, options):
    """The option of the key's remainder."""
    return F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in options]), (key % len(options) + 1).cast("int"))


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("p_container", F.concat("p_type", F.lit("!")))


def _null():
    return F.lit(None).cast("string")


#: Extension, code, rule (null: none) and line of faults that detection must tell apart.
FAULTS = [
    ("js", "f(a[1);", "mismatched_bracket", 1), ("js", "x = 'open", "unterminated_string", 1), ("js", "x = `open ${a}", "unterminated_template_literal", 1), ("js", "/* open", "unterminated_comment", 1),
    ("js", "function f() {\n return 1;\n g();\n}", "unreachable_code", 3), ("js", "f((", "unclosed_bracket", 1), ("js", "debugger;", "leftover_debugger_statement", 1), ("ts", "if (a == b) {}", "loose_equality", 1),
    ("py", "x = [1, 2", "syntax_error", 1), ("py", "x = 1\nprint(x == None)", "eq_none", 2), ("rs", "println!(1)", None, 1), ("go", "x := `a\\`\nf(", "unclosed_bracket", 2), ("jsx", "a = <p>( {f('<')} </p>;\nf());", "unexpected_closing_bracket", 2),
]
_SQL = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_CASE = lambda key, options: f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {_SQL(o)}" for i, o in enumerate(options)) + " END"


@query(f"""
SELECT * FROM (SELECT o_orderkey % 2 AS repo, 'd/f' || (o_orderkey // 26) || '.' || {_CASE("(o_orderkey // 2)", [f[0] for f in FAULTS])} AS file, {_CASE("(o_orderkey // 2)", [f[2] for f in FAULTS])} AS rule,
  ({_CASE("(o_orderkey // 2)", [f[3] for f in FAULTS])} + o_custkey % 5)::INT AS line_start, trim({_CASE("(o_orderkey // 2)", [f[1].split(chr(10))[f[3] - 1] for f in FAULTS])}) AS current_code FROM orders) WHERE rule IS NOT NULL""")
def q_detect(spark, sf_dir):
    k = F.floor(F.col("o_orderkey") / 2)
    made = spread(table(spark, sf_dir, "orders")).select((F.col("o_orderkey") % 2).alias("repo"), F.concat(F.lit("d/f"), F.floor(F.col("o_orderkey") / 26), F.lit("."), _pick(k, [f[0] for f in FAULTS])).alias("file"), F.concat(F.repeat(F.lit("\n"), (F.col("o_custkey") % 5).cast("int")), _pick(k, [f[1] for f in FAULTS])).alias("source"))
    return rules.detect(made, key=("repo", "file")).select("repo", "file", "rule", "line_start", "current_code")


@query("""
WITH s AS (SELECT o_orderkey, o_custkey % 150 AS m, CASE o_orderkey % 3 WHEN 0 THEN 'class C {' || chr(10) || repeat('  a();' || chr(10), (o_custkey % 150)::INT) || '}' || chr(10) || 'tail();'
    WHEN 1 THEN 'x = 1' || chr(10) || 'def run' || chr(10) || repeat('  y' || chr(10), (o_custkey % 150)::INT) || 'end' || chr(10) || 'z' ELSE repeat('select 1;' || chr(10), (o_custkey % 150 + 1)::INT) END AS source FROM orders),
l AS (SELECT *, string_split(rtrim(source, chr(10)), chr(10)) AS l FROM s),
r AS (SELECT *, unnest(CASE o_orderkey % 3 WHEN 0 THEN [{'a': 1, 'b': least(m + 2, 120) + 3, 't': 'class', 'n': 'C'}] WHEN 1 THEN [{'a': 1, 'b': least(m + 3, 121) + 3, 't': 'function', 'n': 'run'}]
    ELSE list_transform(range(0, m // 80 + 1), lambda i: {'a': i * 80 + 1, 'b': i * 80 + 80, 't': 'code_block', 'n': 'block_' || (i * 80 + 1)}) END, recursive := true) FROM l)
SELECT o_orderkey, t AS chunk_type, n AS name, a::INT AS line_start, least(b, len(l))::INT AS line_end, trim(array_to_string(l[a:b], chr(10)), E' \\n') AS code FROM r""")
def q_chunk_file(spark, sf_dir):
    m = (F.col("o_custkey") % 150).cast("int")
    sources = [F.concat(F.lit("class C {\n"), F.repeat(F.lit("  a();\n"), m), F.lit("}\ntail();")), F.concat(F.lit("x = 1\ndef run\n"), F.repeat(F.lit("  y\n"), m), F.lit("end\nz")), F.repeat(F.lit("select 1;\n"), m + 1)]
    made = spread(table(spark, sf_dir, "orders")).select("o_orderkey", F.concat(F.lit("f."), _pick(F.col("o_orderkey"), ["js", "rb", "sql"])).alias("file"), _pick(F.col("o_orderkey"), sources).alias("source"))
    return chunks.chunked(made, ("o_orderkey", "file")).select("o_orderkey", "chunk_type", "name", "line_start", "line_end", "code")


@query("""
SELECT p_partkey, trim(array_to_string(string_split(t, ' ')[2:3], chr(10))) AS segment, concat_ws(chr(10), t, CASE WHEN p_size % 3 = 0 THEN 'Error: ' || p_type END, 'Code: ' || p_brand) AS short,
  concat_ws(chr(10), 'File: ' || t, CASE WHEN p_size % 3 = 0 THEN 'Bug type: ' || p_type END, 'Detection rule: ' || p_brand, 'Code: ' || p_container) AS labelled,
  concat_ws(chr(10), t, '', p_brand, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END, p_container) AS five,
  'function ' || p_brand || chr(10) || 'Lines ' || p_size || '-' || (p_size + 2) || chr(10) || t AS context,
  'File: ' || t || chr(10) || 'Language: Java' || chr(10) || 'Chunk type: function' || chr(10) || 'Name: ' || p_brand || chr(10) || 'Parent: ' || CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END || chr(10) || 'Lines: ' || p_size || '-' || (p_size + 2) || chr(10) || 'Code:' || chr(10) || p_container AS described,
  t || ':' || p_size || '-' || (p_size + 2) || ':' || p_brand AS id, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_container END AS picked FROM (SELECT *, p_name AS t FROM (SELECT *, p_type || '!' AS p_container FROM part))""")
def q_text_forms(spark, sf_dir):
    c, some = F.col, F.when(F.col("p_size") % 3 == 0, F.col("p_type"))
    last = c("p_size") + 2
    return _parts(spark, sf_dir).select(
        "p_partkey", T.segment(F.replace("p_name", F.lit(" "), F.lit("\n")), F.lit(2), F.lit(3)).alias("segment"), T.schema_text(c("p_name"), some, c("p_brand")).alias("short"),
        T.labelled_query(c("p_name"), some, c("p_brand"), F.lit(" "), _null(), c("p_container")).alias("labelled"), T.finding_query(c("p_name"), _null(), c("p_brand"), some, c("p_container")).alias("five"),
        T.chunk_context(F.lit("function"), c("p_brand"), c("p_size"), last, c("p_name")).alias("context"), T.described_chunk(c("p_name"), F.lit("Java"), F.lit("function"), c("p_brand"), some, c("p_size"), last, c("p_container")).alias("described"),
        T.chunk_id(c("p_name"), c("p_size"), last, c("p_brand")).alias("id"), T.code_context(some, F.lit("  "), c("p_container")).alias("picked"),
    )


@query(r"""
SELECT conv_id, turn, role, trim(text, E' \n\t\r\x0b\x0c') AS fenced, regexp_replace(regexp_replace(text, '\A(?:[ \t]*\n)+', ''), '\s+\z', '') AS code FROM conversations WHERE trim(text, E' \n\t\r\x0b\x0c') <> ''""")
def q_reply_cleaning(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(T.safe_text(F.col("text")) != "")
    before = _pick(F.col("turn"), ["Lines 4 - 9\n", "Corrected Code:\n", "method getAll\n", "## Solution\n", "File: src/a.py\n", "REPLACE WITH THIS CODE\n", "lines: 3-4\nCause:\n"])
    fenced = F.concat(_pick(F.col("turn"), ["```json\n", "```", "\n```JSON "]), "text", F.lit("\n```"))
    return c.select("conv_id", "turn", "role", T.clean_json_fence(fenced).alias("fenced"), T.clean_replacement(F.concat(F.lit("```js\n"), before, "text", F.lit("\n```"))).alias("code"))


@query("""
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'read: rate limit exceeded' WHEN 1 THEN 'read: credentials rejected' WHEN 2 THEN 'read: access denied' WHEN 3 THEN 'read: not found' WHEN 4 THEN 'read: status 500' END AS message FROM events""")
def q_http_errors(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", files.http_error(F.element_at(F.array(*map(F.lit, (403, 401, 403, 404, 500, 200, 304))), (k % 7 + 1).cast("int")), F.when(k % 7 == 0, "0").otherwise("9"), F.lit("read")).alias("message"))


@query("""
SELECT conv_id, count(*)::INT AS turns, 'issue' AS artifact_type, least(20, count(*) FILTER (trim(text, E' \\n\\t\\r') <> ''))::INT AS n_comments, array_to_string(list(DISTINCT role ORDER BY role), ', ') AS labels,
  concat_ws(chr(10), 'Title: T' || conv_id, 'State: open', 'Labels: ' || array_to_string(list(DISTINCT role ORDER BY role), ', ')) AS bare
FROM conversations GROUP BY conv_id""")
def q_artifacts(spark, sf_dir):
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("said"), F.array_sort(F.collect_set("role")).alias("roles"))
    items = grouped.select("turns", F.lit("r").alias("repo"), F.col("conv_id").alias("number"), F.format_string(" T%d ", "conv_id").alias("title"), _null().alias("body"), F.lit("open").alias("state"), F.transform("roles", lambda r: F.struct(r.alias("name"))).alias("labels"), F.transform("said", lambda x: x["text"]).alias("comments"), _null().alias("html_url"), _null().alias("created_at"), _null().alias("updated_at"))
    made = history.artifacts(history.normalised(items, "issue"), history.normalised(items.limit(0).withColumn("merged_at", _null()).withColumn("patch", _null()), "pull_request"))
    bare = history.source_text(F.col("title"), F.col("body"), F.col("state"), F.array().cast("array<string>"), _null(), F.col("labels"))
    return made.join(items.select("number", "turns"), "number").select(F.col("number").alias("conv_id"), "turns", "artifact_type", F.size("comments").alias("n_comments"), F.array_join("labels", ", ").alias("labels"), bare.alias("bare"))


@query("""
WITH p AS (SELECT q.vec_id AS query_id, r.vec_id AS number, list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings r ON q.vec_id % 7 = r.vec_id % 7 WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, number DESC) AS rank FROM p)
SELECT query_id, number, round(greatest(0, least(1, s)), 5) AS similarity, rank::INT AS rank FROM k WHERE rank <= 3 AND s > 0.05""")
def q_topk_artifacts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("repo", F.col("vec_id") % 7)
    hits = retrieval.top_k_within(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "number"), "repo", 3)
    return hits.select("query_id", "number", F.round("similarity", 5).alias("similarity"), "rank")


@query("""
WITH q AS (SELECT vec_id AS query_id, vec_id % 5 AS repo, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT query_id, 0 AS source_ord, r.vec_id AS hit, list_inner_product(v, r.embedding::DOUBLE[]) AS s FROM q JOIN embeddings r ON r.vec_id % 2 = 0
  UNION ALL SELECT query_id, 1, r.vec_id, list_inner_product(v, r.embedding::DOUBLE[]) FROM q JOIN embeddings r ON r.vec_id % 2 = 1 AND r.vec_id % 5 = q.repo),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_ord ORDER BY s DESC, CASE source_ord WHEN 0 THEN hit ELSE -hit END) AS rank FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY least(1, s) DESC, source_ord, rank) AS position FROM k WHERE rank <= 3 AND s > 0.05)
SELECT query_id, source_ord, hit, round(least(1, s), 5) AS similarity, position::INT AS position FROM m WHERE position <= 6""")
def q_finding_hits(spark, sf_dir):
    """What is retrieved for findings: the encoder reads vectors that are written out as the findings' texts."""
    e = table(spark, sf_dir, "embeddings").withColumn("repo", F.col("vec_id") % 5)
    found = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("finding_id"), "repo", F.to_json(F.col("embedding").cast("array<double>")).alias("query"))
    known, past = e.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "id"), e.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "number")
    hits = retrieval.retrieved(found, known, past, encode=lambda text: F.from_json(text, "array<double>"))
    return hits.select("query_id", "source_ord", "hit", F.round("similarity", 5).alias("similarity"), "position")


@query("""
SELECT p_partkey, p_partkey % 3 = 0 AS was_cached, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 64 END AS dimensions FROM part""")
def q_cached_vectors(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("source"), F.col("p_type").alias("artifact_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_partkey")).alias("number"), F.format_string("u/%d", "p_partkey").alias("url"), F.col("p_name").alias("text"))
    cache = p.where("p_partkey % 3 = 0").select("source", "artifact_type", "number", "url", F.array(F.lit(1.0)).alias("embedding"))
    return retrieval.with_vectors(p, cache.unionByName(cache)).select("p_partkey", "was_cached", F.size("embedding").alias("dimensions"))


def _runs(spark, sf_dir):
    k = F.col("o_orderkey")
    blank = lambda m, c: F.when(k % m == 0, F.lit("  ")).otherwise(F.col(c))
    rows = table(spark, sf_dir, "orders").select(k.alias("i"), _pick(k, ["Python", "java", "C", "JAVA"]).alias("language"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("buggy_code"), blank(5, "o_orderstatus").alias("source_code"), _null().alias("fixed_code"), blank(7, "o_orderpriority").alias("target_code"), _null().alias("error_message"), F.col("o_orderstatus").alias("stderr"), F.when(k % 2 == 0, "E").alias("error_class"), F.lit("X").alias("exception_type"))
    return knowledge.capped_pairs(rows, "i", ["python", "java"], 300)


_RUNS = """SELECT i, language, buggy_code, error, bug_type FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY i) AS n FROM (
  SELECT o_orderkey AS i, CASE o_orderkey % 4 WHEN 0 THEN 'python' ELSE 'java' END AS language, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS buggy_code, o_orderstatus AS error, CASE WHEN o_orderkey % 2 = 0 THEN 'E' ELSE 'X' END AS bug_type
  FROM orders WHERE o_orderkey % 4 <> 2 AND o_orderkey % 7 <> 0) WHERE buggy_code <> '') WHERE n <= 300"""


@query(f"SELECT 'runbugrun_' || i AS id, language, buggy_code, error, bug_type FROM ({_RUNS})")
def q_run_records(spark, sf_dir):
    return _runs(spark, sf_dir).select("id", "language", "buggy_code", "error", "bug_type")


@query(f"SELECT language, count(*)::BIGINT AS written FROM ({_RUNS}) GROUP BY language")
def q_run_counts(spark, sf_dir):
    return knowledge.per_language(_runs(spark, sf_dir))


@query("SELECT 'b2f_' || p_partkey AS id, p_name AS buggy_code, p_brand AS fixed_code, 'java' AS language FROM part WHERE p_partkey % 4 <> 0")
def q_code_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit("\n")).alias("buggy"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).otherwise(" \n").alias("fixed"))
    return knowledge.pairs(rows, "p_partkey", "b2f", "buggy", "fixed", "java").select("id", "buggy_code", "fixed_code", "language")


FAULTY = [("a.py", "x = (%d", "does not compile"), ("a.py", "x = (%d)", None), ("a.js", "f(%d", "unclosed_bracket"), ("a.js", "f('%d)", "unterminated_string"), ("a.go", "s := `\\`; f(%d)", None), ("a.ts", "f(%d))", "unexpected_closing_bracket"), ("a.php", "f([%d)]", "mismatched_bracket"), ("a.java", "// ( %d", None)]


@query(f"SELECT o_orderkey, {_CASE('o_orderkey', [f[2] for f in FAULTY])} AS fault, CASE WHEN o_orderkey % 8 < 2 THEN 'parser' ELSE 'structure' END AS method FROM orders")
def q_language_faults(spark, sf_dir):
    k = F.col("o_orderkey")
    file = _pick(k, [f[0] for f in FAULTY])
    code = F.replace(_pick(k, [f[1] for f in FAULTY]), F.lit("%d"), k.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", validation.fault(file, code).alias("fault"), validation.method(file).alias("method"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size % 3 + 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END::INT AS line FROM part""")
def q_reported_line(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.concat_ws("\n", F.lit("first"), F.concat(F.lit("  "), "p_name"), F.col("p_brand"))
    said = _pick(k, [F.lit("absent"), F.concat("p_name", F.lit("\n  "), "p_brand", F.lit(" ")), F.col("p_brand"), F.concat("p_brand", F.lit("\n"), "p_name")])
    line = F.when(k % 4 == 0, F.col("p_size") % 3 + 10).otherwise(99).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(validation.reported_line(code, line, F.lit(10), said), F.lit(0)).alias("line"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'try { f(); } catch (IOException ex' || o_custkey || ') { ex' || o_custkey || '.printStackTrace(); }' WHEN 1 THEN 'try { } catch (err$' || o_custkey || ') { console.error(err$' || o_custkey || '); } catch (b) { }'
  WHEN 2 THEN 'try { } catch (error) { console.error(error); }' WHEN 3 THEN 'try { } catch (System.Exception q' || o_custkey || ') { Console.WriteLine(q' || o_custkey || '); }' END AS fixed FROM orders""")
def q_catch_repair(spark, sf_dir):
    k, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    code = _pick(k, [F.concat(F.lit("try { f(); } catch (IOException ex"), n, F.lit(") { }")), F.concat(F.lit("try { } catch (err$"), n, F.lit(") {} catch (b) { }")), F.lit("try { } catch { }"), F.concat(F.lit("try { } catch (System.Exception q"), n, F.lit(") {\n}")), F.lit("try { } catch (...) { }"), F.lit("try { } catch { }")])
    return table(spark, sf_dir, "orders").select("o_orderkey", repair.repaired(F.lit("empty_catch_block"), code, _pick(k, [".java", ".js", ".ts", ".cs", ".cpp", ".java"]), F.lit(1)).alias("fixed"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'f(a[' || o_custkey || ']);' WHEN 1 THEN 'f({a: [' || o_custkey || ']})' WHEN 2 THEN 'g(' || o_custkey || ');' WHEN 3 THEN 'x = "' || o_custkey || '"' || chr(10) || 'f()' WHEN 4 THEN '/* ( */ f(' || o_custkey || ')' ELSE 'x = [' || o_custkey || ']' END AS fixed FROM orders""")
def q_bracket_repair(spark, sf_dir):
    k, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    say = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    code = _pick(k, [say("f(a[", ");"), say("f({a: [", ""), say("g(", "));"), say('x = "', "\nf()"), say("/* ( */ f(", ""), say("x = [", "")])
    rule = F.when(k % 6 == 5, "syntax_error").otherwise("unclosed_bracket")
    return table(spark, sf_dir, "orders").select("o_orderkey", repair.repaired(rule, code, F.when(k % 6 == 5, ".py").otherwise(".js"), F.lit(1)).alias("fixed"))


@query("""
SELECT s_suppkey AS finding_id, CASE s_suppkey % 5 WHEN 1 THEN 'because ' || s_suppkey WHEN 3 THEN 'late ' || s_suppkey END AS cause, s_suppkey % 5 NOT IN (1, 3) AS unavailable FROM supplier""")
def q_analysis_attempts(spark, sf_dir):
    return report.analyzed(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("finding_id"), F.col("s_suppkey").cast("string").alias("prompt")), providers.retrying(_answers, ["used up", "good", "good", " "], passes=2, wait=0)).select("finding_id", "cause", "unavailable")


def _answers(prompt: str, credential: str) -> str:
    """A provider of the tests: one credential is over its limit, and answers depend on the number asked about."""
    n = int(prompt)
    if credential == "used up":
        raise providers.Refused(429)
    return ["no JSON", "```json\n" + json.dumps({"cause": f"because {n}", "solution": "s"}) + "\n```", json.dumps({"cause": " ", "solution": "s"}), f"I think: {{\"cause\": \"late {n}\", \"solution\": [\"s\"]}} so.", "[1]"][n % 5]


@query("SELECT s_suppkey, NULL::VARCHAR AS cause, true AS unavailable FROM supplier")
def q_offline_analysis(spark, sf_dir):
    return report.analyzed(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("finding_id"), F.col("s_name").alias("prompt"))).select(F.col("finding_id").alias("s_suppkey"), "cause", "unavailable")


@query("""
SELECT 'f' || p_partkey || '.scala' AS file, p_size AS line_start, p_size + 1 AS line_end, CASE WHEN p_size % 2 = 0 THEN 'Logic Error' ELSE 'Other' END AS bug_type, p_brand AS error FROM part WHERE p_partkey % 3 = 1""")
def q_file_review(spark, sf_dir):
    k = F.col("p_partkey")
    source = F.to_json(F.struct(F.col("p_brand").alias("error"), F.when(F.col("p_size") % 2 == 0, "Logic Error").otherwise("odd").alias("bug_type"), F.format_string("%d.0", "p_size").alias("line_start"), (F.col("p_size") + 1).alias("line_end")))
    made = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), k, F.when(k % 3 == 0, ".py").otherwise(".scala")).alias("file"), F.when(k % 3 == 1, source).otherwise("junk").alias("source"))
    return review.reviewed(made, _echoes).select("file", "line_start", "line_end", "bug_type", "error")


def _echoes(frames):
    """A reviewer of the tests: what it reads is what it finds, with a row that has no error."""
    for frame in frames:
        yield frame.assign(reply=frame.source.map(lambda s: f"```json\n[{s}, {{\"bug_type\": \"Other\"}}]\n```"))[["row", "reply"]]


def _hits(spark, sf_dir):
    """A known bug, and an artifact of the history, for each part."""
    p, some = spread(_parts(spark, sf_dir)), F.col("p_size") % 3 == 0
    past = F.when(F.col("p_partkey") % 2 == 1, True).otherwise(False)
    fields = {
        "source_type": F.when(past, "github").otherwise("dataset"), "dataset_source": F.when(~some, F.col("p_brand")), "source": F.when(past, "github_issue").otherwise("kb"), "artifact_type": F.when(past, "pull_request"), "bug_type": F.col("p_type"),
        "bug_description": F.col("p_name"), "description": F.col("p_name"), "solution": F.col("p_container"), "file": _null(), "filename": F.when(some, F.col("p_brand")), "path": F.col("p_container"), "code": F.lit(""), "buggy_code": F.col("p_name"), "patch": F.repeat("p_brand", F.lit(1500)), "diff": _null(),
        "title": F.when(some, F.col("p_name")), "state": F.lit("open"), "labels": F.array("p_brand"), "url": _null(), "html_url": F.col("p_name"), "body": F.repeat("p_container", F.lit(600)), "comments": _null(), "number": F.col("p_partkey"), "similarity": F.col("p_size") / F.lit(37.0),
    }
    return p.select("p_partkey", "p_size", "p_name", "p_brand", F.struct(*[v.alias(k) for k, v in fields.items()]).alias("h"))


@query("""
SELECT p_partkey, CASE WHEN past THEN 'History Pull Request' WHEN p_size % 3 = 0 THEN 'Historical Dataset' ELSE p_brand END AS dataset_source, CASE WHEN past THEN 'pull_request' ELSE p_type END AS bug_type,
  CASE WHEN past THEN concat_ws(' - ', 'Pull Request', '#' || p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name END, repeat(p_container, 600)) ELSE p_name END AS bug_description, CASE WHEN past THEN repeat(p_brand, 1500)[:5000] ELSE p_container END AS solution,
  round_even(p_size / 37.0 * 1000, 0) / 10 AS similarity, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_container END AS historical_file, CASE WHEN NOT past THEN p_name END AS historical_code, length(CASE WHEN past THEN repeat(p_brand, 1500)[:10000] ELSE repeat(p_brand, 1500) END)::INT AS patch_chars,
  CASE WHEN past THEN 'pull_request' ELSE 'dataset' END AS artifact_type, CASE WHEN past THEN p_partkey ELSE -1 END AS artifact_number, CASE WHEN past THEN p_name END AS artifact_url FROM (SELECT *, p_partkey % 2 = 1 AS past FROM (SELECT *, p_type || '!' AS p_container FROM part))""")
def q_evidence_projection(spark, sf_dir):
    rows = _hits(spark, sf_dir).select("p_partkey", report.evidence(F.col("h")).alias("e")).select("p_partkey", "e.*")
    return rows.select("p_partkey", "dataset_source", "bug_type", "bug_description", "solution", "similarity", "historical_file", "historical_code", F.char_length("historical_patch").alias("patch_chars"), "artifact_type", F.coalesce("artifact_number", F.lit(-1)).alias("artifact_number"), "artifact_url")


@query("""
WITH p AS (SELECT *, p_partkey % 2 = 1 AS past, printf('%.1f%%', p_size / 37.0 * 100) AS sim FROM (SELECT *, p_type || '!' AS p_container FROM part))
SELECT p_partkey, sha256(concat_ws(chr(10) || chr(10), '## FINDING' || chr(10) || 'File: a.js' || chr(10) || 'Function: -' || chr(10) || 'Lines: ' || p_size || '--' || chr(10) || 'Rule: ' || p_brand || chr(10) || 'Type: -' || chr(10) || 'Error: e' || chr(10) || 'Cause: -',
  '## CODE' || chr(10) || p_name, '## REPORTED CODE' || chr(10) || p_brand,
  '## KNOWN BUGS' || chr(10) || CASE WHEN past THEN 'none' ELSE 'Source: kb' || chr(10) || 'Similarity: ' || sim || chr(10) || 'Description: ' || p_name || chr(10) || 'Solution: ' || p_container END,
  '## HISTORY' || chr(10) || CASE WHEN past THEN 'Kind: pull_request' || chr(10) || 'Title: ' || CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'untitled' END || chr(10) || 'State: open' || chr(10) || 'Labels: ' || p_brand || chr(10) || 'Address: -' || chr(10) || 'Similarity: ' || sim || chr(10) || 'Text: ' || repeat(p_container, 600)[:4000] || chr(10) || 'Comments: -' || chr(10) || 'Patch: ' || repeat(p_brand, 1500)[:5000] ELSE 'none' END,
  '## ANSWER' || chr(10) || 'One JSON object with: error, bug_type, cause, why_occurs, solution_type, solution, replacement_code, add_location, explanation, confidence. replacement_code holds code alone.')) AS prompt FROM p""")
def q_prompt(spark, sf_dir):
    h = _hits(spark, sf_dir)
    text = report.prompt(F.lit("a.js"), _null(), F.col("p_size"), F.lit(None).cast("int"), F.col("p_brand"), _null(), F.lit("e"), F.lit(None).cast("string"), F.col("p_name"), F.col("p_brand"), F.array("h"))
    return h.select("p_partkey", F.sha2(text.cast("binary"), 256).alias("prompt"))


def _fixes(spark, sf_dir):
    """Analyses of six kinds: none, a detector's code, an analyzer's code, the own repair, nothing but context, a removal."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    when = lambda m, x: F.when(k % 6 == m, x)
    return table(spark, sf_dir, "orders").select(
        k.alias("finding_id"), F.lit("a.js").alias("file"), F.when(k % 6 == 5, "unreachable_code").otherwise("var_declaration").alias("rule"), F.when(k % 4 != 0, (k % 9).cast("int")).alias("line_start"),
        (k % 6 == 0).alias("unavailable"), F.lit("said").alias("error"), F.when(k % 5 == 0, "Logic Error").otherwise("odd").alias("bug_type"), F.lit("because").alias("cause"), _null().alias("why_occurs"),
        F.when(k % 6 == 5, "delete").when(k % 6 == 2, "insert").alias("solution_type"), F.when(k % 2 == 0, "s").alias("solution"), when(2, F.concat(F.lit("```js\nadd("), c, F.lit(");\n```"))).when(k % 6 == 5, " ").alias("replacement_code"), F.when(k % 4 == 0, "line 3").alias("add_location"), _null().alias("explanation"),
        _pick(k, ["90", "65", "x"]).alias("confidence"), when(1, F.concat(F.lit("let d = "), c, F.lit(";"))).alias("detector_code"), F.when((k % 6).isin(0, 3), F.concat(F.lit("let a = "), c, F.lit(";"))).alias("own_repair"), F.lit("var a;\nb(").alias("context"), F.lit("var a;").alias("current_code"), F.lit("var a;\nb();").alias("code"),
        F.when(k % 6 == 5, 1).alias("line"), F.lit("Type Error").alias("found_type"), F.lit("found").alias("found_error"), F.when(k % 3 == 0, "own").alias("detection_source"),
    )


_FIXED = """SELECT o_orderkey AS finding_id, o_orderkey % 6 AS c, CASE o_orderkey % 3 WHEN 0 THEN 90 WHEN 1 THEN 65 ELSE 70 END AS sure, o_orderkey, o_custkey FROM orders"""


@query(f"""
SELECT finding_id, CASE WHEN c = 0 THEN 'found' ELSE 'said' END AS error, CASE WHEN c > 0 AND finding_id % 5 = 0 THEN 'Logic Error' ELSE 'Type Error' END AS bug_type,
  CASE c WHEN 1 THEN 'let d = ' || o_custkey || ';' WHEN 2 THEN 'add(' || o_custkey || ');' WHEN 4 THEN 'var a;' || chr(10) || 'b(' WHEN 5 THEN 'var a;' || chr(10) || 'b(' ELSE 'let a = ' || o_custkey || ';' END AS replacement_code,
  CASE WHEN c = 2 THEN 'insert' ELSE 'replace' END AS solution_type, CASE WHEN c = 0 THEN 0 ELSE sure END AS confidence, c IN (0, 4, 5) AS insufficient, CASE WHEN c NOT IN (0, 4, 5) AND sure >= 70 THEN 'High' ELSE 'Low' END AS confidence_level FROM ({_FIXED})""")
def q_normalised_analysis(spark, sf_dir):
    return report.normalised(_fixes(spark, sf_dir)).select("finding_id", "error", "bug_type", "replacement_code", "solution_type", "confidence", "insufficient", "confidence_level")


@query(f"""
WITH v AS (SELECT *, CASE c WHEN 2 THEN 'add' ELSE 'replace' END AS act, CASE WHEN c = 2 AND finding_id % 4 <> 0 THEN 'no location' WHEN c IN (4, 5) THEN 'unclosed_bracket' END AS m, c IN (4, 5) AS poor FROM ({_FIXED}))
SELECT finding_id, CASE WHEN c = 5 THEN 'Unreachable Code' WHEN c > 0 AND finding_id % 5 = 0 THEN 'Logic Error' ELSE 'Type Error' END AS bug_type, act AS solution_type, CASE WHEN c > 0 THEN m END AS validation_message,
  CASE WHEN c = 0 THEN 0 WHEN m IS NULL THEN greatest(sure, 70) ELSE least(sure, 59) END AS confidence, CASE WHEN c > 0 AND m IS NULL AND sure >= 70 AND NOT poor THEN 'Potential Bug' ELSE 'Uncertain Finding' END AS confidence_status,
  c > 0 AND m IS NULL AS fix_validated, c = 0 OR m IS NOT NULL OR poor AS insufficient, CASE WHEN finding_id % 2 = 0 THEN 's' WHEN act = 'add' THEN 'Put' ELSE 'Put' END AS solution,
  CASE WHEN finding_id % 4 = 0 THEN 'The exact line is unknown.' END AS line_note, CASE WHEN finding_id % 3 = 0 THEN 'own' WHEN c = 5 THEN 'unreachable_code' ELSE 'var_declaration' END AS detection_source FROM v""")
def q_report_rows(spark, sf_dir):
    rows = report.reports(validation.validated(report.normalised(_fixes(spark, sf_dir))))
    short = F.when(F.col("solution") == "s", "s").otherwise(F.substring_index(F.replace("solution", F.lit("Add"), F.lit("Put")), " ", 1))
    return rows.select("finding_id", "bug_type", "solution_type", "validation_message", "confidence", "confidence_status", "fix_validated", "insufficient", short.alias("solution"), "line_note", "detection_source")


@query("""
SELECT p_partkey, m AS message, 'remove' AS action FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unclosed_bracket' WHEN 2 THEN 'no original code' ELSE 'reported line not found' END AS m FROM part)""")
def q_validate_remove(spark, sf_dir):
    k = F.col("p_partkey")
    code = _pick(k, ["f();\nlog();", "f(\n);", " ", "f();"])
    line = F.when(k % 4 < 2, 2).cast("int")
    kind = validation.action(_null(), F.lit("leftover_debug_print"))
    return table(spark, sf_dir, "part").select("p_partkey", validation.message(kind, F.lit("a.js"), code, _null(), _null(), line).alias("message"), kind.alias("action"))


@query("""
SELECT 100 AS confidence, 0::BIGINT AS bugs, 'Less Errors' AS error_level, false AS any_unavailable""")
def q_empty_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").where("quality > 1").select(F.col("quality").alias("confidence"), (F.col("toxic") == 1).alias("unavailable"))
    return report.summary(rows).select("confidence", "bugs", "error_level", "any_unavailable")


@query("""
SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'queued' WHEN 9 THEN 'completed' WHEN 10 THEN 'failed' ELSE 'running' END AS status,
  CASE event_id % 12 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 15 WHEN 4 THEN 18 WHEN 5 THEN 25 + floor((user_id % 10) / 9 * 45)::INT WHEN 6 THEN 70 + floor((user_id % 10) / 9 * 25)::INT WHEN 7 THEN 97 WHEN 8 THEN 99 WHEN 9 THEN 100 ELSE -1 END AS percent FROM events""")
def q_job_steps(spark, sf_dir):
    step = _pick(F.col("event_id"), [*scan_jobs.STEPS, "failed", "paused"])
    rows = table(spark, sf_dir, "events").select("event_id", scan_jobs.state(step, F.col("user_id") % 10, F.lit(9)).alias("s"))
    return rows.select("event_id", "s.status", F.coalesce("s.percent", F.lit(-1)).alias("percent"))


@query("""
SELECT repo, file, line_start, rule, row_number() OVER (PARTITION BY repo, file ORDER BY line_start, rule) AS k FROM (
  SELECT o_orderkey % 3 AS repo, 'f' || o_orderkey || '.js' AS file, unnest([1, 2, 2, 3]) AS line_start, unnest(['var_declaration', 'leftover_debugger_statement', 'loose_equality', 'var_declaration']) AS rule FROM orders)""")
def q_finding_order(spark, sf_dir):
    """Findings come in order of lines and rules within their file, as one array a file."""
    made = spread(table(spark, sf_dir, "orders")).select((F.col("o_orderkey") % 3).alias("repo"), F.format_string("f%d.js", "o_orderkey").alias("file"), F.lit("var a;\nif (a == 1) debugger;\nvar c;").alias("source"))
    rows = rules.detect(made, key=("repo", "file")).withColumn("_id", F.monotonically_increasing_id())
    ordered = rows.groupBy("repo", "file").agg(F.array_sort(F.collect_list(F.struct("_id", "line_start", "rule"))).alias("f"))
    return ordered.select("repo", "file", F.posexplode("f").alias("p", "x")).select("repo", "file", "x.line_start", "x.rule", (F.col("p") + 1).cast("long").alias("k"))
