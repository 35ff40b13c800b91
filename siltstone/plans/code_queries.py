"""Queries of the detectors, chunks, repairs and validators over code made from rows, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import brackets, chunks, python_rules, repair, rules, validation
from siltstone.plans.source_queries import query, spread, table


@query(r"""
SELECT page_id, length(html)::BIGINT AS chars, length(html) - length(replace(html, chr(10), '')) AS line_ends, len(regexp_extract_all(html, 'var t="</p>";track\(\d+\);')) AS scripts FROM pages""")
def q_mask_pages(spark, sf_dir):
    masked = T.mask(F.col("html"))
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", F.char_length(masked).cast("long").alias("chars"), (F.char_length(masked) - F.char_length(F.replace(masked, F.lit("\n"), F.lit("")))).cast("long").alias("line_ends"), F.size(F.regexp_extract_all("html", F.lit(r'var t="</p>";track\(\d+\);'), F.lit(0))).cast("long").alias("scripts"))


def _scripts(spark, sf_dir):
    """Every script of every page: page_id, file, source."""
    rows = spread(table(spark, sf_dir, "pages")).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("k", "source"))
    return rows.select("page_id", F.format_string("page%d_%d.js", "page_id", "k").alias("file"), "source")


SCRIPTS = r"(SELECT page_id, i - 1 AS k, s[i] AS source FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS s FROM pages)))"


@query(f"SELECT 'page' || page_id || '_' || k || '.js' AS file, 1 AS line_start, 'var_declaration' AS rule, trim(source) AS current_code FROM {SCRIPTS} WHERE source LIKE 'var %'")
def q_page_scripts(spark, sf_dir):
    return rules.detect(_scripts(spark, sf_dir)).select("file", "line_start", "rule", "current_code")


@query("SELECT page_id, (length(html) - length(replace(html, '(', '')) = length(html) - length(replace(html, ')', '')) AND length(html) - length(replace(html, '[', '')) = length(html) - length(replace(html, ']', '')) AND length(html) - length(replace(html, '{', '')) = length(html) - length(replace(html, '}', ''))) AS even FROM pages")
def q_parity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.parity(F.col("html"), None).alias("even"))


def _js(spark, sf_dir):
    """Five statements an order, some of them faults; the same words in strings and comments are none."""
    k = F.col("o_orderkey")
    parts = [
        F.concat(F.lit("let a"), k, F.lit(" = x "), F.element_at(F.array(*map(F.lit, ("==", "===", "!=", "!=="))), (k % 4 + 1).cast("int")), F.lit(" y; // var z == 1")),
        F.when(k % 3 == 0, F.lit("var b = 'debugger';")).otherwise(F.lit('let b = "var c = 1";')),
        F.when(k % 5 == 0, F.lit("console\n  .log(b);")).otherwise(F.lit("/* console.log(b)\n debugger */")),
        F.when(k % 2 == 0, F.lit("debugger;")).otherwise(F.lit("`debugger`;")),
        F.when(k % 7 == 0, F.lit("try { f(); } catch (e) {\n}")).otherwise(F.lit("try { f(); } catch (e) { g(e);\n}")),
    ]
    return spread(table(spark, sf_dir, "orders")).select(F.format_string("f%d.js", "o_orderkey").alias("file"), F.concat_ws("\n", *parts).alias("source"))


@query("""
SELECT file, rule, line_start::INT AS line_start FROM (
  SELECT 'f' || o_orderkey || '.js' AS file, unnest([
    CASE WHEN o_orderkey % 4 IN (0, 2) THEN {'rule': 'loose_equality', 'line_start': 1} END, CASE WHEN o_orderkey % 3 = 0 THEN {'rule': 'var_declaration', 'line_start': 2} END,
    CASE WHEN o_orderkey % 5 = 0 THEN {'rule': 'leftover_console_statement', 'line_start': 3} END, CASE WHEN o_orderkey % 2 = 0 THEN {'rule': 'leftover_debugger_statement', 'line_start': 5} END,
    CASE WHEN o_orderkey % 7 = 0 THEN {'rule': 'empty_catch_block', 'line_start': 6} END], recursive := true) FROM orders) WHERE rule IS NOT NULL""")
def q_js_rules(spark, sf_dir):
    return rules.detect(_js(spark, sf_dir)).select("file", "rule", "line_start")


@query("""
SELECT 'p' || p_partkey || CASE p_partkey % 7 WHEN 0 THEN '.java' WHEN 1 THEN '.cs' WHEN 2 THEN '.php' WHEN 3 THEN '.kt' WHEN 4 THEN '.swift' WHEN 5 THEN '.rs' ELSE '.go' END AS file,
  2 AS line_start, 'leftover_debug_print' AS rule FROM part WHERE p_partkey % 7 <> 6 AND p_size % 2 = 0""")
def q_debug_print(spark, sf_dir):
    exts = [".java", ".cs", ".php", ".kt", ".swift", ".rs", ".go"]
    prints = ["System.out.println(x);", "Console.WriteLine(x);", "var_dump(x);", "println(x)", "print(x)", "dbg!(x);", "println(x)"]
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 7 + 1).cast("int"))
    code = F.concat(F.lit("f(1)\n"), F.when(F.col("p_size") % 2 == 0, pick(prints)).otherwise(F.concat(F.lit("// "), pick(prints))))
    made = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey", pick(exts)).alias("file"), code.alias("source"))
    return rules.detect(made, dispatched_only=False).select("file", "line_start", "rule")


def _brackets(spark, sf_dir):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    code = F.concat(F.repeat(F.lit("(["), (F.col("l_quantity") % 3).cast("int")), F.lit('"(" /* { */'), F.repeat(F.lit("])"), (F.col("l_linenumber") % 3).cast("int")))
    return spread(table(spark, sf_dir, "lineitem")).select(F.format_string("b%d.java", key).alias("file"), code.alias("source"))


@query("""
SELECT 'b' || (l_orderkey * 10 + l_linenumber) || '.java' AS file, CASE WHEN l_quantity::INT % 3 > l_linenumber % 3 THEN 'unclosed_bracket' ELSE 'unexpected_closing_bracket' END AS rule
FROM lineitem WHERE l_quantity::INT % 3 <> l_linenumber % 3""")
def q_bracket_balance(spark, sf_dir):
    return rules.structural_findings(_brackets(spark, sf_dir)).select("file", "rule")


@query("""
SELECT 'b' || (l_orderkey * 10 + l_linenumber) || '.java' AS file, CASE WHEN l_quantity::INT % 3 > l_linenumber % 3 THEN 'unclosed_bracket' ELSE 'unexpected_closing_bracket' END AS rule, 1 AS line_start
FROM lineitem WHERE l_quantity::INT % 3 <> l_linenumber % 3""")
def q_bracket_scan(spark, sf_dir):
    return brackets.bracket_findings(_brackets(spark, sf_dir)).select("file", "rule", "line_start")


@query("""
SELECT 'u' || o_orderkey || '.java' AS file, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END AS line_start, CASE o_orderkey % 3 WHEN 0 THEN 'unreachable_code' WHEN 1 THEN 'unterminated_string' ELSE 'unterminated_comment' END AS rule FROM orders""")
def q_bracket_statements(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    code = F.when(k == 0, F.lit("int f() {\n  return 1;\n  g();\n}")).when(k == 1, F.lit('f();\nx = "abc;\ny = 1;')).otherwise(F.lit("f();\n/* open"))
    made = spread(table(spark, sf_dir, "orders")).select(F.format_string("u%d.java", "o_orderkey").alias("file"), code.alias("source"))
    return brackets.bracket_findings(made)


def _python(spark, sf_dir):
    k = F.col("s_suppkey")
    when = lambda m, yes, no: F.when(k % m == 0, F.lit(yes)).otherwise(F.lit(no))
    lines = [
        when(2, "def f(a=[]):", "def f(a=None):"), when(3, "    b = a == None", "    b = a is None"), F.concat(F.lit("    c = 10 "), when(5, "//", "%"), F.lit(" "), when(10, "0", "a")),
        F.lit("    try:"), F.lit("        return b"), when(4, "    except:", "    except ValueError:"), F.lit("        return c"), when(7, "    return 5", "    # end"),
        F.lit("def g(): return f(2)"), when(6, "g()", "x = 1"), when(11, "print(unknown_name)", "print(1)"), when(13, "z = (1", "z = (1)"),
    ]
    return table(spark, sf_dir, "supplier").select(F.format_string("m%d.py", "s_suppkey").alias("file"), F.concat_ws("\n", *lines).alias("source"))


@query("""
SELECT file, rule, line_start::INT AS line_start FROM (
  SELECT 'm' || s_suppkey || '.py' AS file, unnest([
    CASE WHEN s_suppkey % 13 = 0 THEN {'rule': 'syntax_error', 'line_start': 12} END, CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 2 = 0 THEN {'rule': 'mutable_default_arg', 'line_start': 1} END,
    CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 3 = 0 THEN {'rule': 'eq_none', 'line_start': 2} END, CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 10 = 0 THEN {'rule': 'division_by_zero', 'line_start': 3} END,
    CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 5 = 0 AND s_suppkey % 10 <> 0 THEN {'rule': 'possible_division_by_zero', 'line_start': 3} END,
    CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 4 = 0 THEN {'rule': 'bare_except', 'line_start': 6} END, CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 7 = 0 THEN {'rule': 'unreachable_code', 'line_start': 8} END,
    CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 6 <> 0 THEN {'rule': 'possibly_unused_function', 'line_start': 9} END, CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 11 = 0 THEN {'rule': 'undefined_name', 'line_start': 11} END], recursive := true) FROM supplier) WHERE rule IS NOT NULL""")
def q_python_rules(spark, sf_dir):
    return python_rules.detect(_python(spark, sf_dir)).select("file", "rule", "line_start")


@query(r"""
SELECT doc_id, 1 + 5 * (i // 5) AS line_start, least(5 * (i // 5) + 5, max(n))::INT AS line_end, trim(string_agg(t, chr(10) ORDER BY i), E' \n\t\r\x0b\x0c') AS code FROM (
  SELECT doc_id, n, i::INT AS i, l[i + 1] AS t FROM (SELECT doc_id, l, len(l) AS n, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))
GROUP BY doc_id, i // 5 HAVING trim(string_agg(t, chr(10) ORDER BY i), E' \n\t\r\x0b\x0c') <> ''""")
def q_chunk_blocks(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("source"))
    return chunks.blocks(made, 5).select(F.col("file").alias("doc_id"), "line_start", "line_end", "code")


@query("""
SELECT 'd' || o_orderkey || '.js' AS file, unnest(['class', 'function', 'function']) AS chunk_type, unnest(['C' || o_orderkey, 'run', 'late']) AS name, unnest([1, 6, 9]) AS line_start, unnest([5, 8, CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 9 END]) AS line_end FROM orders""")
def q_chunk_declarations(spark, sf_dir):
    code = F.concat(F.lit("class C"), "o_orderkey", F.lit(' {\n  a = "}";\n  b = 1; // }\n\n}\nfunction run(x) {\n  if (x) { y(); }\n}\nconst late = (q) => {'), F.when(F.col("o_orderkey") % 2 == 0, F.lit("\n}")).otherwise(F.lit(" }")))
    made = spread(table(spark, sf_dir, "orders")).select(F.format_string("d%d.js", "o_orderkey").alias("file"), code.alias("source"))
    return chunks.declarations(made)


@query("""
SELECT 'm' || s_suppkey || '.py' AS file, unnest(CASE WHEN s_suppkey % 13 = 0 THEN ['file'] ELSE ['f', 'g', CASE WHEN s_suppkey % 6 = 0 THEN 'expr' ELSE 'assign' END, 'expr', 'assign'] END) AS name,
       unnest(CASE WHEN s_suppkey % 13 = 0 THEN [1] ELSE [1, 9, 10, 11, 12] END) AS line_start FROM supplier""")
def q_chunk_python(spark, sf_dir):
    return chunks.python_chunks(_python(spark, sf_dir)).select("file", "name", "line_start")


@query("""
SELECT l_orderkey, kind, min(k) AS first_line FROM (SELECT l_orderkey, l_linenumber % 2 AS kind, l_linenumber AS k FROM lineitem) GROUP BY ALL""")
def q_chunk_dedupe(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.lit("block").alias("chunk_type"), (F.col("l_linenumber") % 2).alias("name"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), "l_linenumber")
    return chunks.deduplicated(made, "l_linenumber").select(F.col("file").alias("l_orderkey"), F.col("name").alias("kind"), F.col("l_linenumber").alias("first_line"))


@query("""
WITH f AS (SELECT o_orderkey AS finding_id, o_orderkey AS file, (o_custkey % 45)::INT AS s, (o_custkey % 45 + o_orderkey % 9)::INT AS e FROM orders),
c AS (SELECT l_orderkey AS file, l_linenumber AS chunk, (l_extendedprice::BIGINT % 40)::INT AS cs, (l_extendedprice::BIGINT % 40)::INT + 6 AS ce FROM lineitem),
p AS (SELECT finding_id, chunk, least(e, ce) - greatest(s, cs) + 1 AS o, greatest(cs - e, s - ce) AS g FROM f JOIN c USING (file))
SELECT finding_id, chunk FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY o > 0 DESC, CASE WHEN o > 0 THEN o ELSE -g END DESC, chunk) AS k FROM p) WHERE k = 1""")
def q_best_chunk(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    start = (F.col("o_custkey") % 45).cast("int")
    findings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderkey").alias("file"), start.alias("line_start"), (start + F.col("o_orderkey") % 9).cast("int").alias("line_end"))
    begin = (F.bround("l_extendedprice").cast("long") % 40).cast("int")
    return chunks.best_chunk(findings, l.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("chunk"), begin.alias("line_start"), (begin + 6).alias("line_end")), "finding_id", "chunk").where("chunk IS NOT NULL").select("finding_id", "chunk")


@query("""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'if x is None or y is not None: pass' WHEN 1 THEN 'if (a === b || c !== d && e === f) {}' WHEN 2 THEN 'let a = 1; var b = 2;'
  WHEN 3 THEN 'try:' || chr(10) || '    f()' || chr(10) || 'except Exception as e:' || chr(10) || '    pass' WHEN 4 THEN 'def f(a, b=None):' || chr(10) || '    if b is None:' || chr(10) || '        b = []' || chr(10) || '    return b'
  WHEN 5 THEN 'try { f(); } catch (e) { e.printStackTrace(); }' WHEN 6 THEN 'if n != 0:' || chr(10) || '    x = 1 / n' ELSE 'a();' || chr(10) || 'b();' END AS fixed FROM orders""")
def q_repair(spark, sf_dir):
    cases = [("eq_none", "if x == None or y != None: pass"), ("loose_equality", "if (a == b || c != d && e === f) {}"), ("var_declaration", "var a = 1; var b = 2;"), ("bare_except", "try:\n    f()\nexcept:\n    pass"), ("mutable_default_arg", "def f(a, b=[]):\n    return b"), ("empty_catch_block", "try { f(); } catch (e) { }"), ("possible_division_by_zero", "x = 1 / n"), ("leftover_debug_print", "a();\nSystem.out.println(1);\nb();")]
    pick = lambda j: F.element_at(F.array(*[F.lit(c[j]) for c in cases]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", repair.repaired(pick(0), pick(1), F.lit(".java"), F.lit(2)).alias("fixed"))


@query("""
SELECT s_suppkey, s_suppkey % 3 = 0 AS was_valid, true AS is_valid FROM supplier""")
def q_syntax_repair(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    code = F.when(k == 0, F.lit("x = [1, 2]")).when(k == 1, F.lit("numbers = [1, 2")).otherwise(F.lit('name = "Munna'))
    return table(spark, sf_dir, "supplier").select("s_suppkey", validation.python_compiles(code).alias("was_valid"), validation.python_compiles(repair.python_syntax(code)).alias("is_valid"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'remove' WHEN 1 THEN 'add' WHEN 2 THEN 'replace' WHEN 3 THEN 'remove' WHEN 4 THEN 'replace' ELSE 'replace' END AS action,
  CASE WHEN event_type IN ('click') THEN 'Other' ELSE 'Logic Error' END AS bug_type, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN 70 ELSE 55 END AS confidence FROM events""")
def q_action_normalize(spark, sf_dir):
    k = F.col("event_id") % 6
    name = F.when(k == 0, F.lit(" Delete ")).when(k == 1, F.lit("insertion")).when(k == 2, F.lit("replace_code")).when(k == 5, F.lit("unknown"))
    rule = F.when(k == 3, F.lit("Unreachable_Code")).otherwise(F.lit("eq_none"))
    sure = F.element_at(F.array(*map(F.lit, ("-5", "400", "7.5", "55"))), (F.col("event_id") % 4 + 1).cast("int"))
    kind = validation.bug_type(F.when(F.col("event_type") == "click", F.lit("Other")).otherwise("odd"), F.lit("Logic Error"))
    return table(spark, sf_dir, "events").select("event_id", validation.action(name, rule).alias("action"), kind.alias("bug_type"), validation.confidence(sure).alias("confidence"))


@query("""
SELECT p_partkey, m AS message, CASE WHEN m IS NULL THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN m IS NULL THEN greatest(p_size * 2, 70) ELSE least(p_size * 2, 59) END AS confidence,
  CASE WHEN m IS NULL AND p_size * 2 >= 70 THEN 'High' ELSE 'Low' END AS level
FROM (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unclosed_bracket' WHEN 2 THEN 'replacement equals the original' WHEN 3 THEN 'no replacement code' WHEN 4 THEN 'no location' ELSE 'reported line not found' END AS m FROM part)""")
def q_validate(spark, sf_dir):
    k = F.col("p_partkey") % 6
    kind = F.when(k == 4, F.lit("add")).when(k == 5, F.lit("remove")).otherwise(F.lit("replace"))
    new = F.when(k == 1, F.lit("f(x")).when(k == 2, F.lit(" f(y) ")).when(k == 3, F.lit(" ")).otherwise(F.lit("f(x)"))
    line = validation.reported_line(F.lit("f(y)"), F.when(k == 5, F.lit(9)).otherwise(F.lit(1)), F.lit(1), F.lit("absent"))
    wrong = validation.message(kind, F.lit("a.java"), F.lit("f(y)"), new, F.lit(""), line)
    rows = table(spark, sf_dir, "part").select("p_partkey", wrong.alias("message"), (F.col("p_size") * 2).cast("string").alias("sure"))
    return rows.select("p_partkey", "message", validation.applied(F.col("message"), F.col("sure"), F.lit(False)).alias("a")).select("p_partkey", "message", "a.status", "a.confidence", "a.level")
