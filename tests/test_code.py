"""Detectors, lexer, repairs and validators on texts whose findings are known."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import brackets, chunks, providers, python_rules, repair, report, retrieval, rules, structure, validation
from siltstone.plans import scan, scan_queries
from siltstone.plans.source_queries import spread
from siltstone.sources import files, knowledge, remote


def one(spark, expression, **values):
    names = list(values) or ["_x"]
    frame = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in (values or {"_x": 1}).items()))
    return frame.select(expression(*[F.col(n) for n in names])).first()[0]


def found(source):
    return [(r[2], r[1]) for r in python_rules.rows_of(source) if r[0] == "finding"]


def test_undefined_name_and_zero_division():
    assert found("print(total)\n") == [("undefined_name", 1)]
    assert found("result = 10 / 0\n") == [("division_by_zero", 1)]
    assert found("print(total)\nresult = 10 / 0\n") == [("undefined_name", 1), ("division_by_zero", 2)]


@pytest.mark.parametrize("source, rule", [
    ("def f():\n    return 1\n    print(2)\n", "unreachable_code"), ("def f():\n    if a_ := 1:\n        return 1\n    else:\n        raise ValueError\n    print(1)\n", "unreachable_code"),
    ("def f(*, a=[]): return f\nf()", None), ("None == print", None), ("x = 1\nx == None", "eq_none"), ("y = 3 % 0", None), ("import os", "unused_import"), ("try:\n    pass\nexcept:\n    pass", "bare_except"),
    ("def f():\n    global g\n    g = 1\nprint(g)\nf()", None), ("print([q for q in range(3)], (lambda z: z)(1))", None), ("x = (", "syntax_error"), ("a = b'\\x00'", None),
])
def test_python_rules(source, rule):
    assert [r for r, _ in found(source)] == ([rule] if rule else [])


def test_unused_functions_are_an_anti_join(spark):
    made = spark.createDataFrame([("a.py", "def used(): pass\ndef idle(): pass\ndef _own(): pass\nused()"), ("b.py", "def used(): pass"), ("c.py", None)], "file string, source string")
    got = {(r.file, r.detail) for r in python_rules.detect(made).where("rule = 'possibly_unused_function'").collect()}
    assert got == {("a.py", "idle"), ("b.py", "used")}


def test_syntax_repairs_compile():
    assert python_rules.mended("numbers = [1, 2") == "numbers = [1, 2]"
    assert python_rules.mended('name = "Munna') == 'name = "Munna"'
    for broken in ("if x\n    pass", "def f(a):\nreturn a", "if x = 1:\n    pass", "break", "x = 1)"):
        compile(python_rules.mended(broken), "f", "exec")


@pytest.mark.parametrize("source, template, want", [
    ("f(a[1]);", True, []), ("f(a[1);", True, [(1, "mismatched_bracket")]), ("f(", True, [(1, "unclosed_bracket")]), ("f())", True, [(1, "unexpected_closing_bracket")]),
    ("x = 'abc", True, [(1, "unterminated_string")]), ("`a ${b + `c`} d`;", True, []), ("`open", True, [(1, "unterminated_template_literal")]), ("\n/* open", True, [(2, "unterminated_comment")]),
    ("x = /[)/\\]]+/g; f();", True, []), ("function f() {\n return 1;\n g();\n}", True, [(3, "unreachable_code")]), ("function f() { if (a) { return 1; } g(); }", True, []),
    ("// ( [ {\n'(' + \"[\"", True, []), ("switch (a) { case 1: return 1; case 2: return 2; }", True, []),
])
def test_bracket_scan(source, template, want):
    assert brackets.scan(source, template) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab(){}[]'\"`/*\\\n ;$", max_size=60), min_size=1, max_size=20))
def test_masking_keeps_length_and_line_ends(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in T.TOKENS:
        for r in frame.select("t", T.mask(F.col("t"), kind).alias("m")).collect():
            assert len(r.m) == len(r.t) and [i for i, c in enumerate(r.m) if c == "\n"] == [i for i, c in enumerate(r.t) if c == "\n"]


def test_long_strings_need_no_stack(spark):
    frame = spark.range(1).select(F.concat(F.lit('x = "'), F.repeat(F.lit("a\\\\n"), 200_000), F.lit('" + y /* ')).alias("t"))
    assert frame.select(F.char_length(T.mask(F.col("t"))) == F.char_length("t")).first()[0]


def test_rules_are_rows_that_users_extend(spark):
    table = rules.rule_table(spark).unionByName(spark.createDataFrame([("todo", "Other", ".js", r"\bTODO\b", True)], "rule string, bug_type string, ext string, pattern string, dispatched boolean"))
    made = spark.createDataFrame([("a.js", "TODO;\nx();TODO TODO"), ("b.js", None), ("c", "TODO")], "file string, source string")
    assert sorted((r.file, r.line_start) for r in rules.detect(made, table).where("rule = 'todo'").collect()) == [("a.js", 1), ("a.js", 2), ("a.js", 2)]


def test_detect_gives_structural_findings_alone_and_joins_unreachable_ones(spark):
    made = spark.createDataFrame([("a.js", "var a;\nf(["), ("b.js", "var b;\n x = 'open"), ("c.js", "function f() {\n return 1;\n g();\n}\nvar c;"), ("d.py", "f(")], "file string, source string")
    got = sorted((r.file, r.line_start, r.rule, r.current_code) for r in rules.detect(made).collect())
    assert got == [
        ("a.js", 2, "unclosed_bracket", "f(["), ("b.js", 2, "unterminated_string", "x = 'open"),
        ("c.js", 3, "unreachable_code", "g();"), ("c.js", 5, "var_declaration", "var c;"), ("d.py", 1, "syntax_error", "f("),
    ]


def test_scan_report_counts_broken_and_unreachable_scripts(spark, tmp_path):
    from siltstone.plans import registry

    scripts = ["f([", "x = 'open", "function f() {\n return 1;\n g();\n}", "var a = 1;"]
    spark.createDataFrame([(i, "u", f"<p><script>{s}</script>") for i, s in enumerate(scripts)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("benchmark", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.rule: r.bugs for r in registry.QUERIES["q_scan_report"](spark, str(tmp_path)).collect()}
    assert got == {"unclosed_bracket": 1, "unterminated_string": 1, "unreachable_code": 1, "var_declaration": 1}


def test_repairs(spark):
    assert one(spark, repair.strict_equality, c="a != b == c === d !== e <= f") == "a !== b === c === d !== e <= f"
    assert one(spark, repair.none_default, c="x = 1\n  def f(a={}, b=2):\n    return a\n") == "x = 1\n  def f(a=None, b=2):\n      if a is None:\n          a = {}\n    return a\n"
    assert one(spark, lambda c: repair.without_line(c, F.lit(2)), c="a\nb\nc") == "a\nc"
    assert one(spark, lambda a, b, c: repair.ensured(a, b, F.lit(None).cast("string"), c)["insufficient"], a=" ", b="", c="ctx") is True


def test_lines_about_code_go_and_code_stays(spark):
    about = ["Lines 4 - 9", "lines: 3-4", "LINE 3 – 4", "Line: 7—9", "Function: run", "file : a b.py", "Path: x/y", "Solution", "Corrected Code:", "Replace with this code", "CAUSE:", "method getAll", "class A.B-c", "use this code:", "Replace code", "use with this code", "## Solution", "###code", "# Replacement"]
    code = ["lines = 4 - 9", "line 4", "lines 4 to 9", "function run() {", "function f x", "file", "file:", "solution = 1", "code", "# comment", "####### code", "class A {", "class 3", "use strict", "replace(code)", "use Foo;", "", "  return", "replacement", "description of it", "lines: 3-4-5", "method: "]
    frame = spark.createDataFrame([(x,) for x in about + code], "x string").select("x", T.commentary(F.col("x")).alias("c"))
    got = {r.x: r.c for r in frame.collect()}
    assert [x for x in about if not got[x]] == [] and [x for x in code if got[x]] == []


def test_validation(spark):
    assert one(spark, validation.confidence, c="7.5") == 70 and one(spark, validation.confidence, c="-3") == 0
    assert one(spark, validation.action, v=" Delete_Code?", r="unreachable_code") == "remove"
    assert one(spark, lambda c: validation.reported_line(c, F.lit(9), F.lit(1), F.lit(" b ")), c="a\n b\nc") == 2
    assert one(spark, T.balance, c="(]") == "mismatched_bracket" and one(spark, T.balance, c="'(' /* [ */ ()") is None


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    for name, content in (("src/a.py", b"x = 1\n"), ("src/b.js", b"\x00\x01"), ("src/node_modules/c.js", b"y"), ("src/d.min.js", b"z"), ("src/e.ts", b"caf\xff"), ("src/f.py", b"")):
        (tmp_path / name).write_bytes(content)
    got = {r.file.rsplit("/", 1)[1]: r.source for r in files.read_sources(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x = 1\n", "e.ts": "caf\ufffd"}
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "set.jsonl").write_text('{"id": "1", "buggy_code": "x", "language": "python", "error": "E"}\n\nnot json\n{"id": "2", "buggy_code": " "}\n')
    assert [(r.id, r.dataset_source, r.bug_description) for r in knowledge.load(spark, str(tmp_path / "kb")).collect()] == [("1", "set", "python bug: E")]
    assert remote.wanted({"type": "blob", "path": "a/b.py", "size": 3}) and not remote.wanted({"type": "blob", "path": "dist/b.py", "size": 3})


def test_repository_source_reads_through_a_stub(spark):
    import json

    class Stub(remote.RepositoryReader):
        def fetch(self, url):
            if "/git/trees/" in url:
                return json.dumps({"tree": [{"type": "blob", "path": p, "size": 1} for p in ("b.py", "a.py", "x.bin", "bad.py")]}).encode()
            return {"a.py": b"A", "b.py": b"B\x00", "bad.py": b"\xff"}[url.rsplit("/", 1)[1]]

    reader = Stub({"api": "https://host", "raw": "https://raw", "owner": "o", "repo": "r", "branch": "main"})
    assert [row for part in reader.partitions() for row in reader.read(part)] == [("a.py", "A", None)]


OPTIONS = {"api": "https://host", "raw": "https://raw", "owner": "o", "repo": "r", "branch": "main"}


def test_failed_files_and_cut_listings_are_errors(monkeypatch):
    import json
    import urllib.error

    class Broken(remote.RepositoryReader):
        def fetch(self, url):
            if "/git/trees/" in url:
                return json.dumps({"truncated": True, "tree": [{"type": "blob", "path": "a.py", "size": 1}]}).encode()
            raise urllib.error.HTTPError(url, 403, "no", {"X-RateLimit-Remaining": "0"}, None)

    with pytest.raises(ValueError, match="short"):  # the root alone is too long
        Broken(OPTIONS).partitions()
    part = Broken(OPTIONS | {"allow_truncated": "true"}).partitions()[0]
    with pytest.raises(ValueError, match="rate limit"):
        list(Broken(OPTIONS).read(part))
    assert list(Broken(OPTIONS | {"skip_failures": "true"}).read(part)) == [("a.py", None, "rate limit exceeded")]


def test_requests_are_tried_again(monkeypatch):
    import io
    import urllib.error

    asked = []

    def fake(request, timeout):
        asked.append(request)
        if len(asked) < 3:
            raise urllib.error.URLError("later")
        return io.BytesIO(b"ok")

    monkeypatch.setattr(remote.urllib.request, "urlopen", fake)
    monkeypatch.setattr(remote, "WAIT", 0)
    assert remote.StatusReader(OPTIONS | {"token": "secret"}).fetch("https://host/x") == b"ok" and len(asked) == 3
    assert asked[0].get_header("Authorization") == "Bearer secret" and remote.token_status("secret") == "present (secr...)" and remote.token_status(" ") == "absent"


def test_pages_status_and_history_through_stubs():
    import json

    pages = {1: list(range(5)), 2: list(range(5, 8)), 3: []}
    ask = lambda url: json.dumps([{"n": n} for n in pages[int(url.split("page=")[1].split("&")[0])]]).encode()
    assert [i["n"] for i in remote.paginated(ask, "https://host/x?a=1", 5)] == [0, 1, 2, 3, 4] and remote.paginated(ask, "https://host/x", 0) == []
    assert remote.paginated(lambda _: b'{"message": "no list"}', "https://host/x", 5) == []

    class Status(remote.StatusReader):
        def fetch(self, url):
            if self.options["repo"] == "gone":
                raise OSError
            return b'{"full_name": "o/r", "private": true}'

    assert list(Status(OPTIONS).read(None)) == [("o", "r", "valid", None, "o/r", "main", None, True)]
    assert list(Status(OPTIONS | {"repo": "gone"}).read(None))[0][2:4] == ("invalid", "unreachable")

    class History(remote.HistoryReader):
        def fetch(self, url):
            if "/comments" in url:
                return json.dumps([{"body": f"c{i}"} for i in range(30)][: 20 if "page=1" in url else 0]).encode()
            if url.endswith(".patch"):
                return b"p" * 40_000
            return json.dumps([{"number": 1, "title": "t", "labels": [{"name": "bug"}], "merged_at": "x"}, {"number": 2, "pull_request": {"url": "u"}}][: 2 if "page=1" in url else 0]).encode()

    issues = [r for part in History(OPTIONS).partitions() for r in History(OPTIONS).read(part)]
    assert [(r[1], r[5], len(r[6]), r[11]) for r in issues] == [(1, [("bug",)], 20, None)]
    pulls = [r for part in History(OPTIONS | {"kind": "pull"}).partitions() for r in History(OPTIONS | {"kind": "pull"}).read(part)]
    assert [(r[1], len(r[11])) for r in pulls] == [(1, 30_000), (2, 30_000)]


def test_normalisers_of_folders_and_runs(spark, tmp_path):
    for bug, patch, about in (("1", "--- a\n+++ b\n-x = 1\n+x = 2", 'bug_report="wrong"\nbug_id=7'), ("2", "--- a\n+++ b\n same", None), ("3", "-gone", None)):
        folder = tmp_path / "projects" / "p" / "bugs" / bug
        folder.mkdir(parents=True)
        (folder / "bug_patch.txt").write_text(patch)
        if about:
            (folder / "bug_info.txt").write_text(about)
    got = {r.id: (r.buggy_code, r.fixed_code, r.bug_description, dict(r.metadata)) for r in knowledge.patch_folder(spark, str(tmp_path / "projects")).collect()}
    assert got == {"bugsinpy_p_1": ("x = 1", "x = 2", "wrong", {"bug_report": "wrong", "bug_id": "7"}), "bugsinpy_p_3": ("gone", "", None, {"bug_id": "3"})}
    knowledge.save(spark.createDataFrame([("1", "a = b", "java")], "id string, buggy_code string, language string"), str(tmp_path / "kb.json"))
    assert [r.buggy_code for r in knowledge.load(spark, str(tmp_path / "kb.json")).collect()] == ["a = b"]


def test_detect_tells_repositories_apart_and_honours_dispatch(spark):
    rows = [("r1", "b.js", "debugger;"), ("r2", "b.js", "f(["), ("r1", "c.js", "f(a[1);"), ("r1", "d.ts", "`open"), ("r1", "e.go", "x := `a\\`; f()"), ("r1", "f.rs", 'println!("x")'), ("r1", "g.py", "import os\nx = (1,\ny = [2\n"), ("r1", "h.jsx", "const a = <p className='x'>( fine {f(')')} </p>;\nvar b = a < c;"), (None, "b.js", "var q"), ("r1", None, "x"), ("r1", "i.js", None)]
    made = spark.createDataFrame(rows, "repo string, file string, source string").withColumn("rule", F.lit("clash"))
    got = sorted((str(r.repo), r.file, r.line_start, r.rule) for r in rules.detect(made, key=("repo", "file")).collect())
    assert got == [
        ("None", "b.js", 1, "var_declaration"), ("r1", "b.js", 1, "leftover_debugger_statement"), ("r1", "c.js", 1, "mismatched_bracket"), ("r1", "d.ts", 1, "unterminated_template_literal"),
        ("r1", "g.py", 2, "syntax_error"), ("r1", "g.py", 3, "syntax_error"), ("r1", "h.jsx", 2, "var_declaration"), ("r2", "b.js", 1, "unclosed_bracket"),
    ]
    assert {r.file for r in rules.detect(made, key=("repo", "file"), dispatched_only=False).collect()} >= {"f.rs"}


def test_hashed_vectors_are_unit(spark):
    v = one(spark, retrieval.hashed_vector, t="one two two three")
    assert abs(sum(x * x for x in v) - 1) < 1e-9


def test_chunks_and_matching(spark):
    made = spark.createDataFrame([("a.py", "import x\n\ndef f():\n    def g(): pass\n\nclass C:\n    def m(self): pass\n"), ("b.py", "def (")], "file string, source string")
    got = {(r.file, r.name, r.parent, r.line_start) for r in chunks.python_chunks(made).collect()}
    assert got == {("a.py", "import", None, 1), ("a.py", "f", None, 3), ("a.py", "g", "f", 4), ("a.py", "C", None, 6), ("a.py", "m", "C", 7), ("b.py", "file", None, 1)}
    findings = spark.createDataFrame([(1, "a", 5, 6), (2, "a", 50, None), (3, "b", 1, 1)], "f long, file string, line_start int, line_end int")
    parts = spark.createDataFrame([(1, "a", 1, 5), (2, "a", 5, 9), (3, "a", 40, 45)], "c long, file string, line_start int, line_end int")
    assert {(r.f, r.c) for r in chunks.best_chunk(findings, parts, "f", "c").collect()} == {(1, 2), (2, 3), (3, None)}


def test_analyzer_rows_without_cause_are_unavailable(spark):
    def half(frames):
        for f in frames:
            yield f.assign(cause="c", solution=f.finding_id.map(lambda i: "s" if i % 2 else " "), replacement_code="", confidence=90, unavailable=False)[["finding_id", "cause", "solution", "replacement_code", "confidence", "unavailable"]]

    frame = spark.range(4).select(F.col("id").alias("finding_id"), F.lit("p").alias("prompt"))
    assert {r.finding_id: r.unavailable for r in report.analyzed(frame, half).collect()} == {0: True, 1: False, 2: True, 3: False}


def test_stored_vectors_are_made_anew_when_counts_differ(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")
    path = str(tmp_path / "vectors")
    assert [retrieval.stored_vectors(r, path)[1] for r in (rows, rows, rows.limit(1))] == [True, False, True]
    assert [len(r.embedding) for r in retrieval.stored_vectors(rows.limit(1), path)[0].collect()] == [64]


def test_scan_brings_findings_evidence_and_repairs_together(spark):
    files_ = spark.createDataFrame([("r1", "a.js", "function f() {\n  var x = 1;\n}\n"), ("r2", "b.py", "x = None\nprint(x == None)\n"), ("r1", "c.js", "f(a[1);"), ("r1", "d.js", "")], "repo string, file string, source string")
    known = spark.createDataFrame([(7, "var_declaration Logic Error x", "use let")], "id long, bug_description string, solution string").withColumn("embedding", retrieval.hashed_vector(F.col("bug_description")))
    past = spark.createDataFrame([("r1", 5, "issue", "var_declaration Logic Error x", ["c1", "c2"]), ("r3", 6, "issue", "var_declaration Logic Error", ["c"])], "repo string, number long, artifact_type string, body string, comments array<string>").withColumn("embedding", retrieval.hashed_vector(F.col("body")))
    asked = spark.sparkContext.accumulator(0)

    def explains(frames):
        for f in frames:
            asked.add(int(f.prompt.str.contains("## HISTORY\nKind: issue").sum()))
            yield f.assign(cause="c", solution="s", confidence="90", unavailable=False)

    rows = {r.rule: r for r in scan.scan(files_, known, past, explains).collect()}
    assert set(rows) == {"var_declaration", "eq_none", "mismatched_bracket"} and asked.value >= 1
    var = rows["var_declaration"]
    assert var.replacement_code == "function f() {\n  let x = 1;\n}" and var.confidence == 90 and var.confidence_level == "High" and var.function == "f"
    assert {e.artifact_type for e in var.retrieved} == {"dataset", "issue"} and {e.artifact_number for e in var.retrieved} == {None, 5}
    assert rows["mismatched_bracket"].replacement_code == "f(a[1]);" and rows["mismatched_bracket"].fix_validated
    assert rows["eq_none"].replacement_code == "x = None\nprint(x is None)" and rows["eq_none"].validation_method == "replace + parser"
    offline = {r.rule: r for r in scan.scan(files_, known, past).collect()}
    assert all(r.unavailable and r.confidence == 0 and r.replacement_code and r.cause is None for r in offline.values())


def test_chat_replies_and_attempts():
    assert report.parsed_reply('so {"cause": "a", "solution": "b"} it is') == {"cause": "a", "solution": "b"}
    assert report.parsed_reply('{"cause": "", "solution": "b"}') is None and report.parsed_reply(None) is None
    seen = []

    def ask(prompt, credential):
        seen.append(credential)
        if credential == "bad":
            raise providers.Refused(401)
        if len(seen) < 5:
            raise providers.Refused(503)
        return '{"cause": "a", "solution": "b", "confidence": 40}'

    frames = iter([pd.DataFrame({"finding_id": [1, 2], "prompt": ["p", "q"]})])
    rows = pd.concat(providers.retrying(ask, ["bad", "one", "two", "one"], wait=0)(frames))
    assert list(rows.unavailable) == [False, False] and list(rows.confidence) == ["40", "40"] and seen == ["bad", "one", "two", "one", "two", "one"]


def test_python_syntax_errors_are_found_one_after_another():
    assert [line for line, _ in python_rules.syntax_errors("if x\n    y = (1\nz = 2\nfor q in z\n    pass\n")] == [1, 2, 4]
    assert python_rules.syntax_errors("x = 1") == [] and len(python_rules.syntax_errors("\x00")) == 1
    assert python_rules.balanced_line("foo(a[1), b)") == "foo(a[1], b)" and python_rules.balanced_line("if f(x:") == "if f(x):"
    assert brackets.balanced_code("f({a: [1}") == "f({a: [1]})"


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    """Most splits of a file with one row group hold nothing, so their number says nothing of where its rows are."""
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = spread(spark.read.parquet(str(tmp_path / "t")))
        shares = rows.rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(shares) == 4000 and sum(s > 0 for s in shares) > 2 * spark.sparkContext.defaultParallelism and max(shares) < 400


def test_equal_files_of_a_batch_are_looked_at_once():
    asked = []

    def look(source, ext):
        asked.append((source, ext))
        return [(source + ext,)] if source else []

    files = [("a", ".js"), ("", ".js"), ("a", ".py"), ("a", ".js"), ("", ".js")]
    assert brackets.each_once(look, iter(files)) == [[("a.js",)], [], [("a.py",)], [("a.js",)], []]
    assert asked == files[:3]


@given(st.lists(st.sampled_from(["(", ")", "{", "}", "[", "]", "return", "throw", "x", ";", "\n", '"', "`", "${", "/*", "*/", " ", "f", "switch", "case"]), max_size=14))
@settings(max_examples=600, deadline=None)
def test_files_without_faults_need_no_outline(parts):
    shape, whole = brackets.Shape(" ".join(parts), ".js"), brackets.Shape(" ".join(parts), ".js")
    assert shape.findings() == (whole.outline.errors or whole.outline.unreachable)
    if structure.plain(shape.tokens):
        assert shape._outline is None


def test_white_space_around_texts_is_what_unicode_calls_so(spark):
    odd = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + ["﻿", "\U0001f600"]
    texts = [None, "", " \n", "a  b", " a", "\t\x85a b　 \n", *(f"{c}x{c} y{c}{c}" for c in odd)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    by_pattern = F.coalesce(F.regexp_replace("t", r"^(?U)\s+|(?U)\s+$", ""), F.lit(""))
    assert rows.where(~T.safe_text(F.col("t")).eqNullSafe(by_pattern)).count() == 0


def test_prompts_of_one_row_group_are_made_by_all_cores(spark):
    shares = scan_queries._hits(spark, "/root/testdata/sf0.001").rdd.glom().map(len).collect()
    assert sum(shares) == 200 and sum(s > 0 for s in shares) > spark.sparkContext.defaultParallelism
