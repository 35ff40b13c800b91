"""Strings, comments and blocks of each language, Python's scopes, and files that break a detector."""

import random

import pytest
from siltstone.operators import brackets, chunks, lexer, python_rules, rules

CLEAN = [
    (".php", "# don't\nf();"), (".php", "<h1>it's ( </h1><?php f(); // don't ?> isn't ( <?php g(); "), (".php", "#[Attr(1)]\nf();"), (".php", "$x = <<<EOT\nit's ( {$a['k']}\nEOT;\nf();"), (".php", "$x = 'it\\'s\n(';"), (".php", "$x = \"a {$b[\"c\"]} ( ${d}\";"),
    (".rb", "# don't\nf()"), (".rb", "x = <<~EOS\n  it's (\nEOS\nf()"), (".rb", "y = %w[a ( b]\nputs \"a#{f(\"(\")}c\"\nz = a / b\nq = x =~ /[(]/"), (".rb", "=begin\nit's (\n=end\nf()"), (".rb", "f(:'a (', ?( )"), (".rb", "f(1)\n__END__\nit's ("),
    (".kt", 'val s = """a " ( b"""'), (".kt", 'val x = "a ${f(")")} b"; val c = \'"\'; /* /* ( */ ( */ f()'), (".kt", "fun `it's (`() { }"),
    (".cs", 'x = @"a\\"; f();'), (".cs", 'x = @"a ""b"" ( \n"; y = $"a {f(")")} {{ (";'), (".cs", 'u = """a "b" ( c"""; w = $$"""x {f(1)}"""; #region don\'t\nf();'.replace("; #", ";\n#")),
    (".rs", "fn f<'a>(x: &'a str) -> &'a str { x }"), (".rs", "let c = '\\''; let d = '('; let e = r#\"a\"(b\"#; let g = b'\"'; /* /* ( */ ( */"), (".rs", "'outer: loop { break 'outer; }"), (".rs", 'let s = "a\n( b";'),
    (".swift", 'let s = "a \\(f("(" + ")")) ("; let r = #"a"("#; /* /* ( */ */ let t = """\n" (\n"""'),
    (".go", "x := `a\\`; c := '('; d := '\\''; f()"), (".java", 'String s = """\n "( \\""" \n"""; char c = \'"\'; // don\'t ('),
    (".cpp", 'auto s = R"x(a ")" (b)x"; int n = 1\'000\'000;\n#error don\'t (\nf();'), (".c", "// a comment \\\n goes on (\nf();"), (".c", "#include <it's(>\nf();"),
    (".js", "x = a ? /[/(]/g : b / c / d; y = `a ${f(`(${\")\"}`)} (`;"), (".js", "// don't (\nlet s = 'a\\\n(';"), (".jsx", "const a = <p title=\"(\">isn't ( {f(')')} <b/> </p>; const b = a < c;"), (".tsx", "const f = <T,>(x: T) => x; let y: Array<string> = g<number>(1);"), (".ts", "let a = <any>f(1);"),
]


@pytest.mark.parametrize("ext, source", CLEAN)
def test_no_findings_in_what_is_no_code(ext, source):
    assert brackets.findings(source, ext) == []
    hit = brackets.findings(source.rstrip("; ") + "\nf(;", ext) if "__END__" not in source and "// don't ?>" not in source else [(0, "unclosed_bracket")]
    assert [r[1] for r in hit] == ["unclosed_bracket"]


@pytest.mark.parametrize("ext, source, want", [
    (".php", "$x = 'a", (1, "unterminated_string")), (".rb", "\nx = <<~A\n a", (3, "unterminated_string")), (".kt", '"""a', (1, "unterminated_string")), (".rs", "/* /* */", (1, "unterminated_comment")), (".swift", "\n/*", (2, "unterminated_comment")),
    (".cs", 'x = @"a', (1, "unterminated_string")), (".cs", 'f("a\n")', (1, "unterminated_string")), (".go", "x := `a", (1, "unterminated_template_literal")), (".js", "`a ${b", (1, "unterminated_template_literal")), (".js", "`a ${f(]}`", (1, "mismatched_bracket")),
    (".ts", "let a = <any>f(;", (1, "unclosed_bracket")), (".java", '"""\na', (1, "unterminated_string")), (".rs", "f('a', \"(\"", (1, "unclosed_bracket")), (".cpp", 'R"x(a)y"', (1, "unterminated_string")),
])
def test_faults_of_each_language(ext, source, want):
    assert [r[:2] for r in brackets.findings(source, ext)] == [want]


def test_masking_keeps_length_and_line_ends_in_every_language():
    rng = random.Random(11)
    bits = ["'", '"', "`", "/*", "*/", "//", "#", "\n", "a", "(", ")", "{", "}", "${", "\\", "<", ">", "/", "=begin", "=end", "<<~A", "\nA\n", '"""', "@", "$", "r#", "%w[", "]", " ", "<?php", "?>", "1'0", "<b>", "</b>", "é", "\r\n"]
    for ext in [e for exts in lexer.EXTENSIONS.values() for e in exts.split()] + [".sql"]:
        for _ in range(60):
            source = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
            shape = brackets.Shape(source, ext)
            text = lexer.masked(source, shape.tokens)
            assert len(text) == len(source) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]
            assert all(1 <= first <= last for _, _, _, first, last in chunks.declared(shape)) and len(shape.outline.errors) <= 1


@pytest.mark.parametrize("ext, source, want", [
    (".java", "class A {\n  @Override\n  public List<String> get(int a,\n    int b) throws E {\n    return x;\n  }\n  void f();\n}", [("class", "A", 1, 8), ("function", "get", 3, 6)]),
    (".go", "func (r *T) Name(a int) (int, error) {\n return 1\n}\nvar x = func(a int) {\n}", [("function", "Name", 1, 3)]), (".c", "struct a *f(int b) {\n}\nstruct a x;\nstruct c {\n int d;\n};", [("function", "f", 1, 2), ("class", "c", 4, 6)]),
    (".js", "const f = async (a) => a + 1;\nlet g = (b) => {\n  b;\n};\nfunction* h() {}\nif (a) {\n}", [("function", "f", 1, 1), ("function", "g", 2, 4), ("function", "h", 5, 5)]), (".rb", "class A\n def b?\n  1\n end\nend", [("class", "A", 1, 4), ("function", "b?", 2, 4)]),
    (".js", "s = 'class X {'; // function y() {\nclass Z {", [("class", "Z", 2, 2)]), (".kt", "class X(val a: Int) {\n fun b(): Int {\n  return 1 }\n}", [("class", "X", 1, 4), ("function", "b", 2, 3)]), (".cs", "class A {\n int this[int i] { get { return 1; } }\n void B() { }\n}", [("class", "A", 1, 4), ("function", "B", 3, 3)]),
])
def test_declarations(ext, source, want):
    assert [(k, n, a, b) for k, n, _, a, b in chunks.declared(brackets.Shape(source, ext))] == want


#: Source and the (line, rule) that the scopes give; the second half is clean.
SCOPES = [
    ("def a():\n    t = 1\n    return t\ndef b():\n    return t\na(b)", [(5, "undefined_name")]), ("x = [i for i in range(3)]\nprint(i)", [(2, "undefined_name")]), ("from a import b", [(1, "unused_import")]), ("import a.b\nimport a.c", [(1, "unused_import"), (2, "unused_import")]),
    ("def f():\n    x = 1\nf()", [(2, "unused_variable")]), ("def f():\n    with g() as x: pass\nf()\ng = f", [(2, "unused_variable")]), ("import os\nimport os\nos", [(2, "redefined_while_unused")]), ("def f(): pass\ndef f(): pass\nf()", [(2, "redefined_while_unused")]),
    ("class A:\n    def f(self): pass\n    def f(self): pass\nA.f()", [(3, "redefined_while_unused")]), ("{'a': 1, 'a': 2}", [(1, "duplicate_key")]), ("x = 1\nx is 'a'", [(2, "is_literal")]), ("x = 1\nx is not ()", [(2, "is_literal")]), ("'%s %s' % (1,)", [(1, "format_arguments")]),
    ("'%(a)s' % {'b': 1}", [(1, "format_arguments"), (1, "format_arguments")]), ("'{} {}'.format(1)", [(1, "format_arguments")]), ("'{0} {}'.format(1, 2)", [(1, "format_arguments")]), ("'{a}'.format(a=1, b=2)", [(1, "format_arguments")]), ("'{'.format(1)", [(1, "format_arguments")]), ("'%z' % 1", [(1, "format_arguments")]),
    ("f'abc'", [(1, "f_string_without_placeholder")]), ("assert (1, 'a')", [(1, "assert_tuple")]), ("if (1, 2): pass", [(1, "if_tuple")]), ("raise NotImplemented('x')", [(1, "raise_not_implemented")]), ("from x import *\nfoo", [(1, "import_star")]), ("__all__ = ['nope']", [(1, "undefined_export")]),
    ("class A:\n    x = 1\n    def f(self): return x\nA.f()", [(3, "undefined_name")]), ("try:\n    pass\nexcept ValueError as e:\n    pass", [(3, "unused_variable")]), ("def f():\n    try:\n        pass\n    except ValueError as e:\n        print(e)\n    return e\nf()", [(6, "undefined_local")]),
    ("def f():\n    print(x)\n    x = 1\nf()", [(2, "undefined_local")]), ("x = 1\ndel x\nprint(x)", [(3, "undefined_name")]), ("def f(a: 'Foo'): pass\nf(1)", [(1, "undefined_name")]), ("def f(a: 'Foo['): pass\nf(1)", [(1, "forward_annotation_syntax_error")]), ("lambda q: q + z", [(1, "undefined_name")]),
    ("def g():\n    y: int\n    return 1\ng()", [(2, "unused_annotation")]), ("import os\nfor os in []: print(os)", [(2, "redefined_while_unused")]), ("import os\nos\nfor os in []: print(os)", [(3, "import_shadowed_by_loop_variable")]), ("class A(B): pass", [(1, "undefined_name")]), ("@deco\ndef f(): pass\nf()", [(1, "undefined_name")]),
    ("def f():\n    import os\n    return 1\nf()", [(2, "unused_import")]), ("x += 1", [(1, "undefined_name")]), ("match 1:\n    case q: pass\n    case [w]: print(v)", [(1, "syntax_error"), (3, "undefined_name")]), ("import a as b", [(1, "unused_import")]),
    # what Python refuses although it parses
    ("return 1", [(1, "syntax_error")]), ("for x in []: pass\nbreak", [(2, "syntax_error")]), ("def f(a, a): return a\nf(1)", [(1, "syntax_error")]), ("(yield)", [(1, "syntax_error")]), ("def f():\n    nonlocal q\nf()", [(2, "syntax_error")]), ("x = 1\ndef f():\n    print(x)\n    global x\nf()\nreturn", [(4, "syntax_error"), (6, "syntax_error")]),
]
CLEAN_PYTHON = [
    "import os\n__all__ = ['os']", "from a import b as c\nprint(c)", "import a.b\na.b.c()", "try:\n    import json\nexcept ImportError:\n    json = None\nprint(json)", "if print:\n    def f(): pass\nelse:\n    def f(): pass\nf()", "def f():\n    global g\n    g = 1\nprint(g)\nf()",
    "class A:\n    x = 1\n    y = [x for _ in range(3)]\nA()", "from __future__ import annotations\nprint(1)", "def f():\n    (a, b) = 1, 2\nf()", "def f():\n    e = 1\n    return locals()\nf()", "def f():\n    while 1:\n        if f: print(q)\n        q = 1\nf()", "def f():\n    x = 1\n    def g():\n        return x\n    return g\nf()",
    "def f():\n    x = 1\n    def g():\n        nonlocal x\n        x = 2\n    return g\nf()", "def g():\n    yield from h()\nclass h: pass\ng()", "import typing\n@typing.overload\ndef f(a: int): ...\n@typing.overload\ndef f(a: str): ...\ndef f(a): return a\nf(1)", "class A:\n    @property\n    def x(self): return 1\n    @x.setter\n    def x(self, v): self.v = v\nA().x(1)",
    "def f[T](x: T) -> T: return x\nf(1)", "type X = list[X]\nprint(X)", "match [1]:\n    case [a, *b]: print(a, b)\n    case {'k': v, **r}: print(v, r)", "print(__file__, __name__, __doc__)", "'%s' % (1,), '%(a)s' % {'a': 1}, '%d%%' % 3, '%*d' % (3, 4)", "'{} {a} {b.c} {d[0]:{e}}'.format(1, a=1, b=2, d=3, e=4)", "x = 1\nx is None, x is True, x == 'a'",
    "f'{1}', f'{1:>10}', rf'{2}'", "{'a': 1, 'b': 1, **{}}", "{'a': 1, 'a': 1}", "raise NotImplementedError", "assert (1)", "from typing import Literal\nx: Literal['not a name'] = 1", "def f(x: 'list[int]') -> 'f': return x\nf(1)", "x = (y := 1)\nprint(y)", "print([z for q in [[1]] for z in q])", "def f(*a, b=1, **c): return a, b, c\nf()", "async def f():\n    async with f() as b:\n        print(b)\n    async for c in f(): print(c)\nf()",
    "for i in range(3): pass\nprint(i)", "with open('f') as g: print(g)", "try:\n    x = 1\nfinally:\n    pass\nprint(x)", "import a\ndef f():\n    import a\n    return a\nf(a)", "class A:\n    def f(self): return __class__\nA.f()", "def f():\n    __tracebackhide__ = True\nf()", "from . import b\nfrom .. import c\nprint(b, c)", "print('{0}{1}'.format(*[1, 2]))",
]


@pytest.mark.parametrize("source, want", SCOPES)
def test_scopes_find(source, want):
    got = sorted((r[1], r[2]) for r in python_rules.rows_of(source) if r[0] == "finding")
    assert got == sorted(want) if "case q" not in source else set(got) >= {want[1]}


@pytest.mark.parametrize("source", CLEAN_PYTHON)
def test_scopes_leave_alone(source):
    compile(source, "f", "exec")
    assert [r for r in python_rules.rows_of(source) if r[0] == "finding"] == []


def test_no_mutation_of_a_source_ends_a_scan(spark):
    rng = random.Random(12)
    bases = [(".py", s) for s, _ in SCOPES] + [(".py", s) for s in CLEAN_PYTHON] + CLEAN
    rows = []
    for k in range(1500):
        ext, s = rng.choice(bases)
        s = list(s)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randint(0, 3)] = rng.choice(["", "(", ")", ":", "\n", "    ", "'", '"', "\0", "def ", "global x\n", "return ", "{", "}", "\\", "*", "=", "é", "\ud7ff"])
        rows.append((k, f"f{k}{ext}", "".join(s)))
    rows += [(9001, "deep.py", "(" * 5000), (9002, "deep2.py", "x = " + "-" * 50_000 + "1"), (9003, "deep.js", "f(" * 20_000), (9004, "n.py", None), (9005, None, "f(")]
    made = spark.createDataFrame(rows, "k long, file string, source string").repartition(4)
    found = rules.detect(made, key=("k", "file"), dispatched_only=False).collect()
    assert {r.k for r in found} >= {9001, 9002, 9003} and 9005 not in {r.k for r in found}
    assert {r.k for r in chunks.chunked(made, ("k", "file")).select("k").collect()} >= {k for k, _, s in rows if s and s.strip()}


def test_a_file_that_breaks_a_detector_is_one_row(spark, monkeypatch):
    def broken(tree):
        raise RecursionError("deep")

    monkeypatch.setattr(python_rules.scopes, "messages", broken)
    assert [r[1] for r in rules.file_findings(brackets.Shape("x = 1", ".py"), [])] == ["detector_error"]


def test_long_rule_tables_are_joined(spark, monkeypatch):
    table = rules.rule_table(spark).unionByName(spark.createDataFrame([("todo", "Other", ".odd", r"\bTODO\b", True)], rules.FIELDS))
    made = spark.createDataFrame([("a.js", "var a; debugger;"), ("b.odd", "TODO"), ("c.kt", "println(1)"), ("d.none", "var a;"), ("e.py", "import os")], "file string, source string")
    few = sorted(map(tuple, rules.detect(made, table).collect()))
    monkeypatch.setattr(rules, "SMALL_TABLE", 3)
    assert sorted(map(tuple, rules.detect(made, table).collect())) == few and {r[0] for r in few} == {"a.js", "b.odd", "e.py"}
    assert {r.file for r in rules.pattern_findings(made, table).collect()} == {"a.js", "b.odd", "c.kt"}
    monkeypatch.undo()
    assert "Exchange" not in rules.detect(made, table)._jdf.queryExecution().executedPlan().toString()


def test_findings_meet_their_chunk_within_the_file(spark):
    from siltstone.plans import scan

    source = "class A {\n  void f() {\n    g();\n  }\n}\n" + "h();\n" * 5 + "int k() {\n  return 1;\n  x();\n}"
    made = spark.createDataFrame([("r", "a.java", source), ("r", "a.java", source), ("r", "b.js", "x;\nvar y;")], "repo string, file string, source string")
    got = sorted((r.file, r.line_start, r["name"], r.chunk_start, r.line) for r in scan.numbered_findings(made, ("repo", "file")).collect())
    assert got == [("a.java", 13, "k", 8, 6)] * 2 + [("b.js", 2, "block_1", 1, 2)]


def test_table_functions_equal_the_operators(spark):
    from siltstone.functions import tables

    tables.register(spark)
    rows = [("r", "a.js", "var a;\nif (a == 1) debugger;"), ("r", "b.py", "import os\ndef f(:\n  pass"), ("r", "c.kt", "println(1)"), (None, "d/e.java", "class A {\n void f() {\n  return;\n }\n}"), ("r", None, "x"), ("r", "f.js", None), ("r", ".js", "var a;")]
    made = spark.createDataFrame(rows, "repo string, file string, source string")
    made.createOrReplaceTempView("files_of_test")
    found = spark.sql("SELECT * FROM file_findings(TABLE(SELECT repo, file, source FROM files_of_test))")
    want = rules.detect(made, key=("repo", "file"), dispatched_only=False)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.count() > 4
    cut = spark.sql("SELECT repo, file, chunk_type, name, line_start, line_end FROM file_chunks(TABLE(SELECT repo, file, source FROM files_of_test))")
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, chunks.chunked(made, ("repo", "file")).select(*cut.columns).collect()))
