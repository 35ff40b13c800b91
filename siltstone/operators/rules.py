"""The detect driver: bracket scan, unreachable statements, pattern rules and Python rules, one pass over each file.

Pattern rules are a table by extension; users extend it with rows of the same columns. They are matched on the text without
its strings and comments, in the same task that reads the file's tokens, and may span lines. A file's findings are made
where its row is: no text is shuffled or comes back from the task, and files of different repositories never meet.

Nulls: a null source is an empty file; a null file name has no extension and no findings. Repeated files are reported
each. A structural error is its file's only finding. Further columns named as keys are carried.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import balance, by_kind, extension
from siltstone.operators import brackets, lexer, python_rules
from siltstone.operators.brackets import Shape

_CATCH = r"catch\s*(\([^)]*\))?\s*\{\s*\}"
#: Rule, bug type, extensions, pattern.
RULES = [
    ("loose_equality", "Logic Error", ".js .jsx .ts .tsx", r"(?<![=!])(==|!=)(?!=)"),
    ("var_declaration", "Logic Error", ".js .jsx .ts .tsx", r"\bvar\s+[a-zA-Z_$][\w$]*"),
    ("empty_catch_block", "Logic Error", ".js .jsx .ts .tsx .java .cs .cpp .php .kt .kts", _CATCH),
    ("leftover_console_statement", "Unnecessary Code", ".js .jsx .ts .tsx", r"\bconsole\s*\.\s*(log|debug|warn|info)\s*\("),
    ("leftover_debugger_statement", "Unnecessary Code", ".js .jsx .ts .tsx", r"\bdebugger\b\s*;?"),
    ("leftover_debug_print", "Unnecessary Code", ".java", r"\bSystem\s*\.\s*(out|err)\s*\.\s*(println|print)\s*\("),
    ("leftover_debug_print", "Unnecessary Code", ".cs", r"\bConsole\s*\.\s*(WriteLine|Write)\s*\("),
    ("leftover_debug_print", "Unnecessary Code", ".php", r"\b(var_dump|print_r)\s*\("),
    ("leftover_debug_print", "Unnecessary Code", ".kt .kts", r"\bprintln\s*\("),
    ("leftover_debug_print", "Unnecessary Code", ".swift", r"\bprint\s*\("),
    ("leftover_debug_print", "Unnecessary Code", ".rb", r"\b(puts|p)\s*\(?"),
    ("leftover_debug_print", "Unnecessary Code", ".rs", r"\b(?:println!|print!|dbg!)\s*\("),
]
#: Extensions that a scan hands to the rules; for the others the rules exist but wait to be asked for.
DISPATCHED = ".py .pyi .js .jsx .ts .tsx .java .c .cpp .cs .go .php".split()


PYTHON = (".py", ".pyi")
FIELDS = "rule string, bug_type string, ext string, pattern string, dispatched boolean"
#: Rule tables up to so many rows go to the tasks as they are; longer ones are joined to the files by extension.
SMALL_TABLE = 10_000

#: line_start, rule, bug_type, current_code, detail
Finding = tuple[int, str, str, str, str]
FINDING = "struct<line_start: int, rule: string, bug_type: string, current_code: string, detail: string>"
FINDING_TYPE = pa.struct([("line_start", pa.int32()), ("rule", pa.string()), ("bug_type", pa.string()), ("current_code", pa.string()), ("detail", pa.string())])


def rule_table(spark: SparkSession) -> DataFrame:
    """The library's rules. A pattern is a regular expression in the notation that Java's and Python's have in common."""
    rows = [(rule, kind, ext, pattern, ext in DISPATCHED) for rule, kind, exts, pattern in RULES for ext in exts.split()]
    return spark.createDataFrame(rows, FIELDS)


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.removeprefix("(?U)"))


def file_findings(shape: Shape, rules: list[tuple[str, str, str]]) -> list[Finding]:
    """What is found in one file, in order of lines and rules: Python's own rules; in brace languages a structural error
    alone, or unreachable statements and matches of the (rule, bug type, pattern)s outside strings and comments."""
    try:
        if shape.ext in PYTHON:
            found = python_rules.findings(shape.source)
        else:
            found = [(line, rule, "Unnecessary Code" if rule == "unreachable_code" else "Syntax Error", "") for line, rule in shape.findings()] if shape.ext in brackets.BRACED else []
            if rules and all(rule == "unreachable_code" for _, rule, _, _ in found):
                found += _matches(shape, rules)
    except Exception as e:  # one file that breaks the detector is one row
        found = [(1, "detector_error", "Other", type(e).__name__)]
    lines = shape.source.split("\n") if found else []
    return sorted((line, rule, kind, lines[line - 1].strip() if 0 < line <= len(lines) else "", detail) for line, rule, kind, detail in found)


def _matches(shape: Shape, rules: list[tuple[str, str, str]]) -> Iterator[tuple[int, str, str, str]]:
    text = lexer.masked(shape.source, shape.tokens)
    for rule, kind, pattern in rules:
        line, at = 1, 0
        for m in _compiled(pattern).finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            yield line, rule, kind, ""


def keyed(files: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The keys, source (null: empty) and ext (null: none)."""
    return files.select(*key, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(extension(F.col("file")), F.lit("")).alias("ext"))


def examined(files: DataFrame, rules: DataFrame | None, key: tuple[str, ...], dispatched_only: bool, look: Callable[[Shape, list[tuple[str, str, str]]], list[tuple]], kind: pa.DataType, sql: str) -> DataFrame:
    """The keys and `f`, what `look` makes of each file and the rules of its extension, in one pass over each source.

    Only what is found comes back from the tasks. A short rule table is handed to them; a long one is joined."""
    rules = rule_table(files.sparkSession) if rules is None else rules
    rows = keyed(files, key)
    few = rules.select("ext", "rule", "bug_type", "pattern", "dispatched").limit(SMALL_TABLE + 1).collect()
    table: dict[str, list[tuple[str, str, str]]] | None = None
    if len(few) <= SMALL_TABLE:
        table = {}
        for r in sorted(few, key=lambda r: (r.rule or "", r.pattern or "")):
            table.setdefault(r.ext, []).append((r.rule, r.bug_type, r.pattern))
        if dispatched_only:
            rows = rows.where(F.col("ext").isin(sorted({*DISPATCHED, *(r.ext for r in few if r.dispatched and r.ext is not None)})))
    else:
        each = F.array_sort(F.collect_list(F.struct("rule", "bug_type", "pattern")))
        grouped = rules.groupBy("ext").agg(each.alias("_rules"), F.max("dispatched").alias("_asked"))
        rows = rows.join(grouped, "ext", "left")
        if dispatched_only:
            rows = rows.where(F.col("ext").isin(DISPATCHED) | F.col("_asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exts, sources = batch.column("ext").to_pylist(), batch.column("source").to_pylist()
            asked = table
            if asked is None:  # the rules that were joined are those of the extension
                first = {ext: i for i, ext in reversed(list(enumerate(exts)))}
                asked = {ext: [(r["rule"], r["bug_type"], r["pattern"]) for r in batch.column("_rules")[i].as_py() or []] for ext, i in first.items()}
            found = brackets.each_once(lambda source, ext: look(Shape(source, ext), asked.get(ext, [])), zip(sources, exts, strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(found, pa.list_(kind))], names=[*key, "f"])

    columns = ", ".join(f"`{c}` {t}" for c, t in rows.select(*key).dtypes)
    return rows.mapInArrow(run, f"{columns}, f array<{sql}>")


def pattern_findings(files: DataFrame, rules: DataFrame | None = None, key: tuple[str, ...] = ("file",)) -> DataFrame:
    """The keys, line_start, rule, bug_type, current_code for every match of every rule of a file's extension."""
    def look(shape: Shape, asked: list) -> list[Finding]:
        lines = shape.source.split("\n")
        return sorted((line, rule, kind, lines[line - 1].strip(), detail) for line, rule, kind, detail in _matches(shape, asked))

    return examined(files, rules, key, False, look, FINDING_TYPE, FINDING).select(*key, F.explode("f").alias("f")).select(*key, "f.line_start", "f.rule", "f.bug_type", "f.current_code")


def structural_findings(files: DataFrame, key: tuple[str, ...] = ("file",)) -> DataFrame:
    """The keys, rule, bug_type of files whose brackets do not match; none if every bracket is closed as often as opened."""
    wrong = by_kind(F.col("file"), lambda k: balance(F.col("source"), k))
    return files.select(*key, F.explode(F.filter(F.array(wrong), lambda w: w.isNotNull() & (w != "unterminated_string"))).alias("rule")).withColumn("bug_type", F.lit("Syntax Error"))


def detect(files: DataFrame, rules: DataFrame | None = None, key: tuple[str, ...] = ("file",), dispatched_only: bool = True) -> DataFrame:
    """The keys, line_start, rule, bug_type, current_code, detail of all findings, in order of lines within a file.

    Brace languages: a structural error alone, or unreachable statements and the pattern rules. Python: its own rules. Files
    of other extensions have none. `dispatched_only` leaves out extensions that a scan does not hand to the rules. A file
    that breaks a detector has one row `detector_error`."""
    return examined(files, rules, key, dispatched_only, file_findings, FINDING_TYPE, FINDING).select(*key, F.explode("f").alias("f")).select(*key, "f.*")
