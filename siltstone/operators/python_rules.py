"""Rules for Python files, which need the language's own parser: one pass of Arrow batches, one parse a file.

Findings, definitions and calls of a file come together; a function is unused if its file never calls its name, so the
anti join stays within the row. A file that does not parse is mended step by step in a scratch copy, so that each of its
syntax errors is found and not the first alone.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import scopes, syntax_repair

LEAVING = (ast.Return, ast.Raise, ast.Break, ast.Continue)
BUG_TYPES = {
    "syntax_error": "Syntax Error", "undefined_name": "Runtime Error", "unreachable_code": "Unnecessary Code", "mutable_default_arg": "Logic Error",
    "bare_except": "Logic Error", "eq_none": "Logic Error", "division_by_zero": "Runtime Error", "possible_division_by_zero": "Runtime Error", "possibly_unused_function": "Unnecessary Code",
}


def leaves(s: ast.stmt) -> bool:
    """Whether a statement surely leaves its block."""
    match s:
        case ast.If(body=body, orelse=orelse):
            return bool(orelse) and leaves(body[-1]) and leaves(orelse[-1])
        case ast.Try(body=body, handlers=handlers):
            return bool(handlers) and leaves(body[-1]) and all(leaves(h.body[-1]) for h in handlers)
    return isinstance(s, LEAVING)


def _blocks(node: ast.AST) -> Iterator[list[ast.stmt]]:
    for name in ("body", "orelse", "finalbody"):
        if isinstance(block := getattr(node, name, None), list):
            yield block
    for handler in getattr(node, "handlers", []):
        yield handler.body


def unreachable(node: ast.AST) -> Iterator[int]:
    """Line of the first statement after a leaving one, in each block of a function; functions inside report their own."""
    for block in _blocks(node):
        for before, after in zip(block, block[1:], strict=False):
            if leaves(before):
                yield after.lineno
                break
        for s in block:
            if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield from unreachable(s)


def rows_of(source: str) -> Iterator[tuple[str, int, str, str]]:
    """(kind, line, rule or name, detail): kinds finding, def and call.

    What does not compile is a syntax error. A file that parses all the same, such as one with a return outside a function,
    is looked at by the other rules too."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        for line, message in syntax_errors(source):
            yield "finding", line, "syntax_error", message
        return
    if _error(source) is not None:
        for line, message in compile_errors(ast.parse(source)):
            yield "finding", line, "syntax_error", message
    for line, rule, detail in scopes.messages(tree):
        yield "finding", line, rule, detail
    dead: set[int] = set()
    for node in ast.walk(tree):
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                yield "def", node.lineno, node.name, ""
                dead.update(unreachable(node))
                for d in node.args.defaults:
                    if isinstance(d, (ast.List, ast.Dict, ast.Set)):
                        yield "finding", d.lineno, "mutable_default_arg", node.name
            case ast.Call(func=ast.Name(id=name)) | ast.Call(func=ast.Attribute(attr=name)):
                yield "call", node.lineno, name, ""
            case ast.ExceptHandler(type=None):
                yield "finding", node.lineno, "bare_except", ""
            case ast.Compare(ops=ops, comparators=right):
                if any(isinstance(o, (ast.Eq, ast.NotEq)) and isinstance(r, ast.Constant) and r.value is None for o, r in zip(ops, right, strict=True)):
                    yield "finding", node.lineno, "eq_none", ""
            case ast.BinOp(op=ast.Div() | ast.FloorDiv(), right=ast.Constant(value=v)):
                if isinstance(v, (int, float)) and not isinstance(v, bool) and v == 0:
                    yield "finding", node.lineno, "division_by_zero", ""
            case ast.BinOp(op=ast.Div() | ast.FloorDiv()):
                yield "finding", node.lineno, "possible_division_by_zero", ""
    for line in sorted(dead):
        yield "finding", line, "unreachable_code", ""


def findings(source: str | None) -> list[tuple[int, str, str, str]]:
    """(line, rule, bug type, detail) of one file, unused functions last. A file that breaks a rule (code nested too deeply
    for Python's own tools, say) has one row that says so, and no other file is touched."""
    try:
        return _findings(source or "")
    except Exception as e:
        return [(1, "detector_error", "Other", type(e).__name__)]


def _findings(source: str) -> list[tuple[int, str, str, str]]:
    rows = list(rows_of(source))
    out = [(line, name, detail) for kind, line, name, detail in rows if kind == "finding"]
    called = {name for kind, _, name, _ in rows if kind == "call"}
    own = {name: line for kind, line, name, _ in rows if kind == "def" and not name.startswith("_") and name != "main"}
    out += [(line, "possibly_unused_function", name) for name, line in own.items() if name not in called]
    return [(line, rule, BUG_TYPES.get(rule, "Other"), detail) for line, rule, detail in out]


def detect(files: DataFrame) -> DataFrame:
    """file, line_start, rule, bug_type, detail of Python files (file, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file, *r) for file, source in zip(batch.column("file").to_pylist(), batch.column("source").to_pylist(), strict=True) for r in findings(source)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["file", "line_start", "rule", "bug_type", "detail"])

    return files.select("file", F.col("source").cast("string")).mapInArrow(run, "file string, line_start int, rule string, bug_type string, detail string")


def balanced_line(line: str) -> str:
    """A line whose brackets and strings are closed by the fewest edits."""
    return syntax_repair.balanced(line)[0]


#: Ways to mend a line, in order of trial.
WAYS = (
    balanced_line,
    lambda x: re.sub(r"^(\s*(?:if|elif|else|for|while|def|class|try|except|finally|with)\b[^:#]*?)\s*$", r"\1:", x),
    lambda x: re.sub(r"^(\s*(?:if|elif|while)\b[^=!<>]*)=(?!=)", r"\1==", x),
    lambda x: "    " + x,
    lambda x: x.removeprefix("    "),
    lambda x: re.sub(r"[)\]}]\s*$", "", x),
    lambda x: re.sub(r"\b(break|continue|return\b.*)$", "pass", x),
    lambda x: re.sub(r"^(\s*)from\s+(\S+)\s+import\s*$", r"\1import \2", x),
)
MOST_ERRORS = 40


def _error(source: str | ast.Module) -> tuple[int, str] | None:
    """Line and message of the first syntax error."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(source, "file", "exec", dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError) as e:
        return getattr(e, "lineno", None) or 1, getattr(e, "msg", None) or str(e)
    return None


def _mended(source: str, line: int) -> str | None:
    """The source with its error at that line mended: the first way after which it compiles, else the way after which the
    next error is furthest down, but below this one; null if none gets further."""
    lines, best = source.split("\n"), (line, None)
    for k in dict.fromkeys((line - 1, line - 2)):
        if 0 <= k < len(lines):
            for way in WAYS:
                text = "\n".join([*lines[:k], way(lines[k]), *lines[k + 1 :]])
                wrong = _error(text) if text != source else (0, "")
                if wrong is None:
                    return text
                if wrong[0] > best[0]:
                    best = wrong[0], text
    return best[1]


class _Passed(ast.NodeTransformer):
    """Puts `pass` for the innermost simple statement that begins at a line."""

    def __init__(self, line: int) -> None:
        self.line, self.done = line, False

    def visit(self, node: ast.AST) -> ast.AST:
        if isinstance(node, ast.stmt) and not hasattr(node, "body") and node.lineno <= self.line <= (node.end_lineno or node.lineno) and not self.done:
            self.done = True
            return ast.copy_location(ast.Pass(), node)
        return self.generic_visit(node) if not isinstance(node, ast.expr) else node


def compile_errors(tree: ast.Module) -> list[tuple[int, str]]:
    """(line, message) of what Python refuses in a file that it can parse: a return outside a function, a name that is both
    parameter and global, and so on. Each statement at fault is passed over and the next looked for."""
    found: list[tuple[int, str]] = []
    while (wrong := _error(tree)) is not None and wrong not in found:
        found.append(wrong)
        passed = _Passed(wrong[0])
        tree = passed.visit(tree)
        if not passed.done:
            break
    return found


def syntax_errors(source: str) -> list[tuple[int, str]]:
    """(line, message) of up to MOST_ERRORS syntax errors: each is mended in a scratch copy, or its line emptied, and the
    next one looked for. It ends when nothing changes any more."""
    found: list[tuple[int, str]] = []
    while len(found) < MOST_ERRORS and (wrong := _error(source)) is not None:
        if wrong in found:
            break
        found.append(wrong)
        mended = _mended(source, wrong[0])
        if mended is None:
            lines, k = source.split("\n"), wrong[0] - 1
            if not 0 <= k < len(lines):
                break
            lines[k] = re.match(r"\s*", lines[k])[0] + "pass"
            mended = "\n".join(lines)
        if mended == source:
            break
        source = mended
    return sorted(found)


def mended(source: str) -> str:
    """The source after the fewest edits that make it compile, if the known ones do; else as it is."""
    return syntax_repair.repaired(source, _error) or source
