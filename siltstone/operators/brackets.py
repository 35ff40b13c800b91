"""Brackets, strings and unreachable statements of brace languages, by one pass over the tokens of each file.

What Catalyst expressions cannot hold is a stack of blocks with interpolation and markup; the pass is a small function over
Arrow batches. What is a string or a comment is the business of each language (`lexer.LANGUAGES`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import lexer, structure
from siltstone.operators.lexer import PAIRS

#: Extensions whose unreachable statements are reported.
UNREACHABLE = ".js .jsx .ts .tsx .java .c .cpp .cs .php .rs .kt .kts .swift".split()
#: Extensions of the languages that the scan reads.
BRACED = [*UNREACHABLE, ".go", ".rb"]
#: Languages whose blocks end with a keyword.
KEYWORD_ENDED = [".rb", ".ex", ".exs"]


class Shape:
    """A file's tokens and outline, each made when first asked for."""

    def __init__(self, source: str, ext: str) -> None:
        self.source, self.ext = source, ext
        self._tokens: list[lexer.Token] | None = None
        self._outline: structure.Outline | None = None

    @property
    def tokens(self) -> list[lexer.Token]:
        if self._tokens is None:
            self._tokens = lexer.tokens(self.source, self.ext)
        return self._tokens

    @property
    def outline(self) -> structure.Outline:
        if self._outline is None:
            self._outline = structure.outline(self.source, self.tokens, self.ext in KEYWORD_ENDED)
        return self._outline

    def findings(self) -> list[tuple[int, str]]:
        """(line, rule): the first structural error alone, or the first unreachable statement of each block."""
        if self._outline is None and structure.plain(self.tokens):
            return []
        return self.outline.errors or (self.outline.unreachable if self.ext in UNREACHABLE else [])


def each_once(look: Callable[..., list[tuple]], files: Iterable[tuple]) -> list[list[tuple]]:
    """What `look` makes of each file (what it is called with); equal ones of a batch, such as copies, are looked at once."""
    known: dict[tuple, list[tuple]] = {}
    out = []
    for file in files:
        found = known.get(file)
        if found is None:
            found = known[file] = look(*file)
        out.append(found)
    return out


def scan(source: str, template: bool = True) -> list[tuple[int, str]]:
    """(line, rule) of a script, or of a language without templates."""
    return Shape(source, ".jsx" if template else ".java").findings()


def findings(source: str, ext: str) -> list[tuple[int, str, str, str]]:
    """(line, rule, bug type, detail) of one file."""
    return [(line, rule, "Unnecessary Code" if rule == "unreachable_code" else "Syntax Error", "") for line, rule in Shape(source, ext).findings()]


def bracket_findings(files: DataFrame) -> DataFrame:
    """file, line_start, rule of files (file, source) in brace languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("file").to_pylist()
            texts = ((source or "", "." + (file or "").lower().rpartition(".")[2]) for file, source in zip(files, batch.column("source").to_pylist(), strict=True))
            rows = [(file, line, rule) for file, found in zip(files, each_once(findings, texts), strict=True) for line, rule, _, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["file", "line_start", "rule"])

    return files.select("file", F.col("source").cast("string")).mapInArrow(run, "file string, line_start int, rule string")


_PART = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|[()\[\]{}]|[^()\[\]{}\"'`/]+|.", re.S)


def balanced_code(code: str) -> str:
    """The code with its brackets, strings and comments closed: a closer that fits a bracket further out gets the missing
    ones before it, one that fits none goes, and what is open at the end is closed there."""
    out: list[str] = []
    stack: list[str] = []
    for t in _PART.findall(code):
        if t in PAIRS:
            stack.append(PAIRS[t])
        elif t in PAIRS.values():
            if t not in stack:
                continue
            while stack[-1] != t:
                out.append(stack.pop())
            stack.pop()
        elif t[0] in "\"'`" and (len(t) == 1 or t[-1] != t[0] or re.search(r"(?<!\\)(?:\\\\)*\\.\Z", t, re.S)):
            t += t[0]
        elif t.startswith("/*") and (len(t) < 4 or not t.endswith("*/")):
            t += " */"
        out.append(t)
    return "".join(out) + "".join(reversed(stack))
