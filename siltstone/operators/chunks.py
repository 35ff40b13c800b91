"""Chunks of source files: declarations with their code, tumbling blocks of lines, duplicates, and the chunk that a finding
belongs to.

`chunked` is the dispatcher: declarations come from the tokens that the detectors read too (Python's from its parser), and
each file is cut where its row is, so no text is shuffled. Nulls: a null or blank source has no chunks. Ties between equal
ranges go to the first by kind and name. Repeated files are cut each.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import chunk_id, described_chunk, language, let, lines_of, safe_text
from siltstone.operators.brackets import Shape, each_once
from siltstone.operators.rules import keyed

BLOCK_LINES, MOST_LINES, CONTEXT = 80, 120, 3


def blocks(files: DataFrame, size: int = BLOCK_LINES, key: tuple[str, ...] = ("file",)) -> DataFrame:
    """Blocks of `size` lines: the keys, name, line_start, line_end, code. Blocks of blank lines are left out."""

    def cut(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(size))
        return F.transform(starts, lambda s: F.struct((s + 1).alias("line_start"), F.least(s + size, F.size(lines)).alias("line_end"), safe_text(F.array_join(F.slice(lines, s + 1, F.lit(size)), "\n")).alias("code")))

    found = F.filter(let(lines_of(F.col("source")), cut), lambda b: b["code"] != "")
    return files.select(*key, F.explode(found).alias("b")).select(*key, F.format_string("block_%d", F.col("b.line_start")).alias("name"), "b.*")


def limited(first: Column, last: Column, total: Column, most: int = MOST_LINES, context: int = CONTEXT) -> Column:
    """struct(line_start, line_end): at most `most` lines, then some lines around them, inside the file."""
    end = F.least(last, first + most - 1)
    return F.struct(F.greatest(first - context, F.lit(1)).alias("line_start"), F.least(end + context, total).alias("line_end"))


def deduplicated(chunks: DataFrame, order: str, key: tuple[str, ...] = ("file",)) -> DataFrame:
    """The first chunk of each file, type, name and range."""
    same = Window.partitionBy(*key, "chunk_type", "name", "line_start", "line_end").orderBy(order)
    return chunks.withColumn("_k", F.row_number().over(same)).where("_k = 1").drop("_k")


#: chunk_type, name, parent, line_start, line_end
Range = tuple[str, str, str | None, int, int]
RANGE = "struct<chunk_type: string, name: string, parent: string, line_start: int, line_end: int>"
RANGE_TYPE = pa.struct([("chunk_type", pa.string()), ("name", pa.string()), ("parent", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])
CHUNK = "struct<chunk_type: string, name: string, parent: string, line_start: int, line_end: int, raw: string>"
CHUNK_TYPE = pa.struct([*RANGE_TYPE, ("raw", pa.string())])
PYTHON = (".py", ".pyi")


def _ranged(files: DataFrame, key: tuple[str, ...], look: Callable[[Shape], list[tuple]], kind: pa.DataType, sql: str) -> DataFrame:
    """The keys and what `look` finds in each file, by one pass where its row is."""
    rows = keyed(files, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = each_once(lambda source, ext: look(Shape(source, ext)), zip(batch.column("source").to_pylist(), batch.column("ext").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(found, pa.list_(kind))], names=[*key, "c"])

    columns = ", ".join(f"`{c}` {t}" for c, t in rows.select(*key).dtypes)
    return rows.mapInArrow(run, f"{columns}, c array<{sql}>").select(*key, F.explode("c").alias("c")).select(*key, "c.*")


#: What every head has; a file without it is not read by tokens.
_ANY_HEAD = re.compile(r"\b(?:class|interface|struct|function|def)\b|=>|\)[^;{}]*+\{")


def declared(shape: Shape) -> list[Range]:
    """Classes and functions of a file in another language than Python, by its tokens."""
    if _ANY_HEAD.search(shape.source) is None:
        return []
    return [(d.kind, d.name, None, d.first, d.last) for d in shape.outline.declarations]


def declarations(files: DataFrame, key: tuple[str, ...] = ("file",)) -> DataFrame:
    """Classes and functions by their heads: the keys, chunk_type, name, line_start, line_end.

    A declaration ends with the block that is its body, or, in languages that end blocks with a keyword and if its line
    opens no brace, at the next line that is `end`; one that never ends takes 80 lines in all."""
    return _ranged(files, key, declared, RANGE_TYPE, RANGE).drop("parent")


def python_ranges(source: str) -> list[Range]:
    """Functions, classes and other top-level statements of a Python file; a file that does not parse is one chunk."""

    def parts(body: list, parent: str | None, top: bool) -> Iterator[Range]:
        for node in body:
            kind = {"ClassDef": "class", "FunctionDef": "function", "AsyncFunctionDef": "function"}.get(type(node).__name__)
            if kind:
                yield kind, node.name, parent, node.lineno, node.end_lineno
                yield from parts(node.body, node.name, False)
            elif top:
                yield "module_code", type(node).__name__.lower(), parent, node.lineno, node.end_lineno

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return list(parts(ast.parse(source).body, None, True))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [("file", "file", None, 1, source.rstrip("\n").count("\n") + 1)]


def python_chunks(files: DataFrame, key: tuple[str, ...] = ("file",)) -> DataFrame:
    """The keys, chunk_type, name, parent, line_start, line_end of Python files."""
    return _ranged(files, key, lambda shape: python_ranges(shape.source), RANGE_TYPE, RANGE)


def file_chunks(shape: Shape) -> list[tuple]:
    """The chunks of one file with their code: declarations of at most MOST_LINES and CONTEXT lines around them, or blocks.
    Those of equal type, name and range are one; blank ones are none."""
    if not shape.source.strip():
        return []
    lines = shape.source.removesuffix("\n").split("\n")
    try:
        found = python_ranges(shape.source) if shape.ext in PYTHON else declared(shape)
    except Exception:  # a file that no parser gets through is cut into blocks
        found = []
    cut = [(max(first - CONTEXT, 1), min(min(last, first + MOST_LINES - 1) + CONTEXT, len(lines)), kind, name, parent) for kind, name, parent, first, last in found]
    cut = cut or [(at + 1, min(at + BLOCK_LINES, len(lines)), "code_block", f"block_{at + 1}", None) for at in range(0, len(lines), BLOCK_LINES)]
    ordered = sorted(dict.fromkeys(cut), key=lambda c: (*c[:4], c[4] is not None, c[4] or ""))
    whole = ((kind, name, parent, first, last, "\n".join(lines[first - 1 : last])) for first, last, kind, name, parent in ordered)
    return [c for c in whole if c[-1].strip()]


def described(rows: DataFrame) -> DataFrame:
    """Chunks with raw code, and their language, code (trimmed), text (what it is embedded by) and chunk_id."""
    rows = rows.withColumn("code", safe_text(F.col("raw"))).withColumn("language", language(F.col("file")))
    text = described_chunk(*[F.col(c) for c in ("file", "language", "chunk_type", "name", "parent", "line_start", "line_end", "code")])
    return rows.withColumn("text", text).withColumn("chunk_id", chunk_id(*[F.col(c) for c in ("file", "line_start", "line_end", "name")]))


def chunked(files: DataFrame, key: tuple[str, ...] = ("file",)) -> DataFrame:
    """The chunks of files (keys with `file`, source): the keys, language, chunk_type, name, parent, line_start, line_end, code
    (trimmed), raw (as in the file), text (what it is embedded by), chunk_id; ordered within a file by lines and type.

    Python by its parser, others by their declarations, at most 120 lines each and three more around them; a file without
    any is cut into blocks. Each file is read once, where its row is: files of equal keys do not meet."""
    rows = described(_ranged(files, key, file_chunks, CHUNK_TYPE, CHUNK))
    return rows.select(*key, "language", "chunk_type", "name", "parent", "line_start", "line_end", "code", "raw", "text", "chunk_id")


def chunk_at(chunks: list[tuple], line: int | None) -> tuple | None:
    """The chunk of a file that a line belongs to: the first that holds it, else the nearest; without a line the first."""
    if not chunks or line is None:
        return chunks[0] if chunks else None
    return min(enumerate(chunks), key=lambda c: (max(c[1][3] - line, line - c[1][4], 0), c[0]))[1]


#: Lines of a bin by which findings and chunks meet.
BIN_LINES = 256


def best_chunk(findings: DataFrame, chunks: DataFrame, finding: str, chunk: str) -> DataFrame:
    """Each finding (file, line_start, line_end) with the chunk of its file that it overlaps most, else the nearest; ties
    go to the first by `chunk`; a finding without a line gets the first chunk.

    A finding first meets the chunks that reach into its bins of lines; only those without an overlap there look for the
    nearest chunk, before and after, by one window. So a file of many lines is not paired with all its findings."""
    f = findings.select("file", finding, F.col("line_start").alias("_s"), F.coalesce("line_end", "line_start").alias("_e"))
    c = chunks.select("file", chunk, F.col("line_start").alias("_cs"), F.col("line_end").alias("_ce"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN_LINES), F.floor(F.greatest(a, b) / BIN_LINES))).alias("_bin")
    overlap = F.least("_e", "_ce") - F.greatest("_s", "_cs") + 1
    near = f.where("_s IS NOT NULL").select("*", bins("_s", "_e")).join(c.select("*", bins("_cs", "_ce")), ["file", "_bin"]).where(overlap > 0)
    best = near.groupBy(finding).agg(F.max(F.struct(overlap.alias("score"), (-F.col(chunk)).alias("_o"))).alias("_b"))
    left = f.join(best, finding, "left_anti")
    # the nearest: before it the chunk with the greatest end, after it the one with the least start
    spots = c.select("file", F.col("_ce").alias("at"), F.lit(0).alias("order"), F.struct(F.col("_ce").alias("at"), (-F.col(chunk)).alias("_o")).alias("ended"), F.lit(None).cast(f"struct<at:int,_o:{dict(c.dtypes)[chunk]}>").alias("begun"))
    heads = c.select("file", F.col("_cs").alias("at"), F.lit(2).alias("order"), F.lit(None).cast(spots.schema["ended"].dataType).alias("ended"), F.struct((-F.col("_cs")).alias("at"), (-F.col(chunk)).alias("_o")).alias("begun"))
    asked = left.select("file", F.coalesce("_s", F.lit(-1_000_000_000)).alias("at"), F.lit(1).alias("order"), finding, "_s", "_e")
    rows = spots.unionByName(heads).unionByName(asked, allowMissingColumns=True)
    by_line = Window.partitionBy("file").orderBy("at", "order")
    rows = rows.withColumn("_before", F.max("ended").over(by_line.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.max("begun").over(by_line.rowsBetween(1, Window.unboundedFollowing)))
    first = c.groupBy("file").agg(F.min(chunk).alias("_first"))
    rows = rows.where("order = 1").join(first, "file", "left")
    before = F.struct((F.col("_before.at") - F.col("_s")).alias("score"), F.col("_before._o").alias("_o"))
    after = F.struct((F.col("_e") + F.col("_after.at")).alias("score"), F.col("_after._o").alias("_o"))
    nearest = F.when(F.col("_s").isNull(), F.struct(F.lit(0).alias("score"), (-F.col("_first")).alias("_o"))).otherwise(F.greatest(F.when(F.col("_before").isNotNull(), before), F.when(F.col("_after").isNotNull(), after)))
    best = best.unionByName(rows.select(finding, nearest.alias("_b")))
    return findings.join(best.select(finding, (-F.col("_b._o")).alias(chunk), F.col("_b.score").alias("overlap")), finding, "left")
