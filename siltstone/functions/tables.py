"""Table functions for SQL: findings and chunks of a table of files.

    tables.register(spark)
    SELECT * FROM file_findings(TABLE(SELECT repo, file, source FROM files))
    SELECT * FROM file_chunks(TABLE(SELECT repo, file, source FROM files))

Batches of files go in and rows come out, as in the DataFrame operators; the table must have repo, file and source, further
columns are not read. Nulls: a null source is an empty file, a null name one without an extension; neither gives rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from siltstone.operators import chunks, rules
from siltstone.operators.brackets import Shape, each_once

FINDINGS = "repo string, file string, line_start int, rule string, bug_type string, current_code string, detail string"
CHUNKS = "repo string, file string, chunk_type string, name string, parent string, line_start int, line_end int, code string"
_TABLE = {}
for _rule, _kind, _exts, _pattern in rules.RULES:
    for _ext in _exts.split():
        _TABLE.setdefault(_ext, []).append((_rule, _kind, _pattern))


def _rows(batch: pa.RecordBatch, kinds: str, look: Callable[[Shape], list[tuple]]) -> Iterator[pa.Table]:
    names, types = zip(*(c.split() for c in kinds.split(", ")), strict=True)
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in zip(names, types, strict=True)])
    columns = [batch.column(c).to_pylist() for c in ("repo", "file", "source")]
    dots = [(file or "").rpartition("/")[2].lower() for file in columns[1]]
    texts = [(source or "", dot[dot.rindex(".") :] if "." in dot[1:] else "") for source, dot in zip(columns[2], dots, strict=True)]
    found = each_once(lambda source, ext: look(Shape(source, ext)), texts)
    out = [(repo, file, *r) for repo, file, rows in zip(*columns[:2], found, strict=True) for r in rows]
    yield pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)


@arrow_udtf(returnType=FINDINGS)
class FileFindings:
    """The library's own rules, for every extension that it knows."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        yield from _rows(batch, FINDINGS, lambda shape: rules.file_findings(shape, _TABLE.get(shape.ext, [])))


@arrow_udtf(returnType=CHUNKS)
class FileChunks:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        yield from _rows(batch, CHUNKS, chunks.file_chunks)


def register(spark: SparkSession) -> None:
    spark.udtf.register("file_findings", FileFindings)
    spark.udtf.register("file_chunks", FileChunks)
