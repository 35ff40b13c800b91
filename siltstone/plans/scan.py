"""The whole scan as one plan: files to reports.

detect -> chunk of each finding -> similar records and history -> prompt -> analyzer -> repair -> validation -> report rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.lineage import settled
from siltstone.functions.text import code_context, described_chunk, extension, labelled_query, language, safe_text
from siltstone.operators import brackets, chunks, repair, report, retrieval, rules, validation

_HIT = "source_type dataset_source source artifact_type bug_type bug_description description solution file filename path code buggy_code patch diff title state labels url html_url body comments number".split()


_FOUND = ["line_start", "rule", "bug_type", "current_code", "detail", "chunk_type", "name", "parent", "chunk_start", "chunk_end", "code"]
_FOUND_TYPE = pa.struct([(c, pa.int32() if c in ("line_start", "chunk_start", "chunk_end") else pa.string()) for c in _FOUND])
_FOUND_SQL = f"struct<{', '.join(f'{c}: {"int" if c in ("line_start", "chunk_start", "chunk_end") else "string"}' for c in _FOUND)}>"


def _with_chunk(shape: brackets.Shape, asked: list) -> list[tuple]:
    """The findings of a file, each with the chunk that it stands in; a file without findings is not cut."""
    found = rules.file_findings(shape, asked)
    parts = chunks.file_chunks(shape) if found else []
    return [(*f, *(chunks.chunk_at(parts, f[0]) or (None,) * 6)) for f in found]


def numbered_findings(files: DataFrame, key: tuple[str, ...], rule_table: DataFrame | None = None) -> DataFrame:
    """Findings of the files (keys, source) with their chunk: finding_id, the keys, line_start, rule, bug_type, error,
    current_code, context (the chunk as a text), code (as in the file), line (the reported line's number in it).

    Detection and chunks come from one pass over each file; what leaves it are the findings with the code of their chunk."""
    found = rules.examined(files, rule_table, key, True, _with_chunk, _FOUND_TYPE, _FOUND_SQL).select(*key, F.explode("f").alias("f")).select(*key, "f.*")
    found = settled(found.withColumn("finding_id", F.monotonically_increasing_id()))
    context = described_chunk(F.col("file"), language(F.col("file")), *[F.col(c) for c in ("chunk_type", "name", "parent", "chunk_start", "chunk_end")], safe_text(F.col("code")))
    found = found.withColumn("error", F.concat_ws(": ", F.col("rule"), F.nullif(F.col("detail"), F.lit("")))).withColumn("context", F.when(F.col("code").isNotNull(), context))
    return found.drop("parent").withColumn("line", validation.reported_line(F.col("code"), F.col("line_start"), F.col("chunk_start"), F.col("current_code")))


def scan(files: DataFrame, records: DataFrame, artifacts: DataFrame, analyzer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] = report.unavailable, encode: Callable[[Column], Column] = retrieval.hashed_vector) -> DataFrame:
    """Report rows of the files (repo, file, source), with the evidence of each: records (id, embedding and fields of a known
    bug), artifacts (repo, number, embedding and fields of the history); fields that a table lacks are null."""
    found = settled(numbered_findings(files, ("repo", "file")))
    text = labelled_query(*[F.col(c) for c in ("file", "bug_type", "rule", "error")], F.lit(None).cast("string"), F.col("current_code"))
    hits = retrieval.retrieved(found.select("finding_id", "repo", text.alias("query")), records, artifacts, encode=encode)

    def fields(table: DataFrame, kind: str, source_ord: int, repo: Column, hit: str) -> DataFrame:
        have = set(table.columns)
        none = {"number": "bigint", "labels": "array<string>", "comments": "string"}
        one = lambda c: F.array_join(c, "\n") if c in have and dict(table.dtypes)[c].startswith("array") and c == "comments" else F.col(c)
        row = F.struct(*[F.lit(kind).alias(c) if c == "source_type" else one(c).cast(none.get(c, "string")).alias(c) if c in have else F.lit(None).cast(none.get(c, "string")).alias(c) for c in _HIT])
        return table.select(F.lit(source_ord).alias("source_ord"), repo.cast("string").alias("_repo"), F.col(hit).cast("long").alias("hit"), row.alias("_hit"))

    # what may be hit, in one table, so that hits of both kinds find their fields by one join
    known = fields(records, "dataset", 0, F.lit(""), "id").unionByName(fields(artifacts, "github", 1, F.coalesce(F.col("repo").cast("string"), F.lit("")), "number"))
    of_finding = found.select(F.col("finding_id").alias("query_id"), F.coalesce(F.col("repo").cast("string"), F.lit("")).alias("_of"))
    asked = hits.join(of_finding, "query_id").withColumn("_repo", F.when(F.col("source_ord") == 1, F.col("_of")).otherwise("")).drop("_of")
    every = asked.join(known, ["source_ord", "_repo", "hit"]).select("query_id", F.struct("position", F.struct("similarity", "_hit.*").alias("h")).alias("_e"))
    evidence = every.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["h"]).alias("hits"))
    rows = found.join(evidence.withColumnRenamed("query_id", "finding_id"), "finding_id", "left")
    rows = rows.withColumn("hits", F.coalesce("hits", F.array().cast(evidence.schema["hits"].dataType)))
    ask = report.prompt(*[F.col(c) for c in ("file", "name", "line_start", "line_start", "rule", "bug_type", "error")], F.lit(None).cast("string"), code_context(F.col("context"), F.col("code"), F.col("current_code")), F.col("current_code"), F.col("hits"))
    rows = settled(rows.withColumn("prompt", ask))
    own = repair.repaired(F.col("rule"), F.col("code"), extension(F.col("file")), F.col("line"))
    about = rows.withColumn("own_repair", own).select("finding_id", "repo", "file", "line_start", "rule", "current_code", "code", "context", "line", "own_repair", "hits", F.col("name").alias("function"), F.col("bug_type").alias("found_type"), F.col("error").alias("found_error"), F.lit(None).cast("string").alias("detector_code"), F.lit(None).cast("string").alias("detection_source"))
    fixes = report.normalised(report.analyzed(rows, analyzer).join(about, "finding_id"))
    judged = validation.validated(fixes)
    return report.reports(judged).withColumn("retrieved", F.transform("hits", report.evidence)).drop("hits", "detector_code", "own_repair", "found_type", "found_error", "context")
