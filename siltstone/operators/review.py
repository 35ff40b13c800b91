"""External review of whole files in languages without detectors: a reviewer's replies become findings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import clean_json_fence, extension, language, safe_text
from siltstone.operators import validation
from siltstone.operators.rules import DISPATCHED

_ROW = "array<struct<error: string, bug_type: string, line_start: string, line_end: string, current_code: string, cause: string, function: string>>"


def silent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The reviewer without a model behind it: it finds nothing."""
    for frame in frames:
        yield frame.assign(reply="[]")[["row", "reply"]]


def reviewed(files: DataFrame, reviewer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] = silent, every: bool = False) -> DataFrame:
    """file, line_start, line_end, rule, bug_type, error, cause, function, current_code of files that no detector reads, or of
    `every` file. A reviewer is a function over frames with row, language and source that gives row and reply: a JSON array,
    in a code fence or not. Rows without an error, and replies that are no such array, give nothing; numbers of lines are
    read from texts, types outside the list become Other. Repeated files are reviewed each; null sources are empty."""
    rows = files.select(F.monotonically_increasing_id().alias("row"), "file", language(F.col("file")).alias("language"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    if not every:
        rows = rows.where(~F.coalesce(extension(F.col("file")).isin(DISPATCHED), F.lit(False)))
    # the file's name goes through the reviewer with its row, so that nothing has to be joined back
    carried = rows.select(F.to_json(F.struct("row", "file")).alias("row"), "language", "source")
    said = carried.mapInPandas(reviewer, "row string, reply string").where("reply IS NOT NULL")
    found = said.select(F.get_json_object("row", "$.file").alias("file"), F.explode(F.from_json(clean_json_fence(F.col("reply")), _ROW)).alias("f")).select("file", "f.*")
    line = F.col("line_start").try_cast("double").cast("int")
    last = F.col("line_end").try_cast("double").cast("int")
    return found.where(safe_text(F.col("error")) != "").select(
        "file", line.alias("line_start"), F.coalesce(last, line).alias("line_end"), F.lit("llm_file_analysis").alias("rule"), validation.bug_type(F.col("bug_type"), F.lit("Other")).alias("bug_type"),
        safe_text(F.col("error")).alias("error"), F.coalesce("cause", F.lit("")).alias("cause"), "function", F.coalesce("current_code", F.lit("")).alias("current_code"),
    )
