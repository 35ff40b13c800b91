"""Issues and pull requests of a repository, as artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import labelled, safe_text

MOST, MOST_COMMENTS, PATCH_CHARS = 30, 20, 30_000


def issues(rows: DataFrame, repo: str = "repo", most: int = MOST) -> DataFrame:
    """The latest updated issues of each repository (ties: the larger number); rows that are pull requests do not count."""
    order = Window.partitionBy(repo).orderBy(F.desc("updated_at"), F.desc("number"))
    return rows.where(~F.coalesce("is_pull_request", F.lit(False))).withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def pull_requests(rows: DataFrame, repo: str = "repo", most: int = MOST) -> DataFrame:
    """The latest updated pull requests of each repository, merged ones first, then by time of update, oldest first."""
    latest = Window.partitionBy(repo).orderBy(F.desc("updated_at"), F.desc("number"))
    final = Window.partitionBy(repo).orderBy(F.col("merged_at").isNull(), F.coalesce("updated_at", F.lit("")), "number")
    kept = rows.withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= most).drop("_k")
    return kept.withColumn("merged", F.col("merged_at").isNotNull()).withColumn("patch", F.substring("patch", 1, PATCH_CHARS)).withColumn("position", F.row_number().over(final))


def artifacts(issue_rows: DataFrame, request_rows: DataFrame) -> DataFrame:
    """Both kinds in one table; columns that one lacks are null."""
    return issue_rows.unionByName(request_rows, allowMissingColumns=True)


def normalised(rows: DataFrame, kind: str) -> DataFrame:
    """Items of a host's listing, as they come in JSON (number, title, body, state, labels: structs with a name, comments: texts,
    html_url, created_at, updated_at, merged_at, patch), as artifacts: texts trimmed, names of labels alone, at most 20
    comments, and `text`, what they are searched by."""
    text = lambda c: safe_text(F.col(c)).alias(c)
    names = F.filter(F.transform("labels", lambda x: x["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    said = F.slice(F.filter(F.transform("comments", safe_text), lambda c: c != ""), 1, MOST_COMMENTS)
    extra = [] if kind == "issue" else ["merged_at", F.col("merged_at").isNotNull().alias("merged"), F.substring("patch", 1, PATCH_CHARS).alias("patch")]
    out = rows.select("repo", F.lit(f"github_{kind}").alias("source"), F.lit(kind).alias("artifact_type"), "number", text("title"), text("body"), text("state"), F.coalesce(names, F.array()).alias("labels"), F.coalesce(said, F.array()).alias("comments"), F.col("html_url").alias("url"), "created_at", "updated_at", *extra)
    patch = F.col("patch") if kind != "issue" else F.lit(None).cast("string")
    return out.withColumn("text", source_text(F.col("title"), F.col("body"), F.col("state"), F.col("comments"), patch, F.col("labels")))


def source_text(title: Column, body: Column, state: Column, comments: Column, patch: Column, labels: Column) -> Column:
    """An artifact as labelled lines, those that there are; comments one below the other, labels in one line."""
    return labelled([("Title: ", title), ("Description: ", body), ("State: ", state), ("Comments: ", F.array_join(comments, "\n")), ("Patch: ", patch), ("Labels: ", F.array_join(labels, ", "))])


def artifact_text(kind: Column, number: Column, title: Column, state: Column, labels: Column, body: Column, comments: Column, patch: Column, source: Column | None = None, text: Column | None = None) -> Column:
    """What an artifact is embedded by; labels and comments are arrays. One that has none of the fields goes by its `text`."""
    none = F.lit(None).cast("string")
    lines = labelled([
        ("Source: ", source if source is not None else none), ("Artifact type: ", kind), ("Number: ", number.cast("string")), ("Title: ", title), ("State: ", state), ("Labels: ", F.array_join(labels, "\n")),
        ("Description: ", body), ("Comments: ", F.array_join(F.slice(comments, 1, MOST_COMMENTS), "\n")), ("Previous fix / patch:\n", F.substring(patch, 1, 12_000)),
    ])
    return F.when(lines != "", lines).otherwise(safe_text(text if text is not None else none))
