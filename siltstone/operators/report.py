"""Reports and summaries, the analyzer that explains findings, and what it is asked."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.lineage import settled
from siltstone.functions.text import safe_text
from siltstone.operators import validation

ANALYSIS = "finding_id long, error string, bug_type string, cause string, why_occurs string, solution_type string, solution string, replacement_code string, add_location string, explanation string, confidence string, unavailable boolean"
_FIELDS = "error bug_type cause why_occurs solution_type solution replacement_code add_location explanation confidence".split()


def unavailable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The analyzer without a model behind it: it explains nothing and invents nothing."""
    for frame in frames:
        yield pd.DataFrame([analysis_row(i, None) for i in frame.finding_id], columns=["finding_id", *_FIELDS, "unavailable"])


def analysis_row(finding_id: int, reply: dict | None) -> list:
    """An ANALYSIS row of a reply, or of none."""
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    if reply is None:
        return [finding_id, *([None] * (len(_FIELDS) - 1)), "0", True]
    return [finding_id, *(text(reply.get(k)) for k in _FIELDS), False]


def text_of_reply(value: object) -> str:
    """What a provider has said, as a text; anything else than a text is none."""
    return value.strip() if isinstance(value, str) else ""


def parsed_reply(text: str | None) -> dict | None:
    """A reply as an object with a cause and a solution, or null: fences go, and of other text the outermost braces count."""
    text = text_of_reply(text)
    text = text.removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict) and str(found.get("cause") or "").strip() and str(found.get("solution") or "").strip():
            return found
    return None


def analyzed(findings: DataFrame, analyzer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] = unavailable) -> DataFrame:
    """Findings through an analyzer: a function over frames with finding_id and prompt that gives ANALYSIS rows, columns that
    it leaves out being null; a row without cause or solution counts as unavailable."""
    columns = ["finding_id", *_FIELDS, "unavailable"]

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in analyzer(frames):
            out = frame.reindex(columns=columns)
            for c in _FIELDS:
                out[c] = out[c].map(lambda v: None if v is None or v != v else str(v)).astype(object)
            yield out

    rows = findings.select("finding_id", "prompt").mapInPandas(whole, ANALYSIS)
    blank = (safe_text(F.col("cause")) == "") | (safe_text(F.col("solution")) == "")
    return rows.withColumn("unavailable", F.coalesce("unavailable", F.lit(True)) | blank)


#: Kinds of artifacts that are history of the repository itself.
HISTORY = ["issue", "pull_request", "pr"]


def is_history(source: Column, artifact_type: Column) -> Column:
    """Whether a hit comes from the repository's own history and not from the knowledge base."""
    source, kind = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(artifact_type, F.lit("")))
    return source.rlike("github|issue|pull[ _]request") | kind.isin(HISTORY) | F.contains(kind, F.lit("github"))


def _or(value: Column, otherwise: str) -> Column:
    return F.coalesce(F.nullif(safe_text(value), F.lit("")), F.lit(otherwise))


def _percent(similarity: Column) -> Column:
    return F.format_string("%.1f%%", F.coalesce(similarity, F.lit(0.0)) * 100)


def prompt(file: Column, function: Column, first: Column, last: Column, rule: Column, bug_type: Column, error: Column, cause: Column, context: Column, code: Column, evidence: Column) -> Column:
    """What an analyzer is asked, about one finding alone. `evidence` is an array of structs (source, artifact_type, title,
    state, labels, url, similarity, body, comments, patch, description, solution); history is told apart from known bugs."""
    own, known = F.filter(evidence, lambda e: is_history(e["source"], e["artifact_type"])), F.filter(evidence, lambda e: ~is_history(e["source"], e["artifact_type"]))
    fields = lambda pairs: F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in pairs])
    bug = lambda e: fields([("Source", _or(e["source"], "-")), ("Similarity", _percent(e["similarity"])), ("Description", _or(e["description"], "-")), ("Solution", _or(e["solution"], "-"))])
    labels = lambda e: _or(F.array_join(e["labels"], ", "), "none")
    past = lambda e: fields([
        ("Kind", _or(e["artifact_type"], "artifact")), ("Title", _or(e["title"], "untitled")), ("State", _or(e["state"], "unknown")), ("Labels", labels(e)), ("Address", _or(e["url"], "-")),
        ("Similarity", _percent(e["similarity"])), ("Text", F.substring(_or(e["body"], "-"), 1, 4000)), ("Comments", F.substring(_or(e["comments"], "-"), 1, 3000)), ("Patch", F.substring(_or(e["patch"], "-"), 1, 5000)),
    ])
    listed = lambda items, of: _or(F.array_join(F.transform(items, of), "\n\n"), "none")
    there = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    finding = fields([("File", there(file)), ("Function", _or(function, "-")), ("Lines", F.concat(there(first), F.lit("-"), there(last))), ("Rule", there(rule)), ("Type", there(bug_type)), ("Error", there(error)), ("Cause", there(cause))])
    parts = [("FINDING", finding), ("CODE", F.coalesce(context, F.lit(""))), ("REPORTED CODE", F.coalesce(code, F.lit(""))), ("KNOWN BUGS", listed(known, bug)), ("HISTORY", listed(own, past)), ("ANSWER", F.lit("One JSON object with: " + ", ".join(_FIELDS) + ". replacement_code holds code alone."))]
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"## {k}\n"), v) for k, v in parts])


def rotated(keys: DataFrame, start: int) -> DataFrame:
    """Keys (provider, number, value) in the order of use: duplicates gone, providers taken in turn by number, begun at
    `start`. A turn's keys are ranked on their own and the turns' sizes summed, so no task sees all keys."""
    once = keys.groupBy("provider", "value").agg(F.min("number").alias("number"))
    turn = once.withColumn("turn", F.row_number().over(Window.partitionBy("provider").orderBy("number")))
    before = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turn.groupBy("turn").agg(F.count("*").alias("_n")).select("turn", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    total = turn.agg(F.count("*").alias("_total"))  # one row
    placed = turn.withColumn("_k", F.row_number().over(Window.partitionBy("turn").orderBy("provider")) - 1).join(turns, "turn").join(F.broadcast(total), F.lit(True))
    return placed.select("provider", "number", "value", F.pmod(F.col("_base") + F.col("_k") - start, F.col("_total")).cast("int").alias("use"))


def _title(kind: Column) -> Column:
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def evidence_text(description: Column, title: Column, number: Column, kind: Column, body: Column | None = None) -> Column:
    """Description of a hit: an artifact's from its kind, number, title and text."""
    return F.coalesce(description, F.concat_ws(" - ", _title(kind), F.concat(F.lit("#"), number.cast("string")), F.nullif(title, F.lit("")), F.nullif(body, F.lit("")) if body is not None else F.lit(None).cast("string")))


def evidence(hit: Column) -> Column:
    """A hit as evidence of a report: of the names that a record's fields go by, the first that is there. Half-even rounding."""
    h = lambda *names: F.coalesce(*[F.nullif(hit[n], F.lit("")) for n in names])
    history = hit["source_type"] != "dataset"
    kind = F.coalesce(hit["artifact_type"], F.lit("artifact"))
    patch = h("patch", "diff")
    return F.struct(
        F.when(history, F.concat(F.lit("History "), _title(kind))).otherwise(F.coalesce(hit["dataset_source"], F.lit("Historical Dataset"))).alias("dataset_source"),
        F.when(history, kind).otherwise(hit["bug_type"]).alias("bug_type"),
        F.when(history, evidence_text(F.lit(None).cast("string"), hit["title"], hit["number"], kind, hit["body"])).otherwise(hit["bug_description"]).alias("bug_description"),
        F.when(history, F.substring(patch, 1, 5000)).otherwise(hit["solution"]).alias("solution"),
        (F.bround(hit["similarity"] * 1000, 0) / 10).alias("similarity"),
        h("file", "filename", "path").alias("historical_file"),
        F.when(~history, h("code", "buggy_code")).alias("historical_code"),
        F.when(history, F.substring(patch, 1, 10_000)).otherwise(patch).alias("historical_patch"),
        F.when(history, kind).otherwise(F.coalesce(hit["artifact_type"], F.lit("dataset"))).alias("artifact_type"),
        F.when(history, hit["number"]).alias("artifact_number"),
        F.when(history, F.nullif(hit["title"], F.lit(""))).alias("artifact_title"),
        F.when(history, h("url", "html_url")).alias("artifact_url"),
        F.when(history, hit["state"]).alias("artifact_state"),
        F.nullif(hit["body"], F.lit("")).alias("evidence"),
    )


def normalised(analysis: DataFrame) -> DataFrame:
    """Analyses joined to their findings (found_type, found_error, detector_code, own_repair, context, current_code) as fixes:
    type from the list, a replacement ensured, confidence as a number. Unavailable ones keep the deterministic repair, else
    the reported code, and explain nothing."""
    from siltstone.operators.repair import ensured

    gone = F.col("unavailable")
    fix = ensured(F.col("detector_code"), F.when(~gone, F.col("replacement_code")), F.col("own_repair"), F.when(gone, F.col("current_code")).otherwise(F.col("context")))
    rows = analysis.withColumn("_f", fix)
    sure = validation.confidence(F.col("confidence"))
    kept = [c for c in rows.columns if c not in ("_f", "error", "bug_type", "replacement_code", "confidence", "solution_type", "insufficient", "confidence_level")]
    return rows.select(
        *kept,
        F.coalesce(F.when(~gone, F.col("error")), F.col("found_error"), F.lit("Detected issue")).alias("error"),
        validation.bug_type(F.when(~gone, F.col("bug_type")), F.col("found_type")).alias("bug_type"),
        F.col("_f.code").alias("replacement_code"),
        F.when(F.col("_f.origin") == "analyzer", F.col("solution_type")).otherwise("replace").alias("solution_type"),
        F.when(gone, 0).otherwise(sure).alias("confidence"),
        (gone | F.col("_f.insufficient")).alias("insufficient"),
        F.when(~gone & (sure >= validation.HIGH) & ~F.col("_f.insufficient"), "High").otherwise("Low").alias("confidence_level"),
    )


def reports(fixes: DataFrame) -> DataFrame:
    """Validated fixes as report rows. Unreachable code is a type of its own; a finding without a line says so; the source is
    the detector's own, else the rule."""
    note = F.when(F.col("line_start").isNull(), F.lit("The exact line is unknown."))
    return fixes.withColumns({
        "bug_type": F.when(F.col("rule") == "unreachable_code", "Unreachable Code").otherwise(F.col("bug_type")),
        "line_note": note,
        "detection_source": F.coalesce(F.nullif(F.col("detection_source"), F.lit("")), F.col("rule")),
        "fix_validated": F.coalesce(F.col("validation_status") == "valid", F.lit(False)),
    })


def numbered(reports: DataFrame, *order: str, partitions: int = 64) -> DataFrame:
    """Reports with `number` from 1 in order. Ranges of the order are counted and ranked each on its own, so no task sees
    all rows."""
    # ranges are drawn by sampling, so they are settled before they are used twice
    ranged = settled(reports.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()))
    ranked = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranked.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return ranked.join(F.broadcast(bases), "_part").withColumn("number", F.col("_base") + F.col("_k")).drop("_part", "_k", "_base")


def summary(reports: DataFrame, *by: str) -> DataFrame:
    """Counts, mean confidence (half-even; 100 without reports), levels of errors and confidence, by the given columns."""
    mean = F.coalesce(F.bround(F.avg("confidence")), F.lit(100)).cast("int")
    rows = reports.groupBy(*by).agg(F.count("*").alias("bugs"), mean.alias("confidence"), F.coalesce(F.max("unavailable"), F.lit(False)).alias("any_unavailable"))
    return rows.withColumn("error_level", error_level(F.col("bugs"))).withColumn("confidence_level", F.when(F.col("confidence") >= 70, "High").otherwise("Low"))


def error_level(bugs: Column) -> Column:
    return F.when(bugs <= 10, "Less Errors").when(bugs <= 30, "Medium Errors").otherwise("More Errors")
