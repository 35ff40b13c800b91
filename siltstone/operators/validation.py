"""Validation of proposed fixes and confidence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from siltstone.functions.text import balance, by_kind, let, validated_language
from siltstone.operators.repair import REMOVED, without_line

#: Other names of the three actions; allowed bug types.
ACTIONS = {"replace": "replace replacement replace_code", "remove": "remove delete remove_code", "add": "add insertion insert add_code"}
BUG_TYPES = ["Runtime Error", "Logic Error", "Syntax Error", "Type Error", "Dependency Error", "Security Issue", "Performance Issue", "API Error", "Unnecessary Code", "Other"]
HIGH, LOW = 70, 59


def action(value: Column, rule: Column) -> Column:
    """replace, remove or add; without a known name the rule decides."""
    name = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    known = F.lit(None).cast("string")
    for to, names in ACTIONS.items():
        known = F.when(name.isin(names.split()), to).otherwise(known)
    return F.coalesce(known, F.when(F.lower(F.coalesce(rule, F.lit(""))).isin(REMOVED), "remove").otherwise("replace"))


def bug_type(value: Column, fallback: Column) -> Column:
    return F.when(value.isin(BUG_TYPES), value).otherwise(F.coalesce(fallback, F.lit("Other")))


def confidence(value: Column) -> Column:
    """0 to 100; 70 if it is no whole number."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(value.try_cast("int"), F.lit(HIGH))))


@F.pandas_udf(BooleanType())
def python_compiles(code: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def ok(text: str | None) -> bool:
        try:
            compile(text or "", "file", "exec")
            return True
        except (SyntaxError, ValueError, RecursionError):
            return False

    for batch in code:
        yield batch.map(ok).astype(bool)


def fault(file: Column, code: Column) -> Column:
    """What is wrong with code in its file's language, or null: Python must compile, of others the structure is looked at.
    No compiler of another language is started."""
    python = F.coalesce(validated_language(file) == "python", F.lit(False))
    return F.when(python, F.when(~python_compiles(F.when(python, code)), F.lit("does not compile"))).otherwise(by_kind(file, lambda k: balance(code, k)))


def method(file: Column) -> Column:
    return F.when(validated_language(file) == "python", "parser").otherwise("structure")


def reported_line(code: Column, line: Column, first: Column, current: Column) -> Column:
    """Number within the code of the reported line: by its place in the chunk, else where its text, of one line or several,
    stands first; null if neither."""
    wanted = F.transform(F.split(F.trim(current), "\n", -1), lambda x: F.trim(x))

    def find(lines: Column) -> Column:
        place = line - first + 1
        n = F.size(wanted)
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines) - n + 1, F.lit(1))), lambda i: F.slice(lines, i, n) == wanted)
        return F.coalesce(F.when((place >= 1) & (place <= F.size(lines)), place), F.when(F.trim(current) != "", F.try_element_at(at, F.lit(1))))

    return let(F.transform(F.split(code, "\n", -1), lambda x: F.trim(x)), find)


def message(kind: Column, file: Column, original: Column, replacement: Column, location: Column, line: Column) -> Column:
    """What is wrong with a fix, or null: by its action. A removal that leaves nothing is no fault of structure."""
    text, there = F.trim(F.coalesce(replacement, F.lit(""))), F.trim(F.coalesce(original, F.lit("")))
    left = without_line(original, line)
    wrong = fault(file, F.when(kind == "remove", left).otherwise(replacement))
    return (
        F.when(kind == "remove", F.when(there == "", F.lit("no original code")).when(line.isNull(), F.lit("reported line not found")).when(F.trim(left) != "", wrong))
        .when(text == "", F.lit("no replacement code"))
        .when(kind == "add", F.when(F.trim(F.coalesce(location, F.lit(""))) == "", F.lit("no location")).otherwise(wrong))
        .otherwise(F.when(text == there, F.lit("replacement equals the original")).otherwise(wrong))
    )


#: What a fix says when its analysis says nothing, by action.
DEFAULT_SOLUTIONS = {"remove": "Remove the reported line.", "add": "Add the code below at the given place.", "replace": "Put the code below in place of the reported code."}


def applied(wrong: Column, score: Column, insufficient: Column) -> Column:
    """struct(status, confidence, level, standing, insufficient) after validation: a valid fix counts 70 at least and is High
    if it did so before and rests on enough evidence; an invalid one counts 59 at most."""
    sure, valid = confidence(score), wrong.isNull()
    high = valid & (sure >= HIGH) & ~insufficient
    return F.struct(
        F.when(valid, "valid").otherwise("invalid").alias("status"),
        F.when(valid, F.greatest(sure, F.lit(HIGH))).otherwise(F.least(sure, F.lit(LOW))).alias("confidence"),
        F.when(high, "High").otherwise("Low").alias("level"),
        F.when(high, "Potential Bug").otherwise("Uncertain Finding").alias("standing"),
        (insufficient | ~valid).alias("insufficient"),
    )


def validated(fixes: DataFrame) -> DataFrame:
    """Fixes (file, rule, code, solution_type, replacement_code, add_location, solution, confidence, insufficient, line) with
    their action, validation message, method, language, corrected code and confidence. Unavailable ones pass as they are."""
    kind, insufficient = action(F.col("solution_type"), F.col("rule")), F.coalesce("insufficient", F.lit(False))
    rows = fixes.withColumn("solution_type", kind)
    wrong = message(F.col("solution_type"), F.col("file"), F.col("code"), F.col("replacement_code"), F.col("add_location"), F.col("line"))
    lacking = F.when(F.col("solution_type") == "remove", F.col("line").isNull()).otherwise((F.trim(F.coalesce("replacement_code", F.lit(""))) == "") | ((F.col("solution_type") == "add") & (F.trim(F.coalesce("add_location", F.lit(""))) == "")))
    rows = rows.withColumn("validation_message", F.when(~F.col("unavailable"), wrong))
    rows = rows.withColumn("_a", applied(F.col("validation_message"), F.col("confidence").cast("string"), insufficient | lacking))
    default = F.create_map(*[F.lit(x) for pair in DEFAULT_SOLUTIONS.items() for x in pair])[F.col("solution_type")]
    kept = [c for c in rows.columns if c not in ("confidence", "insufficient", "solution", "replacement_code", "_a")]
    skipped = F.col("unavailable")
    return rows.select(
        *kept,
        F.when(skipped, F.col("confidence").cast("int")).otherwise(F.col("_a.confidence")).alias("confidence"),
        F.when(skipped, "Low").otherwise(F.col("_a.level")).alias("confidence_level"),
        F.when(skipped, "Uncertain Finding").otherwise(F.col("_a.standing")).alias("confidence_status"),
        F.when(skipped, True).otherwise(F.col("_a.insufficient")).alias("insufficient"),
        F.when(~skipped, F.col("_a.status")).alias("validation_status"),
        F.when(~skipped, F.concat("solution_type", F.lit(" + "), method(F.col("file")))).alias("validation_method"),
        F.when(~skipped, validated_language(F.col("file"))).alias("validation_language"),
        F.when((F.col("solution_type") == "remove") & F.col("line").isNotNull(), F.lit("")).otherwise(F.col("replacement_code")).alias("replacement_code"),
        F.when(skipped | (F.trim(F.coalesce("solution", F.lit(""))) != ""), F.col("solution")).otherwise(default).alias("solution"),
    )
