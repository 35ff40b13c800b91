"""Knowledge base of known bugs: loaders and normalisers, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import let, present, safe_text

RECORD = "id string, dataset_source string, language string, buggy_code string, fixed_code string, error string, bug_type string, bug_description string, solution string, repository string, file string, metadata map<string,string>"


def described(bug_type: Column, error: Column, lang: Column) -> Column:
    """A description for a record without one."""
    name = F.coalesce(present(lang), F.lit("code"))
    kind, why = present(bug_type), present(error)
    return (
        F.when(kind.isNotNull() & why.isNotNull(), F.concat(name, F.lit(" "), F.lower(kind), F.lit(": "), why))
        .when(kind.isNotNull(), F.concat(name, F.lit(" "), F.lower(kind)))
        .when(why.isNotNull(), F.concat(name, F.lit(" bug: "), why))
        .otherwise(F.concat(name, F.lit(" bug")))
    )


def complete(records: DataFrame) -> DataFrame:
    """Records with buggy code, each with a description."""
    return records.where(present(F.col("buggy_code")).isNotNull()).withColumn("bug_description", F.coalesce(present(F.col("bug_description")), described(F.col("bug_type"), F.col("error"), F.col("language"))))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Records of all JSON Lines files of a folder; broken and blank lines are skipped. The file's stem is the source that a
    record goes by (`dataset_source`); the record's own stays in `original_source`."""
    rows = spark.read.schema(RECORD + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", "")
    rows = rows.withColumn("original_source", F.col("dataset_source")).withColumn("dataset_source", stem)
    return complete(rows.where(F.col("_corrupt").isNull()).drop("_corrupt"))


def save(records: DataFrame, path: str) -> None:
    """Records as JSON, one a line, in parts that Spark commits together; `load` reads them again."""
    records.write.mode("overwrite").option("compression", "none").json(path)


def pairs(rows: DataFrame, order: str, prefix: str, buggy: str, fixed: str, lang: str) -> DataFrame:
    """Records from a table of code pairs; both sides must be there, the id keeps the row's place in the source."""
    ok = present(F.col(buggy)).isNotNull() & present(F.col(fixed)).isNotNull()
    return rows.where(ok).select(F.concat(F.lit(f"{prefix}_"), F.col(order)).alias("id"), F.lit(prefix).alias("dataset_source"), F.lit(lang).alias("language"), safe_text(F.col(buggy)).alias("buggy_code"), safe_text(F.col(fixed)).alias("fixed_code"))


def capped_pairs(rows: DataFrame, order: str, languages: list[str], most: int = 2000) -> DataFrame:
    """Records of a table of runs (language, buggy_code or source_code, fixed_code or target_code, error_message or stderr,
    error_class or exception_type): of each of the languages the first `most` whose both sides are there. The id keeps the
    row's place in the source."""
    either = lambda *names: F.coalesce(*[present(F.col(n)) for n in names])
    lang = F.lower(F.coalesce("language", F.lit("")))
    made = rows.select(
        F.col(order).alias("_order"), F.concat(F.lit("runbugrun_"), F.col(order)).alias("id"), F.lit("RunBugRun").alias("dataset_source"), lang.alias("language"),
        safe_text(either("buggy_code", "source_code")).alias("buggy_code"), safe_text(either("fixed_code", "target_code")).alias("fixed_code"), either("error_message", "stderr").alias("error"), either("error_class", "exception_type").alias("bug_type"),
    )
    usable = made.where(F.col("language").isin(languages) & (F.col("buggy_code") != "") & (F.col("fixed_code") != ""))
    return first_per_group(usable, "language", "_order", most).drop("_order")


def per_language(records: DataFrame) -> DataFrame:
    return records.groupBy("language").agg(F.count("*").alias("written"))


def patch_folder(spark: SparkSession, root: str) -> DataFrame:
    """Records from a folder tree projects/<project>/bugs/<bug>/ with a bug_patch.txt and perhaps a bug_info.txt each. Bugs
    whose patch changes no line are left out; what the info file says goes to the metadata."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "bug_*.txt").text(root, wholetext=True)
    parts = F.split(F.regexp_replace(F.col("_metadata.file_path"), "/+", "/"), "/")
    at = lambda n: F.try_element_at(parts, F.lit(n))
    rows = texts.select(F.col("value"), at(-1).alias("name"), at(-2).alias("bug"), at(-3).alias("folder"), at(-4).alias("project")).where("folder = 'bugs'")
    patch = rows.where("name = 'bug_patch.txt'").select("project", "bug", patch_side(F.col("value"), "-").alias("buggy_code"), patch_side(F.col("value"), "+").alias("fixed_code"))
    about = rows.where("name = 'bug_info.txt'").select("project", "bug", info(F.col("value")).alias("_info"))
    told = F.coalesce(F.nullif(F.col("_info")["bug_report"], F.lit("")), F.nullif(F.col("_info")["BugReport"], F.lit("")))
    empty = F.create_map().cast("map<string,string>")
    # an entry of the info file of the same name wins, as it is told last
    own = F.map_filter(F.create_map(F.lit("bug_id"), F.col("bug")), lambda k, _: ~F.coalesce(F.map_contains_key("_info", k), F.lit(False)))
    joined = patch.where("buggy_code <> '' OR fixed_code <> ''").join(about, ["project", "bug"], "left")
    return joined.select(F.concat(F.lit("bugsinpy_"), "project", F.lit("_"), "bug").alias("id"), F.lit("BugsInPy").alias("dataset_source"), F.lit("python").alias("language"), "buggy_code", "fixed_code", told.alias("bug_description"), F.col("project").alias("repository"), F.map_concat(own, F.coalesce("_info", empty)).alias("metadata"))


def first_per_group(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first rows of each group in source order; Spark cuts each partition before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_k") <= most).drop("_k")


def patch_side(patch: Column, sign: str) -> Column:
    """The lines a patch removes (`-`) or adds (`+`), without their sign; the file headers are no such lines."""
    mine = F.filter(F.split(patch, "\n", -1), lambda x: x.startswith(sign) & ~x.startswith(sign * 3))
    return safe_text(F.array_join(F.transform(mine, lambda x: F.substr(x, F.lit(2))), "\n"))


def info(text: Column) -> Column:
    """Map of `key=value` lines; the first `=` splits, blanks and double quotes around the value go. Of a repeated key the
    last value counts."""
    rows = F.filter(F.split(text, "\n", -1), lambda x: F.contains(x, F.lit("=")))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.regexp_replace(F.trim(F.substr(x, F.instr(x, F.lit("=")) + 1)), r'^"+|"+$', "").alias("v"))
    entries = F.transform(rows, entry)
    # Sorted by key and then from the last line on, the first entry of each key counts; no entry looks at all others.
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), (-i).alias("i"), e["v"].alias("v"))))
    pairs = lambda p: F.filter(p, lambda e, i: (i == 0) | (F.try_element_at(p, F.greatest(i, F.lit(1)))["k"] != e["k"]))
    return F.map_from_entries(F.transform(let(placed, pairs), lambda e: F.struct(e["k"], e["v"])))
