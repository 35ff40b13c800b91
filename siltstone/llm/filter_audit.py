"""Filter interaction audit: what each filter removes, in every order of the filters, by relations of failing ids.

One pass over the texts decides the filters that look at a text alone; equal texts are found by a partial aggregation of
their digests. Each filter then gets one stored table of the rows that fail it (row number, part, label marks). No text
and no row that passes everything goes further. What filter f removes after the filters S is

    fails(f)  LEFT ANTI  fails(g)  for each g in S

and all 16 sets S are answered together: for each filter g, the left semi join with fails(g) passes on the failing rows
that g meets, marked with g, and the left anti join passes on the others. A row that f fails and that the filters M meet
too is removed by f after every S without a member of M, and redundant after every other S. From the counts by part follow
removed, redundant, unique_fails (M is empty), kept (the part's rows less what is removed so far), the label losses (the
relations carry the marks of their rows) and the Shapley sum (each set times the orders in which it occurs).

Hot keys: a text with many copies is one row after partial aggregation, and its rows are looked up by a checked broadcast;
failing rows are joined by their row numbers, which are unique; parts are summed partially first.

Nulls: a null text is empty, a null source is the empty string, a row with a null doc_id is no copy of anything, bears no
labels and makes no other row a copy. Repeated rows count each; rows of one doc_id and text are no copies of each other,
since none has the smaller id. A document is good (toxic) if any label row of its id says 1. Ties do not arise. Very long
texts are one row of the first pass. An empty table has no parts and gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import common

FILTERS = "ABCDE"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that look at a text alone; the text is not null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    upper = F.char_length(text) - F.char_length(F.translate(text, common.UPPER, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * upper > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def documents_judged(docs: DataFrame) -> DataFrame:
    """Settled rows: _row, doc_id, part and `failing`, the letters of the filters that the row fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    alone = F.concat(*(F.when(fails, f).otherwise("") for f, fails in text_filters(F.col("_text")).items()))
    # Rows are numbered once and settled: all that follows must see the same numbers.
    once = common.settle(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "part", F.sha2("_text", 256).alias("_digest"), alone.alias("failing")))
    texts = once.where("doc_id IS NOT NULL").groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.count("*").alias("_n"))
    copied = texts.where("_first < _last").drop("_last")
    copies = common.looked_up(once.select("_row", "doc_id", "_digest"), copied, "_digest").where("doc_id > _first").select("_row", F.lit("E").alias("_copy"))
    whole = F.concat("failing", F.coalesce("_copy", F.lit("")))
    return common.settle(once.drop("_digest").join(copies, "_row", "left").select("_row", "doc_id", "part", whole.alias("failing")))


def label_marks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with `good` and `toxic`: whether any label row of their id says 1."""
    says = lambda label: F.coalesce(F.max(F.col(label).cast("int") == 1), F.lit(False))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    marks = marks.where("good OR toxic")
    return rows.join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])


def failing_relations(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """One stored table for each filter, as the partitions of one by `filter`: the rows that fail it, with their label marks."""
    spark, path = judged.sparkSession, common.fresh_path(judged.sparkSession, "failing")
    marked = label_marks(judged.where("failing <> ''"), labels)
    each = marked.select("_row", "part", "good", "toxic", F.explode(F.split("failing", "")).alias("filter"))
    each.write.partitionBy("filter").parquet(path)
    return spark.read.schema("_row long, part string, good boolean, toxic boolean, filter string").parquet(path)


def removals(fails: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter, before (the filters applied before, in order of name), removed, good_lost, toxic_lost; zeros are left out."""
    left = fails.withColumn("met", F.lit(""))
    for g in filters:
        ids = fails.where(F.col("filter") == g).select("_row")
        met, others = left.join(ids, "_row", "left_semi"), left.join(ids, "_row", "left_anti")
        left = common.settle(met.withColumn("met", F.when(F.col("filter") == g, F.col("met")).otherwise(F.concat("met", F.lit(g)))).unionByName(others))
    counted = left.groupBy("part", "filter", "met").agg(F.count("*").alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"))
    sets = ["".join(s) for k in range(len(filters)) for s in combinations(filters, k)]
    every = counted.withColumn("before", F.explode(F.array(*map(F.lit, sets)))).where("NOT contains(before, filter) AND translate(before, met, '') = before")
    return every.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")))


def orders(filters: str = FILTERS) -> Column:
    """An array of every step of every order: filter_order, step, filter, before (the earlier filters in order of name)."""
    steps = [{"filter_order": "".join(p), "step": k + 1, "filter": f, "before": "".join(sorted(p[:k]))} for p in permutations(filters) for k, f in enumerate(p)]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:string,before:string>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step."""
    n = len(FILTERS)
    judged = documents_judged(docs)
    parts = judged.groupBy("part").agg(F.count("*").alias("_rows"))
    found = common.settle(removals(failing_relations(judged, labels)))
    # A relation after k filters is met in k! * (n - 1 - k)! orders.
    times = reduce(lambda c, k: c.when(F.length("before") == k, F.lit(factorial(k) * factorial(n - 1 - k))), range(1, n), F.when(F.length("before") == 0, F.lit(factorial(n - 1))))
    of_filter = found.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == "", F.col("removed")).otherwise(0)).alias("_fails"),
        F.sum(F.when(F.length("before") == n - 1, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * times).alias("shapley"),
    )
    steps = parts.select("part", "_rows", F.explode(orders()).alias("_o")).select("part", "_rows", "_o.*")
    zero = {"removed": 0, "good_lost": 0, "toxic_lost": 0, "_fails": 0, "unique_fails": 0, "shapley": 0}
    whole = steps.join(found, ["part", "filter", "before"], "left").join(of_filter, ["part", "filter"], "left").na.fill(zero)
    so_far = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return whole.select(
        "part", "filter_order", "step", (F.col("_rows") - so_far).alias("kept"), "removed", (F.col("_fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def op12_failing_id_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), measured AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_chars,
    min(doc_id) OVER (PARTITION BY t) AS first_id FROM docs
), judged AS (
  SELECT part, concat(
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * upper_chars > 5 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS failing,
    CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good,
    CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS toxic FROM measured
), classes AS (
  SELECT part, failing, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), perms AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS f, substr(filter_order, 1, k - 1) AS before FROM perms, range(1, 6) r(k)
), hit AS (
  SELECT *, contains(failing, f) AS fails, CASE WHEN before = '' THEN 0 ELSE len(regexp_extract_all(failing, '[' || before || '_]')) END > 0 AS gone
  FROM steps, classes
), counted AS (
  SELECT part, filter_order, step, f, CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failing = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM hit GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""
