"""A corpus from documents: quality rules, quality classifier, near-dedup, decontamination, packing.

Every stage works on what its predecessor kept, and its decision takes effect at once. run() writes each stage's rows to
the shared folder and reads them again, so a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, decontamination, minhash, packing, quality_classifier, quality_rules


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the plain rules or the outlier test reject."""
    return common.without(docs, quality_rules.judge(docs).where(~F.col("kept")))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose predicted quality is 0; learnt from labelled input documents, since those still here may all be of one class."""
    model = quality_classifier.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), "quality")
    return quality_classifier.keep(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component, and one row of each doc_id."""
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of a benchmark item."""
    found = decontamination.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return common.without(docs, found.where("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: one row a piece, with its ids. packing.sequences() makes whole sequences of them."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Outlier estimates and trained classifiers are not SQL; tests hold the later stages against brute-force versions and the
#: first two against the operators' own verdicts and known texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.fresh_path(spark, name)
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
        common.swept(spark)
    return rows
