import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, documents, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_drop_what_they_should_and_keep_the_rest(spark, tmp_path):
    from siltstone.llm import common

    sf = "/root/testdata/sf0.001"
    rows, seen = common.table(spark, sf, "documents"), []
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen.append((name, rows.count(), after.count()))
        if name != "packing":
            assert after.columns == columns and after.join(rows, columns, "left_anti").count() == 0
            rows = after
    assert seen[0][2] < seen[0][1] and seen[2][2] < seen[2][1]
    packed = spark.read.parquet(str(tmp_path / "packing"))
    assert packed.select("doc_id").distinct().count() == rows.count()
    assert packed.where("octet_length(ids) <> 4 * length OR crc32(ids) <> ids_crc32").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_classifier_drops_what_the_rules_leave(spark, tmp_path):
    """The rules reject every labelled junk text, since it repeats itself; an unlabelled one that does not is the classifier's."""
    rng = random.Random(4)
    made = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(120))
    good, bad = "abcdeghilmnoprstu", "ABCDEGHILMNOPRS0123456789"
    rows = [(i, made(good), "en", "a", 1) for i in range(80)] + [(100 + i, " ".join([made(bad)] * 2), "en", "a", 1) for i in range(80)]
    rows += [(200, made(bad), "en", "a", 1), (201, made(good), "en", "a", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int(r[0] < 100), 0) for r in rows if r[0] < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    ruled = corpus_pipeline.quality_rule_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert ids(ruled) == {*range(80), 200, 201}
    assert ids(corpus_pipeline.quality_classifier_stage(spark, ruled, str(tmp_path))) == {*range(80), 201}


def tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = docs.where("doc_id = 8").first()
    spark.createDataFrame([(1, " ".join(item.text.split()[:40]) if item else "x y"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_with_nulls_repeats_clashes_and_long_texts(spark, tmp_path):
    """Clashing column names come back with their own values; each stage's rows are among its predecessor's."""
    rng = random.Random(2)
    extra = [(70, words(rng, 15_000), "en", "a", 1), (8, words(rng, 90), "fr", None, 2), (8, words(rng, 90), "fr", None, 2)]
    clashing = {c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("_id_", "_text_", "text_key", "kept", "g", "distance", "score", "_bad_", "_row", "sequence_id", "_doc_")}
    docs = documents(spark, extra).withColumns(clashing)
    tables(spark, tmp_path, docs)
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        whole = lambda frame: [repr(r) for r in frame.collect()]
        before = whole(rows)
        assert after.columns == rows.columns and set(whole(after)) <= set(before) and after.count() <= len(before), name
        assert all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for r in after.collect() for c in clashing)
        rows = after
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    assert 8 not in {r.doc_id for r in rows.where("lang = 'en'").collect()} or rows.where("doc_id = 8").count() == 1


def test_later_stages_against_brute_force(spark, tmp_path):
    """Near-dedup keeps the first of each group of equal five-word sets; decontamination drops what holds a benchmark window."""
    rng = random.Random(6)
    rows = [(i, words(rng, 80)) for i in range(20)]
    rows += [(100 + i, "".join(c.upper() if c.isascii() else c for c in t)) for i, t in rows[:6]] + [(200 + i, t + " tail") for i, t in rows[6:9]]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)
    tables(spark, tmp_path, docs)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(20))
    assert {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()} == {i for i, _ in rows} - {8, 208}
    packed = corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).toPandas()
    assert packed.doc_id.nunique() == len(rows) and (packed.ids.map(len) == 4 * packed.length).all() and np.isin(packed.origin, ["whole", "fitted", "best_fit"]).all()


def test_empty_tables_give_empty_results(spark, tmp_path):
    tables(spark, tmp_path, spark.createDataFrame([], DOCS))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
