"""Exact search against full products: held sides, cells of large sides, groups; bounded states and plans."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import retrieval

DIMENSIONS = 8


def vectors(spark, n, seed, clustered=True, repeat=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, DIMENSIONS))
    v = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.05, size=(n, DIMENSIONS)) if clustered else rng.normal(size=(n, DIMENSIONS))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if repeat:
        v[1::7] = v[0]  # ties
    rows = [(i, i % 3, [float(x) for x in v[i]]) for i in range(n)]
    return spark.createDataFrame([*rows, (n + 5, 1, None)], "id long, repo long, embedding array<double>"), v


def expected(q, r, k, later=False, repo=None):
    out = set()
    for i, x in enumerate(q):
        pairs = sorted((-round(float(x @ y), 9), -j if later else j) for j, y in enumerate(r) if repo is None or i % repo == j % repo)
        out |= {(i, abs(j), n + 1) for n, (s, j) in enumerate(pairs[:k]) if -s > 0.05}
    return out


def got(frame, name):
    return {(r.query_id, r[name], r["rank"]) for r in frame.collect()}


@pytest.mark.parametrize("clustered", [True, False])
@pytest.mark.parametrize("held,rows", [(1 << 20, 100), (None, 100), (0, 40), (0, 7)])
def test_top_k_equals_all_products(spark, monkeypatch, clustered, held, rows):
    """held: both sides fit; None: only the queries do; 0: cells, of several sizes."""
    records, r = vectors(spark, 230, 1, clustered)
    queries, q = vectors(spark, 60, 2, clustered)
    q = np.concatenate([q[:30], r[:30]]) if clustered else q
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    monkeypatch.setattr(retrieval, "HELD_BYTES", 60 * 8 * DIMENSIONS if held is None else held)
    monkeypatch.setattr(retrieval, "QUERY_ROWS", rows)
    monkeypatch.setattr(retrieval, "RECORD_ROWS", rows)
    assert got(retrieval.top_k(queries, records, 4, record_id="id"), "id") == expected(q, r, 4)
    assert retrieval.top_k(queries.limit(0), records, 4, record_id="id").count() == 0 == retrieval.top_k(queries, records.limit(0), 4, record_id="id").count()


@pytest.mark.parametrize("rows", [1000, 13])
def test_groups_equal_all_products_of_the_group(spark, monkeypatch, rows):
    records, r = vectors(spark, 120, 3)
    queries = records.where("id < 40").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(retrieval, "QUERY_ROWS", rows)
    monkeypatch.setattr(retrieval, "RECORD_ROWS", rows)
    hits = retrieval.top_k_within(queries, records.withColumnRenamed("id", "number"), "repo", 3)
    assert got(hits, "number") == expected(r[:40], r, 3, later=True, repo=3)


def test_cells_are_pruned_and_the_plan_does_not_grow(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "HELD_BYTES", 0)
    monkeypatch.setattr(retrieval, "RECORD_ROWS", 50)
    rng = random.Random(4)
    records, r = vectors(spark, 600, 5, repeat=False)
    queries, q = vectors(spark, 100, 5, repeat=False)
    cells = retrieval.Cells.of(records.where("embedding IS NOT NULL").select(F.col("id").alias("record_id"), F.col("embedding").alias("v")), 600)
    asked = queries.where("embedding IS NOT NULL").select(F.col("id").alias("query_id"), F.col("embedding").alias("v"))
    near = cells.asked(asked, False).count()
    bounds = asked.withColumn("bound", F.lit(0.9))
    further = cells.asked(bounds, True).count()
    assert len(cells.centres) == 12 and near == 100 and further < 100 * 11 / 2
    plans = [len(retrieval.top_k(queries.where(f"id < {n}").withColumnRenamed("id", "query_id"), records, 3, record_id="id")._jdf.queryExecution().optimizedPlan().toString().split("\n")) for n in (10, 100)]
    assert plans[0] == plans[1] and rng


def test_states_are_bounded():
    top = retrieval._Top(np.eye(3), 2, False)
    for at in range(0, 1000, 10):
        top.add(np.arange(at, at + 10), np.random.default_rng(at).normal(size=(10, 3)))
        assert top.ids.shape == (3, 2)


def test_versions_of_vectors(spark, tmp_path):
    """Changed, new and gone records; equal texts once; a reader of the old version; an upsert that dies before its manifest."""
    from siltstone.operators.vector_store import VectorStore

    store = VectorStore(spark, str(tmp_path / "v"))
    made = []
    encode = lambda text: F.transform(F.array(F.char_length(text), F.ascii(text)), lambda x: x.cast("double"))
    rows = lambda *r: spark.createDataFrame(list(r), "id long, text string")
    held = lambda v=None: sorted((repr(r.id), r.embedding) for r in store.read(v).collect())
    with pytest.raises(ValueError, match="no version"):
        store.read()
    first = rows((1, "abc"), (2, "abc"), (3, None), (None, "z"), (3, None))
    assert store.upsert(first, encode) == 1 and store.upsert(first, encode) == 1
    want = [("1", [3.0, 97.0]), ("2", [3.0, 97.0]), ("3", [0.0, 0.0]), ("3", [0.0, 0.0]), ("None", [1.0, 122.0])]
    assert held() == want
    old = store.read()
    second = rows((1, "abcd"), (2, "abc"), (4, "z"))
    assert store.upsert(second, lambda t: made.append(1) or encode(t)) == 2
    assert held() == [("1", [4.0, 97.0]), ("2", [3.0, 97.0]), ("4", [1.0, 122.0])] and held(1) == want
    assert sorted((repr(r.id), r.embedding) for r in old.collect()) == want
    newest = store.manifest()
    assert [spark.read.parquet(f"{store.path}/vectors/{p}").count() for p in newest.parts] == [3, 1] and newest.records == 3 and newest.dimension == 2
    spark.createDataFrame([(9, "k")], "id long, key string").write.parquet(f"{store.path}/index/3")  # died before its manifest
    assert len(held()) == 3 and store.upsert(rows((1, "q")), encode) == 3 and held() == [("1", [1.0, 113.0])]
    assert store.upsert(rows((1, "q")), encode, encoder="other") == 4 and len(store.manifest().parts) == 1
    assert store.upsert(rows(), encode) == 5 and held() == []


@pytest.mark.parametrize("later", [False, True])
def test_the_best_are_found_in_little_more_memory_than_their_products(later):
    """Every step of products is one matrix of PRODUCTS numbers, and what else is held at once is no more than two of these."""
    rng = np.random.default_rng(7)
    queries, records, ids = rng.integers(-3, 4, (4000, 6)).astype(float), rng.integers(-3, 4, (3000, 6)).astype(float), rng.permutation(9000)[:3000].astype(np.int64)
    tracemalloc.start()
    top = retrieval._Top(queries, 3, later)
    for at in (0, 2, 1000):
        top.add(ids[at : {0: 2, 2: 1000, 1000: 3000}[at]], records[at : {0: 2, 2: 1000, 1000: 3000}[at]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    products = queries @ records.T
    order = np.lexsort((np.broadcast_to(-ids if later else ids, products.shape), -products), axis=1)[:, :3]
    assert (top.ids == ids[order]).all() and (top.scores == np.take_along_axis(products, order, 1)).all()
    assert peak < 3.2 * 8 * retrieval.PRODUCTS
