"""Similar records: exact top-k by inner product, merging of evidence, TF-IDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.lineage import settled
from siltstone.functions.vectors import normalised
from siltstone.operators.vector_store import VectorStore

LEAST_SCORE = 0.05
#: One side of a search up to so many bytes of vectors is held by every task; larger sides meet in blocks of so many rows.
HELD_BYTES, QUERY_ROWS, RECORD_ROWS = 32 << 20, 20_000, 20_000
#: Cells that a large set of records is divided into at most, and products at once in a task.
CELLS, PRODUCTS = 256, 4_000_000

_HITS = "query_id long, record_id long, similarity double"
_HIT_FIELDS = ["query_id", "record_id", "similarity"]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors as a matrix; they are of one length."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.list_(pa.float64()))
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int, k: int, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores of each of n rows and their ids, of candidates (row, score, id) of which each row has k, or as
    many as all others; ties go to the smaller id, or to the greater one if `later`."""
    order = np.lexsort((-ids if later else ids, -scores, rows))
    first = np.searchsorted(rows[order], np.arange(n))
    order = order[np.arange(len(rows)) - first[rows[order]] < k]
    return scores[order].reshape(n, -1), ids[order].reshape(n, -1)


class _Top:
    """A bounded state: the k best records so far of some queries."""

    def __init__(self, matrix: np.ndarray, k: int, later: bool) -> None:
        self.matrix, self.k, self.later = matrix, k, later
        self.scores, self.ids = np.empty((len(matrix), 0)), np.empty((len(matrix), 0), np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, PRODUCTS // max(len(self.matrix), 1))
        for at in range(0, len(ids) if len(self.matrix) else 0, step):
            here, products = ids[at : at + step], self.matrix @ vectors[at : at + step].T
            # what is below the k-th score of its row is out; ties with it stay, and so does what is no number
            out = products < self.scores[:, -1:] if self.scores.shape[1] == self.k else np.zeros(products.shape, bool)
            if len(here) > self.k and out.size - np.count_nonzero(out) > 4 * self.k * len(self.matrix):
                out |= products < np.partition(products, len(here) - self.k, axis=1)[:, [len(here) - self.k]]
            rows, columns = np.nonzero(~out)
            rows = np.concatenate([np.repeat(np.arange(len(self.matrix)), self.ids.shape[1]), rows])
            scores = np.concatenate([self.scores.ravel(), products[~out]])
            self.scores, self.ids = _best(rows, scores, np.concatenate([self.ids.ravel(), here[columns]]), len(self.matrix), self.k, self.later)

    def hits(self, queries: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.repeat(queries, self.ids.shape[1]), pa.int64()), pa.array(self.ids.ravel(), pa.int64()), pa.array(self.scores.ravel(), pa.float64())]


def _weight(rows: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their vectors `v`."""
    n, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    return n, n * 8 * max(d or 0, 1)


def _held(rows: DataFrame, key: str):
    """A small side, sorted by its key, for every task."""
    table = rows.toArrow().sort_by(key)
    return rows.sparkSession.sparkContext.broadcast((table[key].to_numpy(), _matrix(table["v"])))


def top_k(queries: DataFrame, records: DataFrame, k: int, query_id: str = "query_id", record_id: str = "vec_id", vector: str = "embedding", least: float = LEAST_SCORE) -> DataFrame:
    """query_id, record id, similarity, rank: the k nearest records of each query by inner product, ties to the smaller id;
    then those over `least`, at most 1.

    A side of up to HELD_BYTES goes to every task, and the other side is read where it is. Two large sides meet by `Cells`:
    the plan is the same for any number of queries, and no query passes through the driver."""
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    known = records.select(F.col(record_id).cast("long").alias("record_id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    if (heavy := _weight(known))[1] <= HELD_BYTES:
        found = _all_records_held(asked, known, k)
    elif _weight(asked)[1] <= HELD_BYTES:
        found = _all_queries_held(asked, known, k)
    else:
        found = Cells.of(known, heavy[0]).search(asked, k)
    return _ranked(found, k, least).withColumnRenamed("record_id", record_id)


def _ranked(found: DataFrame, k: int, least: float, later: bool = False) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("record_id") if later else F.asc("record_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.where(F.col("similarity") > least).withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")))


def _all_records_held(queries: DataFrame, records: DataFrame, k: int) -> DataFrame:
    held = _held(records, "record_id")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = held.value
        for batch in batches:
            if len(ids) and batch.num_rows:
                top = _Top(_matrix(batch.column("v")), k, False)
                top.add(ids, matrix)
                yield pa.RecordBatch.from_arrays(top.hits(batch.column("query_id").to_numpy()), names=_HIT_FIELDS)

    return queries.mapInArrow(multiply, _HITS)


def _all_queries_held(queries: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """Each task of records keeps the best k of every query, so the shuffle holds k rows a query and task."""
    held = _held(queries, "query_id")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = held.value
        top = _Top(matrix, k, False)
        for batch in batches:
            top.add(batch.column("record_id").to_numpy(), _matrix(batch.column("v")))
        yield pa.RecordBatch.from_arrays(top.hits(ids), names=_HIT_FIELDS)

    return records.mapInArrow(multiply, _HITS)


def _met(queries: DataFrame, records: DataFrame, k: int, later: bool = False) -> DataFrame:
    """The best k of the records (cell, record_id, v) for each query (cell, query_id, v), of each block of its cell's records.

    A cell's queries and records are dealt to blocks by their numbers; each pair of blocks of a cell is one group of a task,
    so neither side of a large cell is ever in one."""
    n = queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("_salts"))
    m = records.groupBy("cell").agg(F.ceil(F.count("*") / RECORD_ROWS).alias("_blocks"))
    sizes = settled(n.join(m, "cell"))  # one row a cell
    to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt = lambda rows, id_, own, mine, other, theirs: rows.join(sizes, "cell").select("cell", F.pmod(F.xxhash64(id_), F.col(mine)).alias(own), to(theirs).alias(other), (F.lit(id_) == "query_id").alias("asks"), F.col(id_).alias("id"), "v")
    both = dealt(queries, "query_id", "salt", "_salts", "block", "_blocks").unionByName(dealt(records, "record_id", "block", "_blocks", "salt", "_salts"))

    def multiply(group: pa.Table) -> pa.Table:
        asks, ids, v = group["asks"].to_numpy(), group["id"].to_numpy(), _matrix(group["v"])
        top = _Top(v[asks], k, later)
        top.add(ids[~asks], v[~asks])
        return pa.Table.from_arrays(top.hits(ids[asks]), names=_HIT_FIELDS)

    return both.groupBy("cell", "salt", "block").applyInArrow(multiply, _HITS)


class Cells:
    """An exact index of a large set of records: each belongs to the nearest of some centres, and each cell knows how far its
    records are from its centre. No record of a cell can have a product with q over q * centre + |q| * radius.

    A query first asks the cell of its greatest product with a centre. Its k-th best there, if it has so many, is a bound
    that other cells must reach to be asked too."""

    def __init__(self, records: DataFrame, centres: np.ndarray, radius: np.ndarray) -> None:
        self.records, self.centres, self.radius = records, centres, radius

    @classmethod
    def of(cls, records: DataFrame, n: int) -> Cells:
        """`records`: record_id, v; `n`: how many. The centres are the records of the least hashes."""
        many = int(min(CELLS, max(1, -(-n // RECORD_ROWS))))
        first = records.orderBy(F.xxhash64("record_id"), "record_id").limit(many).toArrow()
        centres = _matrix(first["v"])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (centres**2).sum(axis=1) / 2
            for batch in batches:
                v = _matrix(batch.column("v"))
                cell = (v @ centres.T - half).argmax(axis=1) if len(v) else np.empty(0, np.int64)
                away = np.linalg.norm(v - centres[cell], axis=1) if len(v) else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns, pa.array(away, pa.float64())], names=["cell", "record_id", "v", "away"])

        placed = settled(records.mapInArrow(place, "cell int, record_id long, v array<double>, away double"))
        radius = np.full(len(centres), -np.inf)
        for r in placed.groupBy("cell").agg(F.max("away").alias("r")).collect():  # at most CELLS
            radius[r.cell] = r.r
        return cls(placed.drop("away"), centres, radius)

    def asked(self, queries: DataFrame, bounded: bool) -> DataFrame:
        """cell, query_id, v: the cell that a query asks first, or, of queries with `bound`, the others that may hold better."""
        centres, radius = self.centres, self.radius

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column("v"))
                products = np.where(np.isfinite(radius), v @ centres.T, -np.inf)
                first = products.argmax(axis=1)
                if bounded:
                    reach = products + np.linalg.norm(v, axis=1)[:, None] * np.where(np.isfinite(radius), radius, 0)
                    bound = batch.column("bound").to_numpy(zero_copy_only=False)[:, None]
                    may = reach >= bound - 1e-9 * np.maximum(1, np.abs(bound))
                    may[np.arange(len(v)), first] = False
                    rows, cells = np.nonzero(may & np.isfinite(radius))
                else:
                    rows, cells = np.arange(len(v)), first
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(cells[at : at + 4096], pa.int32()), batch.column("query_id").take(pa.array(part)), batch.column("v").take(pa.array(part))], names=["cell", "query_id", "v"])

        return queries.mapInArrow(choose, "cell int, query_id long, v array<double>")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        queries = settled(queries)
        near = settled(_met(self.asked(queries, False), self.records, k))
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "record_id")
        worst = near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == k).select("query_id", F.col("similarity").alias("bound"))
        bounds = queries.join(worst, "query_id", "left").select("query_id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        return near.unionByName(_met(settled(self.asked(bounds, True)), self.records, k))


def top_k_within(queries: DataFrame, artifacts: DataFrame, by: str, k: int, query_id: str = "query_id", record_id: str = "number", vector: str = "embedding", least: float = LEAST_SCORE) -> DataFrame:
    """As top_k among the artifacts of the query's own group (`by`, a repository): ties go to the later artifact. Each group is
    a cell; a large one is dealt to blocks, of which each keeps the best k a query."""
    asked = queries.select(F.col(by).alias("cell"), F.col(query_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    known = artifacts.select(F.col(by).alias("cell"), F.col(record_id).cast("long").alias("record_id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    return _ranked(_met(asked, known, k, later=True), k, least, later=True).withColumnRenamed("record_id", record_id)


def merged(hits: list[DataFrame], most: int = 6) -> DataFrame:
    """The best hits of several sources: by similarity, then source, then rank; at most `most` a query."""
    every = hits[0].withColumn("source_ord", F.lit(0))
    for i, more in enumerate(hits[1:], 1):
        every = every.unionByName(more.withColumn("source_ord", F.lit(i)))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "source_ord", "rank")
    return every.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def tf_idf_vocabulary(texts: DataFrame, stop_words: list[str], most: int = 5000) -> DataFrame:
    """term, total, docs, idf of the most frequent terms (ties by term); term counts are combined before each shuffle."""
    n = texts.count()
    numbered = texts.select(F.monotonically_increasing_id().alias("_row"), "text")  # before the explode, which would number terms
    every = numbered.select("_row", F.explode(terms(F.col("text"))).alias("term")).where(~F.col("term").isin(stop_words))
    counts = every.groupBy("_row", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("docs"))
    return counts.orderBy(F.desc("total"), "term").limit(most).withColumn("idf", F.log((1.0 + n) / (1 + F.col("docs"))) + 1)


def hashed_vector(text: Column, dimensions: int = 64) -> Column:
    """A text as a normalised vector of hashed term counts: the encoder that needs no model."""
    buckets = F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int"))
    zero = F.array_repeat(F.lit(0.0), dimensions)
    add = lambda v, b: F.transform(v, lambda x, i: F.when(i == b, x + 1.0).otherwise(x))
    return normalised(F.aggregate(buckets, zero, add))


#: What an artifact's vector is kept by.
CACHE_KEY = ["source", "artifact_type", "number", "url"]


def with_vectors(artifacts: DataFrame, cache: DataFrame, encode: Callable[[Column], Column] = hashed_vector, text: str = "text") -> DataFrame:
    """Artifacts (CACHE_KEY, text) with `embedding`: the cached one, else the text's. Of several cached vectors of a key the
    least counts; null parts of a key equal null."""
    once = cache.groupBy(*CACHE_KEY).agg(F.min("embedding").alias("_cached"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in CACHE_KEY]
    joined = artifacts.drop("embedding").alias("a").join(once.alias("c"), on, "left")
    kept = [F.col(f"a.{c}") for c in artifacts.columns if c != "embedding"]
    return joined.select(*kept, F.when(F.col("_cached").isNull(), encode(F.col(f"a.{text}"))).otherwise(F.col("_cached")).alias("embedding"), F.col("_cached").isNotNull().alias("was_cached"))


def stored_vectors(records: DataFrame, path: str, encode: Callable[[Column], Column] = hashed_vector, text: str = "text", record_id: str = "id") -> tuple[DataFrame, bool]:
    """The records' vectors (id, embedding) kept at a path, and whether a version was made for them: records that have changed,
    come or gone make one, and only texts that are new are encoded. Readers of earlier versions are not disturbed."""
    store = VectorStore(records.sparkSession, path)
    before = store.manifest()
    version = store.upsert(records.select(F.col(record_id).alias("id"), F.col(text).alias("text")), encode)
    return store.read(version).withColumnRenamed("id", record_id), before is None or version != before.version


def retrieved(findings: DataFrame, records: DataFrame, artifacts: DataFrame, repo: str = "repo", encode: Callable[[Column], Column] = hashed_vector, k: int = 3, most: int = 6) -> DataFrame:
    """query_id, source_ord (0 knowledge base, 1 history), hit (id of the record, number of the artifact), similarity,
    position: what is most like each finding (finding_id, repo, query: its text), of all records (id, embedding) and of its
    repository's artifacts (number, embedding). Records and artifacts must come from the same encoder."""
    queries = settled(findings.select(F.col("finding_id").cast("long").alias("query_id"), repo, encode(F.col("query")).alias("embedding")))
    known = top_k(queries, records, k, record_id="id").withColumnRenamed("id", "hit")
    own = top_k_within(queries, artifacts, repo, k).select("query_id", F.col("number").cast("long").alias("hit"), "similarity", "rank")
    return merged([known.select("query_id", "hit", "similarity", "rank"), own], most).drop("rank")


def status(records: DataFrame, vector: str = "embedding", *more: Column) -> DataFrame:
    """records, dimension, consistent: whether there are records and all vectors have one length; and more aggregates."""
    n = F.size(vector)
    return records.agg(F.count("*").alias("records"), F.max(n).alias("dimension"), (F.coalesce(F.min(n) == F.max(n), F.lit(False)) & (F.count("*") > 0)).alias("consistent"), *more)
