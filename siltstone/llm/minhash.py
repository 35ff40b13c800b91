"""MinHash near-dedup: circulant MinHash, banding, exact verification.

A document is the set of its distinct five-word shingles, as 64-bit hashes. Two permutations make the whole signature:
the first scatters the shingles over the ring of 2^32 places, the second, shifted circularly by k, gives coordinate k as
its least value over the set. 32 bands of 4 coordinates miss a pair at similarity 0.75 with a chance of 5e-6.

Equal sets form classes first, so exact copies never meet again. In a bucket of classes nothing is paired with
everything. Each class is held against the pivot it shares most buckets with. Where a bucket still has several components,
a class that some class of another component resembles by signature stays. These form clusters over the buckets they
share, so that a class's set moves once a cluster and not once a bucket; blocks of a cluster, bounded in shingles on
average, are multiplied as 0/1 matrices within tasks, which gives all their intersections exactly and lets only true links
out. Every link is confirmed on the full sets.

Hot keys: a class, pivot, bucket or cluster of many rows is looked up by broadcast or dealt to several tasks by a hash, and
pairs within a bucket or cluster meet by pairs of blocks.

Nulls: a null or empty text, or one without words, has an empty set and links with nothing. Rows with a null doc_id are
not linked: their component_id is null, and they are kept. Rows that share a doc_id are one node: their texts are linked.
Very long texts are sets like any other. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common
from siltstone.llm.components import components

SHINGLE_WORDS = 5
#: Similarity of a link, in hundredths.
SIMILAR = 75
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Coordinates that must agree before a pair is verified: at similarity 0.75, 96 of 128 on average, 64 or fewer once in 10^10.
AGREE = 64
#: A block of classes that are compared with each other: shingles and rows on average; classes of a bucket's block; pairs
#: of one pivot that are verified together.
BLOCK_SHINGLES, BLOCK_ROWS, BUCKET_ROWS, PIVOT_PAIRS = 300_000, 1024, 1024, 256
CACHE_WORDS = 60_000
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, one without words none."""
    words = common.words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - width + 1, 1)
    total = np.full(n, np.uint64(min(len(h), width)))
    for j in range(min(width, len(h))):
        total = _mixed(total) * M1 + h[j : j + n]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k: the least place of any shingle under the second permutation shifted by k."""
    s = (_mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(COORDINATES, dtype=np.uint32)[:, None]
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 256):
        t = s[None, at : at + 256] + shift
        u = t >> np.uint32(16)
        np.bitwise_xor(t, u, out=t)
        np.multiply(t, np.uint32(0x7FEB352D), out=t)
        np.right_shift(t, np.uint32(15), out=u)
        np.bitwise_xor(t, u, out=t)
        np.multiply(t, np.uint32(0x846CA68B), out=t)
        np.minimum(out, t.min(axis=1), out=out)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    c = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = _mixed(key * M2 + c[:, j])
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (of the whole set), bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), common.utf8_column(batch, "text"), strict=True):
                    shingles = shingle_set(text)
                    if len(shingles):
                        yield doc_id, key, len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), band_keys(signature(shingles))
                    else:
                        yield doc_id, key, 0, None, None

        yield from common.emit(schema, rows(), lambda row: 1000)

    return _keyed(docs).mapInArrow(sketch, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<bigint>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n, shingles, signature of the wanted classes (node, first_id, text_key): their texts are read again, all others
    only pass by."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64())), ("signature", pa.list_(pa.int32()))])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for node, text in zip(batch.column("node").to_pylist(), common.utf8_column(batch, "text"), strict=True):
                    shingles = shingle_set(text)
                    yield node, len(shingles), shingles.view(np.int64), signature(shingles).view(np.int32)

        yield from common.emit(schema, rows(), lambda row: 8 * row[1])

    there = _keyed(docs).join(wanted.select("node", F.col("first_id").alias("doc_id"), "text_key"), ["doc_id", "text_key"]).select("node", "text")
    return there.mapInArrow(make, "node long, n int, shingles array<bigint>, signature array<int>").dropDuplicates(["node"])


def _similar(n, m, same):
    return 100 * same >= SIMILAR * (n + m - same)


def _possible(a: str, b: str):
    """Bounds that a link cannot break: by sizes exactly, by the signatures up to chance."""
    agree = F.aggregate(F.zip_with(f"{a}.signature", f"{b}.signature", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)) & (agree >= AGREE)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), each b once, whose full sets are similar enough. A pivot's pairs are dealt to groups of a bounded
    number, on average; its own set goes to each group once."""

    def keep(group: pa.Table) -> pa.Table:
        a, node = group["a"].to_numpy(), group["node"].to_numpy()
        shingles = [x.values.to_numpy() for x in group["shingles"]]
        pivot = shingles[int(np.flatnonzero(a == node)[0])]
        ok = [i for i, s in enumerate(shingles) if a[i] != node[i] and _similar(len(pivot), len(s), len(np.intersect1d(pivot, s, assume_unique=True)))]
        return pa.table({"a": pa.array(a[ok], pa.int64()), "b": pa.array(node[ok], pa.int64())})

    counts = pairs.groupBy("a").agg(F.count("*").alias("_n")).withColumn("_groups", F.ceil(F.col("_n") / PIVOT_PAIRS))
    dealt = common.looked_up(pairs, counts, "a").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.col("_groups")).alias("part"))
    own = counts.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1)).alias("part"))
    grouped = dealt.unionByName(own).join(sets.select("node", "shingles"), "node").groupBy("a", "part")
    return grouped.applyInArrow(keep, "a long, b long")


def intersections(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of one side shares with each of the other: products of 0/1 matrices, some columns at a time."""
    sizes = [len(x) for x in one + other]
    _, place, count = np.unique(np.concatenate([*one, *other]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.flatnonzero(count[place] > 1)  # the others are in no intersection
    columns = np.full(len(count), -1)
    columns[count > 1] = np.arange((count > 1).sum())
    row, column = row[shared], columns[place[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(one), len(other)), np.float32)
    for at in range(0, int((count > 1).sum()), 1024):
        lo, hi = np.searchsorted(column, (at, at + 1024))
        m = np.zeros((len(sizes), 1024), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(one)] @ m[len(one) :].T
    return out


def _by_pairs_of_blocks(rows: DataFrame, key: str, blocks) -> DataFrame:
    """The rows with `block`, by a hash of the node, and `low` and `high`, once for each pair of blocks that theirs is in.
    `blocks`: how many of them a key has, as an aggregate over its rows."""
    totals = rows.groupBy(key).agg(F.count("*").alias("_n"), F.greatest(blocks, F.lit(1)).cast("int").alias("_blocks"))
    numbered = common.looked_up(rows, totals, key).withColumn("block", F.pmod(F.xxhash64("node", F.lit(17)), F.col("_blocks")).cast("int"))
    spread = numbered.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return spread.withColumns({"low": F.least("block", "_with"), "high": F.greatest("block", "_with")}).drop("_blocks", "_with")


def _block_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the components of each cluster, of rows (cluster, node, component, n).

    A cluster's rows are dealt to blocks of a number of shingles and of rows; each pair of blocks is one group."""
    spread = _by_pairs_of_blocks(placed, "cluster", F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_ROWS)))

    def multiply(group: pa.Table) -> pa.Table:
        node, component, block = (group[c].to_numpy() for c in ("node", "component", "block"))
        shingles = [x.values.to_numpy() for x in group["shingles"]]
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        i, j = np.flatnonzero(block == low), np.flatnonzero(block == high)
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(i) and len(j):
            n = np.array([len(x) for x in shingles])
            same = intersections([shingles[k] for k in i], [shingles[k] for k in j])
            p, q = np.nonzero(_similar(n[i][:, None], n[j][None, :], same) & (component[i][:, None] != component[j][None, :]))
            a, b = node[i[p]], node[j[q]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    grouped = spread.drop("n").join(sets.select("node", "shingles"), "node").groupBy("cluster", "low", "high")
    return grouped.applyInArrow(multiply, "a long, b long").where("a <> b")


def _resembling(split: DataFrame) -> DataFrame:
    """Of rows (bucket, node, component, n, signature): bucket, node, component, n of those that one of another component in
    their bucket resembles. A bucket's rows meet by pairs of blocks."""
    spread = _by_pairs_of_blocks(split, "bucket", F.ceil(F.count("*") / BUCKET_ROWS))
    x, y = spread.alias("x"), spread.alias("y")
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("x.low") == F.col("x.high")) | (F.col("x.block") != F.col("y.block")))
    return x.join(y, same & apart & _possible("x", "y"), "left_semi").select("bucket", "node", "component", "n").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (the one of each component)."""
    common.prepare(docs.sparkSession)
    base = common.settle(sketches(docs))
    linkable = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("text_key", "bands"), F.struct("doc_id", "text_key")).alias("_r"), F.count("*").alias("_n"))
    classes = common.settle(classes.select("set_key", "node", "_n", "_r.*"))
    # nodes are ids of documents; where an id has several texts, their classes are linked below and the node stands for one
    several = linkable.groupBy("doc_id").agg(F.min("set_key").alias("_a"), F.max("set_key").alias("_b")).where("_a <> _b").select("doc_id")
    several = common.settle(linkable.select("doc_id", "set_key").join(several, "doc_id", "left_semi").distinct())
    classes = _distinct_nodes(classes, several)

    banded = classes.select("node", F.explode("bands").alias("bucket"))
    pivots = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("_n")).where("_n > 1")
    crowded = common.settle(common.looked_up(banded, pivots, "bucket"))
    wanted = classes.join(crowded.select("node").distinct(), "node", "left_semi")
    sets = common.settle(_sets(docs, wanted))
    common.swept(docs.sparkSession)
    facts = sets.select("node", "n", "signature")

    # first each class against the pivot of most of its buckets
    often = crowded.where("node <> pivot").groupBy("node", "pivot").count().groupBy("node").agg(F.max_by("pivot", F.struct("count", -F.col("pivot"))).alias("a")).select("a", F.col("node").alias("b"))
    often = common.settle(often)
    asked = often.groupBy("a").agg(F.count("*").alias("_n"))
    x = asked.join(facts.select(F.col("node").alias("a"), F.struct("n", "signature").alias("x")), "a")
    y = facts.select(F.col("node").alias("b"), F.struct("n", "signature").alias("y"))
    pairs = common.settle(common.looked_up(often.join(y, "b"), x, "a").where(_possible("x", "y")).select("a", "b"))
    links = common.settle(_verified(pairs, sets))
    common.swept(docs.sparkSession)  # the sets went to pairs by a shuffle, and go to blocks by another

    # then, in buckets of several components, classes that resemble one of another component
    labels = components(links)
    split = crowded.select("node", "bucket").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = split.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("_n")).where("_a <> _b").select("bucket", "_n")
    split = common.settle(common.looked_up(split, open_, "bucket").join(facts, "node"))
    resembling = common.settle(_resembling(split))
    firsts = resembling.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("_n"))
    stars = common.looked_up(resembling, firsts, "bucket").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    clusters = components(stars).withColumnRenamed("component", "cluster")
    clustered = common.settle(resembling.select("node", "component", "n").distinct().join(clusters, "node"))
    links = links.unionByName(common.settle(_block_links(clustered, sets)))
    common.swept(docs.sparkSession)

    # an id's own texts
    own = several.join(classes.select("set_key", "node"), "set_key").select("doc_id", "node")
    links = links.unionByName(own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a <> b"))
    labels = components(links)
    # a component goes by the least id of its classes' documents
    placed = classes.select("set_key", "node", "first_id", "_n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_n"))
    placed = common.settle(common.looked_up(placed.withColumnRenamed("_n", "_rows"), least, "component").select("set_key", "component_id", F.col("_rows").alias("_n")))
    some = common.looked_up(linkable.select("doc_id", "n_shingles", "set_key"), placed, "set_key").select("doc_id", "n_shingles", "component_id")
    others = base.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(others).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _distinct_nodes(classes: DataFrame, several: DataFrame) -> DataFrame:
    """The classes with `first_id`, their least document, and `node`, a number that is theirs alone: the id itself, or, for
    classes of an id with several texts, a hash of the set that is no such id's."""
    shared = several.select("set_key").distinct().withColumn("_shared", F.lit(True))
    marked = classes.withColumnRenamed("node", "first_id").join(shared, "set_key", "left")
    return common.settle(marked.withColumn("node", F.when(F.col("_shared"), F.xxhash64("set_key", F.lit(5)).bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("first_id"))).drop("_shared"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, in their own columns: one of each component, the first by doc_id, and one row of each doc_id: the first
    by a hash of the text, then of all columns, so that a retry keeps the same. Rows with a null doc_id all stay."""
    judged = common.settle(near_duplicates(docs))
    dropped = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_bad_")).distinct()
    repeated = common.settle(judged.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_bad_")).count().where("count > 1").select("_bad_"))
    held = docs.select(F.struct("*").alias("_doc_"), F.col("doc_id").cast("long").alias("_id_"))
    on = F.col("_id_") == F.col("_bad_")
    if not repeated.limit(1).count():
        return held.join(dropped, on, "left_anti").select("_doc_.*")
    single = held.join(dropped.unionByName(repeated), on, "left_anti").select("_doc_.*")
    order = F.struct(F.xxhash64(F.col("_doc_.text").cast("string")), F.xxhash64(F.to_json("_doc_")))
    first = held.join(repeated, on, "left_semi").groupBy("_id_").agg(F.min_by("_doc_", order).alias("_doc_")).select("_doc_.*")
    return single.unionByName(first)


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


#: The same rows in DuckDB: all intersections by a join of the shingles, and the transitive closure of the links.
OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
