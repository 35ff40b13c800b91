"""Best-fit packing: pattern packing by non-negative least squares.

Pieces of at most `capacity` tokens go into sequences of that capacity. The histogram of lengths (at most `capacity`
bins, however large the corpus) is all that reaches the driver. There the patterns of two or three lengths are
enumerated, those that fill a sequence exactly first, then with one token to spare and so on, until there are PATTERNS
a length; non-negative least squares fit how often each is used. Counts are rounded down, and then up by the largest
remainder while their pieces last. What remains is packed best fit, longest first, on the histogram itself; as it packs
badly without short pieces, a share of the patterns is given back where that saves sequences. On the cluster a
piece finds its slot from its length and its rank among the pieces of that length, so no row is compared with another.

Nulls: a null text is the empty text (one piece: the end id alone). A null doc_id is carried as it is. Very long texts are
cut into full pieces. Repeated rows are pieces of their own, and pieces of one length are dealt in order of rows. An
empty table gives an empty table. Columns besides those named stay as they are, unless a name clashes with one that is
added: then the added one replaces it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import common, token_ids

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Patterns a length, on average, after which a slack is the last one enumerated; the greatest slack, as a share of the
#: capacity; the solver's steps.
PATTERNS, MOST_SLACK, STEPS = 50, 1 / 16, 60
#: Shares of the fitted patterns that are tried.
SHARES = (1, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4)
ORIGINS = ("whole", "fitted", "best_fit")


def pieces(docs: DataFrame, vocabulary_file: str, capacity: int = CAPACITY, end_id: int = END_ID, control_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit) of each document's tokens and end id.

    Documents of more than `capacity` ids are cut so that all pieces but the first are full."""
    common.prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = token_ids.encoder(vocabulary_file, control_as_text), np.array([end_id], "<u4").tobytes()

        def rows() -> Iterator[tuple]:
            for batch in common.gathered(batches, "text"):
                every, ends = encoder.encode_batch([t or "" for t in batch.column("text").to_pylist()])
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), np.split(every.astype("<u4"), ends[:-1]), strict=True):
                    n, ids = len(ids) + 1, ids.tobytes() + end
                    stop = (n - 1) % capacity + 1
                    start = piece = 0
                    while start < n:
                        yield doc_id, piece, start, stop - start, ids[4 * start : 4 * stop]
                        start, stop, piece = stop, stop + capacity, piece + 1

        yield from common.emit(schema, rows(), lambda row: len(row[4]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def enumerated(counts: np.ndarray, most: int = PATTERNS) -> np.ndarray:
    """Patterns (a, b, c), a >= b >= c, of lengths that there are; c is 0 in pairs. Fullest first, whole slacks at a time."""
    capacity = len(counts) - 1
    there = counts > 0
    there[[0, capacity]] = False
    lengths = np.flatnonzero(there)
    found, total = [np.empty((0, 3), np.int64)], 0
    for slack in range(int(capacity * MOST_SLACK) + 1):
        full = capacity - slack
        for c in (0, *lengths[lengths <= full // 3]):
            b = lengths[(lengths >= c) & (lengths <= (full - c) // 2)]
            a = full - c - b
            fits = there[a]
            found.append(np.stack([a[fits], b[fits], np.full(fits.sum(), c)], axis=1))
            total += len(found[-1])
        if total >= most * len(lengths):
            break
    return np.concatenate(found)


def fit_counts(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often to use each pattern, as non-negative reals: least squares on the histogram, each length weighted by the
    inverse of its count's root, by accelerated projected gradient."""
    bins = len(counts)
    weight = 1 / np.sqrt(np.maximum(counts, 1.0))
    weight[0] = 0
    columns = [np.ascontiguousarray(patterns[:, j]) for j in range(3)]

    def use(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(c, x, bins) for c in columns)

    def back(r: np.ndarray) -> np.ndarray:
        wr = weight * r
        return sum(wr[c] for c in columns)

    v = np.ones(len(patterns))
    for _ in range(8):  # power iteration for the step's length
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - back(use(y) - weight * counts) / (1.05 * norm), 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x


def rounded(patterns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fit in whole numbers that the histogram can serve: rounded down, and the patterns to round up, by largest
    remainder, the fuller first."""
    bins = len(counts)
    rest = counts.copy()
    rest[0] = 3 * len(patterns)  # what is no length lasts
    wanted = sum(np.bincount(patterns[:, j], x, bins) for j in range(3))
    share = np.minimum(1, counts / np.maximum(wanted, 1e-9))
    share[0] = 1
    x = x * share[patterns].min(axis=1)
    times = np.floor(x + 1e-9).astype(np.int64)
    times[patterns[:, 0] == 0] = 0
    left = rest - used(patterns, times, bins)
    left[0] = rest[0]
    left, up = left.tolist(), []
    order = np.lexsort((-patterns.sum(axis=1), times - x))
    for i, (a, b, c) in zip(order.tolist(), patterns[order].tolist(), strict=True):
        left[a] -= 1
        left[b] -= 1
        left[c] -= 1
        if left[a] >= 0 and left[b] >= 0 and left[c] >= 0:
            up.append(i)
        else:
            left[a] += 1
            left[b] += 1
            left[c] += 1
    return times, np.array(up, np.int64)


def used(patterns: np.ndarray, times: np.ndarray, bins: int) -> np.ndarray:
    """Pieces of each length in the patterns; index 0 means nothing. Whole numbers all the way, as counts may be large."""
    out = np.zeros(bins, np.int64)
    for j in range(3):
        np.add.at(out, patterns[:, j], times)
    out[0] = 0
    return out


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Pack a histogram best fit, longest first. All pieces of a length are placed at once: sequences with equal contents
    are one group with a count, so the work depends on the number of lengths, not of pieces."""
    capacity = len(counts) - 1
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by space left
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            space = next((s for s in range(length, capacity) if groups.get(s)), None)
            if space is None:
                each = capacity // length
                times, rest = divmod(left, each)
                for k, n in ((each, times), (rest, 1)):
                    if k and n:
                        groups.setdefault(capacity - k * length, []).append(((length,) * k, n))
                break
            held, n = groups[space].pop()
            each = min(space // length, left)
            times = min(n, left // each)
            if times < n:
                groups[space].append((held, n - times))
            groups.setdefault(space - each * length, []).append((held + (length,) * each, times))
            left -= each * times
    return [group for same in groups.values() for group in same]


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int, int]]:
    """Patterns for a histogram (counts[length], capacity included), how often each is used, and the number of its origin."""
    capacity = len(counts) - 1
    whole = [((capacity,), int(counts[capacity]), 0)] if counts[capacity] else []
    rest = counts.astype(np.int64)
    rest[0] = rest[capacity] = 0
    patterns = enumerated(rest)
    if not len(patterns):
        return whole + [(held, n, 2) for held, n in best_fit(rest)]
    times, up = rounded(patterns, fit_counts(patterns, rest.astype(float)), rest)
    found = None
    for share in SHARES:
        here = np.floor(times * share).astype(np.int64)
        np.add.at(here, up[: int(len(up) * share)], 1)
        last = best_fit(rest - used(patterns, here, len(rest)))
        n = int(here.sum()) + sum(k for _, k in last)
        if found is None or n < found[0]:
            found = n, here, last
    _, here, last = found
    fitted = [(tuple(v for v in patterns[p].tolist() if v), int(here[p]), 1) for p in np.flatnonzero(here)]
    return whole + fitted + [(held, n, 2) for held, n in last]


def slots(patterns: list[tuple[tuple[int, ...], int, int]]) -> dict[str, np.ndarray]:
    """For each length, where its pieces go in order of rank: runs (length, first rank, first sequence, offset, origin)."""
    rows, sequence = [], 0
    for held, times, origin in patterns:
        offset = 0
        for length in held:
            rows.append((length, times, sequence, offset, origin))
            offset += length
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.argsort(table[:, 0], kind="stable")]
    ends = np.cumsum(table[:, 1])
    first = np.concatenate([[0], ends[:-1]]) if len(table) else ends
    begins = np.searchsorted(table[:, 0], table[:, 0])
    return {"length": table[:, 0], "rank": first - (first[begins] if len(table) else first), "sequence": table[:, 2], "offset": table[:, 3], "origin": table[:, 4]}


def pack(piece_rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Any rows with a `length` of 1 to `capacity`, each with its sequence_id and offset, and the sequence's origin: a whole
    piece, a fitted pattern, or best fit.

    Driver: the histogram and the slots, both bounded by the capacity. Cluster: two small shuffles of the rows as given,
    to rank them within their length; wide columns are best joined afterwards."""
    spark = piece_rows.sparkSession
    rows = common.settle(piece_rows.drop("sequence_id", "offset", "origin").withColumn("_row", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():
        counts[length] = n
    where = spark.sparkContext.broadcast(slots(plan(counts)))

    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    in_part = Window.partitionBy("_part", "length").orderBy("_row")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_part", "length").agg(F.count("*").alias("_n")).select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = rows.withColumn("_k", F.row_number().over(in_part) - 1).join(bases, ["_part", "length"]).withColumn("_rank", F.col("_k") + F.col("_base")).drop("_part", "_row", "_k", "_base")
    kept = [c for c in ranked.columns if c != "_rank"]
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "_rank") + ", sequence_id long, offset long, origin string"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = where.value
        key = s["length"] << 44 | s["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            run = np.searchsorted(key, length << 44 | rank, side="right") - 1
            added = [s["sequence"][run] + rank - s["rank"][run], s["offset"][run], np.array(ORIGINS, object)[s["origin"][run]]]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(a, t) for a, t in zip(added, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*kept, "sequence_id", "offset", "origin"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary_file: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A packed table: doc_id, piece, start, length, ids_crc32, sequence_id, offset, origin; with_ids also the ids themselves,
    as little-endian unsigned 32-bit integers. Without them only their checksum is shuffled."""
    cut = pieces(docs, vocabulary_file or token_ids.vocabulary_file(VOCABULARY), capacity).withColumn("ids_crc32", F.crc32("ids"))
    ids = ["ids"] if with_ids else []
    return pack(cut if with_ids else cut.drop("ids"), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "origin", *ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids and lengths of the pieces in order: one row a training sequence, of a packed table with ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))


def op2_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
