import random
import time
import zlib
from collections import Counter
from itertools import product
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bit_packing, packing, sharding, token_ids
from tests.llm.helpers import documents, empty

BYTES, WORDS = token_ids.vocabulary_file("byte_bpe_50k.json"), token_ids.vocabulary_file("word_bpe_49k.json")


def test_ids_are_the_librarys(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    signs = list("ab .,'slé1日Σ\u0301") + ["\n", "\t", "\r", "\x1c", "\xa0", "\u3000", "  ", "<|endoftext|>", "word", "İ"]
    texts = ["It's  a\n\n test,isn't it? 42²", "\xa0\x85 x\x1c y ", "a <|endoftext|> b", "foo\n \nbar", "日本語 and more", "", " ", "\n", "  lead", "Ünïcode É'S 'LL we'll", "x" * 50_000 + " " + "y" * 200]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for most in (token_ids.CACHE_CHUNKS, 50):  # the cache with and without trimming
        monkeypatch.setattr(token_ids, "CACHE_CHUNKS", most)
        for path in (BYTES, WORDS):
            for control_as_text in (False, True):
                plain = Tokenizer.from_file(path)
                plain.encode_special_tokens = control_as_text
                e = token_ids.Encoder(path, control_as_text)
                for at in range(0, len(texts), 400):
                    part = texts[at : at + 400]
                    ids, ends = e.encode_batch(part)
                    assert [r.tolist() for r in np.split(ids, ends[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in part]


def test_packing_is_gapless_and_whole(spark):
    docs = documents(spark).withColumn("sequence_id", F.lit("clash"))
    out = packing.pack_documents(docs).toPandas()
    e = token_ids.encoder(BYTES)
    for d in docs.select("doc_id", "text").distinct().collect():
        ids = e.encode(d.text or "").astype("<u4").tobytes() + b"\0\0\0\0"
        mine = out[out.doc_id.isna() if d.doc_id is None else out.doc_id == d.doc_id].drop_duplicates(["piece"]).sort_values("piece")
        assert mine.length.sum() * 4 == len(ids) and list(mine.start) == [0, *mine.length.cumsum()[:-1]]
        assert all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32))
        assert all(mine.length.iloc[1:] == packing.CAPACITY)
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= packing.CAPACITY
    assert out.sequence_id.nunique() <= -(-out.length.sum() // packing.CAPACITY) + 1
    assert packing.pack_documents(empty(spark)).count() == 0
    whole = packing.sequences(packing.pack_documents(docs, with_ids=True)).collect()
    for r in whole:
        mine = out[out.sequence_id == r.sequence_id].sort_values("offset")
        at = np.cumsum([0, *r.lengths])
        assert len(r.ids) == 4 * at[-1] and [zlib.crc32(r.ids[4 * a : 4 * b]) for a, b in zip(at, at[1:])] == list(mine.ids_crc32)
    assert len(whole) == out.sequence_id.nunique()


def check_plan(counts):
    """Sequences in all, and how many are whole, fitted and best fit."""
    patterns, used, n = packing.plan(counts), Counter(), Counter()
    for held, times, origin in patterns:
        assert times > 0 and sum(held) < len(counts)
        n[origin] += times
        for x in held:
            used[x] += times
    assert all(used[i] == counts[i] for i in range(1, len(counts)))
    return sum(n.values()), n[0], n[1], n[2]


def test_plan_fits_patterns():
    rng = np.random.default_rng(0)
    for times in (1, 10**12):
        counts = times * np.bincount(np.minimum(rng.lognormal(4, 0.8, 20_000).astype(int) + 1, 256), minlength=257)
        total, _, fitted, _ = check_plan(counts)
        assert total <= 1.02 * (counts * np.arange(257)).sum() / 256 + 1 and fitted > 0.2 * total


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_most_sequences_of_the_corpus_are_fitted_patterns(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    counts = np.zeros(packing.CAPACITY + 1, np.int64)
    for length, n in packing.pieces(docs, BYTES).groupBy("length").count().collect():
        counts[length] = n
    began = time.time()
    total, whole, fitted, rest = check_plan(counts)
    assert time.time() - began < 6
    assert fitted > 0.8 * (total - whole) and total <= 1.005 * -(-(counts * np.arange(len(counts))).sum() // packing.CAPACITY)


def fewest(pieces, capacity):
    """The least number of sequences, by trying all ways."""
    best = len(pieces)

    def place(i, spaces):
        nonlocal best
        if len(spaces) >= best:
            return
        if i == len(pieces):
            best = len(spaces)
            return
        for k in range(len(spaces)):
            if spaces[k] >= pieces[i]:
                place(i + 1, [*spaces[:k], spaces[k] - pieces[i], *spaces[k + 1 :]])
        place(i + 1, [*spaces, capacity - pieces[i]])

    place(0, [])
    return best


def test_plan_against_all_ways_of_packing():
    rng = random.Random(5)
    more = 0
    for _ in range(120):
        capacity = rng.randint(4, 12)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 8))]
        counts = np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)
        extra = check_plan(counts)[0] - fewest(sorted(lengths, reverse=True), capacity)
        assert 0 <= extra <= 1
        more += extra
    assert more <= 12


def test_bits_round_trip_and_random_access(spark, tmp_path):
    rng = np.random.default_rng(1)
    for bits in (1, 3, 7, 8, 13, 16, 17, 24, 31):
        ids = rng.integers(0, 1 << bits, 1001).astype("<u4")
        packed = bit_packing.pack_bits(ids, bits)
        assert len(packed) == -(-1001 * bits // 8)
        assert (bit_packing.unpack_bits(packed, bits, 0, 1001) == ids).all() and (bit_packing.unpack_bits(packed, bits, 500, 77) == ids[500:577]).all()
    path, docs = str(tmp_path / "ids"), documents(spark)
    bit_packing.write(docs.withColumn("start", F.lit("clash")), path, WORDS, 1, block_ids=500)
    out = bit_packing.read_documents(spark, path).toPandas().sort_values("start")
    e = token_ids.encoder(WORDS)
    texts = {(r.doc_id, e.encode(r.text or "").astype("<u4").tobytes() + b"\1\0\0\0") for r in docs.collect()}
    assert len(out) == docs.count() and {(None if d != d else int(d), bytes(b)) for d, b in zip(out.doc_id, out.ids)} == texts
    assert list(out.start) == [0, *out.n_tokens.cumsum()[:-1]] and out.doc_id.dropna().is_monotonic_increasing
    every = b"".join(bytes(b) for b in out.ids)
    assert bit_packing.read_range(spark, path, 450, 1200).tobytes() == every[1800:6600]
    with pytest.raises(ValueError):
        bit_packing.pack_bits(np.array([8], "<u4"), 3)
    bit_packing.write(empty(spark), str(tmp_path / "none"), WORDS, 1)
    assert bit_packing.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_shards_are_exact_and_gapless(spark):
    docs = documents(spark).repartition(5)
    out = sharding.shuffle(docs.select("doc_id", F.lit("x").alias("shard")), 7, 1, block_rows=3).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == docs.count() and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    full = sharding.shard_documents(docs).toPandas()
    assert set(full.law) == {"rows"} and (full[full.doc_id == 60]["size"] == 8).all() and full["grown_shard"].isna().all()
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_matrix_has_exact_margins_and_right_expectation():
    rows = np.array([100, 0, 37, 500])
    drawn = np.array([sharding.communication_matrix(rows, 5, s) for s in range(300)])
    assert (drawn.sum(axis=2) == rows).all() and set(drawn.sum(axis=1).ravel()) <= {127, 128}
    assert abs(drawn[:, 3, 0].mean() - 500 / 5) < 2


def test_matrix_follows_its_law_with_both_samplers(monkeypatch):
    def law(drawn):  # two shards of three slots each, three partitions of two rows: every way of dealing is as likely
        return Counter(tuple(sharding.communication_matrix(np.array([2, 2, 2]), 2, s)[:, 0].tolist()) for s in range(drawn))

    ways = {w: comb(2, w[0]) * comb(2, w[1]) * comb(2, w[2]) / comb(6, 3) for w in product(range(3), repeat=3) if sum(w) == 3}
    for most in (sharding.NUMPY_ROWS, 0):
        monkeypatch.setattr(sharding, "NUMPY_ROWS", most)
        seen = law(3000)
        assert set(seen) == set(ways) and sum((seen[w] - 3000 * p) ** 2 / (3000 * p) for w, p in ways.items()) < 27


def test_matrix_beyond_a_billion_rows():
    rows = np.full(40, 100_000_000)
    drawn = sharding.communication_matrix(rows, 24, 3)
    assert (drawn.sum(axis=1) == rows).all() and set(drawn.sum(axis=0)) <= {166_666_666, 166_666_667} and drawn.min() > 4_000_000


def test_shuffle_moves_every_row_anywhere(spark):
    """Each of six rows lands in each of the six places about as often, over many seeds."""
    seen = Counter()
    rows = spark.createDataFrame([(i,) for i in range(6)], "row int").repartition(2).persist()
    for seed in range(40):
        seen.update((r.row, 2 * r.slot + r.shard) for r in sharding.shuffle(rows, 2, seed, block_rows=2).collect())
    assert len(seen) == 36 and sum((n - 40 / 6) ** 2 / (40 / 6) for n in seen.values()) < 60
