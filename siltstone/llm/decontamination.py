"""Benchmark decontamination: prefix-filtered set join, in DataFrame functions alone.

An item's windows are its runs of 13 words (one shorter window if it has fewer). To hold a window whole, a document must
hold its rarest word with the word beside it, so these two are the only prefix needed: the item positions that are the
rarest of some window are its anchors, each with its neighbour inside the window. One pass counts the benchmark's words
in the corpus; a second keeps the document positions whose word is an anchor, each with the words around it, and joins
them to the anchors by both words. Length and position bound what can match: the run of equal words around the position
must cover a whole window. Both passes read the texts once and shuffle no text.

Keys of words that are frequent in the corpus are salted, on the anchors' side repeated, so that an item of one common
word fills no task; documents without any anchor have keys of their own. The driver takes the benchmark's anchor words
with their counts, no part of the corpus, and passes over the corpus once for every 50,000 of them, so a large benchmark
takes more passes, not more memory.

Nulls: a null text has no words, and a document without words is not contaminated. A null item_id is skipped in
items_sha256 but counts in n_items. Of equally rare words the first by word and position counts. Repeated documents are
judged each on its own; items with equal words are one item with several ids. Very long texts are rows of more candidate
places, which are spread over tasks. With an empty benchmark nothing is hit. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

WINDOW = 13
#: Anchor words for one pass over the corpus.
PASS_WORDS = 50_000
#: Occurrences in the corpus from which on an anchor word's keys are salted, and the salts.
HOT_WORD, SALTS = 10_000, 16
#: A document counts as contaminated if this many times its hit words reach its words.
SHARE = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(common.ascii_lower(text.cast("string")), F.lit(WORD), F.lit(0))


def anchors(benchmark: DataFrame, docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """word, item, before, after: an item's anchor with the words on either side that its windows can reach; `need` is the
    length of the item's windows."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.groupBy("words").agg(F.count("*").alias("n_ids"), F.collect_list(F.col("item_id").cast("string")).alias("ids"))
    items = common.settle(items.select(F.xxhash64("words").alias("item"), "words", "n_ids", "ids"))
    places = items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    vocabulary = places.select("word").distinct()
    tokens = docs.select(F.explode(words(F.col("text"))).alias("word"))
    if _small(vocabulary):
        tokens = tokens.join(F.broadcast(vocabulary), "word")
    seen = tokens.groupBy("word").agg(F.count("*").alias("seen"))  # a large vocabulary meets the counts, not the tokens
    ranked = places.join(seen, "word", "left").withColumn("rarity", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "pos"))
    need = F.least("n", F.lit(width))
    # a window starts at each of the `need` places before a word, if it fits into the item
    starts = F.sequence(F.greatest(F.col("pos") - need + 1, F.lit(0)), F.least(F.col("pos"), F.col("n") - need))
    rarest = ranked.select("item", need.alias("need"), F.explode(starts).alias("start"), "rarity").groupBy("item", "need", "start").agg(F.min("rarity").alias("r"))
    # the neighbour is the next word of the window, or the one before where the rarest is its last
    side = F.when(F.col("need") == 1, 0).when(F.col("r.pos") + 1 < F.col("start") + F.col("need"), 1).otherwise(-1)
    rarest = rarest.select("item", "need", "r.pos", "r.word", "r.seen", side.alias("side")).distinct()
    found = rarest.join(items, "item").withColumn("beside", F.when(F.col("side") == 0, "").otherwise(F.get("words", F.col("pos") + F.col("side"))))
    return common.settle(found.select("word", "seen", "side", "beside", "item", "need", "n_ids", "ids", *_around("words", "pos", width)))


def _around(array: str, pos: str, width: int) -> list[Column]:
    """The up to width - 1 words before a position, nearest first, and those after it."""
    first = F.greatest(F.col(pos) - (width - 1), F.lit(0))
    return [F.reverse(F.slice(array, first + 1, F.col(pos) - first)).alias("before"), F.slice(array, F.col(pos) + 2, F.lit(width - 1)).alias("after")]


def _small(vocabulary: DataFrame) -> bool:
    """Whether the benchmark's distinct words may be broadcast: it is asked before every broadcast."""
    return vocabulary.limit(200_001).count() <= 200_000


def _agree(x: str, y: str) -> Column:
    """How many leading words two arrays have in common."""
    same = F.array_join(F.zip_with(x, y, lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    return F.length(F.regexp_extract(same, "^1*", 0))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = SHARE, pass_words: int = PASS_WORDS) -> DataFrame:
    """For each document: doc_id, text_key (xxhash64 of the text), n_words, n_hit, n_items, items_sha256, contaminated, and
    runs: the hit words as (first, number), which may overlap."""
    found = anchors(benchmark, docs, width)
    counts = {r.word: r.seen for r in found.groupBy("word").agg(F.max("seen").alias("seen")).collect()}
    tokens = sorted(counts)
    hot = [w for w in tokens if counts[w] > HOT_WORD]
    chunks = [tokens[at : at + pass_words] for at in range(0, len(tokens), pass_words)] or [[""]]
    salts = F.when(F.col("seen") > HOT_WORD, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = found.withColumn("_salt", F.explode(salts)).withColumn("_key", F.xxhash64("word", "side", "beside", "_salt")).drop("_salt", "seen")
    single = found.where("side = 0").limit(1).count() > 0

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"), F.monotonically_increasing_id().alias("_row"))
    if len(chunks) > 1:  # row numbers must be the same in every pass
        rows = common.settle(rows)
    rows = rows.select("_row", "doc_id", "text_key", words(F.col("text")).alias("_words"))
    key = ["_row", "doc_id", "text_key", "n_words"]

    def matches(chunk: list[str]) -> DataFrame:
        """A row for each document and candidate place; `run` is null where no window is covered."""
        at = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(chunk), i)), lambda i: i.isNotNull())
        held = rows.withColumn("n_words", F.coalesce(F.size("_words"), F.lit(0)).cast("long")).withColumn("_at", at)

        def place(i: Column) -> Column:
            first = F.greatest(i - (width - 1), F.lit(0))
            return F.struct(i.alias("pos"), F.element_at("_words", i + 1).alias("word"), F.reverse(F.slice("_words", first + 1, i - first)).alias("d_before"), F.slice("_words", i + 2, F.lit(width - 1)).alias("d_after"))

        places = held.select(*key, F.explode_outer(F.transform("_at", place)).alias("_p")).select(*key, "_p.*")
        # a place meets the anchors of its word and the next one, of its word and the one before, and of its word alone
        sides = F.array(*[F.struct(F.lit(s).alias("side"), b.alias("beside")) for s, b in [(1, F.get("d_after", F.lit(0))), (-1, F.get("d_before", F.lit(0))), *([(0, F.lit(""))] if single else [])]])
        met = F.filter(sides, lambda x: x["beside"].isNotNull())
        places = places.withColumn("_s", F.explode_outer(F.when(F.col("word").isNotNull(), met))).select("*", "_s.*").drop("_s")
        salt = F.when(F.col("word").isin(hot), F.pmod(F.xxhash64("_row", "pos"), F.lit(SALTS))).otherwise(0).cast("int") if hot else F.lit(0)
        places = places.withColumn("_key", F.when(F.col("side").isNotNull(), F.xxhash64("word", "side", "beside", salt)).otherwise(F.xxhash64("_row")))
        run = F.struct((F.col("pos") - F.col("_l")).alias("first"), (F.col("_l") + F.col("_r") + 1).alias("n"))
        same = [places[c].eqNullSafe(found[c]) for c in ("word", "side", "beside")]
        joined = places.join(found, reduce(Column.__and__, same, places["_key"] == found["_key"]), "left").withColumn("_l", _agree("d_before", "before")).withColumn("_r", _agree("d_after", "after"))
        hit = F.col("_l") + F.col("_r") + 1 >= F.col("need")
        return joined.select(*key, F.when(hit, run).alias("run"), F.when(hit, F.struct("item", "n_ids", "ids")).alias("item"))

    every = reduce(DataFrame.unionByName, [matches(chunk) for chunk in chunks])
    grouped = every.groupBy(*key).agg(F.array_sort(F.collect_set("run")).alias("runs"), F.collect_set("item").alias("_items"))
    # the union of the runs, in order of their first words
    fold = F.aggregate("runs", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")), lambda a, r: F.struct(F.greatest(a["end"], r["first"] + r["n"]).alias("end"), (a["hit"] + F.greatest(r["first"] + r["n"] - F.greatest(a["end"], r["first"]), F.lit(0))).alias("hit")), lambda a: a["hit"])
    n_items = F.aggregate("_items", F.lit(0).cast("long"), lambda a, x: a + x["n_ids"])
    ids = F.array_join(F.array_sort(F.flatten(F.transform("_items", lambda x: x["ids"]))), ",")
    out = grouped.select("doc_id", "text_key", "n_words", fold.cast("long").alias("n_hit"), n_items.alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "runs")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op8_prefix_join_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The same rows in DuckDB: every window of every item against every run of words, by equality.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, len(w[i:i + least(13, len(w)) - 1]) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), m AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM m) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit h USING (rid) LEFT JOIN its USING (rid)
"""
