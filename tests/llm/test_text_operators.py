import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat_format, common, components, decontamination, language_model, minhash, quality_classifier, quality_rules, toxicity
from tests.llm.helpers import documents, empty, words


def test_chat_windows_come_back_whole(spark):
    nasty = "␛1 <|im_end|>\n<|im_start|>assistant\nok ␛0\n"
    rows = [(1, 0, "system", "be kind"), *((1, i, "assistant" if i % 2 == 0 else "user", f"{nasty} {"word " * (5 + 300 * (i % 4 == 0))}") for i in range(1, 12)), (2, 0, "assistant", None), (3, 0, "system", nasty), (3, None, "odd\nrole<|", "x"), (None, 0, "user", ""), (2, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat_format.windows(turns)
    read = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or ""))
        assert read[conv].n_turns == len(mine)
        assert read[conv].turns == "".join(f"{r}\n{t or ''}\n" for _, r, t in mine)
        assert read[conv].loss == "".join(t or "" for _, r, t in mine if r == "assistant")
    ones = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(ones) > 2 and all(w.formatted.startswith("<|im_start|>system\nbe kind<|im_end|>\n") for w in ones)
    assert any(w.n_repeated > 1 for w in ones[1:])
    tight = chat_format.windows(turns, budget=200).where("conv_id = 1").collect()
    assert not any(w.over_budget for w in ones) and any(w.over_budget for w in tight) and all(w.over_budget == (-(-len(w.formatted) // 4) > 200) for w in tight)
    assert chat_format.windows(turns.limit(0)).count() == 0


def test_quality_rules(spark):
    rng_docs = documents(spark)
    junk = [(1000 + i, "### " * 60 + f"w{i} " * 30, "en", "a", 1) for i in range(3)] + [(2000, "same three words " * 40, "en", "a", 1)]
    docs = documents(spark, junk).withColumn("distance", F.lit("clash"))
    out = quality_rules.judge(docs).toPandas()
    assert len(out) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.dropna(subset=["doc_id"]).itertuples():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 2 * len(cover) > len(w)) and not (r.kept and r.base_failed)
    assert not out[out.doc_id >= 1000].kept.any()
    assert out[(out.doc_id < 60) & ~out.base_failed].kept.mean() > 0.9
    assert quality_rules.judge(empty(spark)).count() == 0 and rng_docs.count()


def test_survivors_of_a_junk_source_are_pooled(spark):
    rng = random.Random(6)
    good = [(i, words(rng, 120), "en", "a", 1) for i in range(40)]
    junk = [(100 + i, "too short", "en", "junk", 1) for i in range(60)]
    left = (200, " ".join(f"###$$$%%%{i}" for i in range(80)), "en", "junk", 1)
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame([*good, *junk, left], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not kept[200] and sum(kept[i] for i in range(40)) > 35


def test_c_steps_find_the_covariance_of_the_bulk(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, [1, 2, 3, 1, 1], (2000, 5)), rng.normal(40, 1, (300, 5))])
    rows = spark.createDataFrame([("g", [float(v) for v in r]) for r in x], "g string, x array<double>")
    e = quality_rules.estimates(rows).first()
    assert np.abs(np.array(e.centre)).max() < 0.5
    scatter = np.linalg.inv(np.array(e.inverse).reshape(5, 5))
    assert np.allclose(np.sqrt(np.diag(scatter)), [1.1, 2, 3, 1, 1], rtol=0.35)


def test_estimates_against_all_subsets(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(4):
        x = np.concatenate([rng.normal(g, 1, (9, 5)), rng.normal(g + 30, 3, (3, 5))])
        rows += [(str(g), [float(v) for v in r]) for r in x]
        fits = []
        for subset in combinations(range(12), 9):
            part = x[list(subset)]
            scatter = quality_rules.CONSISTENCY * np.cov(part.T, bias=True) + np.diag(np.square(quality_rules.FLOORS))
            fits.append((np.linalg.slogdet(scatter)[1], part.mean(axis=0), scatter))
        want[str(g)] = min(fits, key=lambda f: f[0])
    for r in quality_rules.estimates(spark.createDataFrame(rows, "g string, x array<double>")).collect():
        assert np.allclose(r.centre, want[r.g][1]) and np.allclose(np.array(r.scatter).reshape(5, 5), want[r.g][2])


def test_small_groups_lean_on_their_language(spark):
    rng = np.random.default_rng(4)
    rows = [("a", "l", "w", [float(v) for v in r]) for r in rng.normal(0, 1, (400, 5))] + [("b", "l", "w", [float(v) for v in r]) for r in rng.normal(9, 1, (2, 5))]
    found = {r.g: r for r in quality_rules.group_estimates(spark.createDataFrame(rows, "g string, g1 string, g0 string, x array<double>")).collect()}
    assert np.abs(found["a"].centre).max() < 0.3 and np.abs(found["b"].centre).max() < 1  # two rows of 50 do not pull far
    assert quality_rules.group_estimates(spark.createDataFrame([], "g string, g1 string, g0 string, x array<double>")).count() == 0


def labelled(spark):
    docs = documents(spark, [(3000 + i, ("$$ %% | " * 20 if i % 3 == 0 else "plain good words here now ") * 5 + (" awfulslur " * 4 if i % 5 == 0 else ""), "en", "a", 1) for i in range(200)])
    return docs, spark.createDataFrame([*((3000 + i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(200)), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_quality_classifier(spark):
    docs, labels = labelled(spark)
    out = quality_classifier.classify(docs, labels).toPandas()
    truth = {3000 + i: int(i % 3 != 0) for i in range(200)}
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    held = out[out.held_out & (out.doc_id >= 3000)]
    assert len(held) > 20 and (held.predicted == held.doc_id.map(truth)).all()
    assert all(h == (zlib.crc32(str(int(d)).encode()) % 4 == 2) for d, h in out.dropna(subset=["doc_id"])[["doc_id", "held_out"]].itertuples(index=False))
    none = quality_classifier.classify(docs, labels.limit(0)).toPandas()
    assert (none.score == 0.5).all() and quality_classifier.classify(empty(spark), labels).count() == 0
    model = quality_classifier.train(docs, labels, "quality")
    kept = quality_classifier.keep(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id >= 3000").count() == sum(truth.values())


def test_a_long_text_does_not_switch_learning_off(spark):
    """Each text in turn, over the bound by itself, is passed over; the others stay."""
    rows = [(i, f"text {i} ", "en", "a", 1) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    sample = lambda rows, most: {r.doc_id for r in common.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), labels, "quality", 4, 2, 100, most).collect()}
    whole = sample(rows, 10_000)
    assert len(whole) > 15
    for long in sorted(whole)[:4]:
        assert sample([(i, t * 2000 if i == long else t, *x) for i, t, *x in rows], 10_000) == whole - {long}
    with pytest.raises(ValueError, match="no labelled text"):
        sample([(i, t * 2000, *x) for i, t, *x in rows], 10_000)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    out = toxicity.classify(docs, labels).toPandas()
    truth = {3000 + i: int(i % 5 == 0) for i in range(200)}
    held = out[out.held_out & (out.doc_id >= 3000)]
    assert len(out) == docs.count() and (held.predicted == held.doc_id.map(truth)).all()
    assert "awfulslur" in set(out[out.doc_id == 3000].evidence.iloc[0])
    twice = toxicity.classify(docs.unionByName(docs).withColumn("label", F.lit("clash")), labels.unionByName(labels)).toPandas()
    scores = lambda frame: set(zip(frame.doc_id.fillna(-1), frame.score.round(9)))
    assert scores(twice) == scores(out) and len(twice) == 2 * len(out)
    assert (toxicity.classify(docs, labels.limit(0)).toPandas().score == 0).all() and toxicity.classify(empty(spark), labels).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(700):
        at = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        w = rng.integers(1, 4, len(at)).astype(float)
        rows.append((at, (w / max(np.linalg.norm(w), 1e-9)).astype(np.float32)))
    index = toxicity.Index(rows, np.arange(700), rng.integers(0, 2, 700), 40)
    dense = np.zeros((700, 40))
    for i, (at, w) in enumerate(rows):
        dense[i, at] = w
    place = np.argsort(index.ids)
    for i in range(0, 700, 23):
        near, cosines = index.nearest(*rows[i])
        every = np.empty(700)
        every[place] = dense @ dense[i]
        assert np.allclose(cosines, np.sort(every)[::-1][:15], atol=1e-5) and np.allclose(every[near], cosines, atol=1e-5)


def test_toxicity_scores_against_all_products(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, "toxic")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect() if r.doc_id is not None}
    examples = {r.doc_id: r.text for r in docs.collect()}
    index, terms = model.all.index, len(model.all.terms)
    dense = np.zeros((index.n, terms))
    for j, i in enumerate(index.ids):
        at, w = model.all.vector(examples[i])
        dense[j, at] = w
    for doc_id, text in examples.items():
        if doc_id is None:
            continue
        at, w = model.all.vector(text)
        cosines = dense[:, at] @ w
        near = np.lexsort((np.arange(index.n), -np.round(cosines, 5)))[: toxicity.NEIGHBOURS]
        weight = 1 / (0.02 + np.maximum(1 - cosines[near], 0))
        vote = weight @ index.labels[near] / weight.sum() if len(at) else -1.0
        assert abs(got[doc_id] - np.interp(vote, *model.knots)) < 0.02
    few = toxicity.train(docs, labels, "toxic", labelled=50, most_bytes=5_000)
    assert 0 < few.all.index.n < 50


def test_quality_votes_against_all_products(spark):
    docs, labels = labelled(spark)
    model = quality_classifier.train(docs, labels, "quality")
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect() if r.doc_id is not None}
    for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        counts = quality_classifier.term_counts(None if r.text is None else r.text.encode())
        if not counts.any():
            assert got[r.doc_id] == model.prior
            continue
        z = model.latent(quality_classifier.weighted(counts[None], model.weights))[0]
        cosines = np.array([float(z @ v) for v in model.vectors])
        last = sorted(cosines)[-quality_classifier.NEIGHBOURS]
        weight = [max(c, 1e-6) ** quality_classifier.SHARPNESS if c >= last - 1e-6 else 0 for c in cosines]
        assert abs(got[r.doc_id] - np.dot(weight, model.labels) / sum(weight)) < 0.02


def test_language_model(spark):
    docs = documents(spark)
    out = common_scores(docs)
    train = Counter()
    rows = docs.collect()
    folds = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    for r in rows:
        if folds(r.doc_id):
            train.update(tokens(r.text))
    n, v = sum(train.values()), len(train)
    for r in rows:
        mine = [x for x in out if x.doc_id == r.doc_id][0]
        want = sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r.text))
        assert math.isclose(mine.base_score, want, rel_tol=1e-9) and mine.train_tokens == n
        assert (mine.n_tokens, mine.n_known) == (len(tokens(r.text)), sum(train[t] > 0 for t in tokens(r.text)))
    assert len(out) == len(rows) and all(x.score < 0 for x in out)
    assert language_model.score(empty(spark), *language_model.train(empty(spark))).count() == 0


def test_language_model_scores_against_the_table(spark):
    """Each token by itself: its unit after the unit before it, and its smoothed share of the unit's count."""
    docs = documents(spark).withColumn("score", F.lit("clash"))
    counts, lexicon, table = language_model.train(docs)
    got = {r.doc_id: r.score for r in language_model.score(docs, counts, lexicon, table).collect() if r.doc_id is not None}
    n = {r.word.encode(): r.n for r in counts.collect()}
    top = sorted((w for w in n if w), key=lambda w: (-n[w], w))[: language_model.WORD_UNITS]
    number = {w: i for i, w in enumerate(top)}
    unit = lambda w: language_model.END if w == b"" else number.get(w, language_model.ending_unit(w))
    rest = [w for w in n if w and w not in number]
    of_unit = {u: [w for w in rest if unit(w) == u] for u in {unit(w) for w in rest}}
    for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        before, want = language_model.END, 0.0
        for w in [*(r.text or "").encode().lower().split(), b""]:
            u = unit(w)
            want += float(table[before, u])
            if u >= language_model.WORD_UNITS and u != language_model.END:
                total = sum(n[x] for x in of_unit.get(u, [])) + language_model.SMOOTH * (len(of_unit.get(u, [])) + 1)
                want += math.log10((n.get(w, 0) + language_model.SMOOTH) / total)
            before = u
        assert math.isclose(got[r.doc_id], want, rel_tol=1e-4, abs_tol=1e-3)


def common_scores(docs):
    from siltstone.llm import common

    return language_model.score(docs, *language_model.train(docs.where(~common.held_out(F.col("doc_id"), 10, 0)))).collect()


def test_log_bilinear_table_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    pairs = np.zeros((language_model.UNITS, language_model.UNITS))
    pairs[:20, :20] = rng.integers(0, 5, (20, 20))
    pairs[3, 7] = 500
    table = language_model.fit(pairs, steps=150)
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-3) and table[3].argmax() == 7


def test_decontamination_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(9)
    items = [words(rng, 30), "a b c", "", None, "the", "so", "so so so so", words(rng, 13).upper(), words(rng, 40)]
    items.append(items[0])
    texts = [items[0], f"x {items[0]} y", items[0][: len(items[0]) // 2], "so A, b; C!", "a b", items[7].lower() + " " + words(rng, 500), words(rng, 400) + items[8] + " " + items[8], None, "", items[8][10:], "the the so so so so the", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, texts[0])], "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    for pass_words, hot in ((50_000, 10_000), (3, 10_000), (50_000, 0)):
        monkeypatch.setattr(decontamination, "HOT_WORD", hot)
        got = decontamination.contamination(docs, bench, pass_words=pass_words).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            d = split(texts[r.doc_id or 0])
            hit, found = set(), set()
            for i, t in enumerate(items):
                w = split(t)
                k = min(13, len(w))
                for s in range(len(w) - k + 1 if w else 0):
                    for at in range(len(d) - k + 1):
                        if d[at : at + k] == w[s : s + k]:
                            hit |= set(range(at, at + k))
                            found.add(str(i))
            assert (r.n_words, r.n_hit, r.n_items) == (len(d), len(hit), len(found))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(d))
    assert decontamination.contamination(docs, bench.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def near_copies(spark):
    import random

    rng = random.Random(4)
    base = words(rng, 120).split()
    rows = []
    for i in range(40):  # a family of edited copies, some too far from all others
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((5000 + i, " ".join(w), "en", "a", 1))
    return documents(spark, rows + [(6000, " ".join(base).upper(), "en", "a", 1), (6001, "a b c", "en", "a", 1), (6002, "A  B\nc", "en", "a", 1)])


@pytest.mark.parametrize("small", [False, True])
def test_minhash_against_brute_force(spark, monkeypatch, small):
    """Also with every key hot and every block tiny, so that all ways of splitting are gone through."""
    if small:
        for where, name, value in ((minhash, "BUCKET_ROWS", 3), (minhash, "PIVOT_PAIRS", 2), (minhash, "BLOCK_ROWS", 4), (common, "HOT_ROWS", 1), (components, "HUB_LINKS", 1)):
            monkeypatch.setattr(where, name, value)
    docs = near_copies(spark)
    out = minhash.near_duplicates(docs).toPandas()
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    ids = sorted(d for d in sets if d is not None)
    part = {d: d for d in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = {d: low if p == high else p for d, p in part.items()}
    assert len(out) == docs.count()
    for r in out.dropna(subset=["doc_id"]).itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), part[r.doc_id], part[r.doc_id] == r.doc_id)
    assert out[out.doc_id.isna()].kept.all() and minhash.near_duplicates(empty(spark)).count() == 0
    one = minhash.keep_one(docs)
    assert one.columns == docs.columns and one.count() == len(set(part.values())) + 1


def test_texts_of_one_id_are_linked(spark):
    rng = random.Random(8)
    x, y, z = (words(rng, 60) for _ in range(3))
    rows = [(5, x), (5, y), (1, x), (9, y + " more"), (7, z), (8, z), (7, z)]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 1), (1, 1), (9, 1), (7, 7), (8, 7)}
    one = minhash.keep_one(spark.createDataFrame([(5, x, 2), (5, y, 1), (7, z, 4), (7, z, 3)], "doc_id long, text string, _id_ long"))
    assert one.columns == ["doc_id", "text", "_id_"] and sorted(r.doc_id for r in one.collect()) == [5, 7]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])
    agree = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(agree - 0.6) < 0.12
