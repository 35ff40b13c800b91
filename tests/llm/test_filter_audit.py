import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from siltstone.llm import filter_audit
from tests.llm.helpers import DOCS, documents, empty, words


def failing(rows):
    """By hand: the filters that each row fails."""
    out = []
    for doc_id, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copies = doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x in rows)
        upper = len(re.findall("[A-Z]", t))
        out.append("".join(f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * upper > 5 * len(t), re.search(r"[#$%&*|]", t), copies)) if bad))
    return out


def test_every_order_against_brute_force(spark):
    rng = random.Random(8)
    extra = [(100 + i, words(rng, 60) + rng.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2, " a b c" * 40]), "en", rng.choice(["a", None, "C"]), 1) for i in range(40)]
    extra += [(200 + i, "one text for all " * 20, "en", "hot", 1) for i in range(50)] + [(200, "one text for all " * 20, "en", "hot", 1), (None, None, None, None, None)]
    docs = documents(spark, extra).withColumns({c: F.lit("clash") for c in ("part", "failing", "_row", "good", "before")})
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 250, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit(docs, marks).collect()}

    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    fails = failing([r[:2] for r in rows])
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    removed_in = {}
    for part in {s or "" for *_, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            alive = mine
            for k, f in enumerate(order):
                out = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                every = sum(f in x[1] for x in mine)
                removed_in[part, f] = removed_in.get((part, f), 0) + len(out)
                want = len(alive), len(out), every - len(out), sum(x[1] == f for x in mine), sum(x[0] in good for x in out), sum(x[0] in toxic for x in out)
                assert found[part, order, k + 1][:6] == want, (part, order, k)
    assert all(v[6] == removed_in[p, o[k - 1]] for (p, o, k), v in found.items())
    assert len(found) == 600 * len({s or "" for *_, s in rows})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty(spark), none).count() == 0
    out = filter_audit.audit(spark.createDataFrame([(1, "x", "en", "s", 1)], DOCS), none)
    assert {(r.kept, r.removed) for r in out.where("filter_order = 'ABCDE'").collect()} == {(0, 1), (0, 0)} and out.count() == 600
