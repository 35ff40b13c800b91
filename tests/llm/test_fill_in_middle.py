import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import fill_in_middle as fim
from tests.llm.helpers import documents, empty


def by_hand(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def awkward():
    rng = random.Random(5)
    rows = [(300 + i, "".join(rng.choice(["a", "é", "日", "\n", "<", "S>", "<S", "\r", "𝄞", " "]) for _ in range(rng.randint(0, 300))), "en", "a", 1) for i in range(150)]
    rows += [(500, "no line end " * 30_000, "en", "a", 1), (501, ("é" * 700 + "\n") * 400, "en", "a", 1), (502, "\n" * 5000, "en", "a", 1), (503, "x<M>y\nz", "en", "a", 1), (504, "last<\n<", "en", "a", 1)]
    return rows


@pytest.mark.parametrize("frame_bytes", [fim.FRAME_BYTES, 37])
@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0)])
def test_against_the_whole_texts(spark, tmp_path, frame_bytes, rate, spm):
    docs = documents(spark, awkward()).withColumns({c: F.lit("clash") for c in ("n", "frames", "form", "output", "marked")})
    out = fim.transform(fim.store(docs, str(tmp_path / "s"), frame_bytes), rate=rate, spm=spm, with_output=True)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in docs.select("doc_id", "text").collect():
        n, form, head, middle, made = by_hand(i, t, rate=rate, spm=spm)
        want.append((i, n, form, head, middle, sha(made), sha(t or ""), made))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    again = sorted((repr(r.doc_id), r.text) for r in fim.restore(out).collect())
    assert again == sorted((repr(r.doc_id), r.text or "") for r in docs.collect())


def test_a_cut_reads_its_frame_only(monkeypatch):
    text = "".join(f"line {i}\n" for i in range(5000)).encode()
    doc, read = fim.stored(text, 1000), []
    whole = fim.Stored.frame
    monkeypatch.setattr(fim.Stored, "frame", lambda self, i: read.append(i) or whole(self, i))
    for k in (0, 1, 2500, 4999, 5000):
        read.clear()
        i, at = doc.place(k)
        assert len(read) <= 1 and b"".join(doc.between((0, 0), (i, at))).count(b"\n") == k
    assert len(doc.frames) > 40 and max(len(whole(doc, i)) for i in range(len(doc.frames))) <= 1000


def test_empty_table(spark, tmp_path):
    assert fim.transform(fim.store(empty(spark), str(tmp_path / "s"))).count() == 0
