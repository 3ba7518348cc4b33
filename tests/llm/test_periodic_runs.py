import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timeloom.llm import periodic_runs as R

from .cases import TEXTS, frame


def brute(words, shortest=24, repeats=3):
    """Every period, every stretch; the smallest period of a stretch is the first one that finds it."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, re.findall("[^ \t-\r]+", text or ""))
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@st.composite
def periodic(draw):
    out = []
    for _ in range(draw(st.integers(1, 4))):
        kind = draw(st.integers(0, 2))
        letters = draw(st.integers(1, 4))
        part = draw(st.lists(st.integers(0, letters), min_size=1, max_size=40))
        out += part if kind == 0 else (part * 12)[: draw(st.integers(1, 300))]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(periodic(), min_size=1, max_size=4))
def test_runs_equal_every_lag_of_every_text(texts):
    got = R.find_runs([np.array(t, np.int64) for t in texts])
    assert got == [brute(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(periodic(), st.integers(5, 40), st.integers(3, 5))
def test_other_bounds(text, shortest, repeats):
    assert R.find_runs([np.array(text, np.int64)], shortest, repeats) == [brute(text, shortest, repeats)]


@pytest.mark.parametrize("q", [15, 16, 17, 23, 24, 25, 36, 37, 100, 333, 1000])
def test_periods_around_the_scales(q):
    rng = random.Random(q)
    for letters in (2, 3, 10_000):
        unit = [rng.randrange(letters) for _ in range(q)]
        for length in (3 * q - 1, 3 * q, 3 * q + 1, 5 * q):
            text = [-5] + (unit * 6)[:length] + [-6] + [rng.randrange(letters) for _ in range(50)]
            text = [x + 10 for x in text]
            assert R.find_runs([np.array(text, np.int64)]) == [brute(text)], (q, letters, length)


def test_small_documents_and_hard_ones(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    short = [r for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    got = {r.doc_id: tuple(r)[1:] for r in R.op12_periodic_runs(spark, small).collect()}
    assert len(got) == docs.count()
    assert all(got[r.doc_id] == expected(r.doc_id, r.text) for r in short)
    assert sum(g[0] > 0 for g in got.values()) > len(got) // 20


def test_defined_cases(spark):
    texts = [*TEXTS, *TEXTS[8:10], "a b " * 20 + "c d " * 20 + " x " * 30]
    rows = R.periodic_runs(frame(spark, texts)).collect()
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for r, t in zip(rows, texts, strict=True):
        words = re.findall("[^ \t-\r]+", t or "")
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == brute(words)
    assert R.periodic_runs(frame(spark, [])).count() == 0
    ids = spark.createDataFrame([(None, "a " * 30), (1 << 60, None), ((1 << 60) + 1, "b " * 25), (1 << 60, "x")], "doc_id long, text string")
    assert [(r.doc_id, len(r.runs), r.collapsed) for r in R.periodic_runs(R.planted(ids).coalesce(1)).orderBy("doc_id", "collapsed").collect()] == [
        (None, 1, "a"), (1 << 60, 0, ""), (1 << 60, 0, "x"), ((1 << 60) + 1, 1, "b")]


def test_a_very_long_text(spark):
    rng = random.Random(5)
    unit = [f"w{rng.randrange(500)}" for _ in range(70_000)]
    text = " ".join(["before", *unit, *unit, *unit, *unit[:5], "after"] + ["same"] * 100_000)
    row = R.periodic_runs(frame(spark, [text])).collect()[0]
    assert [tuple(x) for x in row.runs][0] == (1, 210_005, 70_000) and len(row.runs) >= 2
    assert row.collapsed.split()[70_001:] == ["after", "same"]
