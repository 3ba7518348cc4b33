import hashlib
import random
from collections import defaultdict

import numpy as np

from timeloom.llm import suffix_dedup as S

from .cases import TEXTS, frame


def brute(texts, length=200):
    places = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            places[d[i : i + length]] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if places[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(d)))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int(runs), hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (30, 45, 60, 120, 300)]
    out = []
    for _ in range(60):
        parts = [prose(rnd.randint(1, 80))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            cut = rnd.randint(0, len(p) // 3)
            parts += [p[cut : len(p) - rnd.randint(0, len(p) // 3)], prose(rnd.randint(0, 40))]
        out.append(" ".join(parts))
    base = out[0] + prose(200)
    for _ in range(15):
        own = base.split(" ")
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(len(own))] = word()
        out.append(" ".join(own))
    edge = prose(100)
    out += [edge[:199], edge[:200], edge[:201] + "x", "y" + edge[:200], "z" * 450, "ab" * 300, edge[:150] * 3, prose(90) * 2]
    return out


def same(spark, texts):
    out = S.cut_repeats(frame(spark, texts)).selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "sha2(coalesce(kept, X''), 256) AS h").collect()
    got = {r.doc_id: tuple(r)[1:] for r in out}
    want = dict(enumerate(brute(texts)))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], (k, texts[k] and texts[k][:100])


def test_matches_brute_force(spark):
    same(spark, [*TEXTS[:16], *made(3)])


def test_by_shuffle_and_empty(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_IDS", 0)
    same(spark, made(8))
    assert S.cut_repeats(frame(spark, [])).count() == 0


def test_texts_of_many_segments(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 333)
    rnd = random.Random(12)
    long = " ".join("".join(rnd.choices("abcdefg", k=5)) for _ in range(900))
    same(spark, [*made(5), long, long[700:2000] + "x" + long[2100:], "q" * 3000])


def test_a_very_long_text(spark):
    """20 MB: five segments, of which two passages repeat."""
    rnd = np.random.default_rng(4)
    data = rnd.integers(97, 123, 20_000_000, dtype=np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(1, data), (2, data[4_194_000:4_194_900]), (3, "-" + data[9_000_000:9_000_400])], "doc_id long, text string")
    out = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.cut_repeats(docs).select("row", "n_bytes", "n_removed", "n_spans").collect()}
    assert out == {1: (20_000_000, 1300, 2), 2: (900, 900, 1), 3: (401, 400, 1)}


def test_columns_with_clashing_names_pass(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, True, "k", 7), (2, text + " more", None, "l", 8)], "doc_id long, text string, sd_null boolean, kept string, row long")
    got = sorted(S.remove_repeats(docs).collect())
    assert [tuple(r) for r in got] == [(1, "", True, "k", 7), (2, " more", None, "l", 8)]


def test_repeated_rows_and_texts(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + " tail"), (2, None), (3, "é" * 99 + "xy" + "é" * 100)], "doc_id long, text string")
    out = S.cut_repeats(docs).collect()
    n = len(text)
    assert sorted((r.row.doc_id or 0, r.n_removed) for r in out) == [(0, n), (1, n), (1, n), (2, 0), (3, 0)]
    kept = S.remove_repeats(docs).collect()
    assert sorted((r.text is None, r.text or "") for r in kept) == [(False, ""), (False, ""), (False, " tail"), (False, "é" * 99 + "xy" + "é" * 100), (True, "")]


def test_small_table_matches_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.text for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in S.op8_suffix_dedup(spark, small).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}
    assert any(w[1] for w in want)
