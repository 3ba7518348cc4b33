import random
import re
from collections import defaultdict

import numpy as np
import pytest

from timeloom.llm import near_dedup as N
from timeloom.llm.components import components

from .cases import TEXTS, frame


def brute(rows, width, percent=80):
    sets = {}
    for d, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        grams = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}
        sets[d] = grams if words else set()
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for e in index[x]:
                if e < d:
                    common[e] += 1
        for e, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def family(seed, n, words, edits):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randrange(edits)):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("width", "hubs"), [(2, 2), (5, 2), (2, 1)])
def test_matches_brute_force(spark, small, width, hubs, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_DOCS", 30)
    monkeypatch.setattr(N, "HUBS", hubs)
    monkeypatch.setattr(N, "GROUP_ROWS", 50)
    made = family(1, 120, 100, 14) + family(2, 60, 40, 6) + family(3, 40, 300, 40) + family(4, 30, 6, 2)
    docs = frame(spark, [*TEXTS, *made, "A b\tC", "a B c"]).select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], width)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.classes(docs, width).collect()}
    assert got == want
    kept = {r.doc_id for r in N.drop_near_copies(docs, width).collect()}
    assert kept == {d for d, x in want.items() if x[2]}


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(5)
    errors = []
    for n in (1, 3, 10, 80, 1000):
        for share in (0.5, 0.8, 1.0):
            items = rnd.integers(0, 1 << 62, 2 * n, dtype=np.uint64)
            k = round(n * share)
            a, b = N.sketch(items[:n]), N.sketch(items[n - k : 2 * n - k])
            errors.append((a == b).mean() - k / (2 * n - k))
    assert max(map(abs, errors)) < 0.15 and np.mean(np.abs(errors)) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7), (5, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (1, "other"), (None, "lonely text")]
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert N.classes(frame(spark, []), 2).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    near, far = "a b c d e f g h i j k l m n o p q r s t", "one two three four five six seven eight nine"
    rows = [(5, near + " u"), (5, far), (2, near), (8, far), (8, "alone in the world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in N.classes(docs, 2).collect()}
    assert got == {(5, 20): (2, False), (5, 8): (5, True), (2, 19): (2, True), (8, 8): (5, False), (8, 3): (8, True)}
    kept = {(r.doc_id, r.text) for r in N.drop_near_copies(docs, 2).collect()}
    assert kept == {(5, far), (2, near), (8, "alone in the world")}


def test_blocks_let_all_classes_meet(spark, monkeypatch):
    """Pairs of different classes meet in some block; the largest class is not compared with itself."""
    from timeloom.llm.storage import Workspace

    monkeypatch.setattr(N, "BLOCK_DOCS", 7)
    rows = [(1, i, 0 if i < 60 else i // 3) for i in range(100)] + [(2, i, i) for i in range(200, 205)]
    df = spark.createDataFrame(rows, "nd_band long, nd_id long, nd_class long")
    with Workspace(spark) as w:
        dealt = N._dealt(df, "nd_band", N.F.lit(0), w).collect()
    blocks = defaultdict(list)
    for r in dealt:
        blocks[r.nd_block].append(r)
    met = set()
    for own in blocks.values():
        near = N._meets(np.array([r.nd_class for r in own]), np.array([r.nd_main for r in own]))
        met |= {(own[i].nd_id, own[j].nd_id) for i, j in zip(*np.nonzero(near), strict=True)}
    want = {(a, b) for k, a, x in rows for l, b, y in rows if k == l and x != y}
    assert met == want and max(map(len, blocks.values())) < 40
    assert sum(r.nd_main for r in dealt) == 60 * -(-40 // 7)
