from collections import defaultdict

import duckdb
import pytest

from timeloom.llm import line_dedup as L

from .cases import TEXTS, frame

WS = " \t\n\x0b\x0c\r"
LONG = "This line is shared by many documents, and is long."


def brute(rows, min_chars=40, min_docs=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WS).translate(low)
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != d)]
        out[d] = (None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_matches_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(L, "BROADCAST_IDS", broadcast)
    texts = TEXTS + [f"intro {i}\n  {LONG.upper() if i % 2 else LONG}\t\n{LONG}\nend" for i in range(7)] + [LONG[:39] + "\nx"] * 6 + ["é" * 40] * 5 + ["é" * 39] * 5 + [f"{LONG}\n" * 20_000 + "line " * 200_000]
    docs = frame(spark, texts)
    got = {r.ld_row.doc_id: (r.ld_text, r.ld_lines, r.ld_dropped) for r in L.drop_shared(docs).collect()}
    assert got == brute(list(enumerate(texts)))
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    assert L.dedup_lines(frame(spark, [])).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, LONG), (1, LONG), (1, LONG), (2, LONG), (3, LONG), (4, LONG), (5, LONG)]
    out = L.drop_shared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.ld_row.doc_id or 0, r.ld_dropped) for r in out) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0)]


def test_sql_agrees(spark, small):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(duck.sql(L.OP4_SQL).fetchall())
    got = sorted(tuple(r) for r in L.op4_line_dedup(spark, small).collect())
    assert got == want and any(r[2] for r in got)


@pytest.mark.parametrize("text,n", [(" " * 30 + "x" * 39, None), ("x" * 40, 16)])
def test_key_length(text, n):
    key = L.line_key(text, 40)
    assert (key and len(key)) == n
