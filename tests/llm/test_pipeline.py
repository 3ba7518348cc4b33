import pytest

import corpus_pipeline as C
from timeloom.llm import language_id as L
from timeloom.llm import packing
from timeloom.llm.storage import materialise, release

from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_classes
from .test_pii import brute as brute_pii


@pytest.fixture(scope="module")
def staged(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in C.STAGES:
        new = materialise(stage(spark, docs, small), name)
        out.append((docs, new))
        docs = new
    yield dict(zip([n for n, _ in C.STAGES], out, strict=True))


def test_columns_and_order(staged, spark, small):
    assert list(staged) == ["language_id", "line_dedup", "near_dedup", "pii", "packing"]
    columns = spark.read.parquet(f"{small}/documents.parquet").dtypes
    for name in list(staged)[:-1]:
        assert staged[name][1].dtypes == columns


def test_language_stage(staged):
    before, after = staged["language_id"]
    und = {r.li_row.doc_id for r in L.predict(before, L.learn(before)).filter("li_lang = 'und'").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - und


def test_line_stage(staged):
    before, after = staged["line_dedup"]
    want = brute_lines([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {d: (t, len(t)) for d, (t, _, _) in want.items()}


def test_near_stage(staged):
    before, after = staged["near_dedup"]
    want = brute_classes([(r.doc_id, r.text) for r in before.collect()], 5)
    assert {r.doc_id for r in after.collect()} == {d for d, (_, _, kept) in want.items() if kept}


def test_pii_stage(staged):
    before, after = staged["pii"]
    texts = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        found = any(brute_pii(r.text))
        assert found or texts[r.doc_id] == r.text or "[TERM]" in texts[r.doc_id]
        assert not any(brute_pii(texts[r.doc_id]))
    assert len(texts) == before.count()


def test_packing_stage(staged, spark, small):
    before, after = staged["packing"]
    tokens = packing.Tokens.of(packing.default_path())
    sizes = {r.doc_id: len(tokens.ids(r.text)) for r in before.collect()}
    got = {r.doc_id: r.n for r in after.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert got == sizes
    assert C.run(spark, small).groupBy().sum("length").first()[0] == sum(sizes.values())
    assert release(spark) > 0
