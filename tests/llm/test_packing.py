import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from timeloom.llm import packing as P

from .cases import TEXTS, frame


def check(rows, ids, capacity=1024):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(array("I", ids[d][at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids[d])
    for own in by_window.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_window)


def test_pieces_cover_the_librarys_ids(spark, small):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame(spark, [*TEXTS, "a<|endoftext|> b"]).select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    windows = check(P.pack(docs.repartition(3, "doc_id")).collect(), ids)
    assert sum(map(len, ids.values())) >= 0.95 * 1024 * windows


def test_small_windows_and_merging(spark, monkeypatch):
    monkeypatch.setattr(P, "MERGE_GROUP", 4)
    texts = [("word " * (i * 7 % 50)).strip() for i in range(300)]
    tokens = P.Tokens.of(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tokens.ids(t).tolist() for i, t in enumerate(texts)}
    rows = P.pack(frame(spark, texts).repartition(5), capacity=64, open_windows=3).collect()
    check(rows, ids, 64)
    assert P.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [1, 2, 64])
def test_space_is_bounded(most):
    import numpy as np

    w = P.Windows(100, most, 0)
    for n in range(1, 400):
        w.add(n, np.arange(n * 37 % 250 + 1, dtype="<u4"))
        assert len(w.open) <= most and all(f < 100 for f, _ in w.open)


def test_long_white_space_is_the_librarys():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = P.Tokens.of(public_tokenizers.path("byte_bpe_50k.json"))
    long = " " * 1_000_000
    for text in (long, "a" + long, "\n" * 1_000_000 + "x", "one " + " \t" * 30_000 + "two  three", "é\u3000\u4e2d" + "\u00a0" * 20_000 + " b", " " * 5_000_000, "word " * 400_000, "x" * 1_000_000):
        assert tokens.ids(text)[:-1].tolist() == library.encode(text, add_special_tokens=False).ids


def test_very_long_texts_are_packed(spark):
    texts = [" " * 1_500_000 + "x", "many words " * 60_000, None]
    tokens = P.Tokens.of(public_tokenizers.path("byte_bpe_50k.json"))
    check(P.pack(frame(spark, texts)).collect(), {i: tokens.ids(t).tolist() for i, t in enumerate(texts)})
