import hashlib
import random
import time
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from timeloom.llm import bpe

from .cases import TEXTS, frame


BYTES = {b: c for c, b in bpe._byte_alphabet().items()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.pack_tables(bpe.Vocabulary()))


def texts():
    random.seed(7)
    alphabet = " \t\n\x0b\r\x1c\x85\xa0'sStTdlLve.,!?aé1²٣ ᠎​_-中文😀аб"
    made = ["".join(random.choices(alphabet, k=random.randint(1, 40))) for _ in range(1500)]
    made += ["".join(random.choices("abc", k=random.randint(1, 60))) for _ in range(500)] + ["a" * n for n in range(1, 80)]
    marks = ["<|endoftext|>", "a<|endoftext|> b", "<|endoftext|", "x <|endoftext|>\n<|endoftext|>y"]
    return [t for t in TEXTS if t is not None] + made + marks + ["é" * 3000, "aA" * 5000]


def test_ids_and_texts_are_the_librarys(library, encoder):
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        ids = encoder.encode(t)
        assert list(array("I", ids)) == want, t[:80]
        assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)
    broken = [255, 50256, 163, 40]
    assert encoder.decode(array("I", broken).tobytes()) == library.decode(broken, skip_special_tokens=False)


def test_every_token_is_its_own_encoding_or_is_never_made(library, encoder):
    for i in random.Random(3).sample(sorted(encoder.token), 4000):
        piece = encoder.token[i].decode("utf-8", "replace")
        if "�" not in piece:
            assert list(array("I", encoder.encode(piece))) == library.encode(piece, add_special_tokens=False).ids


def test_bounded_tables_change_nothing(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    fresh = bpe.Encoder(bpe.pack_tables(bpe.Vocabulary()))
    for t in texts()[:300]:
        assert fresh.encode(t) == encoder.encode(t)


def test_query(spark, small, library):
    docs = frame(spark).select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    source = {r.doc_id: r.text or "" for r in docs.collect()}
    out = {r.doc_id: r for r in bpe.digest(docs).collect()}
    assert out.keys() == source.keys()
    for k, t in source.items():
        e = library.encode(t, add_special_tokens=False).ids
        assert (out[k].n_tokens, out[k].ids_sha256) == (len(e), hashlib.sha256(array("I", e).tobytes()).hexdigest())
        assert out[k].decoded_sha256 == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_columns_round_trip(spark):
    df = frame(spark)
    out = bpe.decode_column(bpe.encode_column(df))
    assert out.columns == [*df.columns, "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in out.collect())
    assert bpe.encode_column(frame(spark, [])).count() == 0


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([("a b", "in", 1, "row", [7])], "text string, in_ string, out_ long, row_ string, ids array<int>")
    out = bpe.encode_column(df)
    r = out.first()
    assert out.columns == df.columns and (r.text, r.in_, r.out_, r.row_) == ("a b", "in", 1, "row") and len(r.ids) == 2
    assert bpe.decode_column(out.select("ids")).first().decoded == "a b"


def test_very_long_pieces(library, encoder):
    for t in (" " * 1_000_000, "x" * 300_000, "many words " * 50_000, "\n" * 300_000 + "é\u4e2d"):
        ids = encoder.encode(t)
        assert list(array("I", ids)) == library.encode(t, add_special_tokens=False).ids and encoder.decode(ids) == t


def words(n, low=1, high=16, letters="abcdefghijklmnopqrstuvwxyzé-中😀"):
    made = random.Random(11)
    return ["".join(made.choices(letters, k=made.randint(low, high))) for _ in range(n)]


def test_new_pieces_do_not_cost_a_walk_each(library):
    text = " ".join(words(40_000, 4, 14, "abcdefghijklmnopqrstuvwxyzé"))
    tables = bpe.pack_tables(bpe.Vocabulary())
    fresh, walker = bpe.Encoder(tables), bpe.Encoder(tables)
    pieces = {p.encode() for p in fresh.split(text)}
    began = time.process_time()
    ids = fresh.encode(text)
    together = time.process_time() - began
    assert list(array("I", ids)) == library.encode(text, add_special_tokens=False).ids
    began = time.process_time()
    for p in pieces:
        walker.encode_bytes(p)
    assert together < (time.process_time() - began) / 1.5


def test_steps_and_walks_agree(library, encoder):
    pieces = [p.encode() for p in {*words(3000), *words(300, 20, 64), *("x" * n for n in range(1, 65))}]
    want = [library.model.tokenize("".join(BYTES[c] for c in p)) for p in pieces]
    assert [list(array("I", x)) for x in encoder.encode_pieces(pieces)] == [encoder.encode_bytes(p) for p in pieces] == [[t.id for t in x] for x in want]


def test_texts_with_more_pieces_than_are_kept(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 700)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 64)
    monkeypatch.setattr(bpe, "IDS_AT_ONCE", 100)
    fresh = bpe.Encoder(bpe.pack_tables(bpe.Vocabulary()))
    texts = [None, " ".join(words(5000)), "", "y" * 200 + " <|endoftext|> y<|endoftext|>" + "y" * 200, *words(900), " ".join(words(900))]
    for some in (texts, texts[1:4], texts[::-1]):
        out = fresh.encode_all(some)
        assert len(fresh.pieces) <= 700 and not any(len(p) > bpe.LONGEST_KEPT for p in fresh.pieces)
        assert [list(array("I", x)) for x in out] == [library.encode(t or "", add_special_tokens=False).ids for t in some]
        assert [fresh.decode(x) for x in out] == [t or "" for t in some]


def test_unknown_ids_are_an_error(encoder):
    for ids in ([50257], [0, 4_000_000_000]):
        with pytest.raises((KeyError, IndexError)):
            encoder.decode(array("I", ids).tobytes())
