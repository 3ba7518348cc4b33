import pickle
import random
import zlib

import numpy as np
import pytest

from timeloom.llm import language_id as L

from .cases import TEXTS, frame


def brute_phrases(text, sample):
    """Greedy longest matches by substring search, in blocks."""
    n = 0
    for at in range(0, len(text), L.BLOCK):
        block, i = text[at : at + L.BLOCK], 0
        while i < len(block):
            k = 1
            while i + k < len(block) and block[i : i + k + 1] in sample and block[i : i + k] in sample:
                k += 1
            n, i = n + 1, i + k
    return n


def test_phrases_match_brute_force():
    samples = {"a": "the cat sat on the mat. THE DOG", "b": "le chat est là, sur le tapis"}
    model = L.Model(samples).prepare()
    texts = ["the cat", "", "zzz", "là là là", "The Dog sat là 12 ??", "the " * 400, "x"]
    coded = [L.encode(t, model.codes) for t in texts]
    got = model.phrases(coded)
    for k, s in enumerate(model.samples):
        assert got[:, k].tolist() == [brute_phrases(c.tobytes(), s) for c in coded]
    # what matches nowhere goes to the smaller sample, whose phrases cost fewer bits
    assert [x for x, _ in model.predict(texts)] == ["a", "und", "b", "b", "a", "a", "b"]


def test_every_letter_of_the_samples_has_its_own_code():
    rnd = random.Random(3)
    low, high = [chr(0x4E00 + i) for i in range(400)], [chr(0xC000 + i) for i in range(60)]
    many = "".join(rnd.choice(low) for _ in range(3000))
    samples = {"a": many + "".join(high), "b": many + "".join(reversed(high)), "c": "the cat sat on the mat", "d": "abc " + "".join(high[:30]) * 3}
    model = L.Model(samples).prepare()
    kinds = [(type(s).__name__, own is not None) for s, own in model.steps]
    assert kinds == [("SparseSteps", True)] * 2 + [("DenseSteps", True)] * 2
    texts = ["".join(high[5:40]), "".join(reversed(high[5:40])), "the cat", many[100:1500] + "the cat" + high[3], "", "".join(rnd.choice(low + high + ["x", " ", "\u0e01"]) for _ in range(1300))]
    got = model.phrases([L.encode(t, model.codes) for t in texts])
    # letters that no sample has are all one character, which none of them holds
    assert got.tolist() == [[brute_phrases(t, samples[x]) for x in model.langs] for t in texts]
    assert [x for x, _ in model.predict(texts)][:3] == ["a", "b", "c"]
    assert pickle.loads(pickle.dumps(model)).phrases([L.encode(t, model.codes) for t in texts]).tolist() == got.tolist()


def test_split_and_bounds(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.withColumn("b", L.bucket_of(docs["doc_id"])).collect()
    assert all(r.b == zlib.crc32(str(r.doc_id).encode()) % 3 for r in rows)
    sample = L.learning_sample(docs)
    allowed = {lang: [r.text for r in rows if r.lang == lang and r.b != 1] for lang in sample}
    for lang, text in sample.items():
        assert len(text) <= L.CHARS_PER_LANGUAGE and any(text.startswith(t[:50]) for t in allowed[lang])


def test_a_language_of_mostly_null_texts_is_learned(spark):
    texts = [None if i % 1000 else f"only text {i}" for i in range(8000)]
    docs = frame(spark, texts, ["en"] * len(texts))
    allowed = {r.text for r in docs.filter("text is not null").withColumn("b", L.bucket_of(docs["doc_id"])).filter("b <> 1").collect()}
    assert allowed and set(L.learning_sample(docs)["en"].split("\n")) == allowed


def test_held_out_accuracy(spark, small):
    out = L.op2_language_id(spark, small)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.95


def test_defined_cases(spark):
    docs = frame(spark, [*TEXTS, "12 34 !?", "\n"])
    rows = {r.li_row.doc_id: r for r in L.predict(docs, L.learn(docs)).collect()}
    for i in (0, 1, 2, 3, 4, len(TEXTS), len(TEXTS) + 1):
        assert (rows[i].li_lang, rows[i].li_score) == (L.UNKNOWN, 0.0)
    kept = L.keep_known(docs)
    assert kept.columns == docs.columns and kept.filter("text is null or lang is null").count() == 0
    none = frame(spark, ["some text"], [None])
    assert [r.li_lang for r in L.predict(none, L.learn(none)).collect()] == [L.UNKNOWN]
    assert L.keep_known(frame(spark, [])).count() == 0


def test_no_model_keeps_texts_with_letters(spark):
    texts = ["some text", None, "12 34 !?", "\u4e2d\u6587", "", "held out"]
    assert [r.doc_id for r in L.keep_known(frame(spark, texts, [None] * 6)).orderBy("doc_id").collect()] == [0, 3, 5]


@pytest.mark.parametrize("text", ["中文字", "ß"])
def test_unknown_letters_tie(text):
    model = L.Model({"b": "abc", "a": "abc"}).prepare()
    assert model.predict([text]) == [("a", 0.5)]


def scripts():
    """Three languages of over 500 letters each, of scripts of their own, and one that mixes them."""
    rnd = random.Random(21)
    letters = {"x": [chr(0x4E00 + i) for i in range(600)], "y": [chr(0x5E00 + i) for i in range(600)], "z": [chr(0xAC00 + i) for i in range(600)]}
    words = {lang: ["".join(rnd.choices(own, k=rnd.randint(2, 4))) for _ in range(900)] for lang, own in letters.items()}
    words["mixed"] = ["".join(rnd.choice(rnd.choice(list(letters.values()))) for _ in range(3)) for _ in range(900)]
    return [(lang, " ".join(rnd.choices(own, k=60))) for _ in range(120) for lang, own in words.items()]


def test_scripts_of_many_letters_are_told_apart(spark):
    rows = scripts()
    docs = frame(spark, [t for _, t in rows], [lang for lang, _ in rows])
    out = L.predict(docs, L.learn(docs)).collect()
    assert all(r.li_lang == rows[r.li_row.doc_id][0] for r in out) and min(r.li_score for r in out) > 0.5


def test_very_many_languages(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    texts = [f"text of {i % 9} words" for i in range(90)] + ["more words"] * 30
    langs = [f"l{i % 9}" for i in range(90)] + ["l7"] * 30
    assert list(L.learning_sample(frame(spark, texts, langs)))[0:1] and "l7" in L.learning_sample(frame(spark, texts, langs))
    assert len(L.learning_sample(frame(spark, texts, langs))) == 3


def test_very_long_texts(spark):
    docs = frame(spark, ["the cat sat on the mat " * 100_000, "le chat est sur le tapis " * 100_000, " " * 3_000_000, *["the cat sat on the mat", "le chat est sur le tapis"] * 20], ["en", "fr", None, *["en", "fr"] * 20])
    got = {r.li_row.doc_id: r.li_lang for r in L.predict(docs, L.learn(docs)).collect()}
    assert (got[0], got[1], got[2]) == ("en", "fr", "und")
