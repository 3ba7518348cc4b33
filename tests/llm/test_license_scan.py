import math
import random
import re

import pytest

from timeloom.llm import license_scan as L

from .cases import TEXTS, frame

LINES = [
    "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0.", "mit-license MIT\nLICENSE mit licenses Apache  license general public license apache license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission is hereby granted to nobody, free of charge to any person",
    "GNU Lesser General Public License", "the license of mit", "a mit mit license license",
]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force(spark, small):
    docs = frame(spark, TEXTS + LINES).select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_templates_are_verified(spark):
    got = [r.labels for r in L.scan(frame(spark, LINES)).orderBy("doc_id").collect()]
    assert got == ["mit", "gpl", "cc-by-nc", "apache", "apache,gpl,mit", "mit", "", "gpl,lgpl", "", "mit"]


def test_frequencies_cover_all_documents(spark):
    found, total = L.word_frequencies(frame(spark, LINES))
    assert total == len(LINES) and found[b"mit"] == 4 and b"" not in found
    assert L.scan(frame(spark, [])).count() == 0


def marked(label, t):
    plain, mandatory, at = [], [], None
    for w in t.split():
        at = len(plain) if w.startswith("[") else at
        plain.append(w.strip("[]").encode())
        if w.endswith("]"):
            mandatory.append((at, plain[at:]))
    return label, plain, mandatory


def brute_templates(text, templates=None):
    """Labels and score by trying every template at every position."""
    words = L.words_of(text)
    found, best = set(), 0.0
    for label, plain, mandatory in templates or [marked(*x) for x in L.TEMPLATES]:
        for shift in range(-len(plain), len(words)):
            if all(shift + s >= 0 and words[shift + s : shift + s + len(ws)] == ws for s, ws in mandatory):
                found.add(label)
                best = max(best, sum(0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(plain)) / len(plain))
    return found, best


def notices():
    """Whole, cut and altered notices, among other words and twice over."""
    plain = [re.sub(r"[\[\]]", "", t) for _, t in L.TEMPLATES]
    out = []
    for i, t in enumerate(plain):
        words = t.split()
        out += [t, f"Some code. {t.title()}! And more", " ".join(words[2:]), " ".join(words[:-2]), " ".join([*words[:3], "other", *words[3:]]), f"{t} or {plain[(i + 5) % len(plain)]}", f"{words[0]} {t}"]
    return [*out, " ".join(plain), " ".join(plain * 40)]


def test_labels_and_score_match_brute_force(spark, small):
    docs = frame(spark, [*LINES, *notices()]).select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.scan(docs).collect():
        labels, best = brute_templates(texts[r.doc_id])
        base = {x for x in r.base_labels.split(",") if x}
        assert r.labels == ",".join(sorted(labels | base)) and abs(r.score - max(best, 1.0 if base else 0.0)) < 1e-12, texts[r.doc_id][:200]


def whole_texts():
    """Sixty licences of 80 to 400 words: much of each is shared with others, and of each only some words are its own."""
    rnd = random.Random(8)
    shared = [[f"legal{rnd.randrange(300)}" for _ in range(40)] for _ in range(12)]
    out = []
    for i in range(60):
        own = [f"licence{i}"] + [f"term{(i * 3 + k) % 90}" for k in range(14)]
        parts = [*rnd.sample(shared, rnd.randrange(2, 9)), own]
        rnd.shuffle(parts)
        out.append((f"l{i}", " ".join(w for p in parts for w in p)))
    return out


def plain_phrase(words, templates, documents):
    """The window of words whose summed rarity, in documents and in templates, is the highest, by trying each."""
    rare = lambda w: math.log((len(documents) + 1) / (sum(w in d for d in documents) + 1)) + math.log((len(templates) + 1) / sum(w in t for t in templates))
    worth = {w: rare(w) for w in set(words)}
    n = min(L.KEY_WORDS, len(words))
    best = max(range(len(words) - n + 1), key=lambda i: (round(sum(worth[w] for w in words[i : i + n]), 9), -i))
    return best, words[best : best + n]


def test_whole_licence_texts_from_a_table(spark, small):
    licences = whole_texts()
    texts = [t for _, t in licences] + [f"code before {t.upper()}; and after" for _, t in licences[:20]] + [" ".join(t.split()[:50]) for _, t in licences[:20]] + [licences[3][1] + " x " + licences[9][1], licences[5][1].replace("term", "other"), "Released under the MIT License."]
    docs = frame(spark, texts).select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    table = spark.createDataFrame([*licences, (None, "x"), ("none", None), ("none", " . "), licences[0]], "label string, text string")
    rows = {r.doc_id: r.text for r in docs.collect()}
    words, documents = [L.words_of(t) for _, t in licences], [set(L.words_of(t)) for t in rows.values()]
    sets = [set(w) for w in words]
    known = [(label, ws, [plain_phrase(ws, sets, documents)]) for (label, _), ws in zip(licences, words, strict=True)]
    got = {r.doc_id: r for r in L.scan(docs, table).collect()}
    for d, text in rows.items():
        labels, best = brute_templates(text, known)
        base = {x for x in got[d].base_labels.split(",") if x}
        assert got[d].labels == ",".join(sorted(labels | base)) and abs(got[d].score - max(best, 1.0 if base else 0.0)) < 1e-12
    assert all(got[i].labels == f"l{i}" and got[i].score == 1.0 for i in range(60)) and got[len(texts) - 3].labels == "l3,l9"


def test_too_many_templates(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_TEMPLATES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        L.scan(frame(spark, LINES), spark.createDataFrame([(str(i), "x y") for i in range(3)], "label string, text string"))


def test_a_very_long_text(spark):
    text = "word and more, " * 400_000 + "Released under the MIT License. " + "license mit " * 200_000
    r = L.scan(frame(spark, [text])).collect()[0]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (*brute(text), "mit", 1.0)
