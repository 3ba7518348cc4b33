import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from timeloom.llm import pii as P

from .cases import TEXTS, frame

GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b.c_d@e.f x@y@z.w q@r..s @a.b a@b.c@d.e ñ@b.co é a.b-c%d+e@f-g.h1.i.", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.0255 0001.02.3.4 1.2.3 1..2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005 49927398716 4111 1111 1111 1111 5", "+1 (716) 555-8176 +12 +1234567890123456 +4 9 (0) 30.123-456 7- +1-2",
    "\U0001f600 é +1 (716) 555-8176 \U0001f600 me@x.org 10.0.0.1", "9" * 16 + "." + "1" * 30 + ".2.3", "a" * 5000 + "@" + "b" * 5000 + ".c", "@" * 3000, "1-" * 3000, "1" * 3000, "+1" + "(" * 5000 + "2",
]


def valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return 13 <= len(d) <= 19 and luhn
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in GIVEN.items()]


def test_base_spans_match_brute_force(spark, small):
    docs = frame(spark, TEXTS + HARD).select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = P.find_base(docs).select("doc_id", *[F.size(f"pi_{k}").alias(k) for k in P.KINDS], P._joined(P.KINDS).alias("spans")).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute(texts[r.doc_id])
        assert [r[k] for k in P.KINDS] == [len(x) for x in want], texts[r.doc_id][:200]
        assert r.spans == ",".join(x for own in want for x in own)


def test_very_long_runs_are_linear(spark):
    runs = ["1" * 1_000_000, "1 " * 500_000, "a" * 1_000_000, "a" * 500_000 + "@" + "b" * 500_000, "1." * 500_000 + "x"]
    out = P.find_base(frame(spark, runs)).select(*[F.size(f"pi_{k}") for k in P.KINDS]).collect()
    assert [sum(r) for r in out] == [0, 0, 0, 0, 125_000]


def test_query(spark, small):
    rows = P.op7_pii(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in rows:
        base = ",".join(x for own in brute(texts[r.doc_id]) for x in own)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
    assert len(rows) == len(texts)


def corpus():
    told = [f"{a} Zorblatt {b} zork@example.org {c} closing" for a, b, c in [("Ask", "writes", "often"), ("Our", "has", "for"), ("Mister", "uses", "as"), ("When", "left", "behind")]]
    other = [f"plain words number {i} writes often about closing things x{i}@example.org" for i in range(400)]
    copies = ["the Quibble person is at copy@example.org today"] * 9
    return [*told, "Nobody knows zorblatt, though.", *other, *copies]


def test_disclosing_words(spark):
    docs = frame(spark, corpus())
    over = {r.term: r for r in P.disclosures(docs).collect()}
    assert over.keys() == {"zorblatt"} and over["zorblatt"].entity == "email:zork@example.org" and not over["zorblatt"].remove
    assert abs(over["zorblatt"].probability - 0.8) < 1e-9
    out = P.sanitise(docs)
    texts = [r.text for r in out.orderBy("doc_id").collect()]
    assert out.columns == docs.columns
    assert texts[4] == "Nobody knows [TERM], though." and texts[0] == "Ask [TERM] writes [EMAIL] often closing"
    assert texts[-1] == "the Quibble person is at [EMAIL] today"
    rows = {r.doc_id: r for r in P.find_all(docs).select("doc_id", P._joined((*P.KINDS, P.TERM)).alias("spans")).collect()}
    assert rows[4].spans == "term:13:21"


def test_names_beside_their_entity(spark):
    ends = [("Ask", "often"), ("Our", "for"), ("Mister", "as"), ("When", "behind")]
    beside = [f"{a} Zimbalist <zimba@example.org> {b} closing" for a, b in ends] + [f"{a} mail me@x.org (Quibbleson) {b}" for a, b in ends]
    named = [f"{a} Alicia Johnsonov <aj@example.org> {b}" for a, b in ends]
    signed = [f"Bertram Oddfellow\nbo@example.org\nAcmecorp {b}" for _, b in ends]
    repeated = ["Rarity once@example.org and once@example.org or once@example.org"] * 5
    docs = frame(spark, [*beside, *named, *signed, *repeated, *corpus()])
    over = {r.term for r in P.disclosures(docs).collect()}
    assert {"zimbalist", "quibbleson", "alicia", "johnsonov", "bertram", "oddfellow"} <= over and not {"rarity", "quibble"} & over


def test_short_and_punctuated_names_and_user_names(spark):
    ends = [("Ask", "often"), ("Our", "for"), ("Mister", "as"), ("When", "behind")]
    texts = [f"{a} is at ended@example.org {b} said Punctus." for a, b in ends] + [f"{a} of lee@example.org {b}: Lyu, or -Dashel-" for a, b in ends]
    texts += [f"{a} zh@example.org {b} \u674e\u56db" for a, b in ends] + [f"{a} un@example.org {b} user99x" for a, b in ends]
    docs = frame(spark, [*texts, *corpus()])
    over = {r.term: r.probability for r in P.disclosures(docs).collect()}
    names = {"punctus", "lyu", "dashel", "\u674e\u56db", "user99x"}
    assert names <= over.keys() and all(over[x] == 1 for x in names)
    found = P.sanitise(docs).filter("doc_id in (0, 4, 8, 12)").orderBy("doc_id").collect()
    assert not [x for r in found for x in names if x in r.text.lower()]


def test_near_words_of_any_length(spark):
    x = "me@x.org"
    texts = [f"{'a' * 300} {x} {'b' * 300}", f"annotated {'.' * 185} {x} {'.' * 185} annotated", f"one{'.' * 189}{x}{'.' * 189}two", f"three {x}\u0301four five", f"a four{'.' * 188}{x}"]
    near = {r.doc_id: r.words for r in P.near_words(P.find_base(frame(spark, texts))).groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("words")).collect()}
    # full stops, and what stands before them, are of the address
    assert near == {0: ["a" * 300, "b" * 300], 1: ["annotated"], 2: ["two"], 3: ["five", "three"], 4: ["a"]}
    long = [f"w{i}" + "x" * 40_000 for i in range(20)]
    near = P.near_words(P.find_base(frame(spark, [" ".join(long[:10]) + f" {x} " + " ".join(long[10:])]))).collect()
    assert {r.term for r in near} == set(long[2:18])


def test_joined_by_shuffle_and_removed(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(P, "REMOVE_PROBABILITY", 0.7)
    texts = [r.text for r in P.sanitise(frame(spark, corpus())).orderBy("doc_id").collect()]
    assert texts[4] == "Nobody knows , though."


def test_defined_cases(spark):
    out = [r.text for r in P.sanitise(frame(spark, [None, "", "x 10.0.0.1 +1 (716) 555-8176y", "+1234567890, 12345678901234@a.b"])).orderBy("doc_id").collect()]
    assert out == [None, "", "x [IP] [PHONE]y", "[PHONE], [EMAIL]"]
    assert P.sanitise(frame(spark, [])).count() == 0


def brute_terms(rows):
    """term -> (entities over the thresholds, whether it is to be removed), by the definitions in plain Python."""
    letters = lambda x: [w for w in re.findall(r"[^\W_]+", x.lower()) if re.search(r"[^\W\d_]", w)]
    near, docs_of_entity, docs_of_term = defaultdict(list), defaultdict(set), defaultdict(set)
    rows = [(d, t) for d, t in rows if d is not None]
    for d, text in rows:
        for w in set(letters(text or "")):
            docs_of_term[w].add(d)
        for k, p in GIVEN.items():
            for m in re.finditer(p, text or ""):
                if not valid(k, m[0]):
                    continue
                left, right = re.sub(r"[^\W_]+$", "", text[: m.start()]) if re.match(r"[^\W_]", m[0]) else text[: m.start()], text[m.end() :]
                right = re.sub(r"^[^\W_]+", "", right) if re.search(r"[^\W_]$", m[0]) else right
                sides = letters(left)[::-1][:8], letters(right)[:8]
                entity = f"{k}:{m[0].lower()}"
                docs_of_entity[entity].add(d)
                for own in sides:
                    for i, w in enumerate(own):
                        near[w, entity].append((d, (tuple(sides[0]), tuple(sides[1])), own[i - 1] if i else "^", own[i + 1] if i + 1 < len(own) else "^"))
    out = defaultdict(set)
    for (w, entity), seen in near.items():
        passages = defaultdict(set)
        for d, passage, _, _ in seen:
            passages[d].add(passage)
        # of the passages of a document any one stands for it: with one each there is no choice
        assert all(len(x) == 1 for x in passages.values()) or len(passages) < P.MIN_CONTEXTS or len({min(map(repr, x)) for x in passages.values()}) >= P.MIN_CONTEXTS
        contexts = max(min(len({x[2] for x in seen}), len({x[3] for x in seen})), len({min(map(repr, x)) for x in passages.values()}))
        p = len(passages) / len(docs_of_term[w])
        if contexts >= P.MIN_CONTEXTS and p >= P.MIN_PROBABILITY and math.log2(p * len({d for d, _ in rows}) / len(docs_of_entity[entity])) >= P.MIN_BITS:
            out[w].add((entity, p >= P.REMOVE_PROBABILITY))
    return out


def test_terms_match_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(P, "MIN_BITS", 4.0)
    rnd = random.Random(6)
    people = [(f"Name{chr(97 + i)}x", f"Sur{chr(97 + i)}y", f"p{i}@corp{i % 3}.example") for i in range(20)]
    made = []
    for _ in range(300):
        first, last, mail = rnd.choice(people)
        words = [f"v{rnd.randrange(60)}" for _ in range(30)]
        words.insert(rnd.randrange(30), rnd.choice([f"{first} {last} <{mail}>", f"{mail} ({last})", f"{first}. {mail}", first, last]))
        made.append(" ".join(words))
    docs = frame(spark, made).select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_terms(rows)
    got = defaultdict(set)
    for r in P.disclosures(docs).collect():
        got[r.term].add((r.entity, r.remove))
    assert got == want and len(want) > 5
    terms = {r.doc_id: r.pi_term for r in P.find_all(docs).select("doc_id", "pi_term").collect()}
    for d, text in rows:
        places = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "") if m[0].lower() in want]
        assert [(p.s, p.e) for p in terms[d]] == places


def test_null_ids_and_clashing_columns(spark):
    names = "pi_doc", "pi_terms", "pi_removed", "pi_text", "pi_new", "pi_row", "pi_email"
    rows = [(i, t, *names) for i, t in enumerate(corpus())] + [(None, "and ZORBLATT here", *names), (None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = P.sanitise(docs)
    assert out.columns == docs.columns
    kept = out.filter("doc_id is null").collect()
    assert {r.text for r in kept} == {"and [TERM] here", None} and all(tuple(r)[2:] == names for r in kept)
