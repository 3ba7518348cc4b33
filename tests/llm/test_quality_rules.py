import re
from collections import Counter

from timeloom.llm import quality_rules as Q

from .cases import TEXTS, frame


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(tri)
    marked = {j for i, t in enumerate(tri) if count[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 50 or 100 * len(marked) > 50 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed)


def test_counts_match_brute_force(spark, small):
    docs = frame(spark).select("doc_id", "text", "lang").union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000", "text", "lang"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in Q.apply_policy(Q.ledger(docs)).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text
        assert not (r.base_failed and r.kept)


def test_policy_and_ablation_use_bits(spark):
    led = Q.ledger(frame(spark))
    rows = Q.apply_policy(led).collect()
    by_rule = {r.rule: r for r in Q.ablation(led, "strict-1").collect()}
    assert len(rows) == len(TEXTS)
    for rule in Q.RULES:
        hits = [r.fail_bits for r in rows if r.fail_bits >> rule.bit & 1]
        assert by_rule.get(rule.name) and by_rule[rule.name].n_failed == len(hits)
        assert by_rule[rule.name].n_only == sum(1 for b in hits if b & Q.mask_of("strict-1") == 1 << rule.bit)
    assert Q.ledger(frame(spark, [])).count() == 0


def test_labelled_documents(spark, small):
    """Documents of good quality stay unless a base rule drops them; of poor ones none stays."""
    kept = {r.doc_id: r for r in Q.apply_policy(Q.ledger(spark.read.parquet(f"{small}/documents.parquet"))).collect()}
    for r in spark.read.parquet(f"{small}/labels.parquet").collect():
        assert kept[r.doc_id].kept if r.quality and not kept[r.doc_id].base_failed else not kept[r.doc_id].kept


def test_junk_goes_and_prose_stays(spark):
    prose = " ".join(f"word{i} of{i % 7} clean prose{i} number {i}." for i in range(40))
    junk = " ".join(f"w{i}%%%" for i in range(100))
    loud = " ".join(f"LOUD{i} TEXT!!" for i in range(80))
    kept = [r.kept for r in Q.apply_policy(Q.ledger(frame(spark, [prose, junk, loud]))).orderBy("doc_id").collect()]
    assert kept == [True, False, False]


def test_very_long_texts(spark):
    """More windows than 2 ** 16, with repeats far apart, and a text of one word many times."""
    words = [f"w{i}" for i in range(300_000)]
    words[250_000:250_010] = words[10:20]
    texts = [" ".join(words), "again " * 400_000, "x" * 2_000_000]
    for r in Q.apply_policy(Q.ledger(frame(spark, texts))).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])


def test_published_policies_stay(spark):
    assert "duplicate_lines" in Q.POLICIES["web-1"] and set(Q.POLICIES["web-1"]) - set(Q.POLICIES["web-2"]) == {"duplicate_lines"}
    assert [r.policy for r in Q.apply_policy(Q.ledger(frame(spark, ["a"]))).collect()] == ["web-2"]
