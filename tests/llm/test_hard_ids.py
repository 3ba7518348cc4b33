"""Rows without an id, with ids that repeat, and with ids over 2 ** 53, in all operators."""

import threading
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from timeloom.llm import line_dedup as L
from timeloom.llm import media as M
from timeloom.llm import packing as P
from timeloom.llm import periodic_runs as R
from timeloom.llm import pii
from timeloom.llm import storage as S
from timeloom.llm import suffix_dedup as D
from timeloom.llm.queries import QUERIES

from . import test_line_dedup, test_pii, test_suffix_dedup
from .cases import TEXTS, frame

BIG = (1 << 60) + 1
IDS = [None, BIG, BIG + 2, None, BIG, -BIG, 7, None]


def hard(texts):
    return [(IDS[i % len(IDS)], t) for i, t in enumerate(texts)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", ["op1_bpe", "op3_license_scan", "op6_media_columns", "op10_quality_rules"])
def test_operators_on_single_texts(spark, tmp_path, name):
    """Every row is as it is under an id of its own."""
    texts = [*TEXTS, "released under the MIT License, a@b.c", "word " * 100]
    for folder, rows in (("plain", list(enumerate(texts))), ("hard", hard(texts))):
        table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
    of = lambda folder: QUERIES[name](spark, f"{tmp_path}/{folder}").collect()
    assert Counter((hard(texts)[r.doc_id][0], *tuple(r)[1:]) for r in of("plain")) == Counter(map(tuple, of("hard")))


def test_languages_keep_every_row(spark, tmp_path):
    rows = [(d, t, ["en", None][i % 2]) for i, (d, t) in enumerate(hard([*TEXTS, "the cat sat on the mat"] * 3))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(r.doc_id for r in QUERIES["op2_language_id"](spark, str(tmp_path)).collect()) == Counter(r[0] for r in rows)


def test_packing_keeps_ids(spark):
    tokens = P.Tokens.of(public_tokenizers.path("byte_bpe_50k.json"))
    rows = hard([f"text number {i} " * (i % 40) for i in range(400)])
    out = P.pack(table(spark, rows).repartition(4)).collect()
    want, got = defaultdict(int), defaultdict(int)
    for d, t in rows:
        want[d] += len(tokens.ids(t))
    for r in out:
        got[r.doc_id] += r.length
    assert got == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for o, n in own if o < at) for at, _ in sorted(own)]


def test_white_space_is_looked_for_in_linear_time():
    tokens = P.Tokens.of(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("\n".join([" " * 9_999] * 20), " " * 256, "x" + " " * 256, "x" + " " * 255 + "y", (" " * 255 + "y") * 400, " " * 300):
        assert tokens.ids(text)[:-1].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_lines(spark, monkeypatch, broadcast):
    monkeypatch.setattr(L, "BROADCAST_IDS", broadcast)
    line = test_line_dedup.LONG
    rows = [(i, f"{line}\n{i}") for i in range(6)] + hard([*TEXTS, *[f"own {i}\n{line}\n{line.upper()}" for i in range(30)], *[f"only\n{line}"] * 9])
    holders = {d for d, t in rows if t and line in t and d is not None}
    assert max(holders) == BIG + 2
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.lower() != line.lower() or d == max(holders)]
        want.append((d, None if t is None else "\n".join(kept), len(lines) - len(kept)))
    got = [(r.ld_row.doc_id, r.ld_text, r.ld_dropped) for r in L.drop_shared(table(spark, rows)).collect()]
    assert Counter(got) == Counter(want)


def test_repeats(spark):
    texts = [*test_suffix_dedup.made(3), *test_suffix_dedup.made(3)[:9], None, ""]
    rows = hard(texts)
    got = [(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in D.cut_repeats(table(spark, rows)).collect()]
    assert Counter(got) == Counter((d, *x[:3]) for (d, _), x in zip(rows, test_suffix_dedup.brute(texts), strict=True))


def test_disclosing_words_of_repeated_tables(spark):
    rows = list(enumerate(test_pii.corpus()))
    words = lambda rows: {(r.term, r.entity, round(r.probability, 9), round(r.bits, 9), r.remove) for r in pii.disclosures(table(spark, rows)).collect()}
    once = words(rows)
    assert once and words(rows * 3) == once
    assert words(rows + [(None, f"Zorblatt {i} and {rows[i % len(rows)][1]}") for i in range(40)]) == once
    huge = [(BIG + d, t) for d, t in rows]
    assert words(huge) == once
    new = Counter(pii.sanitise(table(spark, rows * 2 + [(None, "here is Zorblatt"), (None, "nothing")])).collect())
    assert new == Counter([*list(pii.sanitise(table(spark, rows)).collect()) * 2, *pii.sanitise(table(spark, rows + [(None, "here is Zorblatt"), (None, "nothing")])).filter("doc_id is null").collect()])


def test_periodic_runs(spark):
    got = [(r.doc_id, r.n_words, r.collapsed) for r in R.periodic_runs(table(spark, hard(TEXTS)).repartition(2)).collect()]
    plain = {r.doc_id: r for r in R.periodic_runs(frame(spark, TEXTS)).collect()}
    assert Counter(got) == Counter((d, plain[i].n_words, plain[i].collapsed) for i, (d, _) in enumerate(hard(TEXTS)))


def test_runs_of_samples_without_tables_are_bounded_together():
    import struct

    box = lambda kind, *parts: struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)
    file = M.store_payload(bytes(64))
    trun = box(b"trun", struct.pack(">II", 0, 16_000))
    number = M._boxes(file)[0][0][b"tkhd"].read("I", 12)[0]
    traf = box(b"traf", box(b"tfhd", struct.pack(">II", 0, number)), *[trun] * 1000)
    with pytest.raises(M.ContainerError):
        M.read_track(file + box(b"moof", box(b"mfhd", bytes(8)), traf))


def test_two_operators_at_once(spark):
    """One fails while the other is at work: what the other wrote stays."""
    ready, failed, seen = threading.Event(), threading.Event(), {}

    def good():
        with S.Workspace(spark) as w:
            a = w.write(spark.range(5), "good")
            ready.set()
            failed.wait(60)
            seen["good"] = w.result(a, a)

    def bad():
        ready.wait(60)
        try:
            with S.Workspace(spark) as w:
                w.write(spark.range(3), "bad")
                raise RuntimeError
        except RuntimeError:
            failed.set()

    threads = [threading.Thread(target=f) for f in (good, bad)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert seen["good"].count() == 5
    with S.Workspace(spark) as w:
        w.settle(spark.range(1), "settled")
    assert seen["good"].count() == 5


def test_nested_calls_lend_their_tables(spark):
    def inner():
        with S.Workspace(spark) as w:
            a = w.write(spark.range(4), "inner")
            return w.result(a, a)

    with S.Workspace(spark) as w:
        lent = inner()
        assert w.lent == {lent.timeloom_path}
        one = w.settle(lent.selectExpr("id + 1 AS id"), "one")
        last = inner()
        out = w.result(last.join(one, "id"), one)
    assert out.count() == 3 and S._WRITTEN.keys() >= {one.timeloom_path, last.timeloom_path} and lent.timeloom_path not in S._WRITTEN
    with pytest.raises(RuntimeError), S.Workspace(spark):
        gone = inner()
        raise RuntimeError
    assert gone.timeloom_path not in S._WRITTEN
