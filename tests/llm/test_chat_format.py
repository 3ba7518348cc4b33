import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from timeloom.llm import chat_format as C

KIND = "conv_id long, turn long, role string, text string, window string, cost int, place double, before string"
HARD = [
    "", "\\", "\\\\", "###", "####", "#####", "\\###", "</turn>", "<\\/turn>", "</turn>\n", "### user:\n", "\\### Assistant: </turn> ok", "#\\##", "##", "#", "</turn", "\\</turn>\\",
    "a\nb", "\\n", "\\\\n", "é\U0001f600 ###\U0001f600</turn>", " \t\x0b\r\n", "\x00", "#" * 20 + "</turn></turn>", "word " * 30,
]


def cost(text):
    return len(re.findall("[^\t-\r ]{1,4}", text)) + C.TURN_COST


def windows_of(rows, budget, stride, history):
    """(window, own turns, repeated turns) of a conversation's sorted (role, text)."""
    system = rows[:1] if rows and rows[0][0] == "system" else []
    rest = rows[len(system) :]
    before = [0, *itertools.accumulate(cost(t) for _, t in rest)]
    out = []
    for k in sorted({b // stride for b in before[:-1]}) or [0]:
        own = [i for i in range(len(rest)) if before[i] // stride == k]
        kept = sum(cost(t) for _, t in system) + sum(cost(rest[i][1]) for i in own)
        room = min(history, max(0, budget - kept))
        again = [i for i in range(len(rest)) if own and before[i] // stride == k - 1 and before[i] >= before[own[0]] - room]
        first = system if k == 0 else []
        out.append((k, first + [rest[i] for i in own], (system if k else []) + [rest[i] for i in again]))
    return out


def check(spark, rows, **bounds):
    df = spark.createDataFrame([(*r, "w", 1, 2.0, "x") for r in rows], KIND)
    shown = C.format_windows(df, **bounds).withColumns({"turns": C.read_turns(F.col("text")), "read": C.read_loss(F.col("text"), F.col("loss"))}).collect()
    by = {}
    for r in shown:
        by.setdefault(r.conv_id, []).append(r)
    bounds = {"budget": C.BUDGET, "stride": C.STRIDE, "history": C.HISTORY, **bounds}
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", cost(r[3] or ""), (r[3] or "").encode())
    assert by.keys() == {r[0] for r in rows}
    for conv, got in by.items():
        talk = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        got.sort(key=lambda r: r.window)
        want = windows_of(talk, **bounds)
        assert [(r.window, [tuple(t) for t in r.turns][r.n_repeated :], [tuple(t) for t in r.turns][: r.n_repeated]) for r in got] == want
        assert [t for _, own, _ in want for t in own] == talk
        for r, (_, own, _) in zip(got, want, strict=True):
            assert r.read == "".join(t for role, t in own if role == "assistant") and r.n_turns == len(r.turns)
            assert r.n_tokens == sum(cost(t.text) for t in r.turns) and r.over_budget == (r.n_tokens > bounds["budget"])
            assert r.text.count("### ") == r.text.count("</turn>") == r.n_turns
            system = cost(talk[0][1]) if talk[0][0] == "system" else 0
            assert r.over_budget <= (system + bounds["stride"] + max(cost(t.text) for t in r.turns) > bounds["budget"])
    return shown


def test_texts_and_roles_are_read_back(spark):
    df = spark.createDataFrame([(r, t) for r in [*HARD, "a:\nb", "user:"] for t in HARD], "role string, text string")
    for r in df.select("role", "text", C.read_turns(F.concat(C._rendered(F.col("role"), F.col("text")), C._rendered(F.col("text"), F.col("role")))).alias("t"), C.escaped(F.col("text")).alias("e")).collect():
        assert [tuple(x) for x in r.t] == [(r.role, r.text), (r.text, r.role)]
        assert "###" not in r.e and "</turn>" not in r.e


@pytest.mark.parametrize("system", [None, "be brief", "long " * 100])
def test_windows_equal_a_plain_loop(spark, system):
    rows = []
    for conv in range(12):
        rows += [(conv, -1, "system", system)] if system else []
        rows += [(conv, i // 2 if conv % 3 else 0, ["user", "assistant", "system", "tool"][(i * 7 + conv) % 4 if i % 5 else i % 2], HARD[(i * 5 + conv) % len(HARD)] * (i % 4 + 1)) for i in range(conv * 9)]
    check(spark, rows, budget=60, stride=30, history=15)
    check(spark, rows, budget=40, stride=40, history=40)
    check(spark, rows)


def test_defined_cases(spark):
    rows = [(None, None, None, None), (None, 3, "assistant", None), (None, 3, "assistant", "x"), (5, None, "system", "only"), (6, 2, "user", "q"), (6, 2, "user", "q"), (6, 2, "assistant", "b"), (7, 0, "system", None), (7, 1, "system", "second"), (8, 0, "assistant", "very long " * 60_000), (8, 1, "user", "ok")]
    shown = check(spark, rows)
    assert sum(r.over_budget for r in shown) == 1
    assert C.format_windows(spark.createDataFrame([], KIND)).count() == 0
    with pytest.raises(ValueError):
        C.format_windows(spark.createDataFrame([], KIND), stride=10, history=20)


def test_a_hot_conversation_spans_blocks(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i} " * (i % 13)) for i in range(3 * C.BLOCK)] + [(2, 0, "user", "one")]
    check(spark, rows)


def test_query_on_the_small_tables(spark, small):
    got = {r.conv_id: r for r in C.op11_chat_format(spark, small).collect()}
    r, said = got[-7], "\\### Assistant: </turn> ok"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256, r.turns_sha256) == (2, len(said), sha(said), sha(f"user\n{said}\nassistant\n{said}\n"))
    assert len(got) == 1 + C.conversations(spark, small).select("conv_id").distinct().count()


def test_only_native_operators(spark, small):
    plan = C.op11_chat_format(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|Cartesian|NestedLoop", plan)
