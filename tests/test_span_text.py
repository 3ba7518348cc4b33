import random
import re

import pytest

from timeloom.operators import planning as P
from timeloom.operators import windows as W
from timeloom.plans.registry import QUERIES

SPANS, SEGMENTS = "source_id long, candidate_id long, start_ms long, end_ms long", "source_id long, seq long, start_ms long, end_ms long, text string"


@pytest.mark.parametrize("longest", [90_000, 10**7, None])
def test_texts_equal_a_plain_version(spark, longest):
    """Short and long spans, some inverted or null, over segments that overlap, are empty or last for hours."""
    rnd = random.Random(6)
    at = lambda: rnd.choice([None, rnd.randrange(-(10**6), 4 * 10**6)]) if rnd.random() < 0.05 else rnd.randrange(-(10**6), 4 * 10**6)
    plus = lambda t, *n: None if t is None else t + rnd.choice(n)
    spans = [(rnd.choice([1, 2, 3, None]), i, t, plus(t, 5_000, 60_000, 180_000, 2_000_000, -50_000)) for i in range(150) for t in [at()]]
    segs = [(rnd.choice([1, 2, None]), i, t, plus(t, 0, 3_000, 40_000, 7_000_000), f"w{i}") for i in range(200) for t in [at()]]
    want = {}
    for source, i, a, b in spans:
        met = [(s, n, x) for k, n, s, e, x in segs if k is not None and k == source and None not in (a, b, s, e) and e > a and s < b]
        want[i] = " ".join(x for *_, x in sorted(met))[:60]
    spans, segs = spark.createDataFrame(spans, SPANS), spark.createDataFrame(segs, SEGMENTS)
    assert {r.candidate_id: r.text for r in W.span_text(spans, segs, 60, longest).collect()} == want
    inner = {r.candidate_id: r.text for r in W.span_text(spans, segs, 60, longest, "inner").collect()}
    assert inner == {i: want[i] for i in inner} and {i for i, x in want.items() if x} <= set(inner)
    also = spark.createDataFrame([(2, "x"), (9, "y")], "source_id long, more string")
    some = {r.candidate_id: (r.source_id, r.text, r.more) for r in W.span_text(spans, segs, 60, longest, "inner", also).collect()}
    assert all(s == 2 and x == want[i] and m == "x" for i, (s, x, m) in some.items()) and some


def test_no_text_is_shuffled_for_a_span(spark):
    spans = spark.range(1000).selectExpr("id % 9 AS source_id", "id AS candidate_id", "id * 1000 AS start_ms", "id * 1000 + 30000 AS end_ms")
    segs = spark.range(900).selectExpr("id % 9 AS source_id", "id AS seq", "id * 1000 AS start_ms", "id * 1000 + 9000 AS end_ms", "concat('hello', id % 3, ' there friend') AS text")
    plan = W.span_text(spans, segs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys?=\[[^\]]*candidate_id", plan)
    plan = P.top_phrases(W.span_text(spans, segs, how="inner"), lambda more: W.span_text(spans, segs, also=more))._jdf.queryExecution().executedPlan().toString()
    assert "st_rows" in plan and not re.search(r"Aggregate\(keys?=\[[^\]]*candidate_id", plan)


def test_supercuts_shuffle_no_text_for_a_span(spark, small):
    plan = QUERIES["plan_supercut"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "st_rows" in plan and not re.search(r"Aggregate\(keys?=\[[^\]]*candidate_id", plan)
