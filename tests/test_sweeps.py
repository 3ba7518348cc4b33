import random
import re

import pytest
from pyspark.sql import functions as F

from timeloom.operators import sweeps as SW
from timeloom.plans.registry import QUERIES

POINTS, SPANS, VISITS = "k long, g string, t long", "k long, a long, b long", "k long, g string, c long, d long"


def some(rnd, n, most):
    """Keys that may be null, and two times that may be equal, out of order or null."""
    at = lambda: rnd.choice([None, 0, *[rnd.randrange(-most, most) for _ in range(30)]])
    return [(rnd.choice([None, 1, 1, 2]), at(), at()) for _ in range(n)]


@pytest.mark.parametrize("width", [7, 1000, 10**9])
@pytest.mark.parametrize("most", [6, 300])
def test_totals_equal_those_of_all_pairs(spark, width, most):
    rnd = random.Random(most)
    spans, asks = some(rnd, 150, most), [(k, rnd.choice(["x", "y", None, *map(str, range(40))]), a, b) for k, a, b in some(rnd, 120, most)]
    told, met = {}, {}
    for k, g, c, d in asks:
        for k2, a, b in spans:
            if k is None or k != k2 or a is None or b is None or c is None:
                continue
            if a <= c < b:
                n, first, last = told.get(g, (0, a, b))
                told[g] = n + 1, min(first, a), max(last, b)
            if d is not None and b > c and a < d:
                n, shared = met.get(g, (0, 0))
                met[g] = n + 1, shared + min(b, d) - max(a, c)
    spans = spark.createDataFrame(spans, SPANS)
    got = SW.point_totals(spark.createDataFrame([x[:3] for x in asks], POINTS), spans, ["k"], "t", ("a", "b"), ["g"], width)
    assert {r.g: (r.n, r.first_start, r.last_end) for r in got.collect()} == told
    got = SW.overlap_totals(spark.createDataFrame(asks, VISITS), spans, ["k"], ("c", "d"), ("a", "b"), ["g"], width)
    assert {r.g: (r.n, r.shared) for r in got.collect()} == met


@pytest.mark.parametrize("name", ["mixed_points", "mixed_intervals"])
def test_no_pair_is_made(spark, small, name):
    """Rows of stays and calls meet in no join; their places on the timeline are shuffled once."""
    df = QUERIES[name](spark, small)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not re.search(r"Join.*\b(o_orderkey|l_orderkey|from_ms|till_ms)\b", plan) and "pj_node" not in plan
    assert len(set(re.findall(r"REPARTITION_BY_COL, \[plan_id=(\d+)\]", plan))) == 1 and "ReusedExchange" in plan


def test_a_crowded_key(spark):
    """A hundred thousand spans that each hold some of as many points: ten thousand million pairs."""
    n = 100_000
    spans = spark.range(n).selectExpr("1L AS k", "id AS a", f"id + {n} AS b")
    asks = spark.range(n).selectExpr("1L AS k", "id AS g", f"id + {n} - 1 AS t", f"id + {n} AS d")
    got = SW.point_totals(asks, spans, ["k"], "t", ("a", "b"), ["g"], 1000)
    assert got.filter(f"n <> {n} - g OR first_start <> g OR last_end <> {2 * n} - 1").isEmpty() and got.count() == n
    got = SW.overlap_totals(asks, spans, ["k"], ("t", "d"), ("a", "b"), ["g"], 1000)
    assert got.agg(F.sum("n"), F.sum("shared"), F.count("*")).first() == (n * (n + 1) // 2, n * (n + 1) // 2, n)
