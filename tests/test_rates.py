import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timeloom.operators import rates as R

KIND = "who string, ip string, ts long, id long, allowed string, block int, tokens int, number_ int"


def plain(rows, burst, rate):
    """(id -> (allowed, units left)) by a loop over each bucket's requests."""
    by = defaultdict(list)
    for who, ip, ts, i, *_ in rows:
        by[who, ip].append((ts, i))
    out = {}
    for own in by.values():
        left, last = burst * R.UNIT, None
        for ts, i in sorted(own):
            if last is not None:
                left = min(burst * R.UNIT, left + (ts - last) * rate)
            last, ok = ts, left >= R.UNIT
            left -= R.UNIT * ok
            out[i] = (ok, left)
    return out


def got(spark, rows, burst, rate, **bounds):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], KIND)
    return {r.id: (r.allowed, r.left) for r in R.rate_limited(df, ["who", "ip"], "ts", "id", burst, rate, **bounds).collect()}


def requests(seed, n, keys=3, most=3_000_000):
    rnd, ts, rows = random.Random(seed), 0, []
    for i in range(n):
        ts += rnd.choice([0, 1, rnd.randrange(most), rnd.randrange(most // 50)])
        rows.append((rnd.choice([None, "a", "b", "c"][: keys + 1]), rnd.choice(["1", None]), ts, i))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("burst, rate", [(1, 500_000), (3, 1_234_567), (40, 3_000_000), (5, 1), (2, 10**9)])
@pytest.mark.parametrize("block_us", [1, 700_000, 20_000_000, 10**13])
def test_equals_a_loop(spark, monkeypatch, burst, rate, block_us):
    monkeypatch.setattr(R, "GROUP", 4)
    rows = requests(burst, 250)
    assert got(spark, rows, burst, rate, block_us=block_us) == plain(rows, burst, rate)


def test_published_cases(spark):
    slow = [("claude", "1.2.3.4", i, i) for i in range(5)]
    assert [got(spark, slow, 3, 100)[i][0] for i in range(5)] == [True, True, True, False, False]
    pairs = [("a", "1", 0, 0), ("a", "1", 1, 1), ("a", "2", 2, 2), ("b", "1", 3, 3)]
    assert [x[0] for _, x in sorted(got(spark, pairs, 1, 100).items())] == [True, False, True, True]
    for off in ((0, 10), (40, 0)):
        assert set(got(spark, slow, *off).values()) == {(True, None)}
    assert got(spark, [], 3, 10) == {}


def python_map(b, gains):
    """What requests, each after a gain, do to the tokens that the first one finds."""

    def run(t):
        for i, g in enumerate(gains):
            t = min(b.full, t + g) if i else t
            t -= R.UNIT * (t >= R.UNIT)
        return t

    return run


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=25), st.integers(1, 6))
def test_maps_have_few_pieces_and_are_right(spark, tenths, burst):
    b = R.Bucket(burst, 1)
    gains = [t * R.UNIT // 10 for t in tenths]
    rows = "array(" + ", ".join(f"{g}L" for g in gains) + ")"
    expr = f"aggregate(slice({rows}, 2, {len(gains)}), CAST({b.request} AS {R._PIECE}), (acc, g) -> CAST({b.then('acc', 'g', b.request)} AS {R._PIECE}))"
    pieces = spark.range(1).selectExpr(f"{expr} AS m").collect()[0].m
    assert pieces[0].lo == 0 and pieces[-1].hi == b.full + 1 and all(x.hi == y.lo for x, y in zip(pieces, pieces[1:]))
    assert len(pieces) <= burst + 3
    run = python_map(b, gains)
    for k in range(10 * burst + 1):
        for t in {max(0, k * R.UNIT // 10 + d) for d in (-1, 0, 1)}:
            if t <= b.full:
                p = next(p for p in pieces if p.lo <= t < p.hi)
                assert p.slope * t + p.off == run(t)


def test_a_hot_bucket_spreads_over_tasks(spark):
    df = spark.range(200_000).selectExpr("'hot' AS who", "'1' AS ip", "id * 37000 AS ts", "id")
    out = R.rate_limited(df, ["who", "ip"], "ts", "id", 40, 10_000_000)
    assert out.selectExpr("count(*)", "sum(int(allowed))").collect()[0] == (200_000, sum(x[0] for x in plain([("hot", "1", i * 37000, i) for i in range(200_000)], 40, 10_000_000).values()))
    sizes = [r[0] for r in df.selectExpr("struct(struct(who, ip) AS key_, floor(ts / 60000000) AS number_) AS on_").repartition(8, "on_").selectExpr("spark_partition_id() AS p").groupBy("p").count().select("count").collect()]
    assert max(sizes) < 2 * 200_000 / 8
