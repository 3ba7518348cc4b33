import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from timeloom.operators import candidates as C
from timeloom.operators import folds
from timeloom.operators import sequence as S
from timeloom.operators.scan import carried

KIND = "source_id long, start_ms long, end_ms long, seq long, w string, on_ string, key_ int, row_ double, block_ int, n_ int, first_ boolean"


def rows_of(seed, n, gap=400, keys=3):
    rnd, out, at = random.Random(seed), [], 0
    for i in range(n):
        at += rnd.choice([0, 0, 10, 40, 60, rnd.randrange(gap), rnd.randrange(gap)])
        out.append((rnd.choice([None, 1, 2][:keys]), at, at + rnd.randrange(300), i, rnd.choice(["a", "a", "b.", "ab", "c!"]), "x", 1, 2.0, 3, 4, True))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("width", [1, 500, 10**9])
def test_carried_equals_windows(spark, width):
    df = spark.createDataFrame(rows_of(1, 400), KIND)
    order = ["start_ms", "end_ms", "seq"]
    value = F.when(F.col("w") != "ab", F.col("end_ms"))
    got = carried(df, ["source_id"], order, width, sums={"s": F.col("end_ms")}, maxima={"m": value}, lags={"l": value}, totals={"t": F.lit(1)})
    w = Window.partitionBy("source_id").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.coalesce(F.sum("end_ms").over(before), F.lit(0)).alias("s"), F.max(value).over(before).alias("m"), F.lag(value).over(w).alias("l"), F.count("*").over(Window.partitionBy("source_id")).alias("t"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_hot_key_spreads_over_tasks(spark):
    n = 400_000
    df = spark.range(n).selectExpr("7L AS source_id", "id * 300 AS start_ms", "id")
    out = carried(df, ["source_id"], ["start_ms", "id"], 600_000, sums={"before": F.lit(1)}, maxima={"m": F.col("id")})
    assert out.filter("before <> id OR coalesce(m, -1) <> id - 1").isEmpty()
    plan = out._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    tasks = df.withColumn("on_", F.struct("source_id", F.floor(F.col("start_ms") / 600_000).alias("block_"))).repartition(8, "on_").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 2 * n / 8


def whole(monkeypatch, spark, call):
    """What ``call`` gives when each key is folded in one piece."""
    def plain(df, keys, order, fields, first, joins, merged, width=None):
        return folds.fold(df, keys, order, fields, first, joins, merged)

    with monkeypatch.context() as m:
        m.setattr(S, "fold_chunks", plain)
        m.setattr(C, "fold_chunks", plain)
        return sorted(map(repr, call().collect()))


@pytest.mark.parametrize("chunk_ms", [150, 5000])
def test_chunked_folds_equal_plain_ones(spark, monkeypatch, chunk_ms):
    words = spark.createDataFrame(rows_of(2, 250, 150, keys=2), KIND)
    segments = words.withColumn("text", F.col("w"))
    spans = words.selectExpr("source_id", "start_ms", "start_ms + 40 * (end_ms - start_ms) + 1 AS end_ms", "seq AS candidate_id", "w AS label", "double(seq % 7) AS score", "w AS reason")
    for call in (
        lambda **k: S.dedup_words(words, **k), lambda **k: S.dedup_segments(segments, **k), lambda **k: S.group_words(words, **k),
        lambda **k: S.caption_lines(words, **k), lambda **k: C.fuse(spans, **k),
    ):
        got = sorted(map(repr, call(chunk_ms=chunk_ms).collect()))
        assert got == whole(monkeypatch, spark, call) and got


def test_chunks_that_never_agree_with_the_guess(spark, monkeypatch):
    """Groups of thirty words with no pause: each chunk starts out of step, so every one is mended after the one before it."""
    words = spark.range(1_000).selectExpr("1L AS source_id", "id * 100 AS start_ms", "id * 100 + 90 AS end_ms", "id AS seq", "'w' AS w")
    got = S.group_words(words, chunk_ms=7_700)
    assert sorted(map(repr, got.collect())) == whole(monkeypatch, spark, lambda: S.group_words(words))


def test_one_island_of_many_rows(spark):
    """One run of overlapping intervals without end is folded a chunk at a time."""
    n = 300_000
    spans = spark.range(n).selectExpr("1L AS source_id", "id * 1000 AS start_ms", "id * 1000 + 1100 + id % 3 * 900 AS end_ms", "id AS candidate_id", "'quote' AS label", "double(id % 10) AS score", "'r' AS reason")
    got = C.fuse(spans)
    start, end, count, want = None, None, 0, []
    for i in range(n):
        s, e = i * 1000, i * 1000 + 1100 + i % 3 * 900
        inter = min(end, e) - max(start, s) if count else 0
        if inter > 0 and 2 * inter > min(end - start, e - s):
            end, count = min(max(end, e), start + 180_000), count + 1
        else:
            want += [(start, end, count)] if count else []
            start, end, count = s, e, 1
    want.append((start, end, count))
    assert sorted((r.start_ms, r.end_ms, r.n_fused) for r in got.select("start_ms", "end_ms", "n_fused").collect()) == want
    assert max(w[2] for w in want) > 1


def test_no_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert S.group_words(none).count() == 0 and carried(none, ["source_id"], ["start_ms", "seq"], 5, sums={"s": F.lit(1)}).count() == 0
