"""Counts and totals over the intervals that points or other intervals meet, from prefix scans and without any pair of the two.

How many intervals hold a point, and the first start and the last end among them, follow from the edges before and after the point alone; how many
an interval overlaps, and for how long in all, follows from the edges before its two ends. So edges and the places that ask are rows of one timeline per
key, cut into blocks as in ``scan``: rows are shuffled once, sorted within blocks, and joined by block with what the blocks around carry (a left join, though each block that asks has its
row: an inner one would look for nulls on one side below the shuffle, and the sides would not share it). Work and disk grow with rows, where pairs grow with the square of what a key holds at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import interval_join

#: Width of a block of a timeline.
BLOCK_MS = 86_400_000
#: What a row stands for is the last two bits of its place in the order, its time is the rest.
_KINDS = 4


def _rows(df: DataFrame, keys: list[str], by: list[str], places: list[tuple[str, int]], payload: list[Column] | None = None) -> DataFrame:
    """A row for each of ``places`` (a time, a kind) of each row; ``payload``: a number for each place. Columns of ``by`` are null if ``df`` lacks them."""
    each = [F.struct((F.col(at) * _KINDS + kind).alias("sw_order"), *([payload[i].alias("sw_far")] if payload else [])) for i, (at, kind) in enumerate(places)]
    asks = [F.col(c).alias(f"sw_by_{c}") for c in by]
    df = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, *[at for at, _ in places]]))
    return df.select(*keys, *asks, F.explode(F.array(*each)).alias("sw_e")).select(*keys, *[f"sw_by_{c}" for c in by], "sw_e.*")


def _timeline(edges: DataFrame, asks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Both as rows of blocks, dealt out once for what reads them twice; columns are few and small, as all of them are on disk then."""
    rows = edges.unionByName(asks, allowMissingColumns=True)
    at = F.shiftright("sw_order", 2)
    start = at - F.pmod(at, F.lit(width))
    rows = rows.repartition(*keys, start).withColumn("sw_block", start)
    return rows.withColumns({"sw_at": at, "sw_kind": F.col("sw_order").bitwiseAND(F.lit(_KINDS - 1).cast("bigint"))})


def _asked(by: list[str], asks: Column) -> Column:
    """Of a block, a number above 0 if its rows ask. It reads the columns of ``by`` too: the blocks' sums and the rows then need the same columns and so share one shuffle."""
    return F.count(F.when(asks, 1)) + sum((F.count(f"sw_by_{c}") for c in by), F.lit(0))


def point_totals(points: DataFrame, spans: DataFrame, keys: list[str], at: str, st: tuple[str, str], by: list[str], width: int = BLOCK_MS) -> DataFrame:
    """(``by``, n, first_start, last_end) over the spans with equal keys that hold the points of each ``by``: ``start <= at < end``. Without any, no row.

    Spans that hold a point are those that start by then less those that end by then. The last end of all that start by then is theirs if it is after
    the point, and the first start of all that end after it is theirs if it is not: whatever ends before or starts after can be neither, where one holds it."""
    start, end = st
    # edges at the time of a point come before it: a start then holds it, an end does not
    closes, opens, asks = 0, 1, 2
    held = spans.filter(F.col(end) > F.col(start))
    edges = _rows(held, keys, [], [(start, opens), (end, closes)], [F.col(end), F.col(start)])
    rows = _timeline(edges, _rows(points, keys, by, [(at, asks)]), keys, width)
    step = F.when(F.col("sw_kind") == opens, 1).when(F.col("sw_kind") == closes, -1).otherwise(0)
    last, first = F.when(F.col("sw_kind") == opens, F.col("sw_far")), F.when(F.col("sw_kind") == closes, F.col("sw_far"))
    sums = rows.groupBy(*keys, "sw_block").agg(F.sum(step).alias("n"), F.max(last).alias("l"), F.min(first).alias("f"), _asked(by, F.col("sw_kind") == asks).alias("asked"))
    key = Window.partitionBy(*keys)
    before, after = (key.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("sw_block"), F.desc("sw_block")))
    carry = sums.select(*keys, "sw_block", F.sum("n").over(before).alias("sw_n"), F.max("l").over(before).alias("sw_l"), F.min("f").over(after).alias("sw_f"), "asked").filter("asked > 0").drop("asked")
    own = Window.partitionBy(*keys, "sw_block")
    until, since = (own.orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("sw_order"), F.desc("sw_order")))
    seen = rows.withColumns({"n": F.sum(step).over(until), "l": F.max(last).over(until)}).withColumn("f", F.min(first).over(since)).filter(F.col("sw_kind") == asks)
    n = F.col("n") + F.coalesce("sw_n", F.lit(0))
    found = seen.join(carry, [*keys, "sw_block"], "left").select(*[F.col(f"sw_by_{c}").alias(c) for c in by], n.alias("n"), F.least("f", "sw_f").alias("f"), F.greatest("l", "sw_l").alias("l"))
    return found.filter("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.min("f").alias("first_start"), F.max("l").alias("last_end"))


def overlap_totals(visits: DataFrame, spans: DataFrame, keys: list[str], vt: tuple[str, str], st: tuple[str, str], by: list[str], width: int = BLOCK_MS) -> DataFrame:
    """(``by``, n, shared) of the visits of each ``by`` and the spans with equal keys that they overlap, as ``interval_join`` says: how many pairs, and the sum of
    ``least(ends) - greatest(starts)``. Without any, no row.

    A visit overlaps the spans that start before its end, less those that end by its start. What it shares with them is how much the time that all spans have had
    grows from its start to its end. That holds where visits end after they start and spans not before; pairs with other rows are joined, if there are any."""
    straight, going = F.col(st[0]) <= F.col(st[1]), F.col(vt[0]) < F.col(vt[1])
    # at one time: ends, then the ends of visits, which ask for starts before, then starts, then the starts of visits, which ask for ends
    closes, asks_end, opens, asks_start = 0, 1, 2, 3
    edges = _rows(spans.filter(straight), keys, [], [(st[0], opens), (st[1], closes)])
    rows = _timeline(edges, _rows(visits.filter(going), keys, by, [(vt[0], asks_start), (vt[1], asks_end)]), keys, width)
    since = F.col("sw_at") - F.col("sw_block")
    starts, ends = F.when(F.col("sw_kind") == opens, 1).otherwise(0), F.when(F.col("sw_kind") == closes, 1).otherwise(0)
    moment, asking = (starts - ends) * since, F.col("sw_kind").isin(asks_start, asks_end)
    sums = rows.groupBy(*keys, "sw_block").agg(F.sum(starts).alias("s"), F.sum(ends).alias("e"), F.sum(moment).alias("m"), _asked(by, asking).alias("asked"))
    by_block = Window.partitionBy(*keys).orderBy("sw_block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    carry = sums.withColumns({"sw_s": F.coalesce(F.sum("s").over(before), zero), "sw_e": F.coalesce(F.sum("e").over(before), zero), "next": F.lead("sw_block").over(by_block)})
    # time that the spans have from the start of a block to that of the next one there is
    grown = (F.col("sw_s") - F.col("sw_e") + F.col("s") - F.col("e")) * (F.col("next") - F.col("sw_block")) - F.col("m")
    carry = carry.select(*keys, "sw_block", "sw_s", "sw_e", F.coalesce(F.sum(grown).over(before), zero).alias("sw_t"), "asked").filter("asked > 0").drop("asked")
    until = Window.partitionBy(*keys, "sw_block").orderBy("sw_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumns({"s": F.sum(starts).over(until), "e": F.sum(ends).over(until), "m": F.sum(moment).over(until)})
    seen = seen.filter(asking).join(carry, [*keys, "sw_block"], "left")
    s, e = F.col("sw_s") + F.col("s"), F.col("sw_e") + F.col("e")
    had = F.col("sw_t") + (s - e) * since - F.col("m")
    end = F.col("sw_kind") == asks_end
    found = seen.select(*[F.col(f"sw_by_{c}").alias(c) for c in by], F.when(end, s).otherwise(-e).alias("n"), F.when(end, had).otherwise(-had).alias("shared"))
    crooked, idle = spans.filter(~straight), visits.filter(~going)
    shared = F.least(F.col(vt[1]), F.col(st[1])) - F.greatest(F.col(vt[0]), F.col(st[0]))
    for odd, a, b in ((crooked, visits, crooked), (idle, idle, spans.filter(straight))):
        if not odd.isEmpty():
            found = found.unionByName(interval_join(a, b, keys, vt, st).select(*by, F.lit(1).cast("bigint").alias("n"), shared.alias("shared")))
    return found.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("shared").alias("shared")).filter("n > 0")
