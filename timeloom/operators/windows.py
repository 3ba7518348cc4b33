"""Sliding windows over a timeline, and joins of intervals and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KNOBS, Knobs

#: Width of the buckets that interval joins are dealt by.
BUCKET_MS = 60_000
#: Stretches of an output timeline are parts of valid candidates, so they are no longer than these.
STRETCH_MS = KNOBS.candidate_max_ms


def stride(knobs: Knobs = KNOBS) -> int:
    return max(knobs.window_ms - knobs.overlap_ms, 1)


def chunk_bounds(index: Column, knobs: Knobs = KNOBS) -> tuple[Column, Column]:
    start = (index * stride(knobs)).cast("bigint")
    return start, start + knobs.window_ms


def chunk_count(duration_ms: Column, knobs: Knobs = KNOBS) -> Column:
    n = F.ceil((duration_ms - knobs.window_ms) / stride(knobs)) + 1
    return F.when(duration_ms <= knobs.window_ms, F.lit(1)).otherwise(n).cast("bigint")


def chunks(segments: DataFrame, knobs: Knobs = KNOBS) -> DataFrame:
    """Every segment in each window that it overlaps (half open), numbered, and capped to ``segment_cap`` a window.

    The windows of a segment follow from its own times, so nothing is joined; only the numbering shuffles. Adds ``chunk``,
    ``n`` in the window, ``total_available``, ``truncated``.
    """
    step = stride(knobs)
    low = F.greatest(F.floor((F.col("start_ms") - knobs.window_ms) / step) + 1, F.lit(0))
    high = F.greatest(F.ceil(F.col("end_ms") / step) - 1, F.lit(-1))
    each = segments.withColumn("chunk", F.explode(F.when(high >= low, F.sequence(low.cast("bigint"), high.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))))
    w = Window.partitionBy("source_id", "chunk")
    each = each.withColumns({"n": F.row_number().over(w.orderBy("start_ms", "seq")).cast("bigint"), "total_available": F.count("*").over(w)})
    return each.withColumn("truncated", F.col("total_available") > knobs.segment_cap).filter(F.col("n") <= knobs.segment_cap)


def _buckets(start: Column, end: Column) -> Column:
    """Buckets that a half-open interval touches; an empty interval touches that of its start."""
    last = F.greatest(F.floor((end - 1) / BUCKET_MS), F.floor(start / BUCKET_MS))
    return F.sequence(F.floor(start / BUCKET_MS), last)


#: Time buckets of a node's children in the tree of times, and levels of the tree: buckets of a minute, 16 minutes, 4 hours, 3 days.
FANOUT, LEVELS = 16, 4
#: Spans that may be longer than this are dealt to a tree of times instead of to all buckets that they touch.
BUCKETED_MS = 15 * BUCKET_MS


def _cover(start: Column, end: Column) -> Column:
    """Nodes (level, node) that together hold the buckets which a span touches, each bucket under one of them: of a level
    below the top at most two runs, each shorter than ``FANOUT``, or one shorter than two of them."""
    low = F.floor(start / BUCKET_MS)
    high = F.greatest(F.floor((end - 1) / BUCKET_MS), low) + 1
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    run = lambda level, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(level).alias("level"), x.alias("node")))).otherwise(none)
    parts, open_ = [], F.lit(True)
    for level in range(LEVELS):
        up_low, up_high = F.ceil(low / FANOUT), F.floor(high / FANOUT)
        wraps = (up_low < up_high) & F.lit(level + 1 < LEVELS)
        mine = F.when(wraps, F.concat(run(level, low, up_low * FANOUT), run(level, up_high * FANOUT, high))).otherwise(run(level, low, high))
        parts.append(F.when(open_, mine).otherwise(none))
        low, high, open_ = up_low, up_high, open_ & wraps
    return F.concat(*parts)


def _ancestors(at: Column) -> Column:
    """The node of each level that holds a point."""
    bucket = F.floor(at / BUCKET_MS)
    return F.array(*[F.struct(F.lit(level).alias("level"), F.floor(bucket / FANOUT**level).alias("node")) for level in range(LEVELS)])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], lt: tuple[str, str], rt: tuple[str, str], how: str = "inner", longest_ms: int | None = None) -> DataFrame:
    """Pairs with equal keys whose half-open intervals overlap: ``r.end > l.start and r.start < l.end``.

    ``longest_ms``: how long intervals of both sides are, as far as is known. Up to ``BUCKETED_MS`` both sides are dealt to the time buckets
    that they touch and equi-joined on them; a pair is taken only in the first bucket that both touch. Else a pair is met where one side's
    start lies in the other: starts are joined with intervals through a tree of times, by ``point_join``, so that an interval of a
    month is a few rows for each level of the tree and not one for each of its minutes. Longer intervals than said cost rows, but change no
    result. So a hot key spreads over its timeline, and only what shares a node is looked at. Columns of
    the sides must differ but for the keys. ``how``: inner, or left (which is dealt to buckets).
    """
    met = (F.col(rt[1]) > F.col(lt[0])) & (F.col(rt[0]) < F.col(lt[1]))
    if how == "inner" and (longest_ms is None or longest_ms > BUCKETED_MS):
        in_left = point_join(right, left, keys, rt[0], lt).filter(met)
        in_right = point_join(left, right, keys, lt[0], rt).filter(met & (F.col(rt[0]) < F.col(lt[0])))
        columns = [*left.columns, *[c for c in right.columns if c not in keys]]
        return in_left.select(*columns).unionByName(in_right.select(*columns))
    ident = "ij_row"
    dealt = left.withColumn(ident, F.monotonically_increasing_id()) if how == "left" else left
    a = dealt.withColumn("ij_b", F.explode(_buckets(F.col(lt[0]), F.col(lt[1]))))
    b = right.withColumn("ij_b", F.explode(_buckets(F.col(rt[0]), F.col(rt[1]))))
    first = F.col("ij_b") == F.greatest(F.floor(F.col(lt[0]) / BUCKET_MS), F.floor(F.col(rt[0]) / BUCKET_MS))
    if how == "inner":
        return a.join(b, [*keys, "ij_b"]).filter(met & first).drop("ij_b")
    # a left row without a partner is taken from its first bucket, where it is joined with nulls
    own = [c for c in right.columns if c not in keys]
    flagged = a.withColumn("ij_first", F.col("ij_b") == F.floor(F.col(lt[0]) / BUCKET_MS))
    pairs = flagged.join(b, [*keys, "ij_b"], "left")
    pairs = pairs.withColumn("ij_hit", F.coalesce(met & first, F.lit(False)))
    any_hit = F.max("ij_hit").over(Window.partitionBy(*keys, ident))
    rank = F.row_number().over(Window.partitionBy(*keys, ident).orderBy(F.desc("ij_hit"), F.desc("ij_first")))
    pairs = pairs.withColumns({"ij_any": any_hit, "ij_rank": rank}).filter(F.col("ij_hit") | (~F.col("ij_any") & (F.col("ij_rank") == 1)))
    nulled = [F.when(F.col("ij_hit"), F.col(c)).alias(c) for c in own]
    return pairs.select(*left.columns, *nulled)


def point_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, st: tuple[str, str], how: str = "inner", longest_ms: int | None = None) -> DataFrame:
    """Each point with the spans that hold it: ``start <= at < end``.

    Where spans are no longer than ``BUCKETED_MS``, as ``longest_ms`` says, points and spans meet in the time buckets that spans touch. Else spans
    are dealt to the nodes of a tree of times that cover them, and points to the nodes above them, one a level. A point is under
    one node of a span at most, so no pair is met twice. ``how``: inner, or left (which is dealt to buckets)."""
    if how == "inner" and (longest_ms is None or longest_ms > BUCKETED_MS):
        a = points.withColumn("pj_node", F.explode(_ancestors(F.col(at))))
        b = spans.filter(F.col(st[1]) > F.col(st[0])).withColumn("pj_node", F.explode(_cover(F.col(st[0]), F.col(st[1]))))
        return a.join(b, [*keys, "pj_node"]).filter((F.col(st[0]) <= F.col(at)) & (F.col(at) < F.col(st[1]))).drop("pj_node")
    a = points.withColumn("pj_b", F.floor(F.col(at) / BUCKET_MS))
    b = spans.withColumn("pj_b", F.explode(_buckets(F.col(st[0]), F.col(st[1])))).filter(F.col(st[1]) > F.col(st[0]))
    b = b.select(*[F.col(c).alias(f"pj_{c}") if c in keys or c == "pj_b" else F.col(c) for c in b.columns])
    on = [a[k] == b[f"pj_{k}"] for k in keys] + [a["pj_b"] == b["pj_pj_b"], F.col(st[0]) <= F.col(at), F.col(at) < F.col(st[1])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.join(b, cond, how).drop("pj_b", "pj_pj_b", *[f"pj_{k}" for k in keys])


#: Width of the stretches of a transcript that spans find their text in.
STRETCH_TEXT_MS = 600_000


def _stretches(seg: DataFrame, longest_ms: int) -> DataFrame:
    """(source_id, st_block, st_rows): the segments, in order, of each stretch and of the ``longest_ms`` after it, so all of any span that starts in it."""
    low = F.floor((F.col("g_start") - STRETCH_TEXT_MS - longest_ms) / STRETCH_TEXT_MS) + 1
    high = F.ceil(F.col("g_end") / STRETCH_TEXT_MS) - 1
    block = F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))
    each = seg.select("source_id", block.alias("st_block"), F.struct("g_start", "g_seq", "g_text", "g_end").alias("st_row"))
    return each.groupBy("source_id", "st_block").agg(F.array_sort(F.collect_list("st_row")).alias("st_rows"))


def span_text(spans: DataFrame, segments: DataFrame, limit: int = 2000, longest_ms: int | None = KNOBS.candidate_max_ms, how: str = "left", also: DataFrame | None = None) -> DataFrame:
    """``spans`` with the text of the segments that each overlaps, in order, cut to ``limit`` characters.

    Spans up to ``longest_ms`` meet the stretch of the transcript that they start in, as a row, and cut their text out of it: no text is shuffled for a
    span. Longer ones, if there are any, meet segments one by one. ``how``: left, or inner for spans alone that have segments near. ``also``: columns by source_id; spans of other sources
    go. They are joined to the transcripts, not to the spans."""
    seg = segments.select("source_id", F.col("seq").alias("g_seq"), F.col("start_ms").alias("g_start"), F.col("end_ms").alias("g_end"), F.col("text").alias("g_text"))
    spans, over = spans.drop("text"), F.lit(True) if longest_ms is None else F.coalesce(F.col("end_ms") - F.col("start_ms") > longest_ms, F.lit(False))
    parts = []
    if longest_ms is not None:
        rows = _stretches(seg, longest_ms)
        if also is not None:
            rows = rows.join(also, "source_id")
        near = F.filter("st_rows", lambda x: (x["g_end"] > F.col("start_ms")) & (x["g_start"] < F.col("end_ms")))
        text = F.substring(F.array_join(F.transform(near, lambda x: x["g_text"]), " "), 1, limit)
        short = spans.filter(~over).withColumn("st_block", F.floor(F.col("start_ms") / STRETCH_TEXT_MS))
        # merged whatever the sizes: spans grow faster than Spark expects of their files
        short = short.join(rows.hint("merge"), ["source_id", "st_block"], "inner" if also is not None else how)
        parts.append(short.withColumn("text", F.coalesce(text, F.lit(""))).drop("st_block", "st_rows"))
    long = spans.filter(over)
    if longest_ms is None or not long.isEmpty():
        met = interval_join(long.select("source_id", "candidate_id", "start_ms", "end_ms"), seg, ["source_id"], ("start_ms", "end_ms"), ("g_start", "g_end"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("g_start", "g_seq", "g_text"))), lambda x: x["g_text"])
        told = met.groupBy("source_id", "candidate_id").agg(F.substring(F.array_join(ordered, " "), 1, limit).alias("text"))
        long = long.join(told, ["source_id", "candidate_id"], how).withColumn("text", F.coalesce("text", F.lit("")))
        parts.append(long if also is None else long.join(also, "source_id"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def map_words(words: DataFrame, timeline: DataFrame) -> DataFrame:
    """Words on the output timeline: by the first stretch that holds their middle, clamped to it; words in dropped air go."""
    mid = words.withColumn("mid2", F.col("start_ms") + F.col("end_ms"))
    t = timeline.select(F.col("clip_id").alias("source_id"), F.col("seq").alias("t_seq"), (F.col("src_start_ms") * 2).alias("t_lo"), (F.col("src_end_ms") * 2).alias("t_hi"), "src_start_ms", "src_end_ms", "out_start_ms")
    met = point_join(mid, t, ["source_id"], "mid2", ("t_lo", "t_hi"), longest_ms=2 * STRETCH_MS)
    rank = F.row_number().over(Window.partitionBy("source_id", "seq").orderBy("t_seq"))
    met = met.withColumn("rank_", rank).filter("rank_ = 1")
    start = F.greatest("start_ms", "src_start_ms") - F.col("src_start_ms") + F.col("out_start_ms")
    end = F.least("end_ms", "src_end_ms") - F.col("src_start_ms") + F.col("out_start_ms")
    met = met.withColumns({"new_start": start, "new_end": end})
    return met.select("source_id", "seq", "w", F.col("new_start").alias("start_ms"), F.when(F.col("new_end") <= F.col("new_start"), F.col("new_start") + 80).otherwise(F.col("new_end")).alias("end_ms"))


def map_times(points: DataFrame, timeline: DataFrame, at: str = "t_ms") -> DataFrame:
    """``points`` with ``out_ms``: where their time is on the output timeline, or null."""
    t = timeline.select("clip_id", F.col("seq").alias("t_seq"), "src_start_ms", "src_end_ms", "out_start_ms")
    # distinct times are mapped and joined back: points of a clip at one time stay as many as they are
    met = point_join(points.select("clip_id", at).distinct(), t, ["clip_id"], at, ("src_start_ms", "src_end_ms"), longest_ms=STRETCH_MS)
    out = F.col("out_start_ms") + F.col(at) - F.col("src_start_ms")
    met = met.groupBy("clip_id", at).agg(F.min_by(out, "t_seq").alias("out_ms"))
    return points.join(met, ["clip_id", at], "left").select(*points.columns, "out_ms")


def map_cues(segments: DataFrame, timeline: DataFrame) -> DataFrame:
    """Cues on the output timeline: start and end less 10 ms (but not before the start) are mapped each; cues with an end in dropped air, or inverted, go."""
    ends = segments.select(F.col("source_id").alias("clip_id"), "seq", "text", F.posexplode(F.array(F.col("start_ms"), F.greatest(F.col("end_ms") - 10, F.col("start_ms")))).alias("side", "t_ms"))
    t = timeline.select("clip_id", F.col("seq").alias("t_seq"), "src_start_ms", "src_end_ms", "out_start_ms")
    met = point_join(ends, t, ["clip_id"], "t_ms", ("src_start_ms", "src_end_ms"), longest_ms=STRETCH_MS).withColumn("out", F.col("out_start_ms") + F.col("t_ms") - F.col("src_start_ms"))
    first = lambda side: F.min_by(F.when(F.col("side") == side, F.col("out")), F.when(F.col("side") == side, F.col("t_seq")))
    out = met.groupBy("clip_id", "seq", "text").agg(first(0).alias("start_ms"), first(1).alias("end_ms"))
    return out.filter("start_ms is not null and end_ms is not null and end_ms > start_ms")
