"""Order-dependent operators on words, segments and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_WORDS_PER_LINE, WORDS_PER_LINE
from ..functions import text as T
from .folds import CHUNK_MS, appended, fold_chunks, islands
from .scan import BLOCK_MS

_ORDER = ["start_ms", "end_ms", "seq"]


def dedup_words(words: DataFrame, within_ms: int = 50, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Drops a word that equals the last kept one and starts within ``within_ms`` of it."""
    one = "struct(x.start_ms AS start_ms, x.end_ms AS end_ms, x.seq AS seq, x.w AS w)"
    same = f"p.w = x.w AND abs(p.start_ms - x.start_ms) < {within_ms}"
    return fold_chunks(words, ["source_id"], _ORDER, ["w"], first=one, joins=same, merged=one.replace("x.", "p."), width=chunk_ms)


def dedup_segments(segments: DataFrame, near_ms: int = 500, partial_ms: int = 2000, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Collapses rolling captions: a contiguous repeat extends the last segment, a contiguous longer form replaces it."""
    one = "struct(x.start_ms AS start_ms, x.end_ms AS end_ms, x.seq AS seq, x.text AS text)"
    joins = f"x.start_ms - p.end_ms < {near_ms} AND (p.text = x.text OR (startswith(x.text, p.text) AND x.start_ms - p.start_ms < {partial_ms}))"
    merged = "IF(p.text = x.text, struct(p.start_ms AS start_ms, greatest(p.end_ms, x.end_ms) AS end_ms, p.seq AS seq, p.text AS text), " + one + ")"
    return fold_chunks(segments, ["source_id"], _ORDER, ["text"], first=one, joins=joins, merged=merged, width=chunk_ms)


def _grouped(words: DataFrame, breaks: str, chunk_ms: int) -> DataFrame:
    """Words joined with spaces, until ``breaks`` holds for the group ``p`` and the next word ``x``."""
    first = "struct(x.start_ms AS start_ms, x.end_ms AS end_ms, x.seq AS seq, 1L AS n_words, x.w AS text, x.w AS last)"
    merged = "struct(p.start_ms AS start_ms, x.end_ms AS end_ms, p.seq AS seq, p.n_words + 1L AS n_words, concat(p.text, ' ', x.w) AS text, x.w AS last)"
    return fold_chunks(words, ["source_id"], _ORDER, ["w"], first=first, joins=f"NOT ({breaks})", merged=merged, width=chunk_ms).drop("last")


def group_words(words: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Sentence-like segments: broken at pauses over 1.2 s, spans over 12 s, 30 words, and ends of sentences after 4 s."""
    span = "x.end_ms - p.start_ms"
    return _grouped(words, f"x.start_ms - p.end_ms > 1200 OR {span} > 12000 OR p.n_words >= 30 OR (right(p.last, 1) IN ('.', '?', '!') AND {span} > 4000)", chunk_ms)


def caption_lines(words: DataFrame, style: str = "key_phrase", chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Caption lines: broken at the style's words, pauses over 0.7 s, spans over 3.5 s, 30 characters, and punctuation after two words."""
    most = WORDS_PER_LINE.get(style, DEFAULT_WORDS_PER_LINE)
    return _grouped(words, (
        f"p.n_words >= {most} OR x.start_ms - p.end_ms > 700 OR x.end_ms - p.start_ms > 3500 OR length(p.text) + 1 + length(x.w) > 30 "
        "OR (right(p.last, 1) IN ('.', '?', '!', ',') AND p.n_words >= 2)"), chunk_ms)  # fmt: skip


def shots(samples: DataFrame, jump_pm: int = 120) -> DataFrame:
    """``samples`` that found something, with ``shot``: a jump of more than ``jump_pm`` per mille of the width starts the next."""
    found = samples.filter(F.col("x_pm").isNotNull())
    w = Window.partitionBy("clip_id").orderBy("t_ms")
    cut = F.coalesce(F.abs(F.col("x_pm") - F.lag("x_pm").over(w)) > jump_pm, F.lit(False)).cast("bigint")
    return found.withColumn("cut_", cut).withColumn("shot", F.sum("cut_").over(w)).drop("cut_")


def moving_average(shot_rows: DataFrame, column: str = "x_pm", side: int = 2) -> DataFrame:
    """``smooth``: the mean of up to ``side`` samples at each side, within a shot."""
    w = Window.partitionBy("clip_id", "shot").orderBy("t_ms").rowsBetween(-side, side)
    return shot_rows.withColumn("smooth", F.sum(column).over(w).cast("double") / F.count(column).over(w))


def pan_capped(smoothed: DataFrame, per_s: float = 90.0) -> DataFrame:
    """``x``: the smoothed target, approached by at most ``per_s`` a second from the last output; a recurrence within each shot."""
    rows = smoothed.groupBy("clip_id", "shot").agg(F.array_sort(F.collect_list(F.struct("t_ms", "smooth"))).alias("rows_"))
    limit = f"({per_s}D * greatest(s.t_ms - acc.p.t_ms, 1L) / 1000D)"
    step = f"named_struct('t_ms', s.t_ms, 'x', acc.p.x + greatest(-{limit}, least(s.smooth - acc.p.x, {limit})))"
    kind = "struct<t_ms:bigint,x:double>"
    scan = F.expr(
        f"aggregate(slice(rows_, 2, size(rows_)), named_struct('done', CAST(array() AS array<array<{kind}>>), 'cur', CAST(array() AS array<{kind}>), 'p', CAST(named_struct('t_ms', rows_[0].t_ms, 'x', rows_[0].smooth) AS {kind})), "
        f"(acc, s) -> CAST(named_struct({appended('acc', 'acc.p')}, 'p', {step}) AS struct<done:array<array<{kind}>>,cur:array<{kind}>,p:{kind}>), acc -> concat(flatten(acc.done), acc.cur, array(acc.p)))"
    )
    return rows.select("clip_id", "shot", F.explode(scan).alias("o")).select("clip_id", "shot", "o.*")


def cut_snaps(capped: DataFrame, snap_ms: int = 40) -> DataFrame:
    """Before each cut the outgoing position is held until ``snap_ms`` before it: (clip_id, t_ms, x, is_hold)."""
    w = Window.partitionBy("clip_id").orderBy("t_ms", "shot")
    prev = lambda c: F.lag(c).over(w)
    rows = capped.withColumns({"p_shot": prev("shot"), "p_t": prev("t_ms"), "p_x": prev("x")})
    holds = rows.filter((F.col("p_shot") != F.col("shot")) & (F.col("t_ms") - snap_ms > F.col("p_t")))
    holds = holds.select("clip_id", (F.col("t_ms") - snap_ms).alias("t_ms"), F.col("p_x").alias("x"), F.lit(True).alias("is_hold"))
    return capped.select("clip_id", "t_ms", "x", F.lit(False).alias("is_hold")).unionByName(holds)


def thinned(points: DataFrame, most: int = 40, snap_ms: int = 40) -> DataFrame:
    """At most about ``most`` points a clip: both ends and the pairs at cuts stay, the others go at an even stride."""
    w = Window.partitionBy("clip_id").orderBy("t_ms", F.desc("is_hold"))
    n, i = F.count("*").over(Window.partitionBy("clip_id")), F.row_number().over(w) - 1
    cut = F.coalesce((F.col("t_ms") - F.lag("t_ms").over(w) <= snap_ms) & (F.abs(F.col("x") - F.lag("x").over(w)) > 1.0), F.lit(False))
    rows = points.withColumns({"n_": n, "i_": i, "cut_": cut})
    rows = rows.withColumn("keep_", F.col("cut_") | F.coalesce(F.lead("cut_").over(w), F.lit(False)) | (F.col("i_") == 0) | (F.col("i_") == F.col("n_") - 1))
    part = Window.partitionBy("clip_id")
    rows = rows.withColumns({"kept_": F.sum(F.col("keep_").cast("bigint")).over(part), "rest_": F.sum((~F.col("keep_")).cast("bigint")).over(part)})
    rank = F.sum((~F.col("keep_")).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = rows.withColumns({"budget_": F.greatest(F.lit(0), most - F.col("kept_")), "rank_": rank})
    # number i * rest / budget, rounded down, for some i < budget
    nth = F.floor((F.col("rank_") * F.col("budget_") + F.col("rest_") - 1) / F.col("rest_"))
    chosen = (F.col("budget_") > 0) & (nth < F.col("budget_")) & (F.floor(nth * F.col("rest_") / F.col("budget_")) == F.col("rank_"))
    return rows.filter((F.col("n_") <= most) | F.col("keep_") | chosen).select(*points.columns)


def padded_ends(points: DataFrame, durations: DataFrame) -> DataFrame:
    """The first and last position held to time 0 and to the clip's ``duration_ms``."""
    ends = points.groupBy("clip_id").agg(F.min("t_ms").alias("t0"), F.max("t_ms").alias("t1"), F.min_by("x", F.struct("t_ms", ~F.col("is_hold"))).alias("x0"), F.max_by("x", F.struct("t_ms", ~F.col("is_hold"))).alias("x1"))
    ends = ends.join(durations, "clip_id")
    first = ends.filter("t0 > 0").select("clip_id", F.lit(0).cast("bigint").alias("t_ms"), F.col("x0").alias("x"), F.lit(True).alias("is_hold"))
    last = ends.filter("t1 < duration_ms").select("clip_id", F.col("duration_ms").alias("t_ms"), F.col("x1").alias("x"), F.lit(True).alias("is_hold"))
    return points.unionByName(first).unionByName(last)


def fit_spans(samples: DataFrame, durations: DataFrame, step_ms: int = 500, bridge_ms: int = 800, min_ms: int = 1200) -> DataFrame:
    """Output-time spans in which nothing was found. ``samples``: (clip_id, out_ms) of empty samples."""
    # runs are found in blocks of time first, so that what is sorted by clip are runs and not samples; runs that meet at a
    # block's end are one run by the same rule
    def runs(rows: DataFrame, keys: list[str]) -> DataFrame:
        gap = islands(rows, keys, ["first", "last"], 2 * (F.col("first") - F.col("before_end")) > 3 * step_ms, F.max("last"))
        return gap.groupBy(*keys, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")

    held = samples.select("clip_id", F.floor(F.col("out_ms") / BLOCK_MS).alias("block_"), F.col("out_ms").alias("first"), F.col("out_ms").alias("last"))
    spans = runs(runs(held, ["clip_id", "block_"]), ["clip_id"]).select("clip_id", F.col("first").alias("start_ms"), (F.col("last") + step_ms).alias("end_ms"))
    bridged = islands(spans, ["clip_id"], ["start_ms"], F.col("start_ms") - F.col("before_end") > bridge_ms, F.max("end_ms"))
    merged = bridged.groupBy("clip_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).filter(F.col("end_ms") - F.col("start_ms") >= min_ms)
    return merged.join(durations, "clip_id").select("clip_id", "start_ms", F.least("end_ms", "duration_ms").alias("end_ms"))


def loud(samples: DataFrame) -> DataFrame:
    """``samples`` with ``n``, ``is_loud``: at least the mean and 1.2 standard deviations, in exact integers; false below 4 samples."""
    part = Window.partitionBy("clip_id")
    n, s, q = F.count("level").over(part), F.sum("level").over(part), F.sum(F.col("level") * F.col("level")).over(part)
    rows = samples.filter(F.col("level").isNotNull()).withColumns({"n": n, "s_": s, "q_": q})
    d = F.col("n") * F.col("level") - F.col("s_")
    above = (d >= 0) & (25 * d * d >= 36 * (F.col("n") * F.col("q_") - F.col("s_") * F.col("s_")))
    return rows.withColumn("is_loud", above & (F.col("n") >= 4)).drop("s_", "q_")


def energy_spikes(samples: DataFrame, step_ms: int = 500, most: int = 10) -> DataFrame:
    """Runs of loud samples of half a second or more, the first ``most`` of a clip."""
    w = Window.partitionBy("clip_id").orderBy("t_ms")
    rows = loud(samples).withColumn("run_", F.row_number().over(w) - F.row_number().over(Window.partitionBy("clip_id", "is_loud").orderBy("t_ms")))
    runs = rows.filter("is_loud").groupBy("clip_id", "run_").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("last_ms")).filter(F.col("last_ms") - F.col("start_ms") >= 500)
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy("start_ms"))
    return runs.withColumn("rank_", rank).filter(F.col("rank_") <= most).select("clip_id", "start_ms", (F.col("last_ms") + step_ms).alias("end_ms"))


def two_speakers(samples: DataFrame, width: int = 1280, crop: int = 404) -> DataFrame:
    """Left edges of two crops where the positions of a clip fall into two groups: 8 samples, a gap of 15 %, a minority of 20 %."""
    found = samples.filter(F.col("x_pm").isNotNull())
    w = Window.partitionBy("clip_id").orderBy("x_pm", "t_ms")
    rows = found.withColumns({"i_": F.row_number().over(w) - 1, "n_": F.count("*").over(Window.partitionBy("clip_id")), "gap_": F.col("x_pm") - F.lag("x_pm").over(w)})
    split = F.max(F.when(F.col("i_") > 0, F.struct("gap_", -F.col("i_")))).over(Window.partitionBy("clip_id"))
    rows = rows.withColumn("s_", split).withColumns({"best_": F.col("s_").getField("gap_"), "at_": -F.col("s_")["col2"]})
    left = F.col("i_") < F.col("at_")
    mean = lambda side: F.sum(F.when(side, F.col("x_pm"))).cast("double") / F.count(F.when(side, F.lit(1)))
    out = rows.filter((F.col("n_") >= 8) & (F.col("best_") >= 150) & (5 * F.least(F.col("at_"), F.col("n_") - F.col("at_")) >= F.col("n_")))
    out = out.groupBy("clip_id").agg(mean(left).alias("l_"), mean(~left).alias("r_"))
    column = lambda m: F.greatest(F.lit(0.0), F.least(m * width / 1000 - crop / 2, F.lit(float(width - crop))))
    return out.select("clip_id", column(F.col("l_")).alias("left_x"), column(F.col("r_")).alias("right_x"))


def coverage(spans: DataFrame, durations: DataFrame, slack_ms: int = 500) -> DataFrame:
    """Milliseconds of each clip that its spans cover, and whether that is all but ``slack_ms``."""
    clipped = F.greatest(F.least("end_ms", "duration_ms") - F.greatest(F.col("start_ms"), F.lit(0)), F.lit(0))
    return spans.join(durations, "clip_id").groupBy("clip_id", "duration_ms").agg(F.sum(clipped).alias("covered_ms")).withColumn("covers", F.col("covered_ms") >= F.col("duration_ms") - slack_ms)


def piecewise(points: DataFrame) -> DataFrame:
    """A piecewise linear position as text: a flat sum of half-open gates. ``points``: (clip_id, t_ms, x, is_hold)."""
    w = Window.partitionBy("clip_id").orderBy("t_ms", F.desc("is_hold"))
    rows = points.withColumns({"t1": F.lead("t_ms").over(w), "x1": F.lead("x").over(w), "i_": F.row_number().over(w), "n_": F.count("*").over(Window.partitionBy("clip_id"))})
    t0, t1, x = T.fixed(F.col("t_ms") / 1000.0, 3), T.fixed(F.col("t1") / 1000.0, 3), T.fixed(F.col("x"), 1)
    slope = T.fixed((F.col("x1") - F.col("x")) / ((F.col("t1") - F.col("t_ms")) / 1000.0), 3)
    gate = F.format_string("(gte(t,%s)*lt(t,%s)*(%s+%s*(t-%s)))", t0, t1, x, slope, t0)
    last = F.format_string("(gte(t,%s)*%s)", t0, x)
    rows = rows.withColumn("term_", F.when(F.col("i_") == F.col("n_"), F.when(F.col("n_") == 1, x).otherwise(last)).when(F.col("t1") - F.col("t_ms") >= 1, gate))
    text = rows.groupBy("clip_id").agg(F.max("n_").alias("n_points"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("term_").isNotNull(), F.struct("i_", "term_")))), lambda x: x["term_"]), "+").alias("sum_"))
    return text.select("clip_id", "n_points", F.when(F.col("n_points") == 1, F.col("sum_")).otherwise(F.concat(F.lit("clip("), "sum_", F.lit(",0,in_w-out_w)"))).alias("expr"))


def enable_text(spans: DataFrame) -> DataFrame:
    """``between(...)`` terms of a clip's spans, in order."""
    term = F.format_string("between(t,%d.%03d,%d.%03d)", F.floor(F.col("start_ms") / 1000), F.col("start_ms") % 1000, F.floor(F.col("end_ms") / 1000), F.col("end_ms") % 1000)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", term.alias("t")))), lambda x: x["t"])
    return spans.groupBy("clip_id").agg(F.array_join(ordered, "+").alias("expr"))


def budgeted(df: DataFrame, keys: list[str], max_ms: int, min_ms: int = 1) -> DataFrame:
    """Greedy choice by score: each that still fits is taken, others are skipped; the rows that were chosen.

    Ties go by (start, end, id). ``min_ms``: no row is shorter. Where a row is taken, all better ones of its very length were
    taken too, as they met no larger total; so of each length only the best ``max_ms / length`` of a key can matter. The others
    go before the shuffle, and what is collected of a key is at most ``max_ms * ln(max_ms / min_ms)`` rows, however many it has.
    """
    order = ["start_ms", "end_ms", "candidate_id"]
    length = F.col("end_ms") - F.col("start_ms")
    best = Window.partitionBy(*keys, "len_").orderBy((-F.col("score")).asc(), *order)
    df_ = df.filter(length <= max_ms).withColumn("len_", length).withColumn("rank_", F.row_number().over(best))
    few = df_.filter((F.col("rank_") <= max_ms // max(1, min_ms)) & (F.col("rank_") * F.col("len_") <= max_ms))
    rest = [c for c in df.columns if c not in (*keys, *order)]
    rows = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o_"), *order, *rest))).alias("rows_"))
    kind = rows.schema["rows_"].dataType.simpleString()
    length = "(x.end_ms - x.start_ms)"
    chosen = F.expr(
        f"aggregate(rows_, named_struct('total', 0L, 'took', CAST(array() AS {kind})), (acc, x) -> IF(acc.total + {length} > {max_ms}, acc, "
        f"named_struct('total', acc.total + {length}, 'took', concat(acc.took, array(x)))), acc -> acc.took)"
    )
    # the rows travel in the array, so nothing is joined back
    return rows.select(*keys, F.explode(chosen).alias("x_")).select(*[c if c in keys else F.col(f"x_.{c}").alias(c) for c in df.columns])
