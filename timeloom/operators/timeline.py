"""Interval subtraction, output timelines, captions on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DROP_MS, KNOBS, Knobs
from ..functions import text as T
from .scan import BLOCK_MS, carried


def keep_segments(spans: DataFrame, silences: DataFrame, knobs: Knobs = KNOBS) -> DataFrame:
    """What is left of each span once long silences are out: (clip_id, member, seq, src_start_ms, src_end_ms).

    ``spans``: (clip_id, member, start_ms, end_ms, drop_ms, pad_ms); ``silences``: (clip_id, member, sil_start, sil_end), disjoint
    within a span. A span's ends move inward past a silence that covers them; silences over ``drop_ms`` are cut out but for
    ``pad_ms`` at each side; pieces under the shortest length go. A span that would be nothing stays whole.
    """
    keys = ["clip_id", "member"]
    met = spans.join(silences, keys, "left")
    # a silence that covers the span's start or end moves it
    s = F.max(F.when((F.col("sil_start") <= F.col("start_ms")) & (F.col("start_ms") < F.col("sil_end")), F.col("sil_end") - F.col("pad_ms")))
    ends = met.groupBy(*keys, "start_ms", "end_ms", "drop_ms", "pad_ms").agg(s.alias("m_"), F.collect_list(F.when(F.col("sil_start").isNotNull(), F.struct("sil_start", "sil_end"))).alias("sil_"))
    ends = ends.withColumn("a_", F.coalesce(F.least(F.greatest("start_ms", "m_"), "end_ms"), F.col("start_ms")))
    covers = F.filter("sil_", lambda x: (x["sil_start"] < F.col("end_ms")) & (F.col("end_ms") <= x["sil_end"]))
    b = F.greatest(F.least(F.col("end_ms"), F.array_min(F.transform(covers, lambda x: x["sil_start"])) + F.col("pad_ms")), F.col("a_"))
    ends = ends.withColumn("b_", F.when(F.size(covers) > 0, b).otherwise(F.col("end_ms")))
    whole = F.col("b_") - F.col("a_") < knobs.min_segment_ms
    clip = F.transform("sil_", lambda x: F.struct(F.greatest(x["sil_start"], F.col("a_")).alias("lo"), F.least(x["sil_end"], F.col("b_")).alias("hi")))
    drops = F.filter(clip, lambda x: x["hi"] - x["lo"] > F.col("drop_ms"))
    drops = F.filter(F.transform(drops, lambda x: F.struct((x["lo"] + F.col("pad_ms")).alias("lo"), (x["hi"] - F.col("pad_ms")).alias("hi"))), lambda x: x["hi"] - x["lo"] >= knobs.min_drop_ms)
    ends = ends.withColumn("d_", F.array_sort(drops))
    # the complement: from the end of each drop (or the start) to the start of the next (or the end)
    cuts = F.concat(F.array(F.struct(F.col("a_").alias("lo"), F.col("a_").alias("hi"))), F.col("d_"), F.array(F.struct(F.col("b_").alias("lo"), F.col("b_").alias("hi"))))
    ends = ends.withColumn("c_", cuts)
    pieces = F.transform(F.sequence(F.lit(1), F.size("c_") - 1), lambda i: F.struct(F.get("c_", i - 1)["hi"].alias("s"), F.get("c_", i)["lo"].alias("e")))
    pieces = F.filter(pieces, lambda x: x["e"] - x["s"] >= knobs.min_segment_ms)
    none = F.array(F.struct(F.col("a_").alias("s"), F.col("b_").alias("e")))
    ends = ends.withColumn("p_", F.when(whole, F.array(F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))).when(F.size(pieces) > 0, pieces).otherwise(none))
    return ends.select(*keys, F.posexplode("p_").alias("seq", "x")).select(*keys, F.col("seq").cast("bigint").alias("seq"), F.col("x.s").alias("src_start_ms"), F.col("x.e").alias("src_end_ms"))


#: Members of a clip that are summed up in one task.
MEMBERS = 1024


def build_timeline(kept: DataFrame, budget_ms: int, knobs: Knobs = KNOBS) -> DataFrame:
    """Kept pieces laid end to end until the budget: the piece that passes it is cut, what follows goes, and members overlap by
    the crossfade. In closed form over running sums."""
    budget = min(budget_ms, knobs.clip_max_ms)
    # a member's pieces are in one block, so the first of them is known there; members before a piece are counted by these
    opens = F.row_number().over(Window.partitionBy("clip_id", "member").orderBy("seq")) == 1
    rows = kept.withColumn("opens_", opens.cast("bigint"))
    rows = carried(rows, ["clip_id"], ["member", "seq"], MEMBERS, sums={"prior_": F.col("src_end_ms") - F.col("src_start_ms"), "m_": F.col("opens_")})
    rows = rows.filter(budget - F.col("prior_") > knobs.min_segment_ms).withColumn("m_", F.col("m_") + F.col("opens_") - 1)
    length = F.least(F.col("src_end_ms") - F.col("src_start_ms"), budget - F.col("prior_"))
    rows = rows.withColumn("src_end_ms", F.col("src_start_ms") + length)
    out = (F.col("prior_") - knobs.crossfade_ms * F.col("m_")).cast("bigint")
    return rows.select("clip_id", "member", "seq", "src_start_ms", "src_end_ms", out.alias("out_start_ms"))


def trimmed(spans: DataFrame, timeline: DataFrame) -> DataFrame:
    """Milliseconds of each clip's members that the timeline leaves out."""
    raw = spans.groupBy("clip_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("raw_ms"))
    kept = timeline.groupBy("clip_id").agg(F.sum(F.col("src_end_ms") - F.col("src_start_ms")).alias("kept_ms"))
    return raw.join(kept, "clip_id").select("clip_id", "raw_ms", "kept_ms", F.greatest(F.col("raw_ms") - F.col("kept_ms"), F.lit(0)).cast("bigint").alias("trimmed_ms"))


def drop_ms(trim) -> F.Column:
    out = F.lit(500)
    for name, ms in DROP_MS.items():
        out = F.when(trim == name, F.lit(ms)).otherwise(out)
    return out


def silences_of(words: DataFrame, least_ms: int = 300) -> DataFrame:
    """Gaps between the words of a source."""
    rows = carried(words, ["source_id"], ["start_ms", "end_ms", "seq"], BLOCK_MS, maxima={"before_": F.col("end_ms")})
    return rows.filter(F.col("start_ms") - F.col("before_") >= least_ms).select("source_id", F.col("before_").alias("sil_start"), F.col("start_ms").alias("sil_end"))


def word_pop(lines: DataFrame) -> DataFrame:
    """An event per word of a caption line: (source_id, line, i, start_ms, end_ms, text), the word marked in the whole line.

    ``lines``: (source_id, line, i, w, start_ms, end_ms), i from 0.
    """
    part = Window.partitionBy("source_id", "line")
    w = part.orderBy("i")
    rows = lines.withColumns({
        "ls_": F.first("start_ms").over(w), "le_": F.greatest(F.last("end_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.first("start_ms").over(w) + 300),
        "next_": F.lead("start_ms").over(w), "all_": F.transform(F.array_sort(F.collect_list(F.struct("i", "w")).over(part)), lambda x: x["w"]),
    })
    start = F.when(F.col("i") == 0, F.col("ls_")).otherwise(F.greatest("start_ms", "ls_"))
    rows = rows.withColumn("s_", start)
    end = F.least(F.greatest(F.coalesce("next_", "le_"), F.col("s_") + 50), "le_")
    shown = lambda x: F.concat(F.lit(f"{{\\c{POP}&\\fscx108\\fscy108}}"), T.caption_escape(x), F.lit(f"{{\\c{BASE}&\\fscx100\\fscy100}}"))
    marked = F.array_join(F.transform("all_", lambda x, j: F.when(j == F.col("i"), shown(x)).otherwise(T.caption_escape(x))), " ")
    marked = F.concat(F.lit(f"{{\\c{BASE}&}}"), marked)
    return rows.select("source_id", "line", "i", F.col("s_").alias("start_ms"), end.alias("end_ms"), marked.alias("text"))


def cue_events(segments: DataFrame) -> DataFrame:
    """Cue captions: 300 ms at least; more than six words are wrapped to two balanced lines."""
    words = F.filter(F.split(T.caption_escape(F.col("text")), "[ \\t\\n\\r]+"), lambda x: x != "")
    mid = F.floor((F.size("ws_") + 1) / 2).cast("int")
    two = F.concat(F.array_join(F.slice("ws_", F.lit(1), mid), " "), F.lit("\\N"), F.array_join(F.slice("ws_", mid + 1, F.size("ws_")), " "))
    rows = segments.withColumn("ws_", words)
    return rows.select("source_id", "seq", "start_ms", F.greatest(F.col("end_ms"), F.col("start_ms") + 300).alias("end_ms"), F.when(F.size("ws_") > 6, two).otherwise(T.caption_escape(F.col("text"))).alias("text"))


# The caption colours (alpha, blue, green, red), the output's size and rates, and the caption file's header.
POP, BASE, OUTLINE, SHADOW = "&H0000D7FF", "&H00FFFFFF", "&H00101010", "&HA0000000"
OUT_W, OUT_H, OUT_FPS, AUDIO_RATE = 1080, 1920, 30, 44100
BLUR_W, BLUR_H, BLUR_SIGMA, FIT_LIFT = 270, 480, 8, 140
FONT = "Liberation Sans"
HEADER = """[Script Info]
ScriptType: v4.00+
PlayResX: {width}
PlayResY: {height}
WrapStyle: 2
ScaledBorderAndShadow: yes
YCbCr Matrix: TV.709

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Clip,{font},{size},{base},{pop},{outline},{shadow},-1,0,0,0,100,100,0,0,1,4,2,2,80,80,{margin},1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def dialogue(events: DataFrame) -> DataFrame:
    """A dialogue line of a caption file per event."""
    line = F.concat(F.lit("Dialogue: 0,"), T.caption_time(F.col("start_ms")), F.lit(","), T.caption_time(F.col("end_ms")), F.lit(",Clip,,0,0,0,,"), F.col("text"))
    return events.withColumn("dialogue", line)


def caption_files(events: DataFrame, order: list[str], size: int = 76, margin: int = 420) -> DataFrame:
    """A caption file per source: the header, then its dialogue lines in order."""
    head = HEADER.format(width=OUT_W, height=OUT_H, font=FONT, size=size, base=BASE, pop=POP, outline=OUTLINE, shadow=SHADOW, margin=margin)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, "dialogue"))), lambda x: F.concat(x["dialogue"], F.lit("\n")))
    return dialogue(events).groupBy("source_id").agg(F.concat(F.lit(head), F.array_join(lines, "")).alias("captions"))


def join_graph(timeline: DataFrame, knobs: Knobs = KNOBS) -> DataFrame:
    """The part of a media graph that joins a clip's pieces, as text: time bases, hard cuts within a member, crossfades between
    members. (clip_id, n_inputs, n_members, graph); inputs are numbered as the pieces stand in the timeline."""
    part = Window.partitionBy("clip_id")
    w = part.orderBy("member", "seq")
    rows = timeline.withColumns({"i_": F.row_number().over(w) - 1, "m_": F.dense_rank().over(part.orderBy("member")) - 1})
    pins = F.format_string(f"[%d:v]settb=1/{OUT_FPS},fps={OUT_FPS}[v%d];[%d:a]asettb=1/{AUDIO_RATE}[a%d]", "i_", "i_", "i_", "i_")
    first = rows.groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i_", pins.alias("t")))), lambda x: x["t"]), ";").alias("pins_"), F.count("*").alias("n_inputs"))
    cuts = rows.groupBy("clip_id", "m_").agg(F.sort_array(F.collect_list("i_")).alias("is_"), F.sum(F.col("src_end_ms") - F.col("src_start_ms")).alias("len_"))
    chain = F.array_join(F.transform("is_", lambda i: F.concat(F.lit("[v"), i.cast("string"), F.lit("][a"), i.cast("string"), F.lit("]"))), "")
    n, one = F.size("is_"), F.get("is_", F.lit(0)).cast("string")
    concat = F.when(n > 1, F.concat(chain, F.format_string("concat=n=%d:v=1:a=1[cv%d][ca%d];", n, "m_", "m_"))).otherwise(F.lit(""))
    src = lambda k: F.when(n > 1, F.concat(F.lit(f"[c{k}"), F.col("m_").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit(f"[{k}"), one, F.lit("]")))
    member = F.concat(concat, src("v"), F.format_string(f"settb=1/{OUT_FPS},format=yuv420p,setsar=1[mv%d];", "m_"), src("a"), F.format_string(f"asettb=1/{AUDIO_RATE}[ma%d]", "m_"))
    # a member starts where the earlier ones end, less a crossfade each
    before = F.sum("len_").over(part.orderBy("m_").rowsBetween(Window.unboundedPreceding, -1))
    at = F.greatest(before - knobs.crossfade_ms * F.col("m_"), F.lit(0)) / 1000.0
    label = lambda k: F.when(F.col("m_") == 1, F.lit(f"[m{k}0]")).otherwise(F.format_string(f"[{k}x%d]", F.col("m_") - 1))
    fade = knobs.crossfade_ms / 1000
    video = F.concat(label("v"), F.format_string(f"[mv%d]xfade=transition=fade:duration={fade}:offset=%.3f[vx%d];", "m_", at, "m_"))
    cross = F.concat(video, label("a"), F.format_string(f"[ma%d]acrossfade=d={fade}[ax%d]", "m_", "m_"))
    cuts = cuts.withColumns({"member_": member, "cross_": F.when(F.col("m_") > 0, cross)})
    told = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("m_", F.col(c).alias("t"))))), lambda x: x["t"])
    rest = cuts.groupBy("clip_id").agg(told("member_").alias("a_"), told("cross_").alias("b_"), F.count("*").alias("n_members"))
    return first.join(rest, "clip_id").select("clip_id", "n_inputs", "n_members", F.array_join(F.concat(F.array("pins_"), "a_", "b_"), ";").alias("graph"))


def follow_chain(crop, height, expr) -> F.Column:
    """The crop that follows a position, scaled and padded to the output."""
    size = f"{OUT_W}:{OUT_H}"
    return F.concat(F.format_string("crop=w=%d:h=%d:x='", crop, height), F.coalesce(expr, F.lit("(in_w-out_w)/2")), F.lit(f"':y=0,scale={size}:force_original_aspect_ratio=decrease,pad={size}:(ow-iw)/2:(oh-ih)/2:black"))


def fit_chain(source, out) -> F.Column:
    """The whole frame over a blurred, darkened copy of itself; nothing is cropped away."""
    parts = [
        (source, F.lit("split=2[fb_bg][fb_fg]")),
        (F.lit("[fb_bg]"), F.lit(f"scale={BLUR_W}:{BLUR_H}:force_original_aspect_ratio=increase,crop={BLUR_W}:{BLUR_H},gblur=sigma={BLUR_SIGMA},scale={OUT_W}:{OUT_H},eq=brightness=-0.10,setsar=1[fb_bgb]")),
        (F.lit("[fb_fg]"), F.lit(f"scale={OUT_W}:-2,setsar=1[fb_fgs]")),
        (F.lit("[fb_bgb][fb_fgs]"), F.concat(F.lit(f"overlay=(W-w)/2:(H-h)/2-{FIT_LIFT}:format=auto,setsar=1,format=yuv420p"), out)),
    ]
    return F.concat_ws(";", *[F.concat(pins, steps) for pins, steps in parts])


def sample_grid(timeline: DataFrame, per_s: int = 2, most: int = 240) -> DataFrame:
    """(clip_id, seq, t_ms): the times at which kept stretches are looked at, evenly from each start; the first ``most`` of a clip, in order."""
    step = 1000 // per_s
    looks = F.floor((F.col("src_end_ms") - F.col("src_start_ms")) * per_s / 1000) + 1
    w = Window.partitionBy("clip_id").orderBy("seq")
    rows = timeline.withColumn("n_", looks).withColumn("before_", F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("n_", F.least("n_", most - F.col("before_"))).filter("n_ > 0")
    rows = rows.select("clip_id", "seq", "src_start_ms", "src_end_ms", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_") - 1)).alias("i_"))
    return rows.select("clip_id", "seq", F.least(F.col("src_start_ms") + F.col("i_") * step, "src_end_ms").alias("t_ms"))


def face_samples(timeline: DataFrame, boxes: DataFrame) -> DataFrame:
    """The grid with ``x_pm``, the centre of the largest box that was found at that time (of equals the leftmost), or null.

    ``boxes``: (clip_id, t_ms, left_pm, width_pm, height_pm), what a detector found, in per mille of the frame."""
    area = F.col("width_pm") * F.col("height_pm")
    best = boxes.groupBy("clip_id", "t_ms").agg(F.max_by(F.col("left_pm") + F.expr("width_pm div 2"), F.struct(area.alias("a"), (-F.col("left_pm")).alias("l"))).alias("x_pm"))
    return sample_grid(timeline).join(best, ["clip_id", "t_ms"], "left").select("clip_id", "seq", "t_ms", "x_pm")


def envelope(success: F.Column, error: F.Column, hint: F.Column, fields: F.Column) -> F.Column:
    """A result as JSON, success first, with an estimate of its tokens."""
    body = F.to_json(F.struct(success.alias("success"), error.alias("error"), hint.alias("hint"), fields.alias("fields"), F.array().cast("array<string>").alias("progress")))
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"token_estimate":'), T.token_estimate(body).cast("string"), F.lit("}"))
