"""Results of external tools, read from what they print or answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROBE = "struct<title: string, duration: double, webpage_url: string, subtitles: map<string, string>, automatic_captions: map<string, string>>"


def _ms(seconds):
    return F.round(seconds.cast("double") * 1000).cast("bigint")


def silence_log(lines: DataFrame) -> DataFrame:
    """Silences from log lines (clip_id, pos, line, span_start_ms, span_end_ms): times are relative to the span; each end goes with the
    start right before it; a silence that is open at the end lasts to the span's end; all are clipped to the span."""
    kind = F.when(F.col("line").rlike("silence_start:\\s*-?[0-9.]+"), "start").when(F.col("line").rlike("silence_end:\\s*-?[0-9.]+"), "end")
    at = F.col("span_start_ms") + _ms(F.regexp_extract("line", "silence_(?:start|end):\\s*(-?[0-9.]+)", 1))
    rows = lines.withColumns({"k_": kind, "t_": at}).filter("k_ is not null")
    w = Window.partitionBy("clip_id", "span_start_ms").orderBy("pos")
    rows = rows.withColumns({"pk_": F.lag("k_").over(w), "pt_": F.lag("t_").over(w), "nk_": F.lead("k_").over(w)})
    pairs = rows.filter("k_ = 'end' and pk_ = 'start'").select("clip_id", "span_start_ms", "span_end_ms", F.col("pt_").alias("s"), F.col("t_").alias("e"))
    open_ = rows.filter("k_ = 'start' and nk_ is null").select("clip_id", "span_start_ms", "span_end_ms", F.col("t_").alias("s"), F.col("span_end_ms").alias("e"))
    out = pairs.unionByName(open_).select("clip_id", F.greatest("s", "span_start_ms").alias("sil_start"), F.least("e", "span_end_ms").alias("sil_end"))
    return out.filter("sil_end > sil_start")


def rms_log(lines: DataFrame) -> DataFrame:
    """(clip_id, t_ms, level) from log lines (clip_id, pos, line): a level belongs to the last time before it; -inf is skipped."""
    pts = F.regexp_extract("line", "pts_time:([0-9.]+)", 1)
    level = F.regexp_extract("line", "lavfi\\.astats\\.Overall\\.RMS_level=(-?[0-9.]+|-inf)", 1)
    rows = lines.withColumns({"p_": F.nullif(pts, F.lit("")), "l_": F.nullif(level, F.lit(""))})
    rows = rows.withColumn("at_", F.last("p_", True).over(Window.partitionBy("clip_id").orderBy("pos")))
    return rows.filter("l_ is not null and l_ <> '-inf' and at_ is not null").select("clip_id", _ms(F.col("at_")).alias("t_ms"), F.col("l_").cast("double").alias("level"))


def probe_json(rows: DataFrame) -> DataFrame:
    """(source_id, title, duration_ms, url) of metadata answers (source_id, raw); of a list the first entry; nulls where the text is no JSON."""
    p = F.from_json("raw", PROBE)
    first = F.from_json("raw", f"struct<entries: array<{PROBE}>>")["entries"]
    info = F.when(F.size(first) > 0, F.get(first, F.lit(0))).otherwise(p)
    return rows.withColumn("i_", info).select("source_id", F.col("i_.title").alias("title"), _ms(F.coalesce("i_.duration", F.lit(0.0))).alias("duration_ms"), F.col("i_.webpage_url").alias("url"))


def probe_tracks(rows: DataFrame) -> DataFrame:
    """(source_id, track, kind) of the caption tracks that metadata answers list."""
    info = rows.withColumn("i_", F.from_json("raw", PROBE))
    part = lambda c, kind: info.select("source_id", F.explode(F.map_keys(f"i_.{c}")).alias("track"), F.lit(kind).alias("kind"))
    return part("subtitles", "manual").unionByName(part("automatic_captions", "auto"))
