"""Caption files as words and segments. Files are rows (source_id, raw); everything is columns, no file is parsed in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_unescape_all, strip
from ..operators.scan import carried
from ..operators.sequence import dedup_segments, dedup_words, group_words

#: Lines of a file that are numbered in one task.
LINES = 16_384
JSON3 = "struct<events: array<struct<tStartMs: bigint, dDurationMs: bigint, segs: array<struct<utf8: string, tOffsetMs: bigint>>>>>"
# The patterns of the text format.
STAMP = "[0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]{3}"
CUE = f"({STAMP})\\s*-->\\s*({STAMP})"
TAG = f"</?[cvbiu][^>]*>|</?{STAMP}>"


def located(listing: DataFrame, *more: str) -> DataFrame:
    """(source_id, path, kind, columns ``more``) of each source of ``listing`` (source_id, path): its word-timed file if it has one, else its
    cue file, the first by path; null and ``none`` for a source with neither. A source with a null path alone has no files."""
    kind = F.regexp_extract("path", "\\.(json3|vtt)$", 1)
    files = listing.withColumn("kind", F.when(kind != "", kind))
    best = F.min_by(F.struct("path", "kind", *more), F.when(F.col("kind").isNotNull(), F.struct((F.col("kind") != "json3").alias("cues"), "path")))
    found = files.groupBy("source_id").agg(best.alias("f"))
    return found.select("source_id", "f.path", F.coalesce("f.kind", F.lit("none")).alias("kind"), *[F.col(f"f.{c}").alias(c) for c in more])


def read_captions(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, kind, raw) of a folder per source: the word-timed file if there is one, else the cue file, the first by name."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{json3,vtt}")
    files = files.select(F.col("value").alias("raw"), F.input_file_name().alias("path"))
    return located(files.withColumn("source_id", F.regexp_extract("path", "([^/]+)/[^/]+$", 1)), "raw").select("source_id", "kind", "raw")


def _ms(stamp: Column) -> Column:
    part = lambda i, n: F.substring(stamp, i, n).cast("bigint")
    return part(1, 2) * 3_600_000 + part(4, 2) * 60_000 + part(7, 2) * 1000 + part(10, 3)


def json3_words(files: DataFrame) -> DataFrame:
    """Words of word-timed captions: an end is the next word's start within the event, else the event's; 120 ms at least."""
    events = files.select("source_id", F.posexplode(F.from_json("raw", JSON3)["events"]).alias("e_", "ev"))
    segs = F.filter(F.coalesce("ev.segs", F.array().cast("array<struct<utf8:string,tOffsetMs:bigint>>")), lambda s: F.coalesce(s["utf8"].rlike("\\S"), F.lit(False)))
    base = F.coalesce("ev.tStartMs", F.lit(0))
    rows = events.select("source_id", "e_", (base + F.coalesce("ev.dDurationMs", F.lit(0))).alias("stop"), F.transform(segs, lambda s: F.struct(F.regexp_replace(s["utf8"], "^\\s+|\\s+$", "").alias("w"), (base + F.coalesce(s["tOffsetMs"], F.lit(0))).alias("s"))).alias("ws"))
    ends = F.transform("ws", lambda x, i: F.struct(x["w"].alias("w"), x["s"].alias("s"), F.coalesce(F.get("ws", i + 1)["s"], F.col("stop")).alias("e")))
    each = rows.select("source_id", "e_", F.posexplode(ends).alias("i_", "x"))
    each = each.select("source_id", (F.col("e_").cast("bigint") * 1_000_000 + F.col("i_")).alias("seq"), F.col("x.w").alias("w"), F.col("x.s").alias("start_ms"), F.when(F.col("x.e") <= F.col("x.s"), F.col("x.s") + 120).otherwise(F.col("x.e")).alias("end_ms"))
    return dedup_words(each)


def vtt_cues(files: DataFrame) -> DataFrame:
    """Cues as (source_id, cue, start_ms, end_ms, body): a timing line opens one, whether or not a blank line came before; a blank
    line closes it; a bare number before the next timing line is that cue's name."""
    lines = files.select("source_id", F.posexplode(F.split(F.replace("raw", F.lit("\r\n"), F.lit("\n")), "\n")).alias("pos", "line"))
    timing = F.col("line").rlike(CUE)
    lines = lines.withColumns({"t_": timing, "blank_": F.trim("line").rlike("^\\s*$")})
    opens = F.col("t_").cast("bigint")
    lines = carried(lines, ["source_id"], ["pos"], LINES, sums={"before_": opens}, totals={"cues_": opens})
    lines = lines.withColumn("cue", F.col("before_") + opens).filter("cue > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("t_"), F.struct("pos", "line", "blank_"))))
    cues = lines.groupBy("source_id", "cue").agg(F.max("cues_").alias("cues_"), F.max(F.when(F.col("t_"), F.col("line"))).alias("head"), body.alias("b_"))
    first_blank = F.array_min(F.transform(F.filter("b_", lambda x: x["blank_"]), lambda x: x["pos"]))
    cues = cues.withColumn("stop_", first_blank)
    kept = F.filter("b_", lambda x: F.col("stop_").isNull() | (x["pos"] < F.col("stop_")))
    cues = cues.withColumn("l_", F.transform(kept, lambda x: x["line"]))
    more = F.col("cue") < F.col("cues_")
    named = F.col("stop_").isNull() & more & F.coalesce(F.trim(F.get("l_", F.size("l_") - 1)).rlike("^[0-9]+$"), F.lit(False))
    cues = cues.withColumn("n_", named).withColumn("l_", F.when(F.col("n_"), F.slice("l_", F.lit(1), F.size("l_") - 1)).otherwise(F.col("l_")))
    at = lambda i: _ms(F.regexp_extract("head", CUE, i))
    return cues.select("source_id", "cue", at(1).alias("start_ms"), at(2).alias("end_ms"), F.col("l_").alias("body"))


#: Stands between the pieces of a cue while its entities are resolved, all in one call; what is like it in a text is white space.
_BETWEEN = "\x1e"


def _plain(pieces: Column) -> Column:
    """Pieces of a cue without tags, entities and runs of white space."""
    bare = F.transform(pieces, lambda x: F.regexp_replace(F.translate(x, _BETWEEN, " "), TAG, ""))
    whole = html_unescape_all(F.array_join(bare, _BETWEEN))
    return F.transform(F.split(whole, _BETWEEN), lambda x: strip(F.regexp_replace(x, "[\\s\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+", " ")))


def vtt_segments(cues: DataFrame) -> DataFrame:
    rows = cues.select("source_id", F.col("cue").alias("seq"), "start_ms", "end_ms", F.get(_plain(F.array(F.array_join("body", "\n"))), F.lit(0)).alias("text")).filter("text <> ''")
    return dedup_segments(rows)


def vtt_words(cues: DataFrame) -> DataFrame:
    """Words of lines with inline stamps; text before the first stamp starts with the cue, several words of a stamp share its time."""
    timed = F.array_join(F.filter("body", lambda x: x.rlike(f"<{STAMP}>")), "\n")
    rows = cues.withColumn("t_", timed).filter("t_ <> ''")
    rows = rows.withColumns({"p_": F.split("t_", f"<{STAMP}>"), "s_": F.regexp_extract_all("t_", F.lit(f"<({STAMP})>"), F.lit(1))})
    rows = rows.withColumn("p_", _plain(F.col("p_")))
    chunks = F.transform("p_", lambda x, i: F.struct(F.when(i == 0, F.col("start_ms")).otherwise(_ms(F.get("s_", i - 1))).alias("s"), x.alias("x")))
    rows = rows.withColumn("c_", F.filter(chunks, lambda c: c["x"] != ""))
    ends = F.transform("c_", lambda c, i: F.struct(c["s"].alias("s"), F.greatest(F.coalesce(F.get("c_", i + 1)["s"], F.col("end_ms")) - c["s"], F.lit(120)).alias("d"), F.split(c["x"], " ").alias("ws")))
    each = rows.select("source_id", "cue", F.posexplode(ends).alias("i_", "c")).select("source_id", "cue", "i_", F.col("c.s").alias("s"), F.col("c.d").alias("d"), F.size("c.ws").alias("n"), F.posexplode("c.ws").alias("j", "w"))
    at = lambda j: (F.col("s") + F.round(F.col("d") * j / F.col("n"))).cast("bigint")
    seq = F.col("cue") * 1_000_000 + F.col("i_") * 1000 + F.col("j")
    return dedup_words(each.select("source_id", seq.alias("seq"), "w", at(F.col("j")).alias("start_ms"), at(F.col("j") + 1).alias("end_ms")))


def transcript(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, segments) of files (source_id, kind, raw): segments come from words where a source has them, else from its cues."""
    cues = vtt_cues(files.filter("kind = 'vtt'"))
    words = json3_words(files.filter("kind = 'json3'")).unionByName(vtt_words(cues))
    plain = vtt_segments(cues).join(words.select("source_id").distinct(), "source_id", "left_anti")
    columns = ["source_id", "seq", "start_ms", "end_ms", "text"]
    return words, group_words(words).select(*columns).unionByName(plain.select(*columns))
