"""Queries of the scans: files are written as text from the tables and read back; the SQL gives what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import captions as C
from ..sources import logs as L
from ..sources import sinks as S
from . import adapter as A
from .adapter import CAND_SQL, SAMPLES_SQL, WORDS_SQL
from .scratch import scratch


def _turns(spark, sf):
    return A.dense_words(spark, sf).withColumn("e", F.expr("seq div 12"))


def _json3(spark, sf):
    """Events of twelve words each, with a window event and a blank segment."""
    w = F.transform(F.array_sort(F.collect_list(F.struct("seq", "w", "start_ms"))), lambda x: x)
    ev = _turns(spark, sf).groupBy("source_id", "e").agg(F.min("start_ms").alias("t0"), F.max("end_ms").alias("t1"), w.alias("ws"))
    segs = F.concat(F.transform("ws", lambda x: F.struct(F.concat(F.lit(" "), x["w"]).alias("utf8"), (x["start_ms"] - F.col("t0")).alias("tOffsetMs"))), F.array(F.struct(F.lit(" \n").alias("utf8"), F.lit(0).cast("bigint").alias("tOffsetMs"))))
    ev = ev.select("source_id", "e", F.struct(F.col("t0").alias("tStartMs"), (F.col("t1") - F.col("t0")).alias("dDurationMs"), segs.alias("segs")).alias("ev"))
    raw = ev.groupBy("source_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("e", F.to_json("ev").alias("j")))), lambda x: F.from_json(x["j"], "struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string,tOffsetMs:bigint>>>")).alias("events"))).alias("raw"))
    return raw.withColumn("raw", F.replace("raw", F.lit('{"events":['), F.lit('{"wireMagic":"pb3","events":[{"tStartMs":0,"wWinId":1},')))


def json3_words(spark, sf):
    return C.json3_words(_json3(spark, sf)).select("source_id", "w", "start_ms", "end_ms")


JSON3_SQL = f"""WITH {WORDS_SQL} SELECT source_id, w, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY source_id, seq // 12 ORDER BY seq), end_ms) AS end_ms FROM words"""


def _stamp(ms):
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def _vtt(spark, sf, inline: bool):
    """Cues of twelve words; every other one has no blank line before it and a number as its name; words hold entities and tags."""
    words = F.array_sort(F.collect_list(F.struct("seq", "w", "start_ms")))
    cue = _turns(spark, sf).groupBy("source_id", "e").agg(F.min("start_ms").alias("t0"), F.max("end_ms").alias("t1"), words.alias("ws"))
    if inline:
        body = F.array_join(F.transform("ws", lambda x, i: F.concat(F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit("<"), _stamp(x["start_ms"]), F.lit("><c> "))), x["w"], F.when(i == 0, F.lit("")).otherwise(F.lit("</c>")))), "")
        body = F.concat(F.lit("carry over &copy;\n"), body, F.when(F.size("ws") == 1, F.concat(F.lit("<"), _stamp(F.col("t0")), F.lit(">"))).otherwise(F.lit("")))
    else:
        body = F.concat(F.lit("<i>a &amp; b</i> caf&eacute;&#8217;s&nbsp;&hellip; "), F.array_join(F.transform("ws", lambda x: x["w"]), "\n"))
    text = F.concat(F.when(F.col("e") % 2 == 0, F.lit("\n")).otherwise(F.concat(F.col("e").cast("string"), F.lit("\n"))), _stamp(F.col("t0")), F.lit(" --> "), _stamp(F.col("t1")), F.lit(" align:start\n"), body, F.lit("\n"))
    rows = cue.select("source_id", "e", text.alias("x")).groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "x"))), lambda x: x["x"]), "").alias("t"))
    return rows.select("source_id", F.concat(F.lit("WEBVTT\nKind: captions\n"), "t").alias("raw"))


def vtt_segments(spark, sf):
    return C.vtt_segments(C.vtt_cues(_vtt(spark, sf, False))).select("source_id", "start_ms", "end_ms", "text")


VTT_SQL = f"""WITH {WORDS_SQL} SELECT source_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, 'a & b café’s … ' || string_agg(w, ' ' ORDER BY seq) AS text FROM words GROUP BY source_id, seq // 12"""


def vtt_words(spark, sf):
    return C.vtt_words(C.vtt_cues(_vtt(spark, sf, True))).select("source_id", "w", "start_ms", "end_ms")


VTT_WORDS_SQL = f"""WITH {WORDS_SQL} SELECT source_id, w, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY source_id, seq // 12 ORDER BY seq), end_ms) AS end_ms FROM words"""


def transcripts(spark, sf):
    """Files of both kinds, by turns word-timed, with stamps in the cues, and plain: words where a source has them, else its segments."""
    turn = lambda raw, kind, k: raw.filter(F.col("source_id") % 3 == k).select("source_id", F.lit(kind).alias("kind"), "raw")
    files = turn(_json3(spark, sf), "json3", 0).unionByName(turn(_vtt(spark, sf, True), "vtt", 1)).unionByName(turn(_vtt(spark, sf, False), "vtt", 2))
    words, segments = C.transcript(files)
    of = lambda rows, kind, text: rows.select(F.lit(kind).alias("kind"), "source_id", F.col(text).alias("text"), "start_ms", "end_ms")
    return of(words, "word", "w").unionByName(of(segments, "segment", "text"))


_TIMED = f"""{WORDS_SQL}, timed AS (SELECT source_id, seq, w, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY source_id, seq // 12 ORDER BY seq), end_ms) AS end_ms FROM words),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, seq) AS rn FROM timed),
f(source_id, rn, g, q, s, e, n, t, lw) AS (SELECT source_id, rn, 1, seq, start_ms, end_ms, 1, w, w FROM r WHERE rn = 1
  UNION ALL SELECT r.source_id, r.rn, CASE WHEN b THEN g + 1 ELSE g END, CASE WHEN b THEN seq ELSE q END, CASE WHEN b THEN start_ms ELSE s END, end_ms, CASE WHEN b THEN 1 ELSE n + 1 END, CASE WHEN b THEN w ELSE t || ' ' || w END, w
  FROM f JOIN r ON r.source_id = f.source_id AND r.rn = f.rn + 1, LATERAL (SELECT start_ms - e > 1200 OR end_ms - s > 12000 OR n >= 30 OR (right(lw, 1) IN ('.', '?', '!') AND end_ms - s > 4000) AS b)),
grouped AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source_id, g ORDER BY rn DESC) = 1)"""
TRANSCRIPTS_SQL = f"""WITH RECURSIVE {_TIMED} SELECT 'word' AS kind, source_id, w AS text, start_ms, end_ms FROM timed WHERE source_id % 3 < 2
UNION ALL SELECT 'segment', source_id, t, s, e FROM grouped WHERE source_id % 3 < 2
UNION ALL SELECT 'segment', source_id, 'a & b café’s … ' || string_agg(w, ' ' ORDER BY seq), min(start_ms), max(end_ms) FROM words WHERE source_id % 3 = 2 GROUP BY source_id, seq // 12"""


def caption_file(spark, sf):
    """Files of a source's folder, of all kinds or none: the one to read."""
    c, k = A.table(spark, sf, "orders"), F.col("o_orderkey")
    ending = F.get(F.array(*[F.lit(x) for x in (".en.vtt", ".en.json3", ".mp4", ".info.json", "-orig.json3", ".vtt.part", ".de.vtt")]), ((k + F.col("o_custkey")) % 7).cast("int"))
    path = F.when(k % 11 > 0, F.concat(F.lit("sources/"), F.col("o_custkey").cast("string"), F.lit("/v"), (k % 5).cast("string"), ending))
    return C.located(c.select(F.col("o_custkey").alias("source_id"), path.alias("path")))


CAPTION_FILE_SQL = """WITH p AS (SELECT o_custkey AS source_id, CASE WHEN o_orderkey % 11 > 0 THEN 'sources/' || o_custkey || '/v' || (o_orderkey % 5) || ['.en.vtt', '.en.json3', '.mp4', '.info.json', '-orig.json3', '.vtt.part', '.de.vtt'][(o_orderkey + o_custkey) % 7 + 1] END AS path FROM orders),
b AS (SELECT source_id, min(path) FILTER (WHERE ends_with(path, '.json3')) AS j, min(path) FILTER (WHERE ends_with(path, '.vtt')) AS v FROM p GROUP BY source_id)
SELECT source_id, coalesce(j, v) AS path, CASE WHEN j IS NOT NULL THEN 'json3' WHEN v IS NOT NULL THEN 'vtt' ELSE 'none' END AS kind FROM b"""


def saved_transcripts(spark, sf):
    """Transcripts saved as a JSON file each, with one that is broken in three, and read again."""
    w = _turns(spark, sf)
    lines = w.groupBy("source_id", "e").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "w"))), lambda x: x["w"]), " ").alias("text"))
    segments = F.transform(F.array_sort(F.collect_list(F.struct("e", "start_ms", "end_ms", "text"))), lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["text"].alias("text")))
    saved = lines.groupBy("source_id").agg(F.to_json(F.struct("source_id", segments.alias("segments"))).alias("j"))
    broken = F.when(F.col("source_id") % 3 == 0, F.expr("substring(j, 1, length(j) - 1)")).otherwise(F.col("j"))
    folder = scratch(spark, "transcripts")
    # one document a file
    saved.select(broken.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    back = S.load_json(spark, folder, "source_id long, segments array<struct<start_ms: long, end_ms: long, text: string>>", "*.txt")
    return back.select("source_id", F.size("segments").cast("bigint").alias("n_segments"), F.md5(F.array_join(F.transform("segments", lambda x: F.concat_ws("|", x["start_ms"], x["end_ms"], x["text"])), "\n")).alias("segments_md5"))


SAVED_SQL = f"""WITH {WORDS_SQL}, l AS (SELECT source_id, seq // 12 AS e, min(start_ms) || '|' || max(end_ms) || '|' || string_agg(w, ' ' ORDER BY seq) AS t FROM words GROUP BY source_id, seq // 12)
SELECT source_id, count(*) AS n_segments, md5(string_agg(t, chr(10) ORDER BY e)) AS segments_md5 FROM l WHERE source_id % 3 <> 0 GROUP BY source_id"""


def silence_log(spark, sf):
    """Three silences a candidate, the last one without an end, and noise in between."""
    c = A.candidates(spark, sf).select("candidate_id", "start_ms", "end_ms")
    line = lambda k, f: F.format_string("[x] %s: %d.%d%s", F.lit(f"silence_{k}"), F.floor(f / 1000), F.floor(f % 1000 / 100), F.lit(" | silence_duration: 1" if k == "end" else ""))
    d = F.col("end_ms") - F.col("start_ms")
    lines = F.array(F.lit("noise"), line("start", d * 0), line("end", F.lit(700)), line("start", F.lit(1500)), F.lit("size=1"), line("end", F.lit(2300)), line("end", F.lit(2400)), line("start", d - d % 100 - 1000))
    rows = c.select(F.col("candidate_id").alias("clip_id"), F.col("start_ms").alias("span_start_ms"), F.col("end_ms").alias("span_end_ms"), F.posexplode(lines).alias("pos", "line"))
    return L.silence_log(rows)


SILENCE_SQL = f"""WITH {CAND_SQL}, s AS (SELECT candidate_id AS clip_id, start_ms AS a, end_ms AS b, unnest([0, 1500, (end_ms - start_ms) // 100 * 100 - 1000]) AS s, unnest([700, 2300, end_ms - start_ms]) AS e FROM cand)
SELECT clip_id, a + s AS sil_start, least(a + e, b) AS sil_end FROM s"""


def rms_log(spark, sf):
    """A level after each time; where nothing was found it is -inf."""
    s = A.samples(spark, sf)
    level = F.when(F.col("x_pm").isNull(), F.lit("-inf")).otherwise(F.concat(F.lit("-"), F.floor(-F.col("level") / 10).cast("string"), F.lit("."), (-F.col("level") % 10).cast("string")))
    two = F.array(F.concat(F.lit("frame:1 pts:2 pts_time:"), F.floor(F.col("t_ms") / 1000).cast("string"), F.lit("."), F.floor(F.col("t_ms") % 1000 / 100).cast("string")), F.concat(F.lit("lavfi.astats.Overall.RMS_level="), level))
    rows = s.select("clip_id", "t_ms", F.posexplode(two).alias("k", "line")).select("clip_id", (F.col("t_ms") * 2 + F.col("k")).alias("pos"), "line")
    return L.rms_log(rows)


RMS_SQL = f"WITH {SAMPLES_SQL} SELECT clip_id, t_ms, level / 10.0::DOUBLE AS level FROM smp WHERE x_pm IS NOT NULL"


def probe_json(spark, sf):
    c = A.table(spark, sf, "customer")
    k = F.col("c_custkey")
    one = F.to_json(F.struct(F.col("c_name").alias("title"), (k * 1.5).alias("duration"), F.concat(F.lit("https://x/"), k.cast("string")).alias("webpage_url"), F.create_map(F.lit("en"), F.lit("a")).alias("subtitles")))
    raw = F.when(k % 3 == 0, F.concat(F.lit('{"entries": ['), one, F.lit("]}"))).when(k % 7 == 1, F.lit("{broken")).otherwise(one)
    return L.probe_json(c.select(k.alias("source_id"), raw.alias("raw")))


PROBE_SQL = """SELECT c_custkey AS source_id, CASE WHEN ok THEN c_name END AS title, CASE WHEN ok THEN c_custkey * 1500 ELSE 0 END AS duration_ms, CASE WHEN ok THEN 'https://x/' || c_custkey END AS url
FROM (SELECT *, c_custkey % 3 = 0 OR c_custkey % 7 <> 1 AS ok FROM customer)"""

QUERIES = {
    "json3_words": (json3_words, JSON3_SQL), "vtt_segments": (vtt_segments, VTT_SQL), "vtt_words": (vtt_words, VTT_WORDS_SQL), "transcripts": (transcripts, TRANSCRIPTS_SQL), "caption_file": (caption_file, CAPTION_FILE_SQL), "saved_transcripts": (saved_transcripts, SAVED_SQL), "silence_log": (silence_log, SILENCE_SQL), "rms_log": (rms_log, RMS_SQL), "probe_json": (probe_json, PROBE_SQL),
}
