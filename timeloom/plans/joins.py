"""Queries of windows and interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import KNOBS
from ..operators import candidates as C
from ..operators import sweeps as SW
from ..operators import windows as W
from . import adapter as A
from .adapter import CAND_SQL, LONG_SQL, SEG_SQL, TIMELINE_SQL, WORDS_SQL


def chunk_bounds(spark, sf):
    i = A.candidates(spark, sf).select("candidate_id", (F.col("candidate_id") % 40).alias("i"), (F.col("start_ms") * 3).alias("d"))
    lo, hi = W.chunk_bounds(F.col("i"))
    return i.select("candidate_id", lo.alias("start_ms"), hi.alias("end_ms"), W.chunk_count(F.col("d")).alias("n_chunks"))


CHUNK_BOUNDS_SQL = f"""WITH {CAND_SQL} SELECT candidate_id, candidate_id % 40 * 480000 AS start_ms, candidate_id % 40 * 480000 + 600000 AS end_ms,
  CAST(CASE WHEN start_ms * 3 <= 600000 THEN 1 ELSE (start_ms * 3 - 600000 + 479999) // 480000 + 1 END AS BIGINT) AS n_chunks FROM cand"""


def transcript_chunks(spark, sf):
    return W.chunks(A.segments(spark, sf)).select("source_id", "chunk", "n", "seq", "start_ms", "end_ms", "total_available", "truncated")


CHUNKS_SQL = f"""WITH {SEG_SQL}, ch AS (SELECT unnest(range(6)) AS chunk),
m AS (SELECT source_id, chunk, row_number() OVER (PARTITION BY source_id, chunk ORDER BY start_ms, seq) AS n, seq, start_ms, end_ms, count(*) OVER (PARTITION BY source_id, chunk) AS total_available
  FROM seg JOIN ch ON end_ms > chunk * 480000 AND start_ms < chunk * 480000 + 600000)
SELECT source_id, chunk, n, seq, start_ms, end_ms, total_available, total_available > 240 AS truncated FROM m WHERE n <= 240"""


def slice_segments(spark, sf):
    seg = A.segments(spark, sf).select("source_id", F.col("seq").alias("g_seq"), F.col("start_ms").alias("g_start"), F.col("end_ms").alias("g_end"))
    met = W.interval_join(A.candidates(spark, sf), seg, ["source_id"], ("start_ms", "end_ms"), ("g_start", "g_end"), longest_ms=KNOBS.candidate_max_ms)
    return met.groupBy("candidate_id").agg(F.count("*").alias("n_segments"), F.min("g_start").alias("first_ms"), F.max("g_end").alias("last_ms"))


SLICE_SQL = f"""WITH {CAND_SQL}, {SEG_SQL} SELECT candidate_id, count(*) AS n_segments, min(g.start_ms) AS first_ms, max(g.end_ms) AS last_ms
FROM cand c JOIN seg g ON c.source_id = g.source_id AND g.end_ms > c.start_ms AND g.start_ms < c.end_ms GROUP BY candidate_id"""


def span_text(spark, sf):
    out = W.span_text(A.candidates(spark, sf), A.segments(spark, sf))
    return out.select("candidate_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("text_md5"))


TEXT_CTE = """txt AS (SELECT c.source_id, candidate_id, coalesce(substring(string_agg(g.text, ' ' ORDER BY g.start_ms, g.seq), 1, 2000), '') AS text
  FROM cand c LEFT JOIN seg g ON c.source_id = g.source_id AND g.end_ms > c.start_ms AND g.start_ms < c.end_ms GROUP BY c.source_id, candidate_id)"""
SPAN_TEXT_SQL = f"WITH {CAND_SQL}, {SEG_SQL}, {TEXT_CTE} SELECT candidate_id, CAST(length(text) AS BIGINT) AS n, md5(text) AS text_md5 FROM txt"


def words_in_span(spark, sf):
    words = A.long_words(spark, sf).select("source_id", "seq", (F.col("start_ms") + F.col("end_ms")).alias("mid2"))
    spans = A.candidates(spark, sf).select("source_id", "candidate_id", (F.col("start_ms") * 2).alias("lo2"), (F.col("end_ms") * 2).alias("hi2"))
    met = W.point_join(words, spans, ["source_id"], "mid2", ("lo2", "hi2"), longest_ms=2 * KNOBS.candidate_max_ms)
    return met.groupBy("candidate_id").agg(F.count("*").alias("n_words"), F.min("seq").alias("first_seq"))


WORDS_IN_SPAN_SQL = f"""WITH {CAND_SQL}, {LONG_SQL} SELECT candidate_id, count(*) AS n_words, min(seq) AS first_seq FROM cand c JOIN long w
ON c.source_id = w.source_id AND c.start_ms * 2 <= w.start_ms + w.end_ms AND w.start_ms + w.end_ms < c.end_ms * 2 GROUP BY candidate_id"""


def map_words(spark, sf):
    return W.map_words(A.dense_words(spark, sf), A.timeline(spark, sf))


MAP_WORDS_SQL = f"""WITH {WORDS_SQL}, {TIMELINE_SQL}, m AS (
  SELECT w.source_id, w.seq, w, greatest(w.start_ms, t.src_start_ms) - t.src_start_ms + t.out_start_ms AS s, least(w.end_ms, t.src_end_ms) - t.src_start_ms + t.out_start_ms AS e
  FROM words w JOIN tl t ON w.source_id = t.clip_id AND 2 * t.src_start_ms <= w.start_ms + w.end_ms AND w.start_ms + w.end_ms < 2 * t.src_end_ms)
SELECT source_id, seq, w, s AS start_ms, CASE WHEN e <= s THEN s + 80 ELSE e END AS end_ms FROM m"""


def map_times(spark, sf):
    return W.map_times(A.samples(spark, sf).select("clip_id", "t_ms"), A.timeline(spark, sf))


MAP_TIMES_SQL = f"""WITH {A.SAMPLES_SQL}, {TIMELINE_SQL} SELECT s.clip_id, t_ms, t_ms - src_start_ms + out_start_ms AS out_ms
FROM smp s LEFT JOIN tl t ON s.clip_id = t.clip_id AND src_start_ms <= t_ms AND t_ms < src_end_ms"""


def map_cues(spark, sf):
    return W.map_cues(A.segments(spark, sf), A.timeline(spark, sf)).select("clip_id", "seq", "start_ms", "end_ms")


MAP_CUES_SQL = f"""WITH {SEG_SQL}, {TIMELINE_SQL}, m AS (SELECT g.source_id AS clip_id, g.seq, a.out_start_ms + g.start_ms - a.src_start_ms AS start_ms, b.out_start_ms + greatest(g.end_ms - 10, g.start_ms) - b.src_start_ms AS end_ms
  FROM seg g JOIN tl a ON g.source_id = a.clip_id AND a.src_start_ms <= g.start_ms AND g.start_ms < a.src_end_ms
  JOIN tl b ON g.source_id = b.clip_id AND b.src_start_ms <= greatest(g.end_ms - 10, g.start_ms) AND greatest(g.end_ms - 10, g.start_ms) < b.src_end_ms) SELECT * FROM m WHERE end_ms > start_ms"""


def overlap_metrics(spark, sf):
    return C.overlap_metrics(A.candidates(spark, sf)).select("candidate_id", "shared_ms", "shorter_ms", "fuses")


OVERLAP_SQL = f"""WITH {CAND_SQL}, p AS (SELECT *, lag(start_ms) OVER w AS ps, lag(end_ms) OVER w AS pe FROM cand WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, end_ms, candidate_id)),
q AS (SELECT candidate_id, CASE WHEN pe IS NOT NULL THEN greatest(least(pe, end_ms) - greatest(ps, start_ms), 0) END AS shared_ms, CASE WHEN pe IS NOT NULL THEN least(pe - ps, end_ms - start_ms) END AS shorter_ms FROM p)
SELECT candidate_id, shared_ms, shorter_ms, coalesce(2 * shared_ms > shorter_ms, false) AS fuses FROM q"""


def fuse_overlaps(spark, sf):
    return C.fuse(A.candidates(spark, sf)).select("source_id", "candidate_id", "start_ms", "end_ms", "label", "score", "reason", "n_fused")


FUSE_CTE = """r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, candidate_id) AS rn FROM cand),
f(source_id, rn, g, s, e, id, label, score, reason, n) AS (
  SELECT source_id, rn, 1, start_ms, end_ms, candidate_id, label, score, reason, 1 FROM r WHERE rn = 1
  UNION ALL
  SELECT r.source_id, r.rn, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN least(s, start_ms) ELSE start_ms END,
    CASE WHEN j THEN least(greatest(e, end_ms), least(s, start_ms) + 180000) ELSE end_ms END,
    CASE WHEN j AND f.score >= r.score THEN id ELSE candidate_id END, CASE WHEN j AND f.score >= r.score THEN f.label ELSE r.label END,
    CASE WHEN j THEN greatest(f.score, r.score) ELSE r.score END, CASE WHEN j AND f.score >= r.score THEN f.reason ELSE r.reason END, CASE WHEN j THEN n + 1 ELSE 1 END
  FROM f JOIN r ON r.source_id = f.source_id AND r.rn = f.rn + 1,
    LATERAL (SELECT 2 * (least(e, end_ms) - greatest(s, start_ms)) > least(e - s, end_ms - start_ms) AS j)),
fused AS (SELECT source_id, id AS candidate_id, s AS start_ms, e AS end_ms, label, score, reason, CAST(n AS BIGINT) AS n_fused FROM f QUALIFY row_number() OVER (PARTITION BY source_id, g ORDER BY rn DESC) = 1)"""
FUSE_SQL = f"WITH RECURSIVE {CAND_SQL}, {FUSE_CTE} SELECT source_id, candidate_id, start_ms, end_ms, label, score, reason, n_fused FROM fused"

def clip_text(spark, sf):
    words = W.map_words(A.dense_words(spark, sf), A.timeline(spark, sf))
    text = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "seq", "w"))), lambda x: x["w"])
    return words.groupBy("source_id").agg(F.count("*").alias("n_words"), F.md5(F.array_join(text, " ")).alias("text_md5"))


CLIP_TEXT_SQL = f"""WITH {WORDS_SQL}, {TIMELINE_SQL}, m AS (SELECT w.source_id, w.seq, w, greatest(w.start_ms, t.src_start_ms) - t.src_start_ms + t.out_start_ms AS s
  FROM words w JOIN tl t ON w.source_id = t.clip_id AND 2 * t.src_start_ms <= w.start_ms + w.end_ms AND w.start_ms + w.end_ms < 2 * t.src_end_ms)
SELECT source_id, count(*) AS n_words, md5(string_agg(w, ' ' ORDER BY s, seq)) AS text_md5 FROM m GROUP BY source_id"""

def _stays(spark, sf):
    """Stays at a supplier, from seconds to a month: by line number, items as seconds or hours, or up to thirty days."""
    day, unit = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("bigint") * 86_400_000, F.col("l_quantity").cast("bigint")
    length = F.when(F.col("l_linenumber") % 3 == 0, unit * 1000).when(F.col("l_linenumber") % 3 == 1, unit * 3_600_000).otherwise((F.col("l_orderkey") % 30 + 1) * 86_400_000)
    start = day + F.col("l_orderkey") % 86_400 * 1000
    return A.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 100).alias("place"), "l_orderkey", "l_linenumber", start.alias("from_ms"), (start + length).alias("till_ms"))


_STAYS = """stays AS (SELECT l_suppkey % 100 AS place, l_orderkey, l_linenumber, d AS from_ms, d + CASE l_linenumber % 3 WHEN 0 THEN CAST(l_quantity AS BIGINT) * 1000 WHEN 1 THEN CAST(l_quantity AS BIGINT) * 3600000 ELSE (l_orderkey % 30 + 1) * 86400000 END AS till_ms
  FROM (SELECT *, date_diff('day', DATE '1992-01-01', l_shipdate) * 86400000 + l_orderkey % 86400 * 1000 AS d FROM lineitem)),
calls AS (SELECT o_custkey % 100 AS place, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate) * 86400000 + o_orderkey % 86400 * 1000 AS at_ms FROM orders)"""


def _calls(spark, sf):
    at = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("bigint") * 86_400_000 + F.col("o_orderkey") % 86_400 * 1000
    return A.table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("place"), "o_orderkey", at.alias("at_ms"))


def mixed_points(spark, sf):
    """Orders at a place, and the stays there at that time, however long these are."""
    held = SW.point_totals(_calls(spark, sf), _stays(spark, sf), ["place"], "at_ms", ("from_ms", "till_ms"), ["o_orderkey"])
    return held.select("o_orderkey", F.col("n").alias("n_stays"), F.col("first_start").alias("first_ms"), F.col("last_end").alias("last_ms"))


MIXED_POINTS_SQL = f"""WITH {_STAYS} SELECT o_orderkey, count(*) AS n_stays, min(from_ms) AS first_ms, max(till_ms) AS last_ms FROM calls c JOIN stays s ON c.place = s.place AND from_ms <= at_ms AND at_ms < till_ms GROUP BY o_orderkey"""


def mixed_intervals(spark, sf):
    """Stays and visits of an hour to a week at a place that overlap."""
    at = F.col("at_ms")
    visits = _calls(spark, sf).select("place", "o_orderkey", at.alias("v_from"), (at + F.when(F.col("o_orderkey") % 2 == 0, 3_600_000).otherwise(604_800_000)).alias("v_till"))
    met = SW.overlap_totals(visits, _stays(spark, sf), ["place"], ("v_from", "v_till"), ("from_ms", "till_ms"), ["o_orderkey"])
    return met.select("o_orderkey", F.col("n").alias("n_stays"), F.col("shared").alias("shared_ms"))


MIXED_INTERVALS_SQL = f"""WITH {_STAYS}, visits AS (SELECT *, at_ms + CASE WHEN o_orderkey % 2 = 0 THEN 3600000 ELSE 604800000 END AS v_till FROM calls)
SELECT o_orderkey, count(*) AS n_stays, CAST(sum(least(v_till, till_ms) - greatest(at_ms, from_ms)) AS BIGINT) AS shared_ms FROM visits v JOIN stays s ON v.place = s.place AND till_ms > at_ms AND from_ms < v_till GROUP BY o_orderkey"""

QUERIES = {
    "mixed_points": (mixed_points, MIXED_POINTS_SQL), "mixed_intervals": (mixed_intervals, MIXED_INTERVALS_SQL),
    "clip_text": (clip_text, CLIP_TEXT_SQL),
    "chunk_bounds": (chunk_bounds, CHUNK_BOUNDS_SQL), "transcript_chunks": (transcript_chunks, CHUNKS_SQL), "slice_segments": (slice_segments, SLICE_SQL), "span_text": (span_text, SPAN_TEXT_SQL),
    "words_in_span": (words_in_span, WORDS_IN_SPAN_SQL), "map_words": (map_words, MAP_WORDS_SQL), "map_times": (map_times, MAP_TIMES_SQL), "map_cues": (map_cues, MAP_CUES_SQL),
    "overlap_metrics": (overlap_metrics, OVERLAP_SQL), "fuse_overlaps": (fuse_overlaps, FUSE_SQL),
}
