"""Queries of order-dependent operators on words, segments and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as S
from ..operators import windows as W
from . import adapter as A
from .adapter import SAMPLES_SQL, TIMELINE_SQL, WORDS_SQL


def _rolling(spark, sf):
    """Words with repeats close by: every third twice more, 30 ms and 70 ms later."""
    w = A.dense_words(spark, sf)
    more = w.filter("seq % 3 = 0").withColumn("d", F.explode(F.array(F.lit(30), F.lit(70))))
    more = more.select("source_id", (F.col("seq") + 1_000_000 * F.col("d")).alias("seq"), "w", (F.col("start_ms") + F.col("d")).alias("start_ms"), (F.col("end_ms") + F.col("d")).alias("end_ms"))
    return w.unionByName(more)


_ROLLING = f"""{WORDS_SQL}, roll AS (SELECT * FROM words UNION ALL SELECT source_id, seq + 1000000 * d, w, start_ms + d, end_ms + d FROM words, (VALUES (30), (70)) v(d) WHERE seq % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, seq) AS rn FROM roll)"""


def dedup_words(spark, sf):
    return S.dedup_words(_rolling(spark, sf)).select("source_id", "seq", "w", "start_ms", "end_ms")


DEDUP_WORDS_SQL = f"""WITH RECURSIVE {_ROLLING}, f(source_id, rn, kw, ks, kept) AS (SELECT source_id, rn, w, start_ms, true FROM r WHERE rn = 1
  UNION ALL SELECT r.source_id, r.rn, CASE WHEN d THEN kw ELSE w END, CASE WHEN d THEN ks ELSE start_ms END, NOT d FROM f JOIN r ON r.source_id = f.source_id AND r.rn = f.rn + 1,
    LATERAL (SELECT kw = w AND abs(ks - start_ms) < 50 AS d))
SELECT source_id, seq, w, start_ms, end_ms FROM r JOIN f USING (source_id, rn) WHERE kept"""


def _cues(spark, sf):
    """Cues that roll: each second word as two letters, then whole, then again; the others alone."""
    w = A.dense_words(spark, sf)
    parts = F.when(F.col("seq") % 2 == 0, F.array(F.struct(F.lit(0).alias("k"), F.substring("w", 1, 2).alias("t")), F.struct(F.lit(1).alias("k"), F.col("w").alias("t")), F.struct(F.lit(2).alias("k"), F.col("w").alias("t"))))
    parts = parts.otherwise(F.array(F.struct(F.lit(0).alias("k"), F.col("w").alias("t"))))
    each = w.select("source_id", "seq", "start_ms", F.explode(parts).alias("p"))
    start = F.col("start_ms") + 90 * F.col("p.k")
    return each.select("source_id", (F.col("seq") * 3 + F.col("p.k")).alias("seq"), start.alias("start_ms"), (start + 90).alias("end_ms"), F.col("p.t").alias("text"))


_CUES = f"""{WORDS_SQL}, cues AS (SELECT source_id, seq * 3 + k AS seq, start_ms + 90 * k AS start_ms, start_ms + 90 * k + 90 AS end_ms, CASE WHEN seq % 2 = 0 AND k = 0 THEN substring(w, 1, 2) ELSE w END AS text
  FROM words, (VALUES (0), (1), (2)) v(k) WHERE k = 0 OR seq % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, seq) AS rn FROM cues)"""


def dedup_segments(spark, sf):
    return S.dedup_segments(_cues(spark, sf)).select("source_id", "seq", "start_ms", "end_ms", "text")


DEDUP_SEGMENTS_SQL = f"""WITH RECURSIVE {_CUES}, f(source_id, rn, g, q, s, e, t) AS (SELECT source_id, rn, 1, seq, start_ms, end_ms, text FROM r WHERE rn = 1
  UNION ALL SELECT r.source_id, r.rn, CASE WHEN a OR b THEN g ELSE g + 1 END, CASE WHEN a THEN q ELSE seq END, CASE WHEN a THEN s ELSE start_ms END, CASE WHEN a THEN greatest(e, end_ms) ELSE end_ms END, CASE WHEN a THEN t ELSE text END
  FROM f JOIN r ON r.source_id = f.source_id AND r.rn = f.rn + 1, LATERAL (SELECT start_ms - e < 500 AND t = text AS a, start_ms - e < 500 AND starts_with(text, t) AND start_ms - s < 2000 AS b))
SELECT source_id, q AS seq, s AS start_ms, e AS end_ms, t AS text FROM f QUALIFY row_number() OVER (PARTITION BY source_id, g ORDER BY rn DESC) = 1"""


def group_words(spark, sf):
    return S.group_words(A.dense_words(spark, sf)).select("source_id", "seq", "start_ms", "end_ms", "n_words", "text")


def _group_sql(breaks, tail="SELECT source_id, q AS seq, s AS start_ms, e AS end_ms, CAST(n AS BIGINT) AS n_words, t AS text FROM lines"):
    return f"""WITH RECURSIVE {WORDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, seq) AS rn FROM words),
f(source_id, rn, g, q, s, e, n, t, lw) AS (SELECT source_id, rn, 1, seq, start_ms, end_ms, 1, w, w FROM r WHERE rn = 1
  UNION ALL SELECT r.source_id, r.rn, CASE WHEN b THEN g + 1 ELSE g END, CASE WHEN b THEN seq ELSE q END, CASE WHEN b THEN start_ms ELSE s END, end_ms, CASE WHEN b THEN 1 ELSE n + 1 END, CASE WHEN b THEN w ELSE t || ' ' || w END, w
  FROM f JOIN r ON r.source_id = f.source_id AND r.rn = f.rn + 1, LATERAL (SELECT {breaks} AS b)),
lines AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source_id, g ORDER BY rn DESC) = 1) {tail}"""


GROUP_WORDS_SQL = _group_sql("start_ms - e > 1200 OR end_ms - s > 12000 OR n >= 30 OR (right(lw, 1) IN ('.', '?', '!') AND end_ms - s > 4000)")


def caption_lines(spark, sf):
    return S.caption_lines(A.dense_words(spark, sf), "dual_speaker").select("source_id", "seq", "start_ms", "end_ms", "n_words", "text")


CAPTION_LINES_SQL = _group_sql("n >= 5 OR start_ms - e > 700 OR end_ms - s > 3500 OR length(t) + 1 + length(w) > 30 OR (right(lw, 1) IN ('.', '?', '!', ',') AND n >= 2)")


def shot_split(spark, sf):
    return S.shots(A.samples(spark, sf)).select("clip_id", "t_ms", "shot")


_SHOTS = f"""{SAMPLES_SQL}, fnd AS (SELECT *, lag(x_pm) OVER (PARTITION BY clip_id ORDER BY t_ms) AS px FROM smp WHERE x_pm IS NOT NULL),
shots AS (SELECT clip_id, t_ms, x_pm, CAST(sum(CASE WHEN abs(x_pm - px) > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY t_ms) AS BIGINT) AS shot FROM fnd)"""
_SMOOTH = f"""{_SHOTS}, sm AS (SELECT clip_id, t_ms, shot, CAST(sum(x_pm) OVER w AS DOUBLE) / count(x_pm) OVER w AS smooth, row_number() OVER (PARTITION BY clip_id, shot ORDER BY t_ms) AS rn FROM shots
  WINDOW w AS (PARTITION BY clip_id, shot ORDER BY t_ms ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""
_CAPPED = f"""{_SMOOTH}, cap(clip_id, shot, rn, t_ms, x) AS (SELECT clip_id, shot, rn, t_ms, smooth FROM sm WHERE rn = 1
  UNION ALL SELECT s.clip_id, s.shot, s.rn, s.t_ms, x + greatest(-(90.0::DOUBLE * greatest(s.t_ms - c.t_ms, 1) / 1000.0::DOUBLE), least(smooth - x, 90.0::DOUBLE * greatest(s.t_ms - c.t_ms, 1) / 1000.0::DOUBLE))
  FROM cap c JOIN sm s ON s.clip_id = c.clip_id AND s.shot = c.shot AND s.rn = c.rn + 1)"""
SHOTS_SQL = f"WITH {_SHOTS} SELECT clip_id, t_ms, shot FROM shots"


def moving_average(spark, sf):
    return S.moving_average(S.shots(A.samples(spark, sf))).select("clip_id", "t_ms", "smooth")


MOVING_SQL = f"WITH {_SMOOTH} SELECT clip_id, t_ms, smooth FROM sm"


def _capped(spark, sf):
    return S.pan_capped(S.moving_average(S.shots(A.samples(spark, sf))))


def pan_cap(spark, sf):
    return _capped(spark, sf).select("clip_id", "shot", "t_ms", F.round("x", 3).alias("x"))


PAN_SQL = f"WITH RECURSIVE {_CAPPED} SELECT clip_id, shot, t_ms, round(x, 3) AS x FROM cap"


def _snapped(spark, sf):
    return S.cut_snaps(_capped(spark, sf))


_SNAPS = f"""{_CAPPED}, pv AS (SELECT *, lag(shot) OVER w AS p_shot, lag(t_ms) OVER w AS p_t, lag(x) OVER w AS p_x FROM cap WINDOW w AS (PARTITION BY clip_id ORDER BY t_ms, shot)),
snaps AS (SELECT clip_id, t_ms, x, false AS is_hold FROM cap UNION ALL SELECT clip_id, t_ms - 40, p_x, true FROM pv WHERE p_shot <> shot AND t_ms - 40 > p_t)"""


def cut_snaps(spark, sf):
    return _snapped(spark, sf).withColumn("x", F.round("x", 3))


SNAPS_SQL = f"WITH RECURSIVE {_SNAPS} SELECT clip_id, t_ms, round(x, 3) AS x, is_hold FROM snaps"

_THIN = f"""{_SNAPS}, nb AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n, row_number() OVER o - 1 AS i,
    coalesce(t_ms - lag(t_ms) OVER o <= 40 AND abs(x - lag(x) OVER o) > 1.0, false) AS cut FROM snaps WINDOW o AS (PARTITION BY clip_id ORDER BY t_ms, is_hold DESC)),
kp AS (SELECT *, cut OR coalesce(lead(cut) OVER o, false) OR i = 0 OR i = n - 1 AS keep FROM nb WINDOW o AS (PARTITION BY clip_id ORDER BY t_ms, is_hold DESC)),
bg AS (SELECT *, greatest(0, 40 - count(*) FILTER (WHERE keep) OVER (PARTITION BY clip_id)) AS budget, count(*) FILTER (WHERE NOT keep) OVER (PARTITION BY clip_id) AS rest,
    count(*) FILTER (WHERE NOT keep) OVER (PARTITION BY clip_id ORDER BY t_ms, is_hold DESC ROWS UNBOUNDED PRECEDING) - 1 AS rank FROM kp),
thin AS (SELECT clip_id, t_ms, x, is_hold FROM bg WHERE n <= 40 OR keep OR rank IN (SELECT b.i * bg.rest // bg.budget FROM (SELECT unnest(range(40)) AS i) b WHERE b.i < bg.budget))"""


def keypoints(spark, sf):
    return S.thinned(_snapped(spark, sf)).withColumn("x", F.round("x", 3))


KEYPOINTS_SQL = f"WITH RECURSIVE {_THIN} SELECT clip_id, t_ms, round(x, 3) AS x, is_hold FROM thin"


def _durations(spark, sf):
    return A.timeline(spark, sf).groupBy("clip_id").agg(F.sum(F.col("src_end_ms") - F.col("src_start_ms")).alias("duration_ms"))


_DURATIONS = "dur AS (SELECT clip_id, CAST(sum(src_end_ms - src_start_ms) AS BIGINT) AS duration_ms FROM tl GROUP BY clip_id)"


def padded_keypoints(spark, sf):
    return S.padded_ends(S.thinned(_snapped(spark, sf)), _durations(spark, sf)).withColumn("x", F.round("x", 3)).drop("is_hold")


PADDED_SQL = f"""WITH RECURSIVE {_THIN}, {TIMELINE_SQL}, {_DURATIONS}, en AS (SELECT clip_id, arg_min(x, t_ms * 2 + CASE WHEN is_hold THEN 0 ELSE 1 END) AS x0, min(t_ms) AS t0, max(t_ms) AS t1, arg_max(x, t_ms * 2 + CASE WHEN is_hold THEN 0 ELSE 1 END) AS x1 FROM thin GROUP BY clip_id)
SELECT clip_id, t_ms, round(x, 3) AS x FROM thin UNION ALL SELECT clip_id, 0, round(x0, 3) FROM en WHERE t0 > 0 UNION ALL SELECT clip_id, duration_ms, round(x1, 3) FROM en JOIN dur USING (clip_id) WHERE t1 < duration_ms"""


def crop_expr(spark, sf):
    """The position as text."""
    return S.piecewise(S.thinned(_snapped(spark, sf)))


def _fixed(x, places):
    one = 10**places
    n = f"CAST(round_even(abs({x}) * {one}, 0) AS BIGINT)"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || ({n} // {one}) || '.' || lpad(CAST({n} % {one} AS VARCHAR), {places}, '0'))"


_T0, _T1, _X = _fixed("(t_ms / 1000.0::DOUBLE)", 3), _fixed("(t1 / 1000.0::DOUBLE)", 3), _fixed("x", 1)
_SLOPE = _fixed("((x1 - x) / ((t1 - t_ms) / 1000.0::DOUBLE))", 3)
_CROP = f"""{_THIN}, pw AS (SELECT *, lead(t_ms) OVER o AS t1, lead(x) OVER o AS x1, row_number() OVER o AS i1, count(*) OVER (PARTITION BY clip_id) AS n FROM thin WINDOW o AS (PARTITION BY clip_id ORDER BY t_ms, is_hold DESC)),
tm AS (SELECT clip_id, i1, n, CASE WHEN n = 1 THEN {_X} WHEN i1 = n THEN '(gte(t,' || {_T0} || ')*' || {_X} || ')'
  WHEN t1 - t_ms >= 1 THEN '(gte(t,' || {_T0} || ')*lt(t,' || {_T1} || ')*(' || {_X} || '+' || {_SLOPE} || '*(t-' || {_T0} || ')))' END AS term FROM pw),
crop AS (SELECT clip_id, n AS n_points, CASE WHEN n = 1 THEN s ELSE 'clip(' || s || ',0,in_w-out_w)' END AS expr FROM (SELECT clip_id, n, string_agg(term, '+' ORDER BY i1) AS s FROM tm GROUP BY clip_id, n))"""
CROP_SQL = f"WITH RECURSIVE {_CROP} SELECT clip_id, n_points, expr FROM crop"


def _empties(spark, sf):
    s = A.samples(spark, sf).filter((F.col("x_pm").isNull()) | (F.col("x_pm") % 70 > 20)).select("clip_id", "t_ms")
    return W.map_times(s, A.timeline(spark, sf)).filter("out_ms is not null").select("clip_id", "out_ms")


def fit_spans(spark, sf):
    return S.fit_spans(_empties(spark, sf), _durations(spark, sf))


_FIT = f"""{SAMPLES_SQL}, {TIMELINE_SQL}, {_DURATIONS}, em AS (SELECT s.clip_id, t_ms - src_start_ms + out_start_ms AS o FROM smp s JOIN tl t ON s.clip_id = t.clip_id AND src_start_ms <= t_ms AND t_ms < src_end_ms WHERE x_pm IS NULL OR x_pm % 70 > 20),
r1 AS (SELECT *, sum(b) OVER (PARTITION BY clip_id ORDER BY o) AS g FROM (SELECT *, CASE WHEN 2 * (o - lag(o) OVER (PARTITION BY clip_id ORDER BY o)) <= 1500 THEN 0 ELSE 1 END AS b FROM em)),
s1 AS (SELECT clip_id, min(o) AS s, max(o) + 500 AS e FROM r1 GROUP BY clip_id, g),
r2 AS (SELECT *, sum(b) OVER (PARTITION BY clip_id ORDER BY s) AS g FROM (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY clip_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 800 THEN 0 ELSE 1 END AS b FROM s1)),
fit AS (SELECT clip_id, s AS start_ms, least(e, duration_ms) AS end_ms FROM (SELECT clip_id, min(s) AS s, max(e) AS e FROM r2 GROUP BY clip_id, g) JOIN dur USING (clip_id) WHERE e - s >= 1200)"""
FIT_SQL = f"WITH {_FIT} SELECT clip_id, start_ms, end_ms FROM fit"


def enable_expr(spark, sf):
    return S.enable_text(fit_spans(spark, sf))


ENABLE_SQL = f"""WITH {_FIT} SELECT clip_id, string_agg(format('between(t,{{}}.{{:03d}},{{}}.{{:03d}})', start_ms // 1000, start_ms % 1000, end_ms // 1000, end_ms % 1000), '+' ORDER BY start_ms) AS expr FROM fit GROUP BY clip_id"""


def coverage(spark, sf):
    return S.coverage(fit_spans(spark, sf), _durations(spark, sf))


COVERAGE_SQL = f"""WITH {_FIT}, c AS (SELECT clip_id, duration_ms, CAST(sum(greatest(least(end_ms, duration_ms) - greatest(start_ms, 0), 0)) AS BIGINT) AS covered_ms FROM fit JOIN dur USING (clip_id) GROUP BY clip_id, duration_ms)
SELECT *, covered_ms >= duration_ms - 500 AS covers FROM c"""

_LOUD = f"""{SAMPLES_SQL}, st AS (SELECT clip_id, t_ms, level, count(*) OVER p AS n, sum(level) OVER p AS s, sum(level * level) OVER p AS q FROM smp WINDOW p AS (PARTITION BY clip_id)),
loud AS (SELECT clip_id, t_ms, n, n >= 4 AND n * level - s >= 0 AND 25 * (n * level - s) * (n * level - s) >= 36 * (n * q - s * s) AS is_loud FROM st)"""


def span_statistics(spark, sf):
    return S.loud(A.samples(spark, sf)).groupBy("clip_id", "n").agg(F.sum(F.col("is_loud").cast("bigint")).alias("n_loud"))


STATISTICS_SQL = f"WITH {_LOUD} SELECT clip_id, n, CAST(count(*) FILTER (WHERE is_loud) AS BIGINT) AS n_loud FROM loud GROUP BY clip_id, n"


def energy_spikes(spark, sf):
    return S.energy_spikes(A.samples(spark, sf))


SPIKES_SQL = f"""WITH {_LOUD}, ru AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms) - row_number() OVER (PARTITION BY clip_id, is_loud ORDER BY t_ms) AS g FROM loud),
sp AS (SELECT clip_id, min(t_ms) AS start_ms, max(t_ms) + 500 AS end_ms FROM ru WHERE is_loud GROUP BY clip_id, g HAVING max(t_ms) - min(t_ms) >= 500)
SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY start_ms) <= 10"""


def two_speakers(spark, sf):
    return S.two_speakers(A.samples(spark, sf).withColumn("x_pm", F.when(F.col("clip_id") % 2 == 0, F.col("x_pm").cast("bigint") % 100 + F.when(F.col("t_ms") % 1500 == 0, 600).otherwise(100)).otherwise(F.col("x_pm"))))


TWO_SQL = f"""WITH {SAMPLES_SQL}, xs AS (SELECT clip_id, t_ms, CASE WHEN clip_id % 2 = 0 THEN x_pm % 100 + CASE WHEN t_ms % 1500 = 0 THEN 600 ELSE 100 END ELSE x_pm END AS x FROM smp WHERE x_pm IS NOT NULL),
od AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n, x - lag(x) OVER w AS gap FROM xs WINDOW w AS (PARTITION BY clip_id ORDER BY x, t_ms)),
bs AS (SELECT clip_id, i AS cutn, gap AS best FROM od WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY gap DESC, i) = 1),
me AS (SELECT clip_id, CAST(sum(x) FILTER (WHERE i < cutn) AS DOUBLE) / count(*) FILTER (WHERE i < cutn) AS l, CAST(sum(x) FILTER (WHERE i >= cutn) AS DOUBLE) / count(*) FILTER (WHERE i >= cutn) AS r
  FROM od JOIN bs USING (clip_id) WHERE n >= 8 AND best >= 150 AND 5 * least(cutn, n - cutn) >= n GROUP BY clip_id)
SELECT clip_id, greatest(0.0::DOUBLE, least(l * 1280 / 1000.0::DOUBLE - 202.0::DOUBLE, 876.0::DOUBLE)) AS left_x, greatest(0.0::DOUBLE, least(r * 1280 / 1000.0::DOUBLE - 202.0::DOUBLE, 876.0::DOUBLE)) AS right_x FROM me"""


def crop_centres(spark, sf):
    """Positions in output time as left edges of a 404 px crop of 1280 px, clamped."""
    s = W.map_times(A.samples(spark, sf).filter("x_pm is not null"), A.timeline(spark, sf)).filter("out_ms is not null")
    return s.select("clip_id", "out_ms", F.greatest(F.lit(0), F.least(F.expr("x_pm * 1280 div 1000 - 202"), F.lit(876))).cast("bigint").alias("crop_x"))


CENTRES_SQL = f"""WITH {SAMPLES_SQL}, {TIMELINE_SQL} SELECT s.clip_id, t_ms - src_start_ms + out_start_ms AS out_ms, CAST(greatest(0, least(x_pm * 1280 // 1000 - 202, 876)) AS BIGINT) AS crop_x
FROM smp s JOIN tl t ON s.clip_id = t.clip_id AND src_start_ms <= t_ms AND t_ms < src_end_ms WHERE x_pm IS NOT NULL"""

#: The text of a crop that follows ``expr``.
FOLLOW_SQL = f"""WITH RECURSIVE {_CROP} SELECT clip_id, 'crop=w=404:h=720:x=''' || expr || ''':y=0,scale=1080:1920:force_original_aspect_ratio=decrease,pad=1080:1920:(ow-iw)/2:(oh-ih)/2:black' AS chain FROM crop"""

QUERIES = {
    "dedup_words": (dedup_words, DEDUP_WORDS_SQL), "dedup_segments": (dedup_segments, DEDUP_SEGMENTS_SQL), "group_words": (group_words, GROUP_WORDS_SQL), "caption_lines": (caption_lines, CAPTION_LINES_SQL),
    "shot_split": (shot_split, SHOTS_SQL), "moving_average": (moving_average, MOVING_SQL), "pan_cap": (pan_cap, PAN_SQL), "cut_snaps": (cut_snaps, SNAPS_SQL), "keypoints": (keypoints, KEYPOINTS_SQL),
    "padded_keypoints": (padded_keypoints, PADDED_SQL), "crop_expr": (crop_expr, CROP_SQL), "fit_spans": (fit_spans, FIT_SQL), "enable_expr": (enable_expr, ENABLE_SQL), "coverage": (coverage, COVERAGE_SQL),
    "span_statistics": (span_statistics, STATISTICS_SQL), "energy_spikes": (energy_spikes, SPIKES_SQL), "two_speakers": (two_speakers, TWO_SQL), "crop_centres": (crop_centres, CENTRES_SQL),
}
