"""Queries of plans, timelines and captions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as C
from ..operators import planning as P
from ..operators import sequence as S
from ..operators import timeline as TL
from ..operators import windows as W
from . import adapter as A
from .adapter import CAND_SQL, SEG_SQL, WORDS_SQL
from .joins import FUSE_CTE, TEXT_CTE
from .scalars import _ERROR, ASS, PARAMS_SQL, VALIDATE_SQL
from .sequences import CAPTION_LINES_SQL, FOLLOW_SQL, crop_expr

CLIP_COLUMNS = ["members", "n_members", "est_duration_ms", "source_start_ms", "source_end_ms", "score", "reason", "label"]


def plan_auto(spark, sf):
    return P.plan_auto(A.candidates(spark, sf))


AUTO_SQL = f"""WITH {CAND_SQL}, {PARAMS_SQL}, c AS (SELECT cand.*, least(end_ms, start_ms + max_ms) AS e FROM cand JOIN params ON l = label WHERE end_ms - start_ms >= 5000)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, start_ms, e, candidate_id) AS rank, CAST(candidate_id AS VARCHAR) AS members, CAST(1 AS BIGINT) AS n_members,
  CAST(least(e - start_ms, 60000) AS BIGINT) AS est_duration_ms, start_ms AS source_start_ms, e AS source_end_ms, score, reason, label FROM c"""


def fused_plan(spark, sf):
    """Candidates, fused, planned one by one: the flagship."""
    return P.plan_auto(C.fuse(A.candidates(spark, sf)))


FUSED_PLAN_SQL = f"""WITH RECURSIVE {CAND_SQL}, {FUSE_CTE}, {PARAMS_SQL}, c AS (SELECT fused.*, least(end_ms, start_ms + max_ms) AS e2 FROM fused JOIN params ON l = label WHERE end_ms - start_ms >= 5000)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, start_ms, e2, candidate_id) AS rank, CAST(candidate_id AS VARCHAR) AS members, CAST(1 AS BIGINT) AS n_members,
  CAST(least(e2 - start_ms, 60000) AS BIGINT) AS est_duration_ms, start_ms AS source_start_ms, e2 AS source_end_ms, score, reason, label FROM c"""


def _budget(keys, source="cand", where="WHERE end_ms - start_ms >= 5000", extra=""):
    k, on = ", ".join(keys), " AND ".join(f"o.{c} = g.{c}" for c in keys)
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, start_ms, end_ms, candidate_id) AS rn FROM {source} {where}),
g({k}, rn, total, took) AS (SELECT {k}, rn, CASE WHEN end_ms - start_ms > 60000 THEN 0 ELSE end_ms - start_ms END, end_ms - start_ms <= 60000 FROM o WHERE rn = 1
  UNION ALL SELECT {", ".join("o." + c for c in keys)}, o.rn, CASE WHEN total + end_ms - start_ms > 60000 THEN total ELSE total + end_ms - start_ms END, total + end_ms - start_ms <= 60000 FROM g JOIN o ON {on} AND o.rn = g.rn + 1),
mem AS (SELECT o.* FROM o JOIN g USING ({k}, rn) WHERE took)"""


def _rolled(keys, more=""):
    k = ", ".join(keys)
    own = "label" in keys
    lab = f"""lab AS (SELECT {k}, label AS dl FROM (SELECT {k}, label, count(*) AS n, min((start_ms, end_ms, candidate_id)) AS at0 FROM mem GROUP BY {k}, label)
  QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY n DESC, at0) = 1) """
    return ("" if own else f", {lab}") + f"""
SELECT {k}, string_agg(CAST(candidate_id AS VARCHAR), ',' ORDER BY start_ms, end_ms, candidate_id) AS members, count(*) AS n_members, CAST(least(sum(end_ms - start_ms), 60000) AS BIGINT) AS est_duration_ms,
  min(start_ms) AS source_start_ms, max(end_ms) AS source_end_ms, max(score) AS score, first(reason ORDER BY score DESC, start_ms, end_ms, candidate_id) AS reason{more}{"" if own else ", any_value(dl) AS label"}
FROM mem {"" if own else f"JOIN lab USING ({k})"} GROUP BY {k}"""


def plan_by_label(spark, sf):
    return P.plan_by_label(A.candidates(spark, sf))


BY_LABEL_SQL = f"WITH RECURSIVE {CAND_SQL}, {_budget(['source_id', 'label'])} {_rolled(['source_id', 'label'])}"


def plan_montage(spark, sf):
    return P.plan_montage(A.candidates(spark, sf))


MONTAGE_SQL = f"WITH RECURSIVE {CAND_SQL}, {_budget(['source_id'])} {_rolled(['source_id'])}"


def fit_budget(spark, sf):
    return S.budgeted(P.long_enough(A.candidates(spark, sf)), ["source_id"], 60_000).select("source_id", "candidate_id", "start_ms", "end_ms")


FIT_BUDGET_SQL = f"WITH RECURSIVE {CAND_SQL}, {_budget(['source_id'])} SELECT source_id, candidate_id, start_ms, end_ms FROM mem"


def dominant_label(spark, sf):
    return P.dominant_label(A.candidates(spark, sf), ["source_id"])


DOMINANT_SQL = f"""WITH {CAND_SQL} SELECT source_id, label FROM (SELECT source_id, label, count(*) AS n, min((start_ms, end_ms, candidate_id)) AS at0 FROM cand GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, at0) = 1"""


def _texts(spark, sf, also=None, how="left"):
    return W.span_text(A.candidates(spark, sf), A.segments(spark, sf), also=also, how=how)


def plan_by_topic(spark, sf):
    """Order-dependent clustering: rows only."""
    return P.plan_by_topic(_texts(spark, sf))


def top_phrases(spark, sf):
    return P.top_phrases(P.long_enough(_texts(spark, sf, how="inner")), lambda by_source: P.long_enough(_texts(spark, sf, by_source)))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_PHRASES = f"""tk AS (SELECT c.source_id, c.candidate_id, regexp_extract_all(lower(text), '[a-z'']+') AS ws FROM txt JOIN cand c USING (source_id, candidate_id) WHERE c.end_ms - c.start_ms >= 5000),
gr AS (SELECT DISTINCT source_id, candidate_id, array_to_string(g, ' ') AS phrase, len(g) AS k FROM (SELECT source_id, candidate_id, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: ws[i:i + n - 1])) AS g FROM tk, (VALUES (1), (2), (3)) v(n) WHERE len(ws) >= n)
  WHERE len(list_filter(g, lambda w: w NOT IN ({_STOP}))) > 0 AND (len(g) > 1 OR length(g[1]) >= 4)),
ph AS (SELECT source_id, phrase, count(*) AS n FROM gr GROUP BY source_id, phrase, k HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, k DESC, length(phrase) DESC, phrase) = 1)"""
PHRASES_SQL = f"WITH {CAND_SQL}, {SEG_SQL}, {TEXT_CTE}, {_PHRASES} SELECT source_id, phrase, n FROM ph"


def plan_supercut(spark, sf):
    return P.plan_supercut(_texts(spark, sf, how="inner"), joined=lambda by_source: _texts(spark, sf, by_source))


SUPERCUT_SQL = f"""WITH RECURSIVE {CAND_SQL}, {SEG_SQL}, {TEXT_CTE}, {_PHRASES}, hits AS (SELECT c.*, phrase FROM cand c JOIN txt USING (source_id, candidate_id) JOIN ph USING (source_id) WHERE c.end_ms - c.start_ms >= 5000
  AND regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])' || phrase || '($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])')),
{_budget(['source_id'], 'hits', '')} {_rolled(['source_id'], ', any_value(phrase) AS phrase')}"""


def _spans(spark, sf):
    """Members of a clip: all of each source's, best first, that lie in its words' time, with its label's trim."""
    c = A.candidates(spark, sf).withColumns({"start_ms": F.col("start_ms") % 60_000, "len_": F.least(F.col("end_ms") - F.col("start_ms"), F.lit(40_000))})
    c = c.withColumn("end_ms", F.col("start_ms") + F.col("len_"))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "candidate_id")) - 1
    c = C.with_label_params(c.withColumn("member", rank.cast("bigint")))
    return c.select(F.col("source_id").alias("clip_id"), "member", "start_ms", "end_ms", TL.drop_ms(F.col("trim")).cast("bigint").alias("drop_ms"), "pad_ms")


def _met(spans, words):
    """Gaps between words, by the members that they touch."""
    s = TL.silences_of(words)
    met = W.interval_join(spans.select("clip_id", "member", "start_ms", "end_ms"), s.withColumnRenamed("source_id", "clip_id"), ["clip_id"], ("start_ms", "end_ms"), ("sil_start", "sil_end"), longest_ms=W.BUCKETED_MS)
    return met.select("clip_id", "member", "sil_start", "sil_end")


def _silences(spark, sf):
    """Gaps between words."""
    return _met(_spans(spark, sf), A.dense_words(spark, sf))


_KEPT = f"""{CAND_SQL}, {WORDS_SQL}, {PARAMS_SQL}, sp AS (SELECT source_id AS clip_id, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, candidate_id) - 1 AS member, start_ms % 60000 AS start_ms,
    start_ms % 60000 + least(end_ms - start_ms, 40000) AS end_ms, CASE trim WHEN 'very_tight' THEN 600 WHEN 'tight' THEN 800 WHEN 'medium' THEN 1100 ELSE 1800 END AS drop_ms, pad_ms FROM cand JOIN params ON l = label),
gp AS (SELECT source_id, max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ss, start_ms AS se FROM words),
sl AS (SELECT clip_id, member, ss, se FROM sp JOIN gp ON clip_id = source_id AND se > start_ms AND ss < end_ms WHERE se - ss >= 300),
e1 AS (SELECT sp.*, coalesce((SELECT max(least(greatest(sp.start_ms, se - sp.pad_ms), sp.end_ms)) FROM sl WHERE sl.clip_id = sp.clip_id AND sl.member = sp.member AND ss <= sp.start_ms AND sp.start_ms < se), start_ms) AS a FROM sp),
e2 AS (SELECT e1.*, coalesce((SELECT max(greatest(least(e1.end_ms, ss + e1.pad_ms), e1.a)) FROM sl WHERE sl.clip_id = e1.clip_id AND sl.member = e1.member AND ss < e1.end_ms AND e1.end_ms <= se), end_ms) AS b FROM e1),
dr AS (SELECT e2.clip_id, e2.member, greatest(ss, a) + pad_ms AS lo, least(se, b) - pad_ms AS hi FROM e2 JOIN sl USING (clip_id, member) WHERE least(se, b) - greatest(ss, a) > drop_ms AND b - a >= 250),
ct AS (SELECT clip_id, member, lo, hi FROM dr WHERE hi - lo >= 250 UNION ALL SELECT clip_id, member, a, a FROM e2 WHERE b - a >= 250 UNION ALL SELECT clip_id, member, b, b FROM e2 WHERE b - a >= 250),
pc AS (SELECT clip_id, member, hi AS s, lead(lo) OVER (PARTITION BY clip_id, member ORDER BY lo, hi) AS e FROM ct),
pk AS (SELECT * FROM pc WHERE e - s >= 250), al AS (SELECT * FROM pk UNION ALL SELECT clip_id, member, a, b FROM e2 WHERE b - a >= 250 AND (clip_id, member) NOT IN (SELECT (clip_id, member) FROM pk)
  UNION ALL SELECT clip_id, member, start_ms, end_ms FROM e2 WHERE b - a < 250),
kept AS (SELECT clip_id, member, row_number() OVER (PARTITION BY clip_id, member ORDER BY s) - 1 AS seq, s AS src_start_ms, e AS src_end_ms FROM al)"""


def keep_segments(spark, sf):
    return TL.keep_segments(_spans(spark, sf), _silences(spark, sf))


KEEP_SQL = f"WITH {_KEPT} SELECT clip_id, member, seq, src_start_ms, src_end_ms FROM kept"
_BUILT = f"""{_KEPT}, pr AS (SELECT *, coalesce(sum(src_end_ms - src_start_ms) OVER (PARTITION BY clip_id ORDER BY member, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM kept),
tline AS (SELECT clip_id, member, seq, src_start_ms, src_start_ms + least(src_end_ms - src_start_ms, 45000 - prior) AS src_end_ms, prior - 150 * (dense_rank() OVER (PARTITION BY clip_id ORDER BY member) - 1) AS out_start_ms FROM pr WHERE 45000 - prior > 250)"""


def build_timeline(spark, sf):
    return TL.build_timeline(keep_segments(spark, sf), 45_000)


BUILD_SQL = f"WITH {_BUILT} SELECT clip_id, member, seq, src_start_ms, CAST(src_end_ms AS BIGINT) AS src_end_ms, CAST(out_start_ms AS BIGINT) AS out_start_ms FROM tline"


def trimmed(spark, sf):
    return TL.trimmed(_spans(spark, sf), build_timeline(spark, sf))


TRIMMED_SQL = f"""WITH {_BUILT}, a AS (SELECT clip_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS raw_ms FROM sp GROUP BY 1), b AS (SELECT clip_id, CAST(sum(src_end_ms - src_start_ms) AS BIGINT) AS kept_ms FROM tline GROUP BY 1)
SELECT clip_id, raw_ms, kept_ms, CAST(greatest(raw_ms - kept_ms, 0) AS BIGINT) AS trimmed_ms FROM a JOIN b USING (clip_id)"""


def _line_words(spark, sf):
    lines = S.caption_lines(A.dense_words(spark, sf), "dual_speaker").select("source_id", F.col("seq").alias("line"), "start_ms", "end_ms", "n_words", "text")
    words = A.dense_words(spark, sf).select("source_id", "seq", "w", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))
    each = lines.select("source_id", "line", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_words") - 1)).alias("i"))
    each = each.withColumn("seq", F.col("line") + F.col("i")).join(words, ["source_id", "seq"])
    return each.select("source_id", "line", "i", "w", F.col("ws").alias("start_ms"), F.col("we").alias("end_ms"))


def word_pop_events(spark, sf):
    return TL.dialogue(TL.word_pop(_line_words(spark, sf))).select("source_id", "line", "i", "start_ms", "end_ms", "text", "dialogue")


_ESC = "replace(replace(replace(replace(w, chr(92), chr(92) || chr(92)), '{', '('), '}', ')'), chr(10), ' ')"
WORD_POP_SQL = CAPTION_LINES_SQL[: CAPTION_LINES_SQL.rindex("SELECT source_id, q AS seq")] + f""", lw_ AS (SELECT source_id, q AS line, unnest(range(n)) AS i FROM lines),
wl AS (SELECT l.source_id, line, i, w, start_ms, end_ms FROM lw_ l JOIN words w ON w.source_id = l.source_id AND w.seq = line + i),
ev AS (SELECT *, first_value(start_ms) OVER o AS ls, greatest(last_value(end_ms) OVER (PARTITION BY source_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), first_value(start_ms) OVER o + 300) AS le, lead(start_ms) OVER o AS nx FROM wl WINDOW o AS (PARTITION BY source_id, line ORDER BY i)),
ee AS (SELECT *, CASE WHEN i = 0 THEN ls ELSE greatest(start_ms, ls) END AS s FROM ev),
tx AS (SELECT e.source_id, e.line, e.i, e.s AS start_ms, least(greatest(coalesce(e.nx, e.le), e.s + 50), e.le) AS end_ms,
  '{{\\c&H00FFFFFF&}}' || (SELECT string_agg(CASE WHEN x.i = e.i THEN '{{\\c&H0000D7FF&\\fscx108\\fscy108}}' || {_ESC} || '{{\\c&H00FFFFFF&\\fscx100\\fscy100}}' ELSE {_ESC} END, ' ' ORDER BY x.i) FROM wl x WHERE x.source_id = e.source_id AND x.line = e.line) AS text FROM ee e)
SELECT *, 'Dialogue: 0,' || {ASS('start_ms')} || ',' || {ASS('end_ms')} || ',Clip,,0,0,0,,' || text AS dialogue FROM tx"""


def cue_events(spark, sf):
    return TL.dialogue(TL.cue_events(A.segments(spark, sf))).select("source_id", "seq", "start_ms", "end_ms", F.md5("dialogue").alias("dialogue_md5"))


_ESCT = _ESC.replace("(w,", "(text,")
CUE_SQL = f"""WITH {SEG_SQL}, e AS (SELECT source_id, seq, start_ms, greatest(end_ms, start_ms + 300) AS end_ms, {_ESCT} AS t FROM seg),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM e),
o AS (SELECT source_id, seq, start_ms, end_ms, CASE WHEN len(ws) > 6 THEN array_to_string(ws[1:(len(ws) + 1) // 2], ' ') || chr(92) || 'N' || array_to_string(ws[(len(ws) + 1) // 2 + 1:], ' ') ELSE t END AS text FROM w)
SELECT source_id, seq, start_ms, end_ms, md5('Dialogue: 0,' || {ASS('start_ms')} || ',' || {ASS('end_ms')} || ',Clip,,0,0,0,,' || text) AS dialogue_md5 FROM o"""

def caption_files(spark, sf):
    return TL.caption_files(TL.word_pop(_line_words(spark, sf)), ["line", "i"]).select("source_id", F.length("captions").cast("bigint").alias("n"), F.md5("captions").alias("captions_md5"))


_HEAD = TL.HEADER.format(width=TL.OUT_W, height=TL.OUT_H, font=TL.FONT, size=76, base=TL.BASE, pop=TL.POP, outline=TL.OUTLINE, shadow=TL.SHADOW, margin=420)
CAPTION_FILES_SQL = WORD_POP_SQL[: WORD_POP_SQL.rindex("SELECT *, ")] + f""", dl AS (SELECT source_id, line, i, 'Dialogue: 0,' || {ASS('start_ms')} || ',' || {ASS('end_ms')} || ',Clip,,0,0,0,,' || text || chr(10) AS d FROM tx),
fl AS (SELECT source_id, '{_HEAD}' || string_agg(d, '' ORDER BY line, i) AS c FROM dl GROUP BY source_id) SELECT source_id, CAST(length(c) AS BIGINT) AS n, md5(c) AS captions_md5 FROM fl"""


def join_graphs(spark, sf):
    """Media graphs as text."""
    return TL.join_graph(build_timeline(spark, sf))


JOIN_GRAPHS_SQL = f"""WITH {_BUILT}, jr AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY member, seq) - 1 AS i, dense_rank() OVER (PARTITION BY clip_id ORDER BY member) - 1 AS m FROM tline),
jp AS (SELECT clip_id, count(*) AS n_inputs, string_agg('[' || i || ':v]settb=1/{TL.OUT_FPS},fps={TL.OUT_FPS}[v' || i || '];[' || i || ':a]asettb=1/{TL.AUDIO_RATE}[a' || i || ']', ';' ORDER BY i) AS pins FROM jr GROUP BY clip_id),
jc AS (SELECT clip_id, m, count(*) AS n, min(i) AS one, sum(src_end_ms - src_start_ms) AS len, string_agg('[v' || i || '][a' || i || ']', '' ORDER BY i) AS chain FROM jr GROUP BY clip_id, m),
ja AS (SELECT *, CAST(greatest(sum(len) OVER (PARTITION BY clip_id ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 150 * m, 0) AS BIGINT) AS off,
  CASE WHEN n > 1 THEN chain || 'concat=n=' || n || ':v=1:a=1[cv' || m || '][ca' || m || '];[cv' || m || ']' ELSE '[v' || one || ']' END || 'settb=1/{TL.OUT_FPS},format=yuv420p,setsar=1[mv' || m || '];'
    || CASE WHEN n > 1 THEN '[ca' || m || ']' ELSE '[a' || one || ']' END || 'asettb=1/{TL.AUDIO_RATE}[ma' || m || ']' AS part FROM jc),
jx AS (SELECT *, CASE WHEN m = 1 THEN '[mv0]' ELSE '[vx' || (m - 1) || ']' END || '[mv' || m || ']xfade=transition=fade:duration=0.15:offset=' || (off // 1000) || '.' || lpad(CAST(off % 1000 AS VARCHAR), 3, '0') || '[vx' || m || '];'
    || CASE WHEN m = 1 THEN '[ma0]' ELSE '[ax' || (m - 1) || ']' END || '[ma' || m || ']acrossfade=d=0.15[ax' || m || ']' AS fade FROM ja),
jm AS (SELECT clip_id, count(*) AS n_members, string_agg(part, ';' ORDER BY m) AS parts, string_agg(fade, ';' ORDER BY m) FILTER (WHERE m > 0) AS fades FROM jx GROUP BY clip_id)
SELECT clip_id, n_inputs, n_members, pins || ';' || parts || coalesce(';' || fades, '') AS graph FROM jp JOIN jm USING (clip_id)"""


def follow_chains(spark, sf):
    return crop_expr(spark, sf).select("clip_id", TL.follow_chain(F.lit(404), F.lit(720), F.col("expr")).alias("chain"))


def fit_chains(spark, sf):
    c = A.candidates(spark, sf).select("candidate_id")
    pin = lambda k: F.concat(F.lit(f"[{k}"), F.col("candidate_id").cast("string"), F.lit("]"))
    return c.select("candidate_id", TL.fit_chain(pin("v"), pin("f")).alias("chain"))


FIT_CHAINS_SQL = f"""WITH {CAND_SQL} SELECT candidate_id, '[v' || candidate_id || ']split=2[fb_bg][fb_fg];[fb_bg]scale=270:480:force_original_aspect_ratio=increase,crop=270:480,gblur=sigma=8,scale=1080:1920,eq=brightness=-0.10,setsar=1[fb_bgb];'
  || '[fb_fg]scale=1080:-2,setsar=1[fb_fgs];[fb_bgb][fb_fgs]overlay=(W-w)/2:(H-h)/2-140:format=auto,setsar=1,format=yuv420p[f' || candidate_id || ']' AS chain FROM cand"""


def face_samples(spark, sf):
    """Two boxes at each sample of a source that found something, and a second size for every third."""
    s = A.samples(spark, sf).filter("x_pm is not null")
    box = lambda dx, w, h: F.struct((F.col("x_pm") + dx).alias("left_pm"), F.lit(w).cast("bigint").alias("width_pm"), h.cast("bigint").alias("height_pm"))
    boxes = s.select("clip_id", "t_ms", F.explode(F.array(box(0, 100, F.lit(200)), box(7, 120, F.when(F.col("x_pm") % 3 == 0, 10).otherwise(300)))).alias("b")).select("clip_id", "t_ms", "b.*")
    return TL.face_samples(A.timeline(spark, sf), boxes)


FACE_SQL = f"""WITH {A.SAMPLES_SQL}, {A.TIMELINE_SQL}, gr AS (SELECT clip_id, seq, unnest(range((src_end_ms - src_start_ms) * 2 // 1000 + 1)) AS i, src_start_ms, src_end_ms FROM tl),
nb AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY seq, i) AS k FROM gr), g AS (SELECT clip_id, seq, least(src_start_ms + i * 500, src_end_ms) AS t_ms FROM nb WHERE k <= 240)
SELECT g.clip_id, g.seq, g.t_ms, CASE WHEN x_pm % 3 = 0 THEN x_pm + 50 ELSE x_pm + 67 END AS x_pm FROM g LEFT JOIN (SELECT * FROM smp WHERE x_pm IS NOT NULL) s ON s.clip_id = g.clip_id AND s.t_ms = g.t_ms"""


def envelopes(spark, sf):
    c = C.validate(A.raw_candidates(spark, sf), F.lit(A.TIMELINE_MS))
    ok = F.col("error_code").isNull()
    return c.select("candidate_id", TL.envelope(ok, F.col("error_code"), F.when(~ok, F.lit("fix it")), F.struct("source_id")).alias("result"))


ENVELOPES_SQL = VALIDATE_SQL[: VALIDATE_SQL.index("r AS (")] + f"""r AS (SELECT *, {_ERROR} AS error_code FROM raw), b AS (SELECT candidate_id, CASE WHEN error_code IS NULL THEN '{{"success":true,' ELSE '{{"success":false,"error":"' || error_code || '","hint":"fix it",' END || '"fields":{{"source_id":' || source_id || '}},"progress":[]}}' AS b FROM r)
SELECT candidate_id, b[:-2] || ',"token_estimate":' || greatest(1, length(b) // 4) || '}}' AS result FROM b"""

QUERIES = {
    "caption_files": (caption_files, CAPTION_FILES_SQL), "join_graphs": (join_graphs, JOIN_GRAPHS_SQL), "follow_chains": (follow_chains, FOLLOW_SQL), "envelopes": (envelopes, ENVELOPES_SQL), "fit_chains": (fit_chains, FIT_CHAINS_SQL), "face_samples": (face_samples, FACE_SQL),
    "plan_auto": (plan_auto, AUTO_SQL), "plan_fused": (fused_plan, FUSED_PLAN_SQL), "plan_by_label": (plan_by_label, BY_LABEL_SQL), "plan_montage": (plan_montage, MONTAGE_SQL), "fit_budget": (fit_budget, FIT_BUDGET_SQL),
    "dominant_label": (dominant_label, DOMINANT_SQL), "plan_by_topic": (plan_by_topic, None), "top_phrases": (top_phrases, PHRASES_SQL), "plan_supercut": (plan_supercut, SUPERCUT_SQL),
    "keep_segments": (keep_segments, KEEP_SQL), "build_timeline": (build_timeline, BUILD_SQL), "trimmed_seconds": (trimmed, TRIMMED_SQL),
    "word_pop_events": (word_pop_events, WORD_POP_SQL), "cue_events": (cue_events, CUE_SQL),
}
