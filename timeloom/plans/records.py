"""Queries of job tables, library records and what is published."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import jobs as J
from ..operators import library as L
from ..operators import sequence as S
from ..sources import sinks as K
from ..streaming.expiry import EXPIRIES, expiries, rocks
from ..streaming.stateful import TRANSITIONS, job_lifecycle, job_transitions
from ..streaming.upserts import INDEX, index_upserts, read_table
from . import adapter as A
from .adapter import CAND_SQL, table
from .scratch import scratch
from .sequences import _LOUD

NOW = 1_900_000_000_000


def _jobs(spark, sf):
    """Orders as jobs."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "queued").when(k % 5 == 1, "running").when(k % 5 == 2, "failed").otherwise("done")
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1990-01-01 00:00:00', o_orderdate) * 1000")
    return o.select(
        k.alias("job_id"), F.when(k % 3 == 0, "fetch").otherwise("render").alias("kind"), (F.col("o_custkey") % 97).alias("source_id"), (k % 1000).alias("clip_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 7).cast("string")).alias("project"),
        status.alias("status"), at.alias("created_ms"), F.when(k % 5 > 0, at + k % 900).alias("started_ms"), F.when(k % 5 > 1, at + k % 7000).alias("finished_ms"), F.when(k % 5 == 2, F.concat(F.lit("e"), k.cast("string"))).alias("error"),
        F.when((k % 5 > 2) & (k % 11 > 0), F.concat(F.lit("/out/"), k.cast("string"))).alias("output_path"), (k * 37 % 60_000).alias("duration_ms"))


_JOBS = """jobs AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'fetch' ELSE 'render' END AS kind, o_custkey % 97 AS source_id, o_orderkey % 1000 AS clip_id, 'p' || (o_custkey % 7) AS project,
  CASE o_orderkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'done' END AS status, at_ AS created_ms, CASE WHEN o_orderkey % 5 > 0 THEN at_ + o_orderkey % 900 END AS started_ms,
  CASE WHEN o_orderkey % 5 > 1 THEN at_ + o_orderkey % 7000 END AS finished_ms, CASE WHEN o_orderkey % 5 = 2 THEN 'e' || o_orderkey END AS error,
  CASE WHEN o_orderkey % 5 > 2 AND o_orderkey % 11 > 0 THEN '/out/' || o_orderkey END AS output_path, o_orderkey * 37 % 60000 AS duration_ms
  FROM (SELECT *, date_diff('second', TIMESTAMP '1990-01-01', o_orderdate) * 1000 AS at_ FROM orders))"""


def _sources(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("source_id"), F.concat(F.lit("p"), (k % 7).cast("string")).alias("project"), F.concat(F.lit("https://h"), (k % 40).cast("string"), F.lit(".com/v")).alias("url"), (k % 4 > 0).alias("has_video"), (NOW - k * 1_000_000).alias("fetched_ms"), F.col("c_name").alias("title"))


_SOURCES = f"sources AS (SELECT c_custkey AS source_id, 'p' || (c_custkey % 7) AS project, 'https://h' || (c_custkey % 40) || '.com/v' AS url, c_custkey % 4 > 0 AS has_video, {NOW} - c_custkey * 1000000 AS fetched_ms, c_name AS title FROM customer)"


def _clips(spark, sf):
    """Parts as clips of three candidates; some of those do not exist."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select(k.alias("clip_id"), (k % 50).alias("source_id"), F.array(k, k * 3, k * 20).alias("members"), (k % 6 == 0).alias("rendered"), F.concat(F.lit("p"), (k % 9).cast("string")).alias("project"))


_CLIPS = "clips AS (SELECT p_partkey AS clip_id, p_partkey % 50 AS source_id, [p_partkey, p_partkey * 3, p_partkey * 20] AS members, p_partkey % 6 = 0 AS rendered, 'p' || (p_partkey % 9) AS project FROM part)"


def queue_depth(spark, sf):
    return J.queue_depth(_jobs(spark, sf))


QUEUE_SQL = f"WITH {_JOBS} SELECT project, count(*) FILTER (WHERE status IN ('queued', 'running')) AS depth, count(*) AS n_jobs FROM jobs GROUP BY project"


def live_jobs(spark, sf):
    return J.live_jobs(_jobs(spark, sf))


LIVE_SQL = f"WITH {_JOBS} SELECT source_id, count(*) AS n_live FROM jobs WHERE status IN ('queued', 'running') GROUP BY source_id"


def pending_fetch(spark, sf):
    return J.pending_fetch(_jobs(spark, sf)).select("source_id", "job_id", "created_ms")


PENDING_SQL = f"WITH {_JOBS} SELECT source_id, job_id, created_ms FROM jobs WHERE kind = 'fetch' AND status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_ms, job_id) = 1"


def latest_failure(spark, sf):
    return J.latest_failure(_jobs(spark, sf)).select("source_id", "job_id", "error")


FAILURE_SQL = f"WITH {_JOBS} SELECT source_id, job_id, error FROM jobs WHERE kind = 'fetch' AND status = 'failed' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY finished_ms DESC, job_id) = 1"


def claim_next(spark, sf):
    return J.claim_next(_jobs(spark, sf), NOW).select("job_id", "status", "started_ms")


CLAIM_SQL = f"""WITH {_JOBS}, c AS (SELECT *, status = 'queued' AND row_number() OVER (PARTITION BY project, status ORDER BY created_ms, job_id) = 1 AS mine FROM jobs)
SELECT job_id, CASE WHEN mine THEN 'running' ELSE status END AS status, CASE WHEN mine THEN {NOW} ELSE started_ms END AS started_ms FROM c"""


def reconcile(spark, sf):
    return J.reconcile(_jobs(spark, sf), NOW).select("job_id", "status", "error", "finished_ms")


RECONCILE_SQL = f"""WITH {_JOBS} SELECT job_id, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, CASE status WHEN 'running' THEN '{J.INTERRUPTED}' ELSE error END AS error,
  CASE status WHEN 'running' THEN {NOW} ELSE finished_ms END AS finished_ms FROM jobs"""


def fail_jobs(spark, sf):
    jobs = _jobs(spark, sf)
    return J.failed(jobs, jobs.filter("status = 'running' and job_id % 2 = 0"), "boom", NOW).select("job_id", "status", "error", "finished_ms")


FAIL_SQL = f"""WITH {_JOBS}, j AS (SELECT *, status = 'running' AND job_id % 2 = 0 AS bad FROM jobs)
SELECT job_id, CASE WHEN bad THEN 'failed' ELSE status END AS status, CASE WHEN bad THEN 'boom' ELSE error END AS error, CASE WHEN bad THEN {NOW} ELSE finished_ms END AS finished_ms FROM j"""


def job_view(spark, sf):
    return J.job_view(_jobs(spark, sf), NOW).select("job_id", "status", "elapsed_ms")


VIEW_SQL = f"""WITH {_JOBS} SELECT job_id, status, CASE WHEN status = 'running' AND started_ms IS NOT NULL THEN {NOW} - started_ms WHEN finished_ms IS NOT NULL AND started_ms IS NOT NULL THEN finished_ms - started_ms ELSE 0 END AS elapsed_ms FROM jobs"""


def enqueue_renders(spark, sf):
    r = table(spark, sf, "supplier").select((F.col("s_suppkey") * 7).alias("clip_id"), F.when(F.col("s_suppkey") % 5 == 0, "wide").otherwise("speaker").alias("reframe"))
    clips = _clips(spark, sf).withColumn("n_members", F.when(F.col("clip_id") % 3 == 0, 0).otherwise(F.size("members")))
    return J.enqueue_renders(r, clips, _sources(spark, sf), _jobs(spark, sf))


ENQUEUE_SQL = f"""WITH {_JOBS}, {_SOURCES}, {_CLIPS}, r AS (SELECT s_suppkey * 7 AS clip_id, CASE WHEN s_suppkey % 5 = 0 THEN 'wide' ELSE 'speaker' END AS reframe FROM supplier)
SELECT r.clip_id, reframe, CASE WHEN reframe = 'wide' THEN 'unknown_reframe' WHEN c.clip_id IS NULL THEN 'unknown_clip' WHEN c.clip_id % 3 = 0 THEN 'no_members'
  WHEN NOT (coalesce(has_video, false) OR c.source_id IN (SELECT source_id FROM jobs WHERE kind = 'fetch' AND status IN ('queued', 'running'))) THEN 'no_video' END AS error_code
FROM r LEFT JOIN clips c ON r.clip_id = c.clip_id LEFT JOIN sources s ON s.source_id = c.source_id"""


def expired_sources(spark, sf):
    return J.expired_sources(_sources(spark, sf), _jobs(spark, sf), NOW).select("source_id")


EXPIRED_SQL = f"WITH {_JOBS}, {_SOURCES} SELECT source_id FROM sources WHERE has_video AND fetched_ms < {NOW} - 86400000 AND source_id NOT IN (SELECT source_id FROM jobs WHERE status IN ('queued', 'running'))"


def _exports(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    return c.select(k.alias("batch_id"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("project"), (NOW - k * 3_600_000).alias("created_ms"), (k % 300).alias("ttl_hours"))


_EXPORTS = f"exports AS (SELECT c_custkey AS batch_id, 'p' || (c_custkey % 5) AS project, {NOW} - c_custkey * 3600000 AS created_ms, c_custkey % 300 AS ttl_hours FROM customer)"


def expired_exports(spark, sf):
    return J.expired_exports(_exports(spark, sf), NOW).select("batch_id", T.iso(F.col("created_ms") + F.col("ttl_hours") * 3_600_000).alias("expires_at"))


EXPORTS_SQL = f"WITH {_EXPORTS} SELECT batch_id, strftime(make_timestamp((created_ms + ttl_hours * 3600000) * 1000), '%Y-%m-%dT%H:%M:%SZ') AS expires_at FROM exports WHERE created_ms + ttl_hours * 3600000 < {NOW}"


def frame_budget(spark, sf):
    c = A.candidates(spark, sf)
    return J.frame_usage(c.select("source_id", F.col("candidate_id").alias("seq"), "start_ms", "end_ms", (F.col("candidate_id") * 71 % 5000).alias("fps_m"))).select("source_id", "seq", "wanted", "take", "used")


FRAMES_SQL = f"""WITH {CAND_SQL}, w AS (SELECT source_id, candidate_id AS seq, ((end_ms - start_ms) * greatest(100, least(candidate_id * 71 % 5000, 4000)) + 999999) // 1000000 AS wanted FROM cand),
u AS (SELECT *, CAST(least(sum(least(wanted, 20)) OVER (PARTITION BY source_id ORDER BY seq), 60) AS BIGINT) AS used FROM w)
SELECT source_id, seq, wanted, used - coalesce(lag(used) OVER (PARTITION BY source_id ORDER BY seq), 0) AS take, used FROM u"""


def frame_times(spark, sf):
    c = A.candidates(spark, sf)
    return J.frame_times(J.frame_usage(c.select("source_id", F.col("candidate_id").alias("seq"), "start_ms", "end_ms", (F.col("candidate_id") * 71 % 5000).alias("fps_m"))))


FRAME_TIMES_SQL = FRAMES_SQL[: FRAMES_SQL.rindex("SELECT source_id, seq, wanted")].replace("AS wanted FROM cand)", "AS wanted, start_ms, greatest(100, least(candidate_id * 71 % 5000, 4000)) AS rate FROM cand)") + """, t AS (SELECT *, used - coalesce(lag(used) OVER (PARTITION BY source_id ORDER BY seq), 0) AS take FROM u),
e AS (SELECT *, unnest(range(take)) AS i FROM t) SELECT source_id, seq, i, CAST((start_ms * rate + i * 1000000 + 5 * rate) // (10 * rate) * 10 AS BIGINT) AS t_ms FROM e"""


def list_library(spark, sf):
    projects = table(spark, sf, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("project"))
    return L.list_projects(projects, _sources(spark, sf), _clips(spark, sf), _exports(spark, sf))


LIBRARY_SQL = f"""WITH {_SOURCES}, {_CLIPS}, {_EXPORTS}, p AS (SELECT 'p' || n_nationkey AS project FROM nation)
SELECT project, (SELECT count(*) FROM sources s WHERE s.project = p.project) AS n_sources, (SELECT count(*) FROM clips c WHERE c.project = p.project) AS n_clips, (SELECT count(*) FROM exports e WHERE e.project = p.project) AS n_exports FROM p"""


def clip_members(spark, sf):
    return L.clip_members(_clips(spark, sf), A.candidates(spark, sf).drop("source_id")).select("clip_id", "candidate_id", "position", "start_ms")


_MEMBERS = f"{CAND_SQL}, {_CLIPS}, mem AS (SELECT clip_id, cl.source_id, candidate_id, start_ms, end_ms, score, reason, row_number() OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms, candidate_id) - 1 AS position FROM (SELECT clip_id, source_id, unnest(members) AS m FROM clips) cl JOIN cand ON candidate_id = m)"
MEMBERS_SQL = f"WITH {_MEMBERS} SELECT clip_id, candidate_id, position, start_ms FROM mem"


def library_index(spark, sf):
    return L.library_index(source=_sources(spark, sf), clip=_clips(spark, sf), batch=_exports(spark, sf))


INDEX_SQL = f"""WITH {_SOURCES}, {_CLIPS}, {_EXPORTS}, a AS (SELECT CAST(source_id AS VARCHAR) AS entity_id, 'source' AS kind, project FROM sources UNION ALL SELECT CAST(clip_id AS VARCHAR), 'clip', project FROM clips UNION ALL SELECT CAST(batch_id AS VARCHAR), 'batch', project FROM exports)
SELECT entity_id, kind, min(project) AS project FROM a GROUP BY entity_id, kind"""


def source_by_url(spark, sf):
    r = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("p"), (F.col("s_suppkey") % 7).cast("string")).alias("project"), F.concat(F.lit("https://h"), (F.col("s_suppkey") % 60).cast("string"), F.lit(".com/v")).alias("url"))
    path = F.concat(F.lit("sources/"), F.col("source_id").cast("string"), F.lit("/source.yaml"))
    return L.source_by_url(r, _sources(spark, sf).withColumn("path", path))


BY_URL_SQL = f"""WITH {_SOURCES}, r AS (SELECT s_suppkey, 'p' || (s_suppkey % 7) AS project, 'https://h' || (s_suppkey % 60) || '.com/v' AS url FROM supplier)
SELECT s_suppkey, project, url, (SELECT arg_min(source_id, 'sources/' || source_id || '/source.yaml') FROM sources s WHERE s.project = r.project AND s.url = r.url) AS source_id FROM r"""


def clear_clips(spark, sf):
    return L.clear_clips(_clips(spark, sf), _sources(spark, sf).filter("source_id % 3 = 0")).select("clip_id", "source_id", "rendered")


CLEAR_SQL = f"WITH {_SOURCES}, {_CLIPS} SELECT clip_id, source_id, rendered FROM clips WHERE rendered OR source_id NOT IN (SELECT source_id FROM sources WHERE source_id % 3 = 0)"


def append_unique(spark, sf):
    records = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.array(F.lit(1).cast("bigint"), F.col("n_nationkey").cast("bigint")).alias("ids"))
    added = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("bigint").alias("k"), (F.col("s_suppkey") % 9).alias("value"))
    return L.append_unique(records, "ids", added, "k").select("k", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


APPEND_SQL = """WITH a AS (SELECT CAST(s_nationkey AS BIGINT) AS k, list_sort(list(DISTINCT s_suppkey % 9)) AS vs FROM supplier GROUP BY 1), r AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey = 1 THEN [1] ELSE [1, n_nationkey] END AS ids FROM nation)
SELECT k, array_to_string(list_concat(ids, list_filter(coalesce(vs, []), lambda x: NOT list_contains(ids, x))), ',') AS ids FROM r LEFT JOIN a USING (k)"""


def caption_langs(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    names = F.array(*map(F.lit, ("en", "en-US", "EN-gb", "fr", "de")))
    return L.caption_tracks(c.select((k % 60).alias("source_id"), F.get(names, (k % 5).cast("int")).alias("track"), F.when(k % 4 == 0, "manual").otherwise("auto").alias("kind")))


LANGS_SQL = """WITH t AS (SELECT c_custkey % 60 AS source_id, ['en', 'en-US', 'EN-gb', 'fr', 'de'][c_custkey % 5 + 1] AS track, CASE WHEN c_custkey % 4 = 0 THEN 'manual' ELSE 'auto' END AS kind FROM customer)
SELECT source_id, track, max(kind) AS kind FROM t WHERE starts_with(lower(track), 'en') GROUP BY source_id, track"""


def size_estimate(spark, sf):
    x, k = table(spark, sf, "lineitem"), F.col("l_orderkey")
    return L.size_estimate(x.select(
        (k % 500).alias("source_id"), (k % 500 * 10).alias("duration_s"), F.when(F.col("l_linenumber") == 1, k * 1000).otherwise(0).alias("filesize"), F.when(F.col("l_linenumber") == 2, F.col("l_partkey") * 900).alias("approx"),
        (F.col("l_suppkey") * 10).alias("tbr"), F.get(F.array(*map(F.lit, (0, 360, 720, 1080))), (k % 4).cast("int")).alias("height"), F.when(F.col("l_partkey") % 3 == 0, "none").otherwise("avc").alias("vcodec"), F.when(F.col("l_partkey") % 2 == 0, "aac").alias("acodec")), 720)


SIZE_SQL = """WITH f AS (SELECT l_orderkey % 500 AS source_id, l_orderkey % 500 * 10 AS duration_s, coalesce(nullif(CASE WHEN l_linenumber = 1 THEN l_orderkey * 1000 ELSE 0 END, 0), nullif(CASE WHEN l_linenumber = 2 THEN l_partkey * 900 END, 0),
    nullif(l_suppkey * 10, 0) * 125 * nullif(l_orderkey % 500 * 10, 0), 0) AS size, [0, 360, 720, 1080][l_orderkey % 4 + 1] AS height, l_partkey % 3 <> 0 AS v, l_partkey % 2 = 0 AS a FROM lineitem),
g AS (SELECT source_id, duration_s, coalesce(max(size) FILTER (WHERE v AND height BETWEEN 1 AND 720), 0) + coalesce(max(size) FILTER (WHERE NOT v AND a), 0) AS b FROM f GROUP BY ALL)
SELECT source_id, duration_s, CAST(CASE WHEN b > 0 THEN b ELSE duration_s * 256000 END AS BIGINT) AS bytes FROM g"""


def dimensions(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return L.dimensions(p.select(k.alias("source_id"), F.when(k % 3 == 0, k).alias("frame_w"), F.when(k % 3 == 0, k + 1).alias("frame_h"), F.when(k % 2 == 0, k * 2).alias("header_w"), F.when(k % 2 == 0, k * 3).alias("header_h")))


DIMENSIONS_SQL = """WITH d AS (SELECT p_partkey AS source_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey WHEN p_partkey % 2 = 0 THEN p_partkey * 2 END AS w, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 WHEN p_partkey % 2 = 0 THEN p_partkey * 3 END AS h FROM part)
SELECT source_id, CAST(CASE WHEN w > 0 AND h > 0 THEN w ELSE 1280 END AS BIGINT) AS width, CAST(CASE WHEN w > 0 AND h > 0 THEN h ELSE 720 END AS BIGINT) AS height FROM d"""


def _requests(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2 - 1).alias("job_id")).distinct()


_REQ = "req AS (SELECT DISTINCT l_orderkey * 2 - 1 AS job_id FROM lineitem)"


def publishable(spark, sf):
    return L.publishable(_requests(spark, sf), _jobs(spark, sf)).select("job_id", "error_code")


PUBLISHABLE_SQL = f"""WITH {_JOBS}, {_REQ} SELECT job_id, CASE WHEN status IS NULL THEN 'unknown_job' WHEN status <> 'done' THEN 'not_done' WHEN output_path IS NULL THEN 'no_file' END AS error_code FROM req LEFT JOIN jobs USING (job_id)"""


def manifest(spark, sf):
    done = L.publishable(_requests(spark, sf), _jobs(spark, sf)).filter("error_code is null").drop("source_id")
    clips = _clips(spark, sf)
    done = done.join(clips.select("clip_id", "source_id"), "clip_id").withColumn("label", F.lit("quote"))
    members = L.clip_members(clips, A.candidates(spark, sf).drop("source_id"))
    return L.manifest(done, members, _sources(spark, sf), "https://x", "b_1")


_MANIFEST = f"""{_JOBS}, {_REQ}, {_SOURCES}, {_MEMBERS}, done AS (SELECT job_id, j.clip_id, c.source_id, duration_ms FROM req JOIN jobs j USING (job_id) JOIN clips c ON c.clip_id = j.clip_id WHERE status = 'done' AND output_path IS NOT NULL),
bu AS (SELECT clip_id, min(start_ms) AS source_start_ms, max(end_ms) AS source_end_ms, max(score) AS score, first(reason ORDER BY score DESC, start_ms, end_ms, candidate_id) AS reason,
  '[' || string_agg('{{"candidate_id":' || candidate_id || ',"start_ms":' || start_ms || ',"end_ms":' || end_ms || '}}', ',' ORDER BY start_ms, end_ms, candidate_id) || ']' AS built_from FROM mem GROUP BY clip_id),
man AS (SELECT job_id, clip_id, source_id, 'quote' AS label, duration_ms, source_start_ms, source_end_ms, score, reason, built_from, 'https://x/b_1/' || clip_id || '.mp4' AS link, url || '?t=' || (source_start_ms // 1000) AS source_link FROM done JOIN bu USING (clip_id) JOIN sources USING (source_id))"""
MANIFEST_SQL = f"WITH {_MANIFEST} SELECT * FROM man"


def summary(spark, sf):
    return L.summary(manifest(spark, sf)).select("source_id", "n_clips", F.md5("summary").alias("summary_md5"))


_HMS = lambda e: f"(CASE WHEN {e} >= 3600000 THEN format('{{}}:{{:02d}}:{{:02d}}', {e} // 3600000, {e} // 60000 % 60, {e} // 1000 % 60) ELSE format('{{}}:{{:02d}}', {e} // 60000, {e} // 1000 % 60) END)"
SUMMARY_SQL = f"""WITH {_MANIFEST}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY source_start_ms, clip_id, job_id) AS n FROM man),
l AS (SELECT source_id, n, n || '. [' || label || ' · ' || ((duration_ms + 500) // 1000) || 's]  ' || link || chr(10) || '   source ' || {_HMS('source_start_ms')} || '–' || {_HMS('source_end_ms')} || ' · ' || source_link || chr(10) || '   "' || reason || '"' AS t FROM n)
SELECT source_id, count(*) AS n_clips, md5(string_agg(t, chr(10) ORDER BY n)) AS summary_md5 FROM l GROUP BY source_id"""


def gallery(spark, sf):
    return L.gallery_cards(manifest(spark, sf))


GALLERY_SQL = f"""WITH {_MANIFEST} SELECT clip_id, '<article><a href="' || link || '">' || label || '</a><p>' || reason || '</p><a href="' || source_link || '">source</a></article>' AS card FROM man"""


def _entries(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select((k % 20).alias("folder"), F.col("p_name").alias("name"), (k % 4 == 0).alias("is_dir"), (k * k * 77).alias("size"))


_ENTRIES = "en AS (SELECT p_partkey % 20 AS folder, p_name AS name, p_partkey % 4 = 0 AS is_dir, p_partkey * p_partkey * 77 AS size FROM part)"


def folder_sizes(spark, sf):
    return L.folder_sizes(_entries(spark, sf))


FOLDERS_SQL = f"WITH {_ENTRIES} SELECT folder, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n_files FROM en WHERE NOT is_dir GROUP BY folder"


def listing(spark, sf):
    return L.listing(_entries(spark, sf)).select("folder", "name", "place")


LISTING_SQL = f"WITH {_ENTRIES} SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY NOT is_dir, lower(name), name) AS place FROM en"


def returned_candidates(spark, sf):
    return L.capped(A.candidates(spark, sf), ["source_id"], ["start_ms", "end_ms", "candidate_id"], 30).select("source_id", "candidate_id", "returned", "total_available", "truncated")


RETURNED_SQL = f"""WITH {CAND_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, candidate_id) AS n, count(*) OVER (PARTITION BY source_id) AS total_available FROM cand)
SELECT source_id, candidate_id, CAST(least(total_available, 30) AS BIGINT) AS returned, total_available, total_available > 30 AS truncated FROM n WHERE n <= 30"""


def two_cue_agreement(spark, sf):
    s = A.samples(spark, sf)
    spikes = S.energy_spikes(s)
    marks = s.filter("x_pm % 40 = 0").select("clip_id")
    return L.agreement(spikes, marks, s.select("clip_id").distinct())


AGREEMENT_SQL = f"""WITH {_LOUD}, ru AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms) - row_number() OVER (PARTITION BY clip_id, is_loud ORDER BY t_ms) AS g FROM loud),
sp AS (SELECT clip_id FROM ru WHERE is_loud GROUP BY clip_id, g HAVING max(t_ms) - min(t_ms) >= 500), k AS (SELECT DISTINCT clip_id FROM smp)
SELECT clip_id, clip_id IN (SELECT clip_id FROM sp) AS has_spike, clip_id IN (SELECT clip_id FROM smp WHERE x_pm % 40 = 0) AS has_marker, clip_id IN (SELECT clip_id FROM sp) AND clip_id IN (SELECT clip_id FROM smp WHERE x_pm % 40 = 0) AS two_cues FROM k"""

def live_clients(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return J.live_clients(c.select(k.alias("client_id"), (k * 7919 % 100_003).alias("created_ms"), (k % 601 == 0).alias("is_static")), 100_003, 90_000)


CLIENTS_SQL = """WITH c AS (SELECT c_custkey AS client_id, c_custkey * 7919 % 100003 AS created_ms, c_custkey % 601 = 0 AS is_static FROM customer)
SELECT * FROM c WHERE is_static UNION ALL SELECT client_id, created_ms, is_static FROM (SELECT *, row_number() OVER (ORDER BY created_ms DESC, client_id DESC) AS r FROM c WHERE NOT is_static AND 100003 - created_ms <= 90000)
WHERE r <= greatest(0, 256 - (SELECT count(*) FROM c WHERE is_static))"""


def first_answer(spark, sf):
    e = A.raw_candidates(spark, sf).select("source_id", F.col("candidate_id").alias("attempt"), F.col("reason").alias("answer"), (F.col("k") % 4 - 2).alias("n_found"))
    return J.first_answer(e)


ANSWER_SQL = f"""WITH {A.RAW_SQL}, a AS (SELECT source_id, candidate_id AS attempt, reason AS answer, k % 4 - 2 AS n_found FROM raw),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n_found <= 0, CASE WHEN n_found > 0 THEN attempt ELSE -attempt END) AS n FROM a) SELECT source_id, attempt, answer, n_found FROM r WHERE n = 1"""


def saved_records(spark, sf):
    """Candidates saved by label, one label replaced by a second save, and all read back."""
    c = A.candidates(spark, sf).select("candidate_id", "score", "label")
    path = scratch(spark, "records")
    K.save_records(c, path, ["label"])
    K.save_records(c.filter("label = 'story'").withColumn("score", F.col("score") + 100), path, ["label"])
    return K.load_records(spark, path, "candidate_id long, score double, label string")


SAVED_SQL = f"WITH {CAND_SQL} SELECT candidate_id, score + CASE WHEN label = 'story' THEN 100 ELSE 0 END AS score, label FROM cand"


def receipts_tail(spark, sf):
    """Receipts appended twice; the last fifty are the feature."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    at = F.timestamp_add("SECOND", k * 37 % 1_000_003, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))
    rows = o.select(at.alias("ts"), F.concat(F.lit("t"), k.cast("string")).alias("tool"), F.lit("{}").alias("args"), F.when(k % 2 == 0, "ok").otherwise("failed").alias("result"), F.lit("").alias("backup"))
    path = scratch(spark, "receipts")
    for part in (0, 1):
        K.append_receipts(rows.filter(k % 2 == part), path)
    return K.read_receipts(spark, path).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("told_at"), "tool", "result")


RECEIPTS_SQL = """SELECT strftime(TIMESTAMP '2024-01-01' + to_seconds(CAST(o_orderkey * 37 % 1000003 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS told_at, 't' || o_orderkey AS tool, CASE WHEN o_orderkey % 2 = 0 THEN 'ok' ELSE 'failed' END AS result FROM orders ORDER BY told_at DESC, tool LIMIT 50"""


def job_stream(spark, sf):
    """Three kinds of job histories as a stream, its transitions written by the stream and read back."""
    path = scratch(spark, "stream")
    schema = table(spark, sf, "customer").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
    k = F.col("c_custkey")
    told = lambda *x: F.array(*map(F.lit, x))
    steps = F.when(k % 3 == 0, told("queued", "running", "done", "running")).when(k % 3 == 1, told("running", "queued", "failed")).otherwise(told("queued", "done"))
    events = stream.select(k.cast("bigint").alias("job_id"), F.posexplode(steps).alias("i", "status")).select("job_id", "status", F.timestamp_seconds("i").alias("ts"))
    run = job_transitions(events).writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(TRANSITIONS).parquet(path).select("job_id", "old", "new", "accepted")


STREAM_SQL = """WITH m(kind, old, new, accepted) AS (VALUES (0, '', 'queued', true), (0, 'queued', 'running', true), (0, 'running', 'done', true), (0, 'done', 'running', false),
  (1, '', 'running', false), (1, '', 'queued', true), (1, 'queued', 'failed', true), (2, '', 'queued', true), (2, 'queued', 'done', false))
SELECT CAST(c_custkey AS BIGINT) AS job_id, old, new, accepted FROM customer JOIN m ON kind = c_custkey % 3"""

def _arriving(spark, rows, name, batches=3):
    """``rows`` (with ``batch_``, from 0) as a stream of as many batches, and a last one to move the watermark."""
    path = scratch(spark, name)
    for i in range(batches):
        rows.filter(F.col("batch_") == i).drop("batch_").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("batch_").schema).option("maxFilesPerTrigger", 1).parquet(path)


def _ran(stream, state, **options):
    """The stream, run over all that is there."""
    run = stream.option("checkpointLocation", f"{state}-state").trigger(availableNow=True).start(**options)
    run.awaitTermination()


def late_events(spark, sf):
    """The histories of ``job_stream``, whose last events arrive first; the result is in the order of events all the same."""
    k = F.col("c_custkey")
    told = lambda *x: F.array(*map(F.lit, x))
    steps = F.when(k % 3 == 0, told("queued", "running", "done", "running")).when(k % 3 == 1, told("running", "queued", "failed")).otherwise(told("queued", "done"))
    rows = table(spark, sf, "customer").select(k.cast("bigint").alias("job_id"), F.posexplode(steps).alias("i", "status"))
    rows = rows.select("job_id", "status", F.timestamp_seconds(F.col("i") * 60 + 1000).alias("ts"), F.when(F.col("i") % 2 == 1, 0).otherwise(1).alias("batch_"))
    end = spark.range(2).select(F.lit(-1).cast("bigint").alias("job_id"), F.lit("queued").alias("status"), F.timestamp_seconds(F.lit(10**6)).alias("ts"), (F.col("id") + 2).cast("int").alias("batch_"))
    stream, path = _arriving(spark, rows.unionByName(end), "late-in", 4), scratch(spark, "late")
    _ran(job_lifecycle(stream).writeStream.format("parquet"), path, path=path)
    return spark.read.schema(TRANSITIONS).parquet(path).filter("job_id >= 0").select("job_id", "old", "new", "accepted")


def expiry_stream(spark, sf):
    """Exports as a stream in two batches; the watermark comes to now."""
    e = _exports(spark, sf).select(F.col("batch_id").alias("export_id"), "created_ms", "ttl_hours")
    # a timer goes off when the watermark reaches it, so that comes to one before now
    rows = e.withColumns({"ts": F.timestamp_millis(F.col("created_ms") - 1), "batch_": (F.col("created_ms") > NOW - 500 * 3_600_000).cast("int")})
    end = spark.range(2).select(F.lit(-1).cast("bigint").alias("export_id"), F.lit(NOW).cast("bigint").alias("created_ms"), F.lit(10**6).cast("bigint").alias("ttl_hours"), F.timestamp_millis(F.lit(NOW - 1)).alias("ts"), (F.col("id") + 2).cast("int").alias("batch_"))
    # rows of one batch may be older than those of another by all of their range
    stream, path = _arriving(spark, rows.unionByName(end.select(rows.columns)), "expiry-in", 4), scratch(spark, "expiry")
    with rocks(spark):
        _ran(expiries(stream).writeStream.format("parquet"), path, path=path)
    return spark.read.schema(EXPIRIES).parquet(path).select(F.col("export_id").alias("batch_id"), T.iso(F.col("expires_ms")).alias("expires_at"))


def index_stream(spark, sf):
    """The index of ``library_index``, kept by a stream of three batches."""
    part = lambda rows, kind, i: rows.select(F.col(f"{kind}_id").cast("string").alias("entity_id"), F.lit(kind).alias("kind"), "project", F.lit(i).alias("batch_"))
    rows = part(_sources(spark, sf), "source", 0).unionByName(part(_clips(spark, sf), "clip", 1)).unionByName(part(_exports(spark, sf), "batch", 2))
    stream, path = _arriving(spark, rows, "index-in"), scratch(spark, "index")
    _ran(stream.writeStream.foreachBatch(index_upserts(path)), path)
    return read_table(spark, path, INDEX)


QUERIES = {
    "late_events": (late_events, STREAM_SQL), "expiry_stream": (expiry_stream, EXPORTS_SQL), "index_stream": (index_stream, INDEX_SQL),
    "live_clients": (live_clients, CLIENTS_SQL), "first_answer": (first_answer, ANSWER_SQL), "saved_records": (saved_records, SAVED_SQL), "receipts_tail": (receipts_tail, RECEIPTS_SQL), "job_stream": (job_stream, STREAM_SQL),
    "queue_depth": (queue_depth, QUEUE_SQL), "live_jobs": (live_jobs, LIVE_SQL), "pending_fetch": (pending_fetch, PENDING_SQL), "latest_failure": (latest_failure, FAILURE_SQL), "claim_next": (claim_next, CLAIM_SQL),
    "reconcile": (reconcile, RECONCILE_SQL), "fail_jobs": (fail_jobs, FAIL_SQL), "job_view": (job_view, VIEW_SQL), "enqueue_renders": (enqueue_renders, ENQUEUE_SQL), "expired_sources": (expired_sources, EXPIRED_SQL),
    "expired_exports": (expired_exports, EXPORTS_SQL), "frame_budget": (frame_budget, FRAMES_SQL), "frame_times": (frame_times, FRAME_TIMES_SQL), "list_library": (list_library, LIBRARY_SQL), "clip_members": (clip_members, MEMBERS_SQL), "library_index": (library_index, INDEX_SQL),
    "source_by_url": (source_by_url, BY_URL_SQL), "clear_clips": (clear_clips, CLEAR_SQL), "append_unique": (append_unique, APPEND_SQL), "caption_langs": (caption_langs, LANGS_SQL), "size_estimate": (size_estimate, SIZE_SQL),
    "dimensions": (dimensions, DIMENSIONS_SQL), "publishable": (publishable, PUBLISHABLE_SQL), "manifest": (manifest, MANIFEST_SQL), "summary": (summary, SUMMARY_SQL), "gallery": (gallery, GALLERY_SQL),
    "folder_sizes": (folder_sizes, FOLDERS_SQL), "listing": (listing, LISTING_SQL), "returned_candidates": (returned_candidates, RETURNED_SQL), "two_cue_agreement": (two_cue_agreement, AGREEMENT_SQL),
}
