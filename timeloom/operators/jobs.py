"""Job tables: states, queue, lifecycle. Times are epoch milliseconds; ``now`` is a parameter. Nothing is changed in place: each
function returns the table, or the rows, that follow from its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KNOBS, REFRAME_MODES, Knobs
from .scan import carried

LIVE = ("queued", "running")
#: Requests of a source that are summed up in one task.
REQUESTS = 4096
INTERRUPTED = "Interrupted by a restart."


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("project").agg(F.count(F.when(F.col("status").isin(*LIVE), F.lit(1))).alias("depth"), F.count("*").alias("n_jobs"))


def live_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(*LIVE)).groupBy("source_id").agg(F.count("*").alias("n_live"))


def _first(jobs: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``; ranks are cut to one row before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return jobs.withColumn("first_", F.row_number().over(w)).filter("first_ = 1").drop("first_")


def pending_fetch(jobs: DataFrame) -> DataFrame:
    """The oldest download of each source that is queued or runs."""
    return _first(jobs.filter((F.col("kind") == "fetch") & F.col("status").isin(*LIVE)), ["source_id"], F.col("created_ms"), F.col("job_id"))


def latest_failure(jobs: DataFrame) -> DataFrame:
    """The last failed download of each source."""
    return _first(jobs.filter((F.col("kind") == "fetch") & (F.col("status") == "failed")), ["source_id"], F.col("finished_ms").desc(), F.col("job_id"))


def claim_next(jobs: DataFrame, now_ms: int, keys: tuple[str, ...] = ("project",)) -> DataFrame:
    """The whole table after the oldest queued job of each key started. A batch transition: of concurrent ones only one may be written."""
    w = Window.partitionBy(*keys, "status").orderBy("created_ms", "job_id")
    mine = (F.col("status") == "queued") & (F.row_number().over(w) == 1)
    rows = jobs.withColumn("mine_", mine)
    return rows.withColumns({"started_ms": F.when(F.col("mine_"), F.lit(now_ms)).otherwise(F.col("started_ms")), "status": F.when(F.col("mine_"), F.lit("running")).otherwise(F.col("status"))}).drop("mine_")


def reconcile(jobs: DataFrame, now_ms: int) -> DataFrame:
    """After a restart nothing finishes what ran: running jobs have failed."""
    died = F.col("status") == "running"
    return jobs.withColumns({"error": F.when(died, F.lit(INTERRUPTED)).otherwise(F.col("error")), "finished_ms": F.when(died, F.lit(now_ms)).otherwise(F.col("finished_ms")), "status": F.when(died, F.lit("failed")).otherwise(F.col("status"))})


def failed(jobs: DataFrame, ids: DataFrame, error: str, now_ms: int) -> DataFrame:
    """The table after the jobs of ``ids`` failed."""
    hit = ids.select("job_id").distinct().withColumn("hit_", F.lit(True))
    rows = jobs.join(hit, "job_id", "left")
    bad = F.coalesce("hit_", F.lit(False))
    return rows.withColumns({"status": F.when(bad, F.lit("failed")).otherwise(F.col("status")), "error": F.when(bad, F.lit(error)).otherwise(F.col("error")), "finished_ms": F.when(bad, F.lit(now_ms)).otherwise(F.col("finished_ms"))}).drop("hit_")


def job_view(jobs: DataFrame, now_ms: int) -> DataFrame:
    """``elapsed_ms``: so far for running jobs, in all for finished ones, else 0."""
    ran = F.when((F.col("status") == "running") & F.col("started_ms").isNotNull(), F.lit(now_ms) - F.col("started_ms"))
    ran = ran.when(F.col("finished_ms").isNotNull() & F.col("started_ms").isNotNull(), F.col("finished_ms") - F.col("started_ms"))
    return jobs.withColumn("elapsed_ms", ran.otherwise(F.lit(0)).cast("bigint"))


def enqueue_renders(requests: DataFrame, clips: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (clip_id, reframe) with ``error_code``, or null where the job may be queued: the mode, the clip, its members, and a
    video that is there or on its way."""
    pending = pending_fetch(jobs).select(F.col("source_id").alias("p_source"), F.lit(True).alias("p_"))
    c = clips.select(F.col("clip_id").alias("c_clip"), "source_id", "n_members")
    s = sources.select(F.col("source_id").alias("s_source"), "has_video")
    rows = requests.join(c, F.col("clip_id") == F.col("c_clip"), "left").join(s, F.col("source_id") == F.col("s_source"), "left").join(pending, F.col("source_id") == F.col("p_source"), "left")
    there = F.coalesce("has_video", F.lit(False)) | F.coalesce("p_", F.lit(False))
    code = (
        F.when(~F.col("reframe").isin(*REFRAME_MODES), F.lit("unknown_reframe")).when(F.col("c_clip").isNull(), F.lit("unknown_clip"))
        .when(F.coalesce("n_members", F.lit(0)) == 0, F.lit("no_members")).when(~there, F.lit("no_video"))
    )
    return rows.select(*requests.columns, code.alias("error_code"))


def expired_sources(sources: DataFrame, jobs: DataFrame, now_ms: int, knobs: Knobs = KNOBS) -> DataFrame:
    """Sources whose video is past its age and that no live job needs."""
    old = sources.filter(F.col("has_video") & (F.col("fetched_ms") < now_ms - knobs.source_age_hours * 3_600_000))
    return old.join(jobs.filter(F.col("status").isin(*LIVE)).select("source_id"), "source_id", "left_anti")


def expired_exports(exports: DataFrame, now_ms: int) -> DataFrame:
    return exports.filter(F.col("created_ms") + F.col("ttl_hours") * 3_600_000 < now_ms)


def live_clients(clients: DataFrame, now_ms: int, ttl_ms: int, most: int = 256) -> DataFrame:
    """Clients (client_id, created_ms, is_static) that are kept: the static ones, and of the others that are within their age the
    newest, ``most`` with the static ones. Of equal times the larger id is the newer."""
    fresh = clients.filter(~F.col("is_static") & (now_ms - F.col("created_ms") <= ttl_ms))
    static = clients.filter("is_static")
    room = F.broadcast(static.agg(F.greatest(F.lit(0), most - F.count("*")).alias("room_")))
    newest = fresh.orderBy(F.desc("created_ms"), F.desc("client_id")).limit(most)
    # at most ``most`` rows are numbered
    newest = newest.withColumn("r_", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("created_ms"), F.desc("client_id"))))
    return static.unionByName(newest.join(room, F.col("r_") <= F.col("room_")).select(*clients.columns))


def first_answer(attempts: DataFrame) -> DataFrame:
    """Of each source's attempts (source_id, attempt, answer, n_found) the first that found something, else the last: (source_id, attempt, answer, n_found)."""
    found = F.coalesce(F.col("n_found") > 0, F.lit(False))
    best = F.struct("attempt", "answer", "n_found")
    picked = attempts.groupBy("source_id").agg(F.min_by(F.when(found, best), F.when(found, F.col("attempt"))).alias("a"), F.max_by(best, "attempt").alias("b"))
    return picked.select("source_id", F.coalesce("a", "b").alias("x")).select("source_id", "x.*")


def disk_needed(estimated: Column) -> Column:
    """Bytes that a download needs: twice the estimate, and 300 MiB."""
    return (2 * estimated + 300 * 1024 * 1024).cast("bigint")


def frame_times(usage: DataFrame) -> DataFrame:
    """When the frames that a request took are: its start and a frame's length further each, to the nearest 10 ms: (source_id, seq, i, t_ms)."""
    rate = F.greatest(F.lit(100), F.least(F.col("fps_m"), F.lit(4000)))
    each = usage.withColumn("rate_", rate).filter("take > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("take") - 1)))
    at = F.expr("((start_ms * rate_ + i * 1000000 + 5 * rate_) div (10 * rate_)) * 10")
    return each.select("source_id", "seq", "i", at.cast("bigint").alias("t_ms"))


def frame_usage(requests: DataFrame, knobs: Knobs = KNOBS) -> DataFrame:
    """Frames that each request of a source takes of its budget, in order: (wanted, take, used).

    ``requests``: (source_id, seq, start_ms, end_ms, fps_m), the rate in frames per 1000 s. A request takes the least of what it
    wants, the cap per call, and what is left; so what is used is the running sum of the first two, cut at the budget.
    """
    rate = F.greatest(F.lit(100), F.least(F.col("fps_m"), F.lit(4000)))
    wanted = F.ceil((F.col("end_ms") - F.col("start_ms")) * rate / 1_000_000)
    rows = requests.withColumn("wanted", wanted.cast("bigint")).withColumn("asked_", F.least("wanted", F.lit(knobs.frames_per_call)))
    rows = carried(rows, ["source_id"], ["seq"], REQUESTS, sums={"before_": F.col("asked_")})
    left = lambda c: F.least(c, F.lit(knobs.frame_budget)).cast("bigint")
    rows = rows.withColumn("used", left(F.col("before_") + F.col("asked_")))
    return rows.withColumn("take", F.col("used") - left(F.col("before_"))).drop("asked_", "before_")
