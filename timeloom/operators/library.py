"""Library records: sources, clips, exports, projects; what is published from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def list_projects(projects: DataFrame, sources: DataFrame, clips: DataFrame, exports: DataFrame) -> DataFrame:
    """Projects with the number of their sources, clips and exports. Counts are joined, not rows."""
    out = projects
    for name, rows in (("n_sources", sources), ("n_clips", clips), ("n_exports", exports)):
        out = out.join(rows.groupBy("project").agg(F.count("*").alias(name)), "project", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def clip_members(clips: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates of each clip in time: (clip_id, position, ...). Members that are gone are left out."""
    each = clips.select("clip_id", F.explode("members").alias("candidate_id"))
    met = each.join(candidates, "candidate_id")
    w = Window.partitionBy("clip_id").orderBy("start_ms", "end_ms", "candidate_id")
    return met.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))


def library_index(**kinds: DataFrame) -> DataFrame:
    """(entity_id, kind, project) of all records; rebuilt, never kept. Of an id that occurs more than once the first project."""
    out = None
    for kind, rows in kinds.items():
        part = rows.select(F.col(f"{kind}_id").cast("string").alias("entity_id"), F.lit(kind).alias("kind"), "project")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("entity_id", "kind").agg(F.min("project").alias("project"))


def source_by_url(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """``requests`` (project, url) with the id of the source that was fetched before; null for a new one. Of several ``sources``
    (project, url, path, source_id) it is the first by the path of its record, in the order of paths as texts."""
    known = sources.groupBy("project", "url").agg(F.min_by("source_id", F.struct("path", "source_id")).alias("source_id"))
    return requests.join(known, ["project", "url"], "left")


def clear_clips(clips: DataFrame, replanned: DataFrame) -> DataFrame:
    """Clips without the definitions of replanned sources; what is rendered stays."""
    gone = replanned.select(F.col("source_id").alias("g_source")).distinct().withColumn("g_", F.lit(True))
    rows = clips.join(gone, F.col("source_id") == F.col("g_source"), "left")
    return rows.filter(F.col("rendered") | F.col("g_").isNull()).select(*clips.columns)


def append_unique(records: DataFrame, column: str, added: DataFrame, key: str) -> DataFrame:
    """``records`` with the values of ``added`` (key, value) at the end of an array column, each once."""
    more = added.groupBy(key).agg(F.sort_array(F.collect_set("value")).alias("more_"))
    return records.join(more, key, "left").withColumn(column, F.array_union(column, F.coalesce("more_", F.array().cast(records.schema[column].dataType)))).drop("more_")


def preferred(*ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Union with precedence: for each key the row of the first table that has it."""
    out = None
    for i, rows in enumerate(ranked):
        part = rows.withColumn("rank_", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in ranked[0].columns if c not in keys]
    best = out.groupBy(*keys).agg(F.min_by(F.struct(*rest), "rank_").alias("b_"))
    return best.select(*keys, "b_.*")


def caption_tracks(tracks: DataFrame) -> DataFrame:
    """English tracks of a source, (source_id, track, kind); those made by hand win over automatic ones."""
    english = tracks.filter(F.lower("track").startswith("en")).select("source_id", "track", "kind")
    return preferred(english.filter("kind = 'manual'"), english.filter("kind = 'auto'"), keys=["source_id", "track"])


def size_estimate(formats: DataFrame, max_height: int) -> DataFrame:
    """Bytes of a download: the best picture up to a height and the best sound alone; 256,000 a second if nothing is known.

    ``formats``: (source_id, duration_s, filesize, approx, tbr, height, vcodec, acodec), 0 or null for unknown.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    size = F.coalesce(some("filesize"), some("approx"), F.floor(some("tbr") * 125 * some("duration_s")).cast("bigint"), F.lit(0))
    video, audio = F.coalesce("vcodec", F.lit("none")) != "none", F.coalesce("acodec", F.lit("none")) != "none"
    best = lambda cond: F.coalesce(F.max(F.when(cond, size)), F.lit(0))
    out = formats.groupBy("source_id", "duration_s").agg((best(video & (F.coalesce("height", F.lit(0)) > 0) & (F.col("height") <= max_height)) + best(~video & audio)).alias("bytes"))
    return out.withColumn("bytes", F.when(F.col("bytes") > 0, F.col("bytes")).otherwise(F.coalesce("duration_s", F.lit(0)) * 256_000).cast("bigint"))


def dimensions(frames: DataFrame) -> DataFrame:
    """What a frame says of its size wins over the header."""
    w, h = F.coalesce("frame_w", "header_w"), F.coalesce("frame_h", "header_h")
    width, height = T.clamped(w, h)
    return frames.select("source_id", width.alias("width"), height.alias("height"))


def publishable(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requested jobs with ``error_code``: unknown, not done, or without a file; null where the clip can be published."""
    j = jobs.select(F.col("job_id").alias("j_job"), "status", "output_path", "clip_id", "source_id", "duration_ms")
    code = F.when(F.col("j_job").isNull(), F.lit("unknown_job")).when(F.col("status") != "done", F.lit("not_done")).when(F.coalesce("output_path", F.lit("")) == "", F.lit("no_file"))
    return requests.join(j, F.col("job_id") == F.col("j_job"), "left").withColumn("error_code", code).drop("j_job")


def manifest(done: DataFrame, members: DataFrame, sources: DataFrame, base_url: str, batch_id: str) -> DataFrame:
    """A row per published clip with its bounds, its best member's reason, links, and what it was built from as JSON.

    ``done``: (job_id, clip_id, source_id, label, duration_ms); ``members``: of ``clip_members``.
    """
    part = F.struct("start_ms", "end_ms", "candidate_id")
    built = members.groupBy("clip_id").agg(
        F.min("start_ms").alias("source_start_ms"), F.max("end_ms").alias("source_end_ms"), F.max("score").alias("score"),
        F.min_by("reason", F.struct((-F.col("score")).alias("s"), "start_ms", "end_ms", "candidate_id")).alias("reason"),
        F.to_json(F.transform(F.array_sort(F.collect_list(part)), lambda x: F.struct(x["candidate_id"].alias("candidate_id"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms")))).alias("built_from"),
    )
    rows = done.join(built, "clip_id").join(sources.select("source_id", "url"), "source_id")
    return rows.select(
        "job_id", "clip_id", "source_id", "label", "duration_ms", "source_start_ms", "source_end_ms", "score", "reason", "built_from",
        F.concat(F.lit(f"{base_url}/{batch_id}/"), "clip_id", F.lit(".mp4")).alias("link"), T.deep_link(F.col("url"), F.col("source_start_ms")).alias("source_link"))


def summary(rows: DataFrame) -> DataFrame:
    """A text per source that lists its clips in time."""
    w = Window.partitionBy("source_id").orderBy("source_start_ms", "clip_id", "job_id")
    n = F.row_number().over(w)
    head = F.format_string("%d. [%s · %ds]  %s", n, F.col("label"), F.floor((F.col("duration_ms") + 500) / 1000), F.col("link"))
    body = F.concat(head, F.lit("\n   source "), T.hhmmss(F.col("source_start_ms")), F.lit("–"), T.hhmmss(F.col("source_end_ms")), F.lit(" · "), F.col("source_link"))
    body = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(body, F.lit('\n   "'), "reason", F.lit('"'))).otherwise(body)
    each = rows.select("source_id", n.alias("n_"), body.alias("line_"))
    return each.groupBy("source_id").agg(F.count("*").alias("n_clips"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_", "line_"))), lambda x: x["line_"]), "\n").alias("summary"))


def gallery_cards(rows: DataFrame) -> DataFrame:
    """An HTML card per clip, with all text escaped."""
    e = lambda c: T.html_escape(F.col(c))
    card = F.concat(F.lit('<article><a href="'), e("link"), F.lit('">'), e("label"), F.lit("</a><p>"), T.html_escape(F.coalesce("reason", F.lit(""))), F.lit('</p><a href="'), e("source_link"), F.lit('">source</a></article>'))
    return rows.select("clip_id", card.alias("card"))


def listing(entries: DataFrame) -> DataFrame:
    """Folder entries (folder, name, is_dir, size) with their place: folders first, then by name in lower case."""
    w = Window.partitionBy("folder").orderBy(~F.col("is_dir"), F.lower("name"), "name")
    return entries.select("folder", "name", (F.row_number().over(w)).cast("bigint").alias("place"), F.when(~F.col("is_dir"), T.human_size(F.col("size"))).alias("size_text"))


def folder_sizes(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.col("is_dir")).groupBy("folder").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_files"))


def capped(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key, with how many were returned, how many there are, and whether that cut some off."""
    w = Window.partitionBy(*keys)
    out = rows.withColumns({"n_": F.row_number().over(w.orderBy(*order)), "total_available": F.count("*").over(w)}).filter(F.col("n_") <= most).drop("n_")
    return out.withColumns({"returned": F.least("total_available", F.lit(most)).cast("bigint"), "truncated": F.col("total_available") > most})


def agreement(spikes: DataFrame, markers: DataFrame, keys: DataFrame) -> DataFrame:
    """Whether a clip has both an energy spike and a transcript marker."""
    a = spikes.select("clip_id").distinct().withColumn("has_spike", F.lit(True))
    b = markers.select("clip_id").distinct().withColumn("has_marker", F.lit(True))
    out = keys.join(a, "clip_id", "left").join(b, "clip_id", "left").fillna(False, ["has_spike", "has_marker"])
    return out.withColumn("two_cues", F.col("has_spike") & F.col("has_marker"))
