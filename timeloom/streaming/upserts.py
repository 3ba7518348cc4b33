"""Tables that a stream keeps up to date: the rows of each batch are merged into the hash buckets that they fall into, and no others.

A table is a folder with ``data/version=<batch>/bucket=<n>`` and a small list for each batch, ``list/batch=<batch>``, of which version holds
each bucket. A batch writes the buckets that it touches anew, then its list; readers follow the newest list, so they see a batch as a
whole or not at all. A batch that is replayed starts from the list before it and writes the same once more, so it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table. Their list is all that the driver holds.
BUCKETS = 64


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of folders ``<prefix><number>`` that hold a finished write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at)]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().removeprefix(prefix)) for p in names if p.getName().startswith(prefix) and fs.exists(done(p, "_SUCCESS")))


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> version, by the newest list, or the newest one before a batch."""
    lists = [n for n in _folders(spark, f"{path}/list", "batch=") if before is None or n < before]
    if not lists:
        return {}
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").json(f"{path}/list/batch={lists[-1]}").collect()}


def _read(spark: SparkSession, path: str, schema: str, held: dict[int, int]) -> DataFrame:
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())])


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as of its newest batch; empty before the first one."""
    return _read(spark, path, schema, _versions(spark, path))


def upsert(path: str, keys: list[str], schema: str, merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``. ``merge`` makes the rows of keys from all their rows, old and new, and may see rows more than once."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        columns = spark.createDataFrame([], schema).columns
        new = batch.select(*columns).withColumn("bucket", bucket).persist()
        try:
            touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
            if not touched:
                return
            held = _versions(spark, path, before=batch_id)
            old = _read(spark, path, schema, {b: held[b] for b in touched if b in held})
            merged = merge(old.unionByName(new.drop("bucket"))).select(*columns).withColumn("bucket", bucket)
            # all touched buckets are written, also if they should come out empty
            merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={batch_id}")
            there = set(_buckets(spark, f"{path}/data/version={batch_id}"))
            listed = {b: v for b, v in held.items() if b not in touched} | {b: batch_id for b in touched if b in there}
            spark.createDataFrame(sorted(listed.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{path}/list/batch={batch_id}")
        finally:
            new.unpersist()

    return apply


def _buckets(spark: SparkSession, path: str) -> list[int]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes versions that neither the newest list names nor the one before it, from which a replay of the newest batch starts; returns
    how many. Readers of older lists must be done."""
    lists = _folders(spark, f"{path}/list", "batch=")
    kept = {v for n in lists[-2:] for v in _versions(spark, path, before=n + 1).values()}
    gone = [f"{path}/list/batch={n}" for n in lists[:-2]] + [f"{path}/data/version={v}" for v in _folders(spark, f"{path}/data", "version=") if v not in kept and lists and v < lists[-1]]
    for folder in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return sum("/data/" in g for g in gone)


INDEX = "entity_id string, kind string, project string"


def first_project(rows: DataFrame) -> DataFrame:
    return rows.groupBy("entity_id", "kind").agg(F.min("project").alias("project"))


def index_upserts(path: str) -> Callable[[DataFrame, int], None]:
    """``library_index``, kept up to date: batches are its rows (entity_id, kind, project)."""
    return upsert(path, ["entity_id", "kind"], INDEX, first_project)


CAPTIONS = "source_id string, path string, kind string, raw string"


def preferred_file(rows: DataFrame) -> DataFrame:
    """Of each source the word-timed file, else the cue file, the first by path."""
    return rows.groupBy("source_id").agg(F.min_by(F.struct("path", "kind", "raw"), F.struct((F.col("kind") != "json3").alias("cues"), "path")).alias("f")).select("source_id", "f.*")


def caption_stream(spark: SparkSession, folder: str, delay: str = "1 day", **options: str) -> DataFrame:
    """Caption files of a folder per source, as they arrive: (source_id, path, kind, raw). A file that is found again under its path
    within ``delay`` of its time is not read again."""
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json3,vtt}").options(**options)
    files = reader.load(folder).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("seen"))
    files = files.withWatermark("seen", delay).dropDuplicatesWithinWatermark(["path"])
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("source_id"), "path", F.regexp_extract("path", "\\.([a-z0-9]+)$", 1).alias("kind"), "raw")


def caption_upserts(path: str) -> Callable[[DataFrame, int], None]:
    """The file to read of each source, kept up to date: a word-timed file that comes late takes the place of a cue file."""
    return upsert(path, ["source_id"], CAPTIONS, preferred_file)
