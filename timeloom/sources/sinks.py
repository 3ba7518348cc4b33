"""Sinks: records, receipts, documents."""

from __future__ import annotations

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RECEIPT = "ts timestamp_ntz, tool string, args string, result string, backup string"


def write_text(path: str, text: str) -> None:
    """A small document on the driver's own disk, whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def save_records(records: DataFrame, path: str, keys: list[str]) -> None:
    """Whole-record replacement: the partitions of ``keys`` that ``records`` has are replaced, others stay."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def load_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records by an explicit schema; an absent folder is an empty table."""
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_json(spark: SparkSession, path: str, schema: str, names: str = "*.json") -> DataFrame:
    """Records that are a JSON file each, with ``path``; an absent folder is an empty table, what is no JSON is left out. ``names``: of files."""
    wanted = f"{schema}, path string"
    if not _there(spark, path):
        return spark.createDataFrame([], wanted)
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names).withColumn("path", F.input_file_name())
    return rows.select(F.from_json("value", f"{schema}, broken_ string", {"columnNameOfCorruptRecord": "broken_"}).alias("r"), "path").filter("r.broken_ is null and r is not null").select("r.*", "path").drop("broken_")


@F.pandas_udf(StringType())
def _yaml_to_json(path: pd.Series, text: pd.Series) -> pd.Series:
    import yaml

    def one(at: str, body: str) -> str | None:
        try:
            found = yaml.safe_load(body)
        except yaml.YAMLError as e:
            raise ValueError(f"malformed YAML in {at}: {e}") from None
        return json.dumps(found, default=str) if found else None

    return pd.Series([one(a, b) for a, b in zip(path, text, strict=True)])


def load_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records that are a YAML file each, with ``path``; an absent folder is an empty table, an empty file no row, and what is no YAML
    fails the read, with the file's name."""
    if not _there(spark, path):
        return spark.createDataFrame([], f"{schema}, path string")
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yaml,yml}").withColumn("path", F.input_file_name())
    return rows.withColumn("j_", _yaml_to_json("path", "value")).filter("j_ is not null").select(F.from_json("j_", schema).alias("r"), "path").select("r.*", "path")


def append_receipts(receipts: DataFrame, path: str) -> None:
    receipts.write.mode("append").json(path)


def read_receipts(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The last receipts; lines that are no JSON are skipped."""
    rows = spark.read.schema(f"{RECEIPT}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.filter(F.col("broken").isNull() & F.col("tool").isNotNull()).drop("broken").orderBy(F.desc("ts"), "tool").limit(limit)


def write_manifests(rows: DataFrame, path: str) -> None:
    """A JSON document per ``batch_id``, its clips nested in time: a batch, which is one request's clips, is a group of its own."""
    clips = F.array_sort(F.collect_list(F.struct("source_start_ms", *[c for c in rows.columns if c not in ("source_start_ms", "batch_id")])))
    rows.groupBy("batch_id").agg(clips.alias("clips")).write.mode("overwrite").json(path)


def write_manifest(rows: DataFrame, path: str, batch_id: str) -> None:
    """The manifest of one batch."""
    write_manifests(rows.withColumn("batch_id", F.lit(batch_id)), path)
