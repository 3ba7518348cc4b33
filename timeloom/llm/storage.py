"""Where the operators put intermediate tables so that lost executors can be survived."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: What ``materialise`` wrote and nothing has deleted yet, by path.
_WRITTEN: dict[str, SparkSession] = {}
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a temporary folder of this machine serves local mode
    (tests); on a cluster that is an error, as executors would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.split("[")[0] == "local":
        raise ValueError(f"spark.checkpoint.dir must name a shared folder where the master is {master}")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.TemporaryDirectory(prefix="timeloom-")
        atexit.register(folder.cleanup)
        _LOCAL[app] = folder.name
    return f"file://{_LOCAL[app]}"


def _home(spark: SparkSession) -> str:
    """All tables of an application are in one folder, which one delete removes."""
    return f"{shared_dir(spark)}/timeloom-{spark.sparkContext.applicationId}"


def _workspaces() -> list[Workspace]:
    """The workspaces that are open in this thread, the innermost last."""
    if not hasattr(_OPEN, "stack"):
        _OPEN.stack = []
    return _OPEN.stack


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is cut, and
    a later loss of executors costs no recomputation. ``release`` removes what was written, also by a job that failed. Inside a
    ``Workspace`` the table is one of its own."""
    spark = df.sparkSession
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    if _workspaces():
        _workspaces()[-1].own.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.timeloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for df in tables:
        _forget(df.sparkSession, df.timeloom_path)


def _forget(spark: SparkSession, path: str) -> None:
    _delete(spark, path)
    _WRITTEN.pop(path, None)


def sweep(spark: SparkSession) -> None:
    """Asks Spark's cleaner to drop the shuffle files of jobs that are over, which it else does whenever the driver happens to
    collect its garbage. For operators of many rounds."""
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> int:
    """Delete every table that ``materialise`` wrote in this session. Call after the results are stored."""
    mine = [p for p, s in list(_WRITTEN.items()) if s is spark]
    for path in mine:
        _forget(spark, path)
    if mine and not _WRITTEN:
        _delete(spark, _home(spark))
    return len(mine)


class Workspace:
    """The intermediate tables of one call of an operator: all go at the end, also after a failure, but those that its result reads.

    ``with Workspace(spark) as w: ...; return w.result(df, table, ...)``

    A workspace knows the paths that were written in it. What the result of a nested call reads is lent to the workspace around it, which deletes
    it if it fails or settles, else hands it on. So calls in other threads, or that began before, keep their tables whatever happens here.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.own, self.lent, self.kept = spark, set(), set(), set()

    def __enter__(self) -> Workspace:
        _workspaces().append(self)
        return self

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.adopt(materialise(df, name))

    def adopt(self, table: DataFrame) -> DataFrame:
        """``table``, which a nested call returned, as one of this workspace's own."""
        self.lent.discard(table.timeloom_path)
        self.own.add(table.timeloom_path)
        return table

    def free(self, *tables: DataFrame) -> None:
        self.own -= {t.timeloom_path for t in tables}
        discard(*tables)

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written; all else that was written in this workspace goes."""
        out = self.write(df, name)
        for path in (self.own | self.lent) - {out.timeloom_path}:
            _forget(self.spark, path)
        self.own, self.lent = {out.timeloom_path}, set()
        return out

    def result(self, df: DataFrame, *tables: DataFrame) -> DataFrame:
        """``df``, which reads ``tables``: these stay until ``release``."""
        self.kept |= {t.timeloom_path for t in tables}
        return df

    def __exit__(self, failed, *_) -> None:
        _workspaces().remove(self)
        kept = set() if failed else self.kept | self.lent
        for path in (self.own | self.lent) - kept:
            _forget(self.spark, path)
        if _workspaces():
            _workspaces()[-1].lent |= kept


#: Bytes of an Arrow batch that goes to a Python worker, unless the session has a smaller bound.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes: a worker's memory follows neither row counts nor long texts.

    Spark reads the bound when a query runs, not when it is built, so the session's ``maxBytesPerBatch`` stays lowered to
    ``BATCH_BYTES``; a session with a smaller bound keeps its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(key)
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
