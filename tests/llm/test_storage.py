import os
from types import SimpleNamespace

import pytest

from timeloom.llm import storage as S


def test_the_folder_that_the_cluster_names():
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": "hdfs://x/shared/"}.get(key, default)))
    assert S.shared_dir(named) == "hdfs://x/shared"


def test_tables_are_written_and_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "shared_dir", lambda spark: f"file://{tmp_path}")
    names = lambda: sorted(x.split("-")[0] for home in tmp_path.iterdir() for x in os.listdir(home))
    S.release(spark)
    a, b = (S.materialise(spark.range(5), n) for n in ("one", "two"))
    assert names() == ["one", "two"] and a.count() == b.count() == 5
    S.discard(a)
    assert names() == ["two"] and b.count() == 5
    S.release(spark)
    assert os.listdir(tmp_path) == []


def test_a_call_leaves_what_its_result_reads_and_nothing_after_a_failure(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "shared_dir", lambda spark: f"file://{tmp_path}")
    names = lambda: sorted(x.split("-")[0] for home in tmp_path.iterdir() for x in os.listdir(home))
    with S.Workspace(spark) as w:
        one, two = w.write(spark.range(3), "one"), w.write(spark.range(4), "two")
        out = w.result(two.filter("id > 0"), two)
    assert names() == ["two"] and out.count() == 3
    with pytest.raises(RuntimeError), S.Workspace(spark) as w:
        three = w.write(spark.range(3), "three")
        S.materialise(spark.range(3), "inner")
        w.result(three, three)
        raise RuntimeError
    assert names() == ["two"]
    S.release(spark)


def test_a_cluster_without_a_shared_folder_is_an_error():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="shared folder"):
        S.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context))


def test_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    df = spark.range(40).selectExpr("id", "repeat('x', 1000000) AS text").repartition(1)
    rows = S.map_batches(df, sizes, "n long").collect()
    assert len(rows) > 5 and max(r.n for r in rows) < 2 * S.BATCH_BYTES
