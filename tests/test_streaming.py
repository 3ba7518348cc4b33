import os
import random
import time

from pyspark.sql import functions as F

from timeloom.operators.jobs import expired_exports
from timeloom.sources.captions import read_captions
from timeloom.streaming import expiry as E
from timeloom.streaming import stateful as S
from timeloom.streaming import upserts as U


def run(df, mode, name, spark, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_transitions(spark, tmp_path):
    rows = [(1, "queued", 1), (1, "running", 2), (1, "done", 3), (1, "running", 4), (2, "done", 1), (2, "queued", 2), (2, "failed", 3)]
    spark.createDataFrame(rows, "job_id long, status string, t long").selectExpr("job_id", "status", "timestamp_seconds(t) AS ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id long, status string, ts timestamp").parquet(str(tmp_path / "in"))
    out = run(S.job_transitions(stream), "append", "transitions", spark, tmp_path)
    assert sorted((r.job_id, r.ts.second, r.new, r.accepted) for r in out) == [(1, 1, "queued", True), (1, 2, "running", True), (1, 3, "done", True), (1, 4, "running", False), (2, 1, "done", False), (2, 2, "queued", True), (2, 3, "failed", True)]


def test_chunk_counts_equal_the_batch(spark, tmp_path):
    rows = [(s, i, i * 7_000, i * 7_000 + 500, "w") for s in (1, 2) for i in range(200)]
    words = spark.createDataFrame(rows, "source_id long, i long, start_ms long, end_ms long, w string").selectExpr("*", "timestamp_millis(start_ms) AS ts")
    words.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(words.schema).parquet(str(tmp_path / "in"))
    got = {}
    for r in run(S.chunk_counts(stream), "complete", "chunks", spark, tmp_path):
        got[r.source_id, r.chunk] = got.get((r.source_id, r.chunk), 0) + r.n_words
    want = {(s, c): sum(1 for i in range(200) if i * 7_000 + 500 > c * 480_000 and i * 7_000 < c * 480_000 + 600_000) for s in (1, 2) for c in range(3)}
    assert got == {k: v for k, v in want.items() if v}


def stream_of(spark, folder, schema, batches, stamp="ts"):
    """A stream that gets each of ``batches`` (rows with seconds in the last column) as a batch of its own."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn(stamp, F.timestamp_seconds("t")).drop("t").coalesce(1)
        df.write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def lifecycle(events):
    """Transitions of jobs by a loop over all events in order."""
    now, out = {}, []
    for job, status, t in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        ok = (now.get(job, ""), status) in S.MOVES
        out.append((job, now.get(job, ""), status, ok, t))
        now[job] = status if ok else now.get(job, "")
    return sorted(out)


def test_events_of_later_batches_take_their_place(spark, tmp_path):
    rnd = random.Random(3)
    events = [(job, status, 1000 + job * 7 + i * rnd.choice([1, 60, 300])) for job in range(40) for i, status in enumerate(rnd.choice([["queued", "running", "done", "running"], ["running", "queued", "failed"], ["queued", "done", "queued"]]))]
    # each event arrives in the batch of a time up to ten minutes after its own
    arrival = sorted((e[2] + rnd.randrange(500), e) for e in events)
    n = len(arrival)
    batches = [[e for _, e in arrival[i * n // 6 : (i + 1) * n // 6]] for i in range(6)]
    schema = "job_id long, status string, t long"
    stream = stream_of(spark, str(tmp_path / "in"), schema, [*batches, [(-1, "queued", 10**6)], [(-1, "queued", 10**6 + 1)]])
    out = run(S.job_lifecycle(stream, "20 minutes"), "append", "lifecycle", spark, tmp_path)
    got = sorted((r.job_id, r.old, r.new, r.accepted, int(r.ts.timestamp())) for r in out if r.job_id >= 0)
    assert got == lifecycle(events)


def test_ended_jobs_are_forgotten(spark, tmp_path):
    day = 86_400
    batches = [[(1, "queued", 10), (1, "failed", 20), (2, "queued", 10)], [(9, "queued", 1000)], [(9, "queued", 3 * day)], [(9, "queued", 3 * day + 5), (1, "queued", 3 * day + 10), (2, "running", 3 * day + 10)], [(9, "queued", 9 * day)], [(9, "queued", 9 * day + 1)]]
    stream = stream_of(spark, str(tmp_path / "in"), "job_id long, status string, t long", batches)
    out = run(S.job_lifecycle(stream, "1 minute"), "append", "forgotten", spark, tmp_path)
    told = {(r.job_id, r.old, r.new, r.accepted) for r in out if r.job_id < 9}
    assert told == {(1, "", "queued", True), (1, "queued", "failed", True), (2, "", "queued", True), (2, "queued", "running", True)}
    assert sorted(r.old for r in out if r.job_id == 1 and r.new == "queued") == ["", ""]


def test_streamed_expiries_equal_the_batch(spark, tmp_path):
    rnd = random.Random(4)
    hour = 3600
    first = [(i, i * hour * 1000, rnd.randrange(1, 30), i * hour) for i in range(50)]
    again = [(i, (50 + i) * hour * 1000, 5, (50 + i) * hour) for i in range(0, 50, 3)]
    batches = [first, again, [(-1, 0, 10**6, 120 * hour + 1800)], [(-1, 0, 10**6, 120 * hour + 1801)]]
    stream = stream_of(spark, str(tmp_path / "in"), "export_id long, created_ms long, ttl_hours long, t long", batches)
    with E.rocks(spark):
        out = run(E.expiries(stream), "append", "expiries", spark, tmp_path)
    newest = {r[0]: r for r in first} | {r[0]: r for r in again}
    gone_between = {i for i, c, ttl, _ in first if i % 3 == 0 and c + ttl * hour * 1000 < 49 * hour * 1000}
    exports = spark.createDataFrame([r[:3] for r in newest.values()], "export_id long, created_ms long, ttl_hours long")
    want = {(r.export_id, r.created_ms + r.ttl_hours * hour * 1000) for r in expired_exports(exports, (120 * hour + 1800) * 1000).collect()}
    got = {(r.export_id, r.expires_ms) for r in out}
    assert want <= got and {i for i, _ in got - want} <= gone_between


def test_an_index_equals_its_rebuild_after_each_batch(spark, tmp_path):
    rnd, path = random.Random(5), str(tmp_path / "index")
    apply = U.index_upserts(path)
    assert U.read_table(spark, path, U.INDEX).count() == 0
    seen = []
    for batch_id in range(10):
        rows = [(str(rnd.randrange(40)), rnd.choice(["clip", "source"]), f"p{rnd.randrange(9)}") for _ in range(rnd.choice([0, 1, 3, 30]))]
        seen += rows
        batch = spark.createDataFrame(rows, U.INDEX)
        for _ in range(2 if batch_id % 3 == 0 else 1):
            apply(batch, batch_id)
        want = {(e, k): min(p for a, b, p in seen if (a, b) == (e, k)) for e, k, _ in seen}
        assert {(r.entity_id, r.kind): r.project for r in U.read_table(spark, path, U.INDEX).collect()} == want
    written = os.listdir(f"{path}/data/version={max(int(x.split('=')[1]) for x in os.listdir(path + '/data'))}")
    assert sum(x.startswith("bucket=") for x in written) <= 30
    # old versions go, what is read stays, and the last batch can still be replayed
    U.vacuum(spark, path)
    assert len(os.listdir(f"{path}/list")) == 2
    for _ in range(2):
        assert {(r.entity_id, r.kind): r.project for r in U.read_table(spark, path, U.INDEX).collect()} == want
        apply(batch, batch_id)
    more = [("new", "clip", "p0")]
    apply(spark.createDataFrame(more, U.INDEX), 10)
    assert U.read_table(spark, path, U.INDEX).filter("entity_id = 'new'").count() == 1 and U.vacuum(spark, path) >= 0


def test_a_word_timed_file_that_comes_late(spark, tmp_path):
    folder, path = tmp_path / "captions", str(tmp_path / "kept")

    def put(source, name):
        (folder / source).mkdir(parents=True, exist_ok=True)
        (folder / source / name).write_text(f"{source} {name}")

    def ingest():
        q = U.caption_stream(spark, str(folder)).writeStream.foreachBatch(U.caption_upserts(path)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return {r.source_id: r.raw for r in U.read_table(spark, path, U.CAPTIONS).collect()}

    put("a", "x.en.vtt"), put("b", "x.json3"), put("a", "x.mp4")
    assert ingest() == {"a": "a x.en.vtt", "b": "b x.json3"}
    put("a", "y.json3"), put("b", "a.vtt"), put("c", "b.vtt")
    assert ingest() == {"a": "a y.json3", "b": "b x.json3", "c": "c b.vtt"}
    put("c", "a.vtt"), put("b", "a.json3")
    want = {r.source_id: r.raw for r in read_captions(spark, str(folder)).collect()}
    assert ingest() == want == {"a": "a y.json3", "b": "b a.json3", "c": "c a.vtt"}


def test_expiries_before_1970(spark, tmp_path):
    """A watermark starts at 1970; exports and expiries before that are told like any other, in their order."""
    hour, years = 3600, 365 * 86_400
    at = [-1900 * years, -555 * years, -40 * years, -3 * hour, -hour, 0, 5 * hour]
    first = [(i, t * 1000, 2, t) for i, t in enumerate(at)]
    batches = [first[:4], [*first[4:], (3, 6 * hour * 1000, 1, 6 * hour)], [(-1, 0, 10**6, 6 * hour + 60)], [(-1, 0, 10**6, 6 * hour + 61)]]
    stream = stream_of(spark, str(tmp_path / "in"), "export_id long, created_ms long, ttl_hours long, t long", batches)
    with E.rocks(spark):
        out = run(E.expiries(stream), "append", "expiries_before_1970", spark, tmp_path)
    assert {(r.export_id, r.expires_ms) for r in out} == {(i, (t + 2 * hour) * 1000) for i, t in enumerate(at) if i not in (3, 6)}
    assert len(out) == 5
