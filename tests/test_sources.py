import json

import pytest

from timeloom.sources import captions as C
from timeloom.sources import logs as L
from timeloom.sources import sinks as K

WORDS = {"events": [
    {"tStartMs": 0, "wWinId": 1},
    {"tStartMs": 500, "dDurationMs": 2000, "segs": [{"utf8": "Raise"}, {"utf8": " money", "tOffsetMs": 320}, {"utf8": " \n", "tOffsetMs": 400}, {"utf8": " now.", "tOffsetMs": 900}]},
    {"tStartMs": 5200, "dDurationMs": 0, "segs": [{"utf8": "Exactly."}]},
    {"tStartMs": 5230, "dDurationMs": 900, "segs": [{"utf8": "Exactly."}]},
    {"tStartMs": 80000, "dDurationMs": 900, "segs": [{"utf8": "Exactly."}]},
]}
CUES = """WEBVTT

NOTE x

1
00:00:01.000 --> 00:00:02.500 align:start
<i>Hello &amp; welcome</i>
to   this
2
00:00:02.600 --> 00:00:03.000
Exactly.

00:01:20.000 --> 00:01:21.000
Exactly.
00:01:21.100 --> 00:01:22.000
Exactly. More
00:01:30,000 --> 00:01:31.000

"""
ROLLING = """WEBVTT

00:00:01.000 --> 00:00:03.000
old line
nobody<00:00:01.500><c> tells</c><00:00:02.000><c> you this</c>

00:00:03.000 --> 00:00:03.010
nobody tells you this

00:00:03.010 --> 00:00:05.000
nobody tells you this
funding<00:00:03.600><c> dies</c>
"""


def test_word_timed(spark):
    rows = C.json3_words(spark.createDataFrame([(1, json.dumps(WORDS))], "source_id long, raw string")).orderBy("start_ms").collect()
    assert [(r.w, r.start_ms, r.end_ms) for r in rows] == [("Raise", 500, 820), ("money", 820, 1400), ("now.", 1400, 2500), ("Exactly.", 5200, 5320), ("Exactly.", 80000, 80900)]


def test_cues_without_separators(spark):
    rows = C.vtt_segments(C.vtt_cues(spark.createDataFrame([(1, CUES.replace("\n", "\r\n"))], "source_id long, raw string"))).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in rows] == [(1000, 2500, "Hello & welcome to this"), (2600, 3000, "Exactly."), (81100, 82000, "Exactly. More")]


def test_rolling_words(spark):
    rows = C.vtt_words(C.vtt_cues(spark.createDataFrame([(1, ROLLING)], "source_id long, raw string"))).orderBy("start_ms").collect()
    assert [(r.w, r.start_ms, r.end_ms) for r in rows] == [("nobody", 1000, 1500), ("tells", 1500, 2000), ("you", 2000, 2500), ("this", 2500, 3000), ("funding", 3010, 3600), ("dies", 3600, 5000)]


def test_files_and_transcript(spark, tmp_path):
    for name, files in {"a": {"x.json3": json.dumps(WORDS), "x.vtt": CUES}, "b": {"y.vtt": CUES}, "c": {"z.vtt": ROLLING}}.items():
        (tmp_path / name).mkdir()
        for f, text in files.items():
            (tmp_path / name / f).write_text(text)
    files = C.read_captions(spark, str(tmp_path))
    assert {r.source_id: r.kind for r in files.collect()} == {"a": "json3", "b": "vtt", "c": "vtt"}
    words, segments = C.transcript(files)
    texts = {}
    for r in segments.orderBy("start_ms").collect():
        texts.setdefault(r.source_id, []).append(r.text)
    assert texts["a"][0] == "Raise money now." and texts["b"][1] == "Exactly." and texts["c"] == ["nobody tells you this funding dies"]
    assert {r.source_id for r in words.select("source_id").distinct().collect()} == {"a", "c"}


def test_silence_pairs(spark):
    lines = ["silence_end: 1", "silence_start: -0.5", "silence_start: 2", "x", "silence_end: 3.25 | d", "silence_start: 9"]
    rows = L.silence_log(spark.createDataFrame([(1, i, x, 10_000, 20_000) for i, x in enumerate(lines)], "clip_id long, pos int, line string, span_start_ms long, span_end_ms long"))
    assert sorted((r.sil_start, r.sil_end) for r in rows.collect()) == [(12000, 13250), (19000, 20000)]


def test_probe_tracks(spark):
    raw = json.dumps({"title": "t", "subtitles": {"en": []}, "automatic_captions": {"en": [], "fr": []}})
    got = {(r.track, r.kind) for r in L.probe_tracks(spark.createDataFrame([(1, raw), (2, "x")], "source_id long, raw string")).collect()}
    assert got == {("en", "manual"), ("en", "auto"), ("fr", "auto")}


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "clips")
    schema = "clip_id long, score double, project string"
    assert K.load_records(spark, at, schema).count() == 0
    K.save_records(spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], schema), at, ["project"])
    K.save_records(spark.createDataFrame([(3, 3.0, "b")], schema), at, ["project"])
    assert sorted((r.clip_id, r.project) for r in K.load_records(spark, at, schema).collect()) == [(1, "a"), (3, "b")]
    log = str(tmp_path / "receipts")
    for i in range(3):
        K.append_receipts(spark.sql(f"SELECT TIMESTAMP_NTZ'2024-01-0{i + 1}' AS ts, 'tool{i}' AS tool, '' AS args, 'ok' AS result, '' AS backup"), log)
    (tmp_path / "receipts" / "bad.json").write_text("{not json\n")
    assert [r.tool for r in K.read_receipts(spark, log, 2).collect()] == ["tool2", "tool1"]
    K.write_text(str(tmp_path / "d" / "x.txt"), "one")
    K.write_text(str(tmp_path / "d" / "x.txt"), "two")
    assert [p.read_text() for p in (tmp_path / "d").iterdir()] == ["two"]
    with pytest.raises(TypeError):
        K.write_text(str(tmp_path / "d" / "x.txt"), 5)
    assert [p.read_text() for p in (tmp_path / "d").iterdir()] == ["two"]
    K.write_manifest(spark.createDataFrame([(5, "b"), (2, "a")], "source_start_ms long, clip string"), str(tmp_path / "m"), "b_1")
    doc = json.loads(next((tmp_path / "m").glob("part-*")).read_text())
    assert [c["clip"] for c in doc["clips"]] == ["a", "b"] and doc["batch_id"] == "b_1"


def test_every_entity_of_cues_is_resolved(spark):
    text = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\ncaf&eacute;<00:00:02.000><c> isn&#8217;t &lt;b&gt; &amp;amp; &hearts;</c>\n\n00:00:04.000 --> 00:00:05.000\n&nbsp;plain &copy &#x41;\x1e \n"
    cues = C.vtt_cues(spark.createDataFrame([(1, text)], "source_id long, raw string"))
    words = [(r.w, r.start_ms) for r in C.vtt_words(cues).orderBy("start_ms").collect()]
    assert words == [("café", 1000), ("isn’t", 2000), ("<b>", 2250), ("&amp;", 2500), ("♥", 2750)]
    assert [r.text for r in C.vtt_segments(cues).orderBy("start_ms").collect()] == ["café isn’t <b> &amp; ♥", "plain © A"]


def test_json_and_yaml_records(spark, tmp_path):
    schema = "title string, n long, parts array<string>"
    assert K.load_yaml(spark, str(tmp_path / "none"), schema).count() == 0 and K.load_json(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "r" / "a").mkdir(parents=True)
    for name, text in {"a/x.yaml": "title: one\nn: 3\nparts:\n- p\n- q\n", "y.yml": "", "z.json": '{"title": "two",\n "n": 4}', "bad.json": "{no", "a/n.json": "null"}.items():
        (tmp_path / "r" / name).write_text(text)
    got = [(r.title, r.n, r.parts) for r in K.load_yaml(spark, str(tmp_path / "r"), schema).collect()]
    assert got == [("one", 3, ["p", "q"])]
    assert [(r.title, r.n, r.parts) for r in K.load_json(spark, str(tmp_path / "r"), schema).collect()] == [("two", 4, None)]
    (tmp_path / "r" / "broken.yaml").write_text("a: [1")
    with pytest.raises(Exception, match="malformed YAML in .*broken.yaml"):
        K.load_yaml(spark, str(tmp_path / "r"), schema).collect()
