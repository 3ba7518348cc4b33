"""Timed entities made from the driver's tables, in Spark and as SQL common table expressions of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000
TIMELINE_MS = 2_592_000
NOW_MS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unvalidated candidates: too short, over long and past the end as well."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 1000000")
    label = F.create_map(*[F.lit(x) for kv in {"click": "quote", "view": "reaction", "purchase": "story", "signup": "hot_take", "error": "argument"}.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("candidate_id"), F.col("user_id").alias("source_id"), at.alias("start_ms"),
        (at + F.round(F.col("value") * 1000).cast("bigint")).alias("end_ms"), label[F.col("event_type")].alias("label"),
        (k % 11).cast("double").alias("score"), F.concat_ws(" ", "event_type", k.cast("string")).alias("reason"), k.alias("k"), F.col("value"), F.col("event_type"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_candidates(spark, sf_dir)
    return raw.withColumn("end_ms", F.col("start_ms") + F.least(F.lit(180_000), F.greatest(F.lit(3_000), F.col("end_ms") - F.col("start_ms"))))


def dense_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations: 280 ms each, 40 ms apart, and a pause between turns."""
    each = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r]+"), F.lit(0))).alias("pos", "w"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "pos")) - 1
    each = each.withColumn("seq", n.cast("bigint"))
    start = F.lit(320) * F.col("seq") + F.lit(1500) * F.col("turn")
    return each.select(F.col("conv_id").alias("source_id"), "seq", "w", start.alias("start_ms"), (start + 280).alias("end_ms"))


def long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, spread over the timeline."""
    words = F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r]+"), F.lit(0))
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), words.alias("ws"))
    # the count is taken below the generator, which would else take it for every word
    each = held.select("source_id", F.size("ws").alias("n"), "ws").select("source_id", "n", F.posexplode("ws").alias("seq", "w"))
    at = lambda i: F.expr(f"({i}) * {TIMELINE_MS}L div n")
    return each.select("source_id", F.col("seq").cast("bigint").alias("seq"), "w", at("seq").alias("start_ms"), at("seq + 1").alias("end_ms"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten words of a long transcript each, as ``long_words`` has them: cut out of a text where it is, so that words are not rows. Texts of one id are put together word by word."""
    words = F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r]+"), F.lit(0))
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), words.alias("ws")).select("source_id", F.size("ws").alias("n"), "ws")
    # the generator makes the cuts, so that a text is not taken along for each
    tens = F.sequence(F.lit(0), F.expr("(n - 1) div 10").cast("int"))
    cuts = F.transform(tens, lambda i: F.struct(i.alias("i"), F.slice("ws", i * 10 + 1, F.lit(10)).alias("ws")))
    each = held.select("source_id", "n", F.explode(F.when(F.col("n") > 0, cuts)).alias("c")).select("source_id", "n", F.col("c.i").alias("i"), F.col("c.ws").alias("ws"))
    at = lambda i: F.expr(f"({i}) * {TIMELINE_MS}L div n")
    each = each.select("source_id", F.col("i").cast("bigint").alias("seq"), at("i * 10").alias("start_ms"), at("least(i * 10 + 10, n)").alias("end_ms"), "ws")
    placed = F.flatten(F.transform(F.collect_list("ws"), lambda ws: F.transform(ws, lambda w, k: F.struct(k.alias("k"), w.alias("w")))))
    text = F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")
    return each.groupBy("source_id", "seq").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), text.alias("text"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample series per source in steps of half a second: x is null where nothing was found; level for loudness."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("user_id").alias("clip_id"), (n * 500).cast("bigint").alias("t_ms"),
        F.when(F.col("event_type") != "error", k * 10).alias("x_pm"), (-F.round(F.col("value") * 10)).cast("bigint").alias("level"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept stretches of a source: every other 4 s to 7 s of its time, laid end to end."""
    ids = candidates(spark, sf_dir).select(F.col("source_id").alias("clip_id")).distinct()
    rows = ids.select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("seq"))
    length = 4000 + (F.col("clip_id") + F.col("seq")) % 4 * 1000
    rows = rows.select("clip_id", F.col("seq").cast("bigint").alias("seq"), (F.col("seq") * 9000).cast("bigint").alias("src_start_ms"), (F.col("seq") * 9000 + length).cast("bigint").alias("src_end_ms"))
    before = Window.partitionBy("clip_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("out_start_ms", F.coalesce(F.sum(F.col("src_end_ms") - F.col("src_start_ms")).over(before), F.lit(0)).cast("bigint"))


_LABEL = "CASE event_type WHEN 'click' THEN 'quote' WHEN 'view' THEN 'reaction' WHEN 'purchase' THEN 'story' WHEN 'signup' THEN 'hot_take' WHEN 'error' THEN 'argument' END"
_K = "CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT)"
RAW_SQL = f"""raw AS (
  SELECT event_id AS candidate_id, user_id AS source_id, (epoch_us(ts) - {EPOCH_US}) // 1000000 AS start_ms,
         (epoch_us(ts) - {EPOCH_US}) // 1000000 + CAST(round(value * 1000) AS BIGINT) AS end_ms, {_LABEL} AS label,
         CAST({_K} % 11 AS DOUBLE) AS score, event_type || ' ' || {_K} AS reason, {_K} AS k, value, event_type FROM events)"""
CAND_SQL = f"""{RAW_SQL}, cand AS (
  SELECT candidate_id, source_id, start_ms, start_ms + least(180000, greatest(3000, end_ms - start_ms)) AS end_ms, label, score, reason, k FROM raw)"""
WORDS_SQL = """words_ AS (
  SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w, unnest(range(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')))) AS pos FROM conversations),
numbered_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS seq FROM words_),
words AS (SELECT conv_id AS source_id, seq, w, 320 * seq + 1500 * turn AS start_ms, 320 * seq + 1500 * turn + 280 AS end_ms FROM numbered_)"""
LONG_SQL = f"""split_ AS (
  SELECT doc_id AS source_id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS ws FROM documents),
long AS (SELECT source_id, seq, w, seq * {TIMELINE_MS} // n AS start_ms, (seq + 1) * {TIMELINE_MS} // n AS end_ms
  FROM (SELECT source_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS seq FROM split_))"""
SEG_SQL = f"""{LONG_SQL}, seg AS (
  SELECT source_id, seq // 10 AS seq, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(w, ' ' ORDER BY long.seq) AS text FROM long GROUP BY source_id, seq // 10)"""
SAMPLES_SQL = f"""smp AS (
  SELECT user_id AS clip_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 500 AS t_ms,
         CASE WHEN event_type <> 'error' THEN {_K} * 10 END AS x_pm, CAST(-round(value * 10) AS BIGINT) AS level FROM events)"""
TIMELINE_SQL = """tl_ AS (SELECT clip_id, seq, seq * 9000 AS src_start_ms, seq * 9000 + 4000 + (clip_id + seq) % 4 * 1000 AS src_end_ms
  FROM (SELECT DISTINCT user_id AS clip_id FROM events), (SELECT unnest(range(20)) AS seq)),
tl AS (SELECT *, CAST(coalesce(sum(src_end_ms - src_start_ms) OVER (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start_ms FROM tl_)"""
