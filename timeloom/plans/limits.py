"""Queries of rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rates as R
from . import adapter as A

#: Tokens of a bucket, and those it gains in 10 ** 6 seconds.
BURST, RATE = 3, 80
BLOCK_US = 6 * 3_600_000_000


def rate_limited(spark, sf):
    """Events as requests: 35 buckets by kind and address, so each is hot."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    requests = A.table(spark, sf, "events").select("event_id", F.col("event_type").alias("principal"), (F.col("user_id") % 7).alias("ip"), at.alias("at_us"))
    return R.rate_limited(requests, ["principal", "ip"], "at_us", "event_id", BURST, RATE, BLOCK_US).select("event_id", "principal", "ip", "allowed", "left")


RATE_SQL = f"""WITH RECURSIVE r AS (SELECT event_id, event_type AS principal, user_id % 7 AS ip, epoch_us(ts) - {A.EPOCH_US} AS t, row_number() OVER (PARTITION BY event_type, user_id % 7 ORDER BY ts, event_id) AS rn FROM events),
f(principal, ip, rn, event_id, t, found) AS (SELECT principal, ip, rn, event_id, t, CAST({BURST * R.UNIT} AS BIGINT) FROM r WHERE rn = 1
  UNION ALL SELECT r.principal, r.ip, r.rn, r.event_id, r.t, least({BURST * R.UNIT}, found - CASE WHEN found >= {R.UNIT} THEN {R.UNIT} ELSE 0 END + (r.t - f.t) * {RATE}) FROM f JOIN r ON r.principal = f.principal AND r.ip = f.ip AND r.rn = f.rn + 1)
SELECT event_id, principal, ip, found >= {R.UNIT} AS allowed, found - CASE WHEN found >= {R.UNIT} THEN {R.UNIT} ELSE 0 END AS "left" FROM f"""

QUERIES = {"rate_limited": (rate_limited, RATE_SQL)}
