"""Prefix scans of hot keys in two levels: within blocks of the order, and over the blocks' sums.

A window over a key sorts all of the key's rows in one task. Here a key is cut into blocks of its first order column, which is a
time or a number; rows are sorted within blocks only, blocks are summed up where their rows are, a window over these few sums gives what
each block carries, and a join by block adds it. So a key spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of columns in milliseconds: a block is ten minutes.
BLOCK_MS = 600_000


def carried(df: DataFrame, keys: list[str], order: list[str], width: int, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None,
            lags: dict[str, Column] | None = None, totals: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with columns over all earlier rows of each row's key, in ``order``, which is total: ``sums`` (0 for the first row), ``maxima`` (null) and
    ``lags``, the value in the row before (null); and ``totals``, sums over all rows of the key.

    ``width``: of a block, in units of the first column of ``order``. Rows of a block are sorted in one task. Keys may be null."""
    sums, maxima, lags, totals = sums or {}, maxima or {}, lags or {}, totals or {}
    # one struct is the key of the window, the sums and the join, so that rows are shuffled once; nulls in it are equal
    rows = df.withColumn("scan_on", F.struct(*[F.col(k) for k in keys], F.floor(F.col(order[0]) / width).alias("scan_block")))
    place = F.struct(*order)
    blocks = rows.groupBy("scan_on").agg(
        F.count("*").alias("scan_n"), *[F.sum(c).alias(f"scan_s_{n}") for n, c in sums.items()], *[F.max(c).alias(f"scan_m_{n}") for n, c in maxima.items()],
        *[F.max_by(c, place).alias(f"scan_l_{n}") for n, c in lags.items()], *[F.sum(c).alias(f"scan_t_{n}") for n, c in totals.items()])
    key = Window.partitionBy(*[F.col("scan_on").getField(k) for k in keys])
    by = key.orderBy(F.col("scan_on.scan_block"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(
        "scan_on", *[F.sum(f"scan_s_{n}").over(before).alias(f"scan_s_{n}") for n in sums], *[F.max(f"scan_m_{n}").over(before).alias(f"scan_m_{n}") for n in maxima],
        *[F.lag(f"scan_l_{n}").over(by).alias(f"scan_l_{n}") for n in lags], *[F.sum(f"scan_t_{n}").over(key).alias(f"scan_t_{n}") for n in totals])
    own = Window.partitionBy("scan_on").orderBy(*order)
    until = own.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"scan_a_{n}": F.sum(c).over(until) for n, c in sums.items()} | {f"scan_b_{n}": F.max(c).over(until) for n, c in maxima.items()} | {f"scan_c_{n}": F.lag(c).over(own) for n, c in lags.items()}
    rows = rows.withColumns(local | {"scan_first": F.row_number().over(own) == 1}).join(carry, "scan_on")
    zero = F.lit(0)
    return rows.select(
        *df.columns, *[(F.coalesce(f"scan_a_{n}", zero) + F.coalesce(f"scan_s_{n}", zero)).alias(n) for n in sums], *[F.greatest(f"scan_b_{n}", f"scan_m_{n}").alias(n) for n in maxima],
        *[F.when(F.col("scan_first"), F.col(f"scan_l_{n}")).otherwise(F.col(f"scan_c_{n}")).alias(n) for n in lags], *[F.col(f"scan_t_{n}").alias(n) for n in totals])
