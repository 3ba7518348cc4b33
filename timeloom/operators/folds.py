"""Order-dependent folds: each row joins the last kept one, or starts the next.

``fold_chunks`` folds a key of any size in chunks of its time, in parallel; ``fold`` folds a key, or an island of it, in one piece.
"""

from __future__ import annotations

import atexit
import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Milliseconds of a key that are folded in one piece.
CHUNK_MS = 600_000
#: Kept rows that are appended to before a chunk is closed, so that a fold does not copy all it has kept at every step.
CHUNK = 64


def appended(acc: str, row: str) -> str:
    """The fields ``done`` (full chunks) and ``cur`` of an accumulator, with ``row`` after the rows of ``acc``."""
    room = f"size({acc}.cur) < {CHUNK}"
    return f"'done', IF({room}, {acc}.done, concat({acc}.done, array({acc}.cur))), 'cur', IF({room}, concat({acc}.cur, array({row})), array({row}))"


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, before: Column | None = None) -> DataFrame:
    """``df`` with ``island``, which grows by one where ``breaks`` holds for a row.

    ``breaks`` may use ``before_end``: ``before`` over all earlier rows of the key. Rows of different islands must not
    affect each other in the fold that follows, whose state is then bounded by an island and not by a key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    if before is not None:
        df = df.withColumn("before_end", before.over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("break_", F.coalesce(breaks, F.lit(True)).cast("int"))
    df = df.withColumn("island", F.sum("break_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.drop("break_", "before_end")


def fold(df: DataFrame, keys: list[str], order: list[str], fields: list[str], first: str, joins: str, merged: str) -> DataFrame:
    """Folds the rows of each key in order, in expressions over ``p``, the last kept row, and ``x``, the next one.

    Kept rows are held in chunks of ``CHUNK``. ``first`` makes a kept row of ``x``; where ``joins`` holds, ``p`` becomes ``merged``, else ``p`` is done and ``x`` is the
    next. Returns the keys and the kept rows' fields. ``order`` must be total, for equal results at every run.
    """
    rest = [c for c in fields if c not in order]
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(*order, *rest)).alias("rows_"))
    by = " ".join(f"WHEN a.{c} < b.{c} THEN -1 WHEN a.{c} > b.{c} THEN 1" for c in order)
    rows = rows.withColumn("rows_", F.expr(f"array_sort(rows_, (a, b) -> CASE {by} ELSE 0 END)"))
    start = first.replace("x.", "rows_[0].")
    kind = rows.select(F.expr(start).alias("s")).schema["s"].dataType.simpleString()
    step = f"CASE WHEN {_of(joins)} THEN named_struct('done', acc.done, 'cur', acc.cur, 'p', {_of(merged)}) ELSE named_struct({appended('acc', 'acc.p')}, 'p', {first}) END"
    folded = F.expr(
        f"aggregate(slice(rows_, 2, size(rows_)), named_struct('done', CAST(array() AS array<array<{kind}>>), 'cur', CAST(array() AS array<{kind}>), 'p', CAST({start} AS {kind})), "
        f"(acc, x) -> {step}, acc -> concat(flatten(acc.done), acc.cur, array(acc.p)))"
    )
    return rows.select(*keys, F.explode(folded).alias("p_")).select(*keys, "p_.*")


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed and kept in the shared folder of ``spark.checkpoint.dir``, so that what follows does not compute it again and
    survives lost executors. Only a local master gets a folder of its own where none is set."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        if not named:
            folder = tempfile.TemporaryDirectory(prefix="timeloom-")
            atexit.register(folder.cleanup)
            named = f"file://{folder.name}"
        context.setCheckpointDir(named)
    return df.checkpoint()


def fold_chunks(df: DataFrame, keys: list[str], order: list[str], fields: list[str], first: str, joins: str, merged: str, width: int = CHUNK_MS) -> DataFrame:
    """The rows of ``fold`` over whole keys, by speculation: chunks are folded in parallel and then mended.

    A key is cut into chunks of ``width`` of its first order column, a time. Each chunk is folded as if it were the first.
    What a chunk leaves as its last kept row is then handed to the next one. Where that row and the next chunk's first do not join, the guess
    was right. Elsewhere the chunk is folded again from the row handed on, and only if its own last row comes out differently does the mending go on to
    the chunk after it, in rounds that end when no last row changes. A round costs what the chunks that it mends cost. What is in memory at once is a chunk; no key and no island is. ``order`` must be total. Keys may be null.
    """
    rest = [c for c in fields if c not in order]
    # one struct is the key of chunks and of the joins with them, so that rows are shuffled once
    on = F.struct(F.struct(*keys).alias("key_"), F.floor(F.col(order[0]) / width).alias("chunk_"))
    rows = df.select(on.alias("on_"), F.struct(*order, *rest).alias("row_")).groupBy("on_").agg(F.collect_list("row_").alias("rows_"))
    by = " ".join(f"WHEN a.{c} < b.{c} THEN -1 WHEN a.{c} > b.{c} THEN 1" for c in order)
    rows = rows.withColumn("rows_", F.expr(f"array_sort(rows_, (a, b) -> CASE {by} ELSE 0 END)"))
    start = first.replace("x.", "rows_[0].")
    kind = rows.select(F.expr(start).alias("s")).schema["s"].dataType.simpleString()
    last = f"aggregate(slice(rows_, {{0}}, size(rows_)), CAST({{1}} AS {kind}), (p, x) -> CAST(IF({joins}, {merged}, {first}) AS {kind}))"
    meets = joins.replace("x.", "head_.")
    meets = re.sub(r"(?<![A-Za-z_.])p(?=[.,) ])", "in_", meets)
    none = F.lit(None).cast(kind)
    chunks = cut(rows.withColumns({"head_": F.col("rows_")[0], "guess_": F.expr(last.format(2, start))}))
    state = chunks.select("on_", "head_", "guess_").withColumns({"in_": none, "out_": F.col("guess_")})
    whole = chunks.select("on_", "rows_")
    before = Window.partitionBy("on_.key_").orderBy("on_.chunk_")
    # maps cannot be compared, their text can
    plain = lambda c: F.to_json(c) if "map<" in kind else F.col(c)
    while True:
        now = state.withColumns({"was_": F.col("in_"), "in_": F.lag("out_").over(before), "old_": F.col("out_")})
        handed = ~plain("in_").eqNullSafe(plain("was_"))
        again = handed & F.coalesce(F.expr(meets), F.lit(False))
        kept = now.filter(~again).withColumn("out_", F.when(handed, F.col("guess_")).otherwise(F.col("out_")))
        mended = now.filter(again).join(whole, "on_").withColumn("out_", F.expr(last.format(1, "in_")))
        columns = ["on_", "head_", "guess_", "in_", "out_", (~plain("out_").eqNullSafe(plain("old_"))).alias("moved_")]
        state = cut(kept.select(*columns).unionByName(mended.select(*columns)))
        if state.filter("moved_").isEmpty():
            break
    ends = state.select("on_", "in_", F.lead("on_.chunk_").over(before).isNull().alias("end_"))
    step = f"CASE WHEN {_of(joins)} THEN named_struct('done', acc.done, 'cur', acc.cur, 'p', {_of(merged)}) ELSE named_struct({appended('acc', 'acc.p')}, 'p', {first}) END"
    folded = F.expr(
        f"aggregate(IF(in_ IS NULL, slice(rows_, 2, size(rows_)), rows_), named_struct('done', CAST(array() AS array<array<{kind}>>), 'cur', CAST(array() AS array<{kind}>), 'p', CAST(coalesce(in_, {start}) AS {kind})), "
        f"(acc, x) -> {step}, acc -> concat(flatten(acc.done), acc.cur, IF(end_, array(acc.p), CAST(array() AS array<{kind}>))))"
    )
    # a chunk gives the rows that were done in it; its last one is the next chunk's to give, or its own at the end
    # merged whatever the sizes: were chunks small enough to be broadcast, the few tasks of ``ends`` would do all the folding
    return whole.hint("merge").join(ends, "on_").select("on_.key_", F.explode(folded).alias("p_")).select("key_.*", "p_.*")


def _of(merged: str) -> str:
    """``p`` in terms of the accumulator."""
    return re.sub(r"(?<![A-Za-z_.])p(?=[.,) ])", "acc.p", merged)
