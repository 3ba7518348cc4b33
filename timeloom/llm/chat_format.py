"""Operator 11, chat formatting: budgeted windows.

Conversations become training texts of a bounded number of tokens. A turn costs its estimated tokens (a token for every started group
of four characters of a word) and ``TURN_COST`` for its marks. Prefix sums of these costs choose turn-aligned spans: a turn belongs to
the window into whose stride of tokens its prefix sum falls, so windows follow from a sum and nothing is packed in order. Every window
retains the conversation's system turn (its first turn, where that has the role ``system``), then repeats as many of the turns right before the span as
fit in ``history`` and in what the budget leaves, then has its own turns. The loss mask covers the texts of its own assistant turns only: repeated targets are
masked, so each is trained on once.

A window is one text of marked turns, ``### role:`` at the head and ``</turn>`` at the end. Control strings in texts are broken up with
a backslash, and backslashes are doubled, so that marks are only ever marks and texts can be read back: ``read_turns``, ``read_loss``.

Prefix sums are taken in two levels, within blocks of turn numbers and over the blocks' totals, so that a conversation with a third of
all rows is sorted in many tasks. What is collected into one row is a window, bounded by its stride and the length of one turn. Only
DataFrame functions are used.

Defined cases: a null or empty text is an empty turn; a null role is an empty role, and roles can hold any characters; turns are in
the order of (turn, role, text), nulls first, so repeated and tied rows stay and their order is total; rows with a null ``conv_id`` are one
conversation; texts are never cut, so a window is over its budget where the system turn, a stride and its last turn together are (``over_budget`` tells); an empty table gives an empty
table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET = 2048
#: New tokens in a window, about; a window's own turns begin within one stride.
STRIDE = 1024
#: Tokens of repeated turns, at most. Not over the stride, so that a window repeats turns of the one before it only.
HISTORY = 512
TURN_COST = 4
#: Turn numbers of a block of the prefix sums.
BLOCK = 256
# The template.
HEAD, AFTER_ROLE, END = "### ", ":\n", "</turn>\n"
SYSTEM, TARGET = "system", "assistant"
_TOKEN = "[^\\x09-\\x0D\\x20]{1,4}"


def tokens(text: Column) -> Column:
    """An estimate: a token for every started group of four characters that are no white space."""
    return F.regexp_count(text, F.lit(_TOKEN)).cast("bigint")


def escaped(text: Column) -> Column:
    """``text`` without control strings: backslashes are doubled, then one breaks up each control string."""
    return F.regexp_replace(F.regexp_replace(text, "\\\\", "\\\\\\\\"), "#(?=##)|<(?=/turn>)", "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\(\\\\?)", "$1")


def _escaped_role(role: Column) -> Column:
    """A role in one line."""
    return F.regexp_replace(escaped(role), "\n", "\\\\n")


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, "(?<!\\\\)((?:\\\\\\\\)*)\\\\n", "$1\n"))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), _escaped_role(role), F.lit(AFTER_ROLE), escaped(text), F.lit(END))


#: The order of a conversation's turns.
_ORDER = ("turn", "role", "cost", "text")


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """``turns`` with ``is_system``, ``place`` (from 0), ``before`` (the cost of all turns before but the system turn) and ``whole``
    (of all turns but that one). What is joined is a row for each block."""
    # one struct is the key of the sums, the window and the join, so that texts are shuffled once; nulls in it are equal
    rows = turns.withColumn("on", F.struct("conv_id", F.floor(F.col("turn") / BLOCK).cast("bigint").alias("block")))
    sums = rows.groupBy("on").agg(F.count("*").alias("n"), F.sum("cost").alias("sum"), F.min(F.struct(*_ORDER[:3])).alias("first"))
    every = Window.partitionBy("on.conv_id")
    earlier = every.orderBy("on.block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("first").over(every)
    carried = sums.select(
        "on", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("c_n"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("c_sum"),
        F.sum("sum").over(every).alias("c_all"), F.when(first["role"] == SYSTEM, first["cost"]).otherwise(F.lit(0)).alias("c_system"))
    order = Window.partitionBy("on").orderBy(*_ORDER)
    until = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"l_n": F.row_number().over(order) - 1, "l_sum": F.coalesce(F.sum("cost").over(until), F.lit(0))}).join(carried, "on")
    place = F.col("c_n") + F.col("l_n")
    return rows.select(
        *turns.columns, place.alias("place"), ((place == 0) & (F.col("role") == SYSTEM)).alias("is_system"),
        F.greatest(F.lit(0), F.col("c_sum") + F.col("l_sum") - F.col("c_system")).alias("before"), (F.col("c_all") - F.col("c_system")).alias("whole"))


#: Why a turn is in a window: as one of its own, as history, as the system turn.
_OWN, _HISTORY, _SYSTEM = 0, 1, 2


def format_windows(conversations: DataFrame, budget: int = BUDGET, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, loss, n_turns, n_repeated, n_tokens, over_budget) of ``conversations`` (conv_id, turn, role, text).

    ``window`` grows within a conversation and can have gaps. ``loss``: (start, stop) in code points of ``text``, stop exclusive.
    The first ``n_repeated`` of the ``n_turns`` turns stood in an earlier window."""
    if history > stride:
        raise ValueError("history is at most the stride")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _prefix_sums(turns.withColumn("cost", tokens(F.col("text")) + TURN_COST)).withColumn("own", F.expr(f"before div {stride}"))
    put = lambda window, kind: F.struct(window.alias("window"), F.lit(kind).alias("kind"))
    own, again = put(F.col("own"), _OWN), put(F.col("own") + 1, _HISTORY)
    everywhere = F.transform(F.sequence(F.lit(0).cast("bigint"), F.expr(f"whole div {stride}")), lambda k: put(k, _SYSTEM))
    # only what is within ``history`` of the next window's start can be repeated there
    late = F.col("before") >= (F.col("own") + 1) * stride - history
    placed = F.when(F.col("is_system"), everywhere).when(late, F.array(own, again)).otherwise(F.array(own))
    each = rows.withColumn("at", F.explode(placed)).select("conv_id", "at.*", "place", "before", "role", "text", "cost")
    is_own = F.col("kind") == _OWN
    held = each.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("place", "kind", "before", "role", "cost", "text"))).alias("turns"), F.min(F.when(is_own, F.col("before"))).alias("first"),
        F.sum(F.when(F.col("kind") != _HISTORY, F.col("cost")).otherwise(F.lit(0))).alias("kept"), F.max((F.col("kind") == _SYSTEM).cast("int")).alias("system"))
    # window 0 has turns of its own, or the conversation is a system turn alone; later ones that lie within a long turn are none
    held = held.filter("first is not null or (window = 0 and system = 1)")
    room = F.least(F.lit(history), F.greatest(F.lit(0), budget - F.col("kept")))
    held = held.withColumn("turns", F.filter("turns", lambda t: (t["kind"] != _HISTORY) | (t["before"] >= F.col("first") - room)))
    shown = F.transform("turns", lambda t: F.struct(t["kind"].alias("kind"), t["cost"].alias("cost"), (t["role"] == TARGET).alias("target"), _rendered(t["role"], t["text"]).alias("shown"), F.length(_escaped_role(t["role"])).alias("head")))
    held = held.select("conv_id", "window", shown.alias("turns"))
    fixed = len(HEAD) + len(AFTER_ROLE)
    loss = F.expr(f"""aggregate(turns, named_struct('at', 0, 'spans', CAST(array() AS array<struct<start:int,stop:int>>)), (acc, t) -> named_struct(
        'at', acc.at + length(t.shown), 'spans', IF(t.kind = {_OWN} AND t.target, concat(acc.spans, array(named_struct('start', acc.at + {fixed} + t.head, 'stop', acc.at + length(t.shown) - {len(END)}))), acc.spans)), acc -> acc.spans)""")
    repeated = F.size(F.filter("turns", lambda t: (t["kind"] == _HISTORY) | ((t["kind"] == _SYSTEM) & (F.col("window") > 0)))).cast("bigint")
    n_tokens = F.aggregate("turns", F.lit(0).cast("bigint"), lambda acc, t: acc + t["cost"])
    return held.select(
        "conv_id", "window", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("text"), loss.alias("loss"),
        F.size("turns").cast("bigint").alias("n_turns"), repeated.alias("n_repeated"), n_tokens.alias("n_tokens"), (n_tokens > budget).alias("over_budget"))


def read_turns(text: Column) -> Column:
    """(role, text) of the turns of a formatted text."""
    pieces = F.split(text, END)
    turn = lambda x: F.struct(_unescaped_role(F.substr(x, F.lit(len(HEAD) + 1), F.instr(x, "\n") - 2 - len(HEAD))).alias("role"), unescaped(F.substr(x, F.instr(x, "\n") + 1)).alias("text"))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_loss(text: Column, loss: Column) -> Column:
    """What stands under the loss mask of a formatted text, as it was before it was escaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, s["start"] + 1, s["stop"] - s["start"]))), "")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


_SAID = "\\### Assistant: </turn> ok"


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    talk = conversations(spark, sf_dir).select("conv_id", "turn", "role", "text")
    said = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(TARGET)).alias("role"), F.lit(_SAID).alias("text"))
    windows = format_windows(talk.unionByName(said))
    turns = read_turns(F.col("text"))
    read = windows.select("conv_id", "window", F.slice(turns, F.col("n_repeated").cast("int") + 1, F.col("n_turns").cast("int")).alias("own"), read_loss(F.col("text"), F.col("loss")).alias("loss"), F.length("text").alias("chars"))
    lines = F.array_join(F.transform("own", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.size("own").alias("n"), F.length("loss").alias("n_loss"), "chars", F.struct("window", lines.alias("x")).alias("lines"), F.struct("window", F.col("loss").alias("x")).alias("loss"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda w: w["x"]), "").cast("binary"), 256)
    return read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), joined("lines").alias("turns_sha256"), F.sum("n_loss").alias("loss_chars"), joined("loss").alias("loss_sha256"), F.sum("chars").alias("formatted_chars"))


_RUNS = "coalesce(list_sum(list_transform(regexp_extract_all({0}, '###+'), lambda x: length(x) - 2)), 0)"
_GROWTH = "(length({0}) - length(replace({0}, chr(92), ''))) + " + _RUNS + " + (length({0}) - length(replace({0}, '</turn>', ''))) // 7"
OP11_SQL = f"""
WITH talk AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
cost AS (
  SELECT *, len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]{{1,4}}')) + {TURN_COST} AS cost,
         {len(HEAD + AFTER_ROLE + END)} + length(role) + {_GROWTH.format("role")} + length(role) - length(replace(role, chr(10), '')) + length(text) + {_GROWTH.format("text")} AS shown FROM talk),
placed AS (
  SELECT *, row_number() OVER o - 1 AS place, coalesce(sum(cost) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
  FROM cost WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, cost, text)),
systems AS (SELECT conv_id, cost AS s_cost, shown AS s_shown FROM placed WHERE place = 0 AND role = '{SYSTEM}'),
rest AS (
  SELECT t.*, p - coalesce(s_cost, 0) AS before, (p - coalesce(s_cost, 0)) // {STRIDE} AS own, coalesce(s_cost, 0) AS s_cost, coalesce(s_shown, 0) AS s_shown
  FROM placed t LEFT JOIN systems s ON t.conv_id IS NOT DISTINCT FROM s.conv_id WHERE NOT (place = 0 AND role = '{SYSTEM}')),
wins AS (
  SELECT conv_id, own, min(before) AS f, least({HISTORY}, greatest(0, {BUDGET} - sum(cost) - any_value(s_cost))) AS room, sum(shown) + any_value(s_shown) AS chars FROM rest GROUP BY conv_id, own),
again AS (
  SELECT w.conv_id, sum(r.shown) AS chars FROM wins w JOIN rest r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.own = w.own - 1 AND r.before >= w.f - w.room GROUP BY w.conv_id),
alone AS (SELECT conv_id, s_shown AS chars FROM systems s WHERE NOT EXISTS (SELECT 1 FROM rest r WHERE r.conv_id IS NOT DISTINCT FROM s.conv_id)),
total AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, chars FROM wins UNION ALL SELECT * FROM again UNION ALL SELECT * FROM alone) GROUP BY conv_id),
text AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
         CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{TARGET}'), 0) AS BIGINT) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = '{TARGET}'), '')) AS loss_sha256 FROM placed GROUP BY conv_id)
SELECT text.*, CAST(total.chars AS BIGINT) AS formatted_chars FROM text JOIN total ON text.conv_id IS NOT DISTINCT FROM total.conv_id
"""
