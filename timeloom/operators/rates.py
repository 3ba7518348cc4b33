"""Token buckets over a log of requests: which requests a rate limiter lets pass.

A bucket holds up to ``burst`` tokens and gains ``rate`` a second; a request passes if a token is left, and takes it. One bucket is a
recurrence over all its requests, but what a stretch of requests does to the tokens it finds is a map with few pieces: on each piece the tokens
are shifted by a constant, or they overflowed and are a constant themselves. A piece ends where one token more lets one
request more pass, so there are no more than about ``burst`` pieces, however long the stretch; and maps of stretches compose. So a hot
bucket is cut into blocks of time, each block becomes a map where its requests are, maps are composed over groups of blocks, only
these few are chained in order, and the tokens found by each block then decide its requests, again where they are.

Tokens are counted in whole units, ``UNIT`` to a token, so that results do not depend on how a bucket was cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import appended

#: Units of a token. A rate of one token in 10 ** 6 seconds is one unit a microsecond.
UNIT = 10**12
#: Blocks whose maps are composed before they are chained.
GROUP = 64
_PIECE = "array<struct<lo:bigint,hi:bigint,slope:int,off:bigint>>"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


class Bucket:
    """Expressions for one size of bucket. A map is an array of pieces: for tokens in [lo, hi) it gives ``slope * tokens + off``."""

    def __init__(self, burst: int, per_million_s: int):
        self.full, self.rate = burst * UNIT, per_million_s
        #: What a request does to the tokens it finds.
        self.request = f"array(named_struct('lo', 0L, 'hi', {UNIT}L, 'slope', 1, 'off', 0L), named_struct('lo', {UNIT}L, 'hi', {self.full + 1}L, 'slope', 1, 'off', {-UNIT}L))"

    def gain(self, before: str, after: str) -> str:
        """Units gained between two times in microseconds; what fills a bucket is enough."""
        most = -(-self.full // self.rate)
        return f"(least({after} - {before}, {most}L) * {self.rate}L)"

    def filled(self, tokens: str, gain: str) -> str:
        return f"least({self.full}L, {tokens} + {gain})"

    def then(self, first: str, gain: str, second: str) -> str:
        """The map of ``first``, then a gain, then ``second``."""
        # a piece that overflows ends where it does, and a constant follows
        over = f"({self.full}L - p.off - {gain})"
        gained = f"""flatten(transform({first}, p -> IF(p.slope = 0,
            array(named_struct('lo', p.lo, 'hi', p.hi, 'slope', 0, 'off', {self.filled("p.off", gain)})),
            filter(array(named_struct('lo', p.lo, 'hi', least(p.hi, {over}), 'slope', 1, 'off', p.off + {gain}), named_struct('lo', greatest(p.lo, {over}), 'hi', p.hi, 'slope', 0, 'off', {self.full}L)), q -> q.lo < q.hi))))"""
        low = "IF(q.slope = 0, q.off, q.lo + q.off)"
        high = "IF(q.slope = 0, q.off + 1, q.hi + q.off)"
        part = "named_struct('lo', greatest(q.lo, IF(q.slope = 0, q.lo, s.lo - q.off)), 'hi', least(q.hi, IF(q.slope = 0, q.hi, s.hi - q.off)), 'slope', q.slope * s.slope, 'off', s.slope * q.off + s.off)"
        both = f"flatten(transform({gained}, q -> transform(filter({second}, s -> s.lo < {high} AND {low} < s.hi), s -> {part})))"
        same = "(i > 0 AND m[i - 1].slope = x.slope AND m[i - 1].off = x.off)"
        # neighbouring pieces that do the same are one
        ends = f"filter(transform(m, (x, i) -> named_struct('x', x, 'keep', NOT {same}, 'i', i)), y -> y.keep)"
        joined = _let(ends, "k", f"transform(k, (y, j) -> named_struct('lo', y.x.lo, 'hi', IF(j + 1 < size(k), k[IF(j + 1 < size(k), j + 1, j)].x.lo, {self.full + 1}L), 'slope', y.x.slope, 'off', y.x.off))")
        return _let(both, "m", joined)

    def applied(self, pieces: str, tokens: str) -> str:
        return _let(f"filter({pieces}, p -> p.lo <= {tokens} AND {tokens} < p.hi)[0]", "p", f"p.slope * {tokens} + p.off")

    def composed(self, blocks: str) -> str:
        """The map of an array of consecutive blocks (first, last, map)."""
        step = self.then("acc.map", self.gain("acc.last", "b.first"), "b.map")
        start = f"named_struct('last', {blocks}[0].last, 'map', CAST({blocks}[0].map AS {_PIECE}))"
        return f"aggregate(slice({blocks}, 2, size({blocks})), {start}, (acc, b) -> named_struct('last', b.last, 'map', CAST({step} AS {_PIECE})), acc -> acc.map)"

    def found(self, blocks: str, tokens: str) -> str:
        """The tokens that each block (number, first, last, map) finds, where the first one finds ``tokens``."""
        kind = "array<struct<number:bigint,tokens:bigint>>"
        now = f"IF(acc.last IS NULL, acc.left, {self.filled('acc.left', self.gain('acc.last', 'b.first'))})"
        step = _let(now, "t", f"named_struct('last', b.last, 'left', {self.applied('b.map', 't')}, 'out', concat(acc.out, array(named_struct('number', b.number, 'tokens', t))))")
        return f"aggregate({blocks}, named_struct('last', CAST(NULL AS bigint), 'left', {tokens}, 'out', CAST(array() AS {kind})), (acc, b) -> {step}, acc -> acc.out)"


def rate_limited(requests: DataFrame, keys: list[str], at: str, ident: str, burst: int, per_million_s: int, block_us: int = 60_000_000) -> DataFrame:
    """``keys``, ``at``, ``ident`` of ``requests`` with ``allowed`` and ``left``, the units left after it.

    ``at``: microseconds; equal times go by ``ident``, which is unique in a bucket. ``per_million_s``: tokens gained in 10 ** 6
    seconds. A burst or rate of 0 turns the limiter off: all pass, ``left`` is null. A new bucket is full. What is collected in one row are the
    requests of a bucket in ``block_us``."""
    rows = requests.select(*keys, F.col(at).cast("bigint").alias("at_"), F.col(ident).alias("id_"))
    back = lambda df: df.select(*keys, F.col("at_").alias(at), F.col("id_").alias(ident), "allowed", "left")
    if burst <= 0 or per_million_s <= 0:
        return back(rows.withColumns({"allowed": F.lit(True), "left": F.lit(None).cast("bigint")}))
    b = Bucket(burst, per_million_s)
    # one struct is the key of all shuffles, and a key with nulls in it joins as any other
    rows = rows.select(F.struct(*keys).alias("key_"), F.floor(F.col("at_") / block_us).alias("number_"), "at_", "id_")
    blocks = rows.groupBy("key_", "number_").agg(F.array_sort(F.collect_list(F.struct("at_", "id_"))).alias("rows_"))
    step = b.then("acc.map", b.gain("acc.last", "r.at_"), b.request)
    start = f"named_struct('last', rows_[0].at_, 'map', CAST({b.request} AS {_PIECE}))"
    maps = blocks.select(
        "key_", F.expr(f"number_ div {GROUP}").alias("group_"),
        F.struct(F.col("number_").alias("number"), F.col("rows_")[0]["at_"].alias("first"), F.element_at("rows_", -1)["at_"].alias("last"),
                 F.expr(f"aggregate(slice(rows_, 2, size(rows_)), {start}, (acc, r) -> named_struct('last', r.at_, 'map', CAST({step} AS {_PIECE})), acc -> acc.map)").alias("map")).alias("block"))
    groups = maps.groupBy("key_", "group_").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    whole = groups.select("key_", F.struct(F.col("group_").alias("number"), F.col("blocks")[0]["first"].alias("first"), F.element_at("blocks", -1)["last"].alias("last"), F.expr(b.composed("blocks")).alias("map")).alias("group"))
    chained = whole.groupBy("key_").agg(F.array_sort(F.collect_list("group")).alias("groups"))
    chained = chained.select("key_", F.explode(F.expr(b.found("groups", f"{b.full}L"))).alias("f")).select(F.struct("key_", F.col("f.number").alias("group_")).alias("on_"), "f.tokens")
    held = groups.withColumn("on_", F.struct("key_", "group_")).join(chained, "on_")
    held = held.select("key_", F.explode(F.expr(b.found("blocks", "tokens"))).alias("f")).select(F.struct("key_", F.col("f.number").alias("number_")).alias("on_"), "f.tokens")
    ready = blocks.withColumn("on_", F.struct("key_", "number_")).join(held, "on_")
    kind = "struct<at_:bigint,id_:" + rows.schema["id_"].dataType.simpleString() + ",allowed:boolean,left:bigint>"
    now = f"IF(acc.last IS NULL, acc.left, {b.filled('acc.left', b.gain('acc.last', 'r.at_'))})"
    row = f"named_struct('at_', r.at_, 'id_', r.id_, 'allowed', t >= {UNIT}L, 'left', IF(t >= {UNIT}L, t - {UNIT}L, t))"
    decide = _let(now, "t", f"CAST(named_struct('last', r.at_, 'left', IF(t >= {UNIT}L, t - {UNIT}L, t), {appended('acc', row)}) AS struct<last:bigint,left:bigint,done:array<array<{kind}>>,cur:array<{kind}>>)")
    out = F.expr(f"aggregate(rows_, named_struct('last', CAST(NULL AS bigint), 'left', tokens, 'done', CAST(array() AS array<array<{kind}>>), 'cur', CAST(array() AS array<{kind}>)), (acc, r) -> {decide}, acc -> concat(flatten(acc.done), acc.cur))")
    return back(ready.select("key_.*", F.explode(out).alias("x")).select(*keys, "x.*"))
