"""Operator 8, suffix-array dedup: repeated byte strings of ``LENGTH`` bytes or more, by fingerprints of growing length.

This is not the prefix doubling of the literature, in which every byte position has a row that is sorted in every round: its
rows are some 16 bytes a byte and round, far over the disk that the operator may use (the README has figures). What is kept of
it is that positions are ranked by equal contents at growing lengths and leave as soon as they are unique or known to repeat past
the threshold. In place of positions, runs of them are ranked, and a rank is a fingerprint, so that grouping takes the place of sorting:

* A run is the strings of ``LENGTH`` bytes that share their smallest hashed gram of ``GRAM`` bytes, so that equal strings are in
  runs of equal grams, at the same place. What all strings of a run have in common (first the gram) is its core,
  what they cover together its stretch.
* Runs whose core is unique are unique and leave. Runs whose stretch occurs again repeat as a whole and leave. The rest
  is cut into shorter runs, which have longer cores, at ``WIDTHS`` strings each, and ranked again; the last ones
  are single strings, where core and stretch are the same ``LENGTH`` bytes. Of runs that repeat, one
  representative goes on where a run of the same core does.

Nothing is sampled from the result: every string is in a run, and every repeat is found. A hot passage makes one row per
place and is counted by partial aggregation; no pairs are made. Stretches are equal if two 64-bit fingerprints of all
their bytes, by independent functions, are: a byte is removed wrongly only if both collide, within runs of one core.

Texts are UTF-8 bytes; matches stay within documents. Texts of any length are read, in segments of ``SEGMENT`` bytes and the strings that
begin there, so that memory does not follow them. Defined cases: a null text is empty; texts shorter than ``LENGTH``
keep everything; rows that repeat a ``doc_id`` are places of their own; a null ``doc_id`` is a document like any
other; an empty table gives an empty table; in ``remove_repeats`` a character that is cut apart goes as a whole, and U+FFFD with it, and further columns
pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, documents, map_batches, sweep

LENGTH, GRAM = 200, 64
#: Strings in a run, round by round.
WIDTHS = (LENGTH - GRAM + 1, 18, 3, 1)
#: Documents with repeats up to which their ids are broadcast to the texts; beyond, texts are shuffled to them.
BROADCAST_IDS = 500_000
#: Bytes of a text that are fingerprinted at once; with a string more, they fit in ``_POSITION`` bits.
SEGMENT = 1 << 22
_POSITION = 23
#: More than any run reaches to either side of its first string.
_REACH = 4 * LENGTH
_NULL_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Of two functions: what stands for each byte, and an odd base.
_BYTES = tuple(_mix(np.arange(i, i + 256, dtype=np.uint64) * _GOLDEN) for i in (1, 1001))
_BASES = (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2 ** 64, as far as segments are long."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 17)
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (self.base, inverse))
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in _BASES)


class Prints:
    """Fingerprints of any stretches of a segment, from prefix sums, by one of the two functions."""

    def __init__(self, data: bytes, function: int = 0):
        self.n = len(data)
        up, self.down = _POWERS[function].upto(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTES[function][np.frombuffer(data, np.uint8)] * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return _mix(raw + _mix(np.asarray(end - start, np.uint64) + np.uint64(1) + (np.asarray(salt, np.uint64) << np.uint64(32))))

    def runs(self, length: int) -> np.ndarray:
        """Of every stretch of that length."""
        k = self.n - length + 1
        return _mix((self.sums[length:] - self.sums[:k]) * self.down[:k] + np.uint64(length))


def anchors(grams: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of consecutive strings with the same smallest gram: its position, and the first and last string. Of equal grams the leftmost."""
    held = grams >> np.uint64(_POSITION) << np.uint64(_POSITION)
    low = held | np.arange(len(grams), dtype=np.uint64)
    width, size = len(grams) - windows + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: windows], low[width - size : width - size + windows])
    at = (low & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return at[first], first, np.concatenate([first[1:] - 1, [windows - 1]])


_RUNS = "sd_doc long, sd_text long, pos int, lo int, hi int, at int, core long, stretch long, check long, wanted boolean"
_PLACE = ["sd_doc", "sd_text", "pos", "lo", "hi", "at"]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _batch(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3, pa.bool_()]
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0)] * len(kinds)
    return pa.record_batch([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _RUNS.split(", ")])


def _stretches(one: Prints, two: Prints, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of what the strings lo to hi cover, and of where the gram stands there."""
    salt = (pos - lo) * LENGTH + hi - lo
    return _signed(one.of(lo, hi + LENGTH, salt)), _signed(two.of(lo, hi + LENGTH, salt))


def _first_runs(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                for base in range(0, len(data) - LENGTH + 1, segment):
                    part = data[base : base + segment + LENGTH - 1]
                    one, two = Prints(part, 0), Prints(part, 1)
                    grams = one.runs(GRAM)
                    pos, lo, hi = anchors(grams, len(part) - LENGTH + 1)
                    n = len(pos)
                    same = _stretches(one, two, pos, lo, hi)
                    rows.append((np.full(n, doc), np.full(n, key), pos + base, lo + base, hi + base, np.zeros(n), _signed(grams[pos]), *same, np.ones(n, bool)))
            yield _batch(rows)

    return run


def _listed(column: pa.Array, names: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """For every row of a column of lists of structs, the fields as arrays; a null is an empty list."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    fields = [flat.field(n).to_numpy(zero_copy_only=False) for n in names]
    for start, end in zip(np.concatenate([[0], ends[:-1]]).astype(int), ends.astype(int), strict=True):
        yield tuple(f[start:end] for f in fields)


def _shorter_runs(width: int, new: int, segment: int):
    """Cuts runs of ``width`` strings into runs of ``new`` ones. ``at``: bytes from a run's last string to the gram."""

    def cut(part: bytes, doc: int, key: int, base: int, pos, lo, hi, at, wanted) -> tuple[np.ndarray, ...]:
        one, two = Prints(part, 0), Prints(part, 1)
        parts = -(-width // new)
        k = np.tile(np.arange(parts) * new, len(pos))
        size = np.minimum(new, width - k)
        pos, lo, hi, at, wanted = (np.repeat(x, parts) for x in (pos - base, lo - base, hi - base, at, wanted))
        at = at + k
        some = (pos - at >= lo) & (pos - at - size + 1 <= hi)
        pos, lo, hi, at, wanted, size = (x[some] for x in (pos, lo, hi, at, wanted, size))
        core = _signed(one.of(pos - at, pos - at - size + 1 + LENGTH, at))
        lo, hi = np.maximum(lo, pos - at - size + 1), np.minimum(hi, pos - at)
        n = len(pos)
        return np.full(n, doc), np.full(n, key), pos + base, lo + base, hi + base, at, core, *_stretches(one, two, pos, lo, hi), wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, text, listed in zip(batch["sd_doc"].to_pylist(), batch["sd_text"].to_pylist(), batch["text"], _listed(batch["listed"], ["pos", "lo", "hi", "at", "wanted"]), strict=True):
                data = (text.as_py() or "").encode()
                pos, lo, hi, at = (x.astype(np.int64) for x in listed[:4])
                wanted, at_segment = listed[4].astype(bool), lo // segment
                for s in np.unique(at_segment).tolist():
                    base, here = max(0, s * segment - _REACH), at_segment == s
                    rows.append(cut(data[base : (s + 1) * segment + _REACH], doc, key, base, *(x[here] for x in (pos, lo, hi, at, wanted))))
            yield _batch(rows)

    return run


def _with_texts(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of ``listed`` (unique by ``_KEY``) with the texts. The keys are broadcast, if they are few enough, to leave all other texts where they are."""
    texts = docs.select(_id().alias("sd_doc"), _hash().alias("sd_text"), "text")
    if listed.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(listed.select(*_KEY)), _KEY, "left_semi")
    return texts.join(listed, _KEY)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID).cast("bigint"))


def _hash() -> Column:
    return F.xxhash64("text")


#: What a row is known by: rows that share both have the same repeats, so that no key holds more than those of one text.
_KEY = ["sd_doc", "sd_text"]


def repeats(docs: DataFrame, w: Workspace) -> DataFrame:
    """Stretches (sd_doc, sd_text, s, e) in bytes, which together cover what repeats; ``sd_text`` is a hash of the text."""
    runs = w.write(map_batches(docs.select(_id().alias("sd_doc"), "text", _hash().alias("sd_text")), _first_runs(SEGMENT), _RUNS), "repeat-runs")
    known = []
    for width, new in zip(WIDTHS, [*WIDTHS[1:], None], strict=True):
        # the cores are written first: a join of two tables has a hot core's rows split at run time
        shared = w.write(runs.groupBy("core").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "repeat-cores")
        alive = w.write(runs.join(shared, "core"), "repeat-alive")
        w.free(runs, shared)
        again = alive.groupBy("core", "stretch", "check").agg(F.count("*").alias("c"), F.min(F.struct(*_PLACE)).alias("p")).filter("c > 1")
        again = w.write(again.select(F.col("core").alias("ac"), F.col("stretch").alias("st"), F.col("check").alias("ck"), "p"), "repeat-again")
        same = (F.col("core") == F.col("ac")) & (F.col("stretch") == F.col("st")) & (F.col("check") == F.col("ck"))
        rated = alive.join(again.select("ac", "st", "ck"), same, "left")
        rated = w.write(rated.select(*_PLACE, "core", "wanted", F.col("ac").isNotNull().alias("done")), "repeat-rated")
        w.free(alive)
        known.append(w.write(rated.filter("done and wanted").select("sd_doc", "sd_text", F.col("lo").alias("s"), (F.col("hi") + LENGTH).alias("e")), "repeat-known"))
        if new is None:
            w.free(rated, again)
            break
        rest = rated.filter("not done and wanted")
        asked = rest.select(F.col("core").alias("asked")).distinct()
        others = rated.filter("not done and not wanted").select("core", *_PLACE).unionByName(again.select(F.col("ac").alias("core"), "p.*"))
        others = others.join(asked, F.col("core") == F.col("asked"), "left_semi").withColumn("wanted", F.lit(False))
        listed = rest.select(*_PLACE, "wanted").unionByName(others.select(*_PLACE, "wanted")).groupBy(*_KEY)
        # a set: rows that share the key have the same runs, and each is cut once for every row
        listed = w.write(listed.agg(F.collect_set(F.struct("pos", "lo", "hi", "at", "wanted")).alias("listed")), "repeat-listed")
        w.free(rated, again)
        runs = w.write(map_batches(_with_texts(docs, listed), _shorter_runs(width, new, SEGMENT), _RUNS), "repeat-runs")
        w.free(listed)
        sweep(docs.sparkSession)
    out = known[0]
    for more in known[1:]:
        out = out.unionByName(more)
    return out


def _cut(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """What is left, how many bytes went and in how many runs."""
    if not len(starts):
        return data, 0, 0
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    s = starts[first]
    e = ends[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(ends) - 1]])]
    at, left = 0, []
    for i, j in zip(s.tolist(), e.tolist(), strict=True):
        left.append(data[at:i])
        at = j
    return b"".join([*left, data[at:]]), int((e - s).sum()), len(s)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n, removed, spans = [], [], [], []
        for text, (starts, ends) in zip(batch["text"], _listed(batch["listed"], ["s", "e"]), strict=True):
            data = (text.as_py() or "").encode()
            left, gone, runs = _cut(data, starts.astype(np.int64), ends.astype(np.int64))
            kept.append(left if text.is_valid else None)
            n.append(len(data))
            removed.append(gone)
            spans.append(runs)
        yield pa.record_batch(
            [batch["row"], pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
            ["row", "kept", "n_bytes", "n_removed", "n_spans"],
        )


def cut_repeats(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: the columns but the text as the struct ``row``, the bytes that are ``kept`` (null for a null text),
    ``n_bytes`` (before), ``n_removed``, ``n_spans``."""
    with Workspace(docs.sparkSession) as w:
        found = repeats(docs, w).groupBy(*_KEY).agg(F.collect_set(F.struct("s", "e")).alias("listed"))
        found = w.write(found, "repeat-found")
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), _id().alias("sd_id"), _hash().alias("sd_of"), "text")
        same = (F.col("sd_id") == F.col("sd_doc")) & (F.col("sd_of") == F.col("sd_text"))
        kind = rows.schema["row"].dataType.simpleString()
        schema = f"row {kind}, kept binary, n_bytes long, n_removed long, n_spans long"
        if found.count() > BROADCAST_IDS:
            joined = rows.join(found, same, "left")
            return w.result(map_batches(joined.select("row", "text", "listed"), _kept, schema), found)
        # texts without repeats stay where they are
        ids = F.broadcast(found.select(*_KEY))
        some = rows.join(ids, same, "left_semi").join(found, same)
        none = rows.join(ids, same, "left_anti").withColumn("listed", F.lit(None).cast(found.schema["listed"].dataType))
        out = map_batches(some.select("row", "text", "listed"), _kept, schema).unionByName(map_batches(none.select("row", "text", "listed"), _kept, schema))
        return w.result(out, found)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes removed from ``text``; null texts stay null."""
    out = cut_repeats(docs)
    text = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    return out.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = cut_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))
