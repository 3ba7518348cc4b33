"""Operator 12, periodic run detection: multi-scale minimizers.

A run is a stretch of consecutive words with a smallest period q and a length of at least ``max(shortest, repeats * q)`` that no
neighbouring word extends with that period. Runs are found in three steps, over all documents of an Arrow batch at once:

* Periods up to ``LAGS`` are too short for grams: every such lag is scanned directly.
* Longer periods are covered by scales ``(low, gram)``, for the periods from low + 1 to gram. A gram as long as the period occurs in
  a run at multiples of the period only. So the minima of windows over hashed grams repeat at exactly the period's distance, and two
  neighbouring equal minimizers are a seed. Windows are as long as the shortest run of the scale allows, so no run is without a seed.
* A seed is extended word by word to both sides; what is long enough is a run. Hashes only propose; words decide.

Stretches that are found with several periods keep the smallest one. A scale reads only documents that are long enough for it.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a text of
any length is read whole, in memory proportional to its words; rows that repeat an id are each worked on by itself; a null
``doc_id`` stays null; an empty table gives an empty table; only ``doc_id`` and ``text`` are read, other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import documents, map_batches

SHORTEST = 24
REPEATS = 3
#: Periods up to this one are scanned lag by lag.
LAGS = 16
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def scales(longest: int, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """(low, gram): scales for all periods from ``LAGS + 1`` on that a text of ``longest`` words has room for."""
    out, low = [], LAGS
    while repeats * (low + 1) <= longest:
        out.append((low, low * 3 // 2))
        low = low * 3 // 2
    return out


def _sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every window of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values, size = best(values[:-size], values[size:]), 2 * size
    return values if size == width else best(values[: len(values) - (width - size)], values[width - size :])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Grams:
    """Hashes of all grams of a sequence, of any length, from prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.full(n, _BASE, np.uint64)
        inverse = np.full(n, _BASE_INVERSE, np.uint64)
        power[:1] = inverse[:1] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(words.astype(np.uint64)) * np.cumprod(power, dtype=np.uint64), out=self.prefix[1:], dtype=np.uint64)

    def of(self, gram: int, stop: int) -> np.ndarray:
        """Hashes of the grams that end at ``stop`` or before."""
        return _mixed((self.prefix[gram : stop + 1] - self.prefix[: stop + 1 - gram]) * self.inverse[: stop + 1 - gram])


def _seeds(hashes: np.ndarray, window: int, low: int, gram: int) -> list[tuple[int, int]]:
    """(distance, position) of neighbouring equal minimizers whose distance is over ``low`` and at most ``gram``."""
    if len(hashes) < window:
        return []
    least = _sliding(np.minimum, hashes, window)
    room = np.zeros(window - 1, np.uint64)
    # a gram is a minimizer if it is the least of some window that holds it; the highest of these windows' minima is then its own
    chosen = np.flatnonzero(hashes == _sliding(np.maximum, np.concatenate([room, least, room]), window))
    held = hashes[chosen]
    order = np.argsort(held, kind="stable")
    held, chosen = held[order], chosen[order]
    apart = chosen[1:] - chosen[:-1]
    found = (held[1:] == held[:-1]) & (apart > low) & (apart <= gram)
    return sorted(zip(apart[found].tolist(), chosen[:-1][found].tolist(), strict=True))


def _extent(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch of positions around ``at`` that equal the word ``lag`` further on."""
    low, high, step = at, at, 64
    while True:
        a, b = words[high : high + step], words[high + lag : high + lag + step]
        odd = np.flatnonzero(a[: len(b)] != b)
        high += int(odd[0]) if len(odd) else len(b)
        if len(odd) or len(b) < step:
            break
        step *= 2
    step = 64
    while low:
        first = max(0, low - step)
        odd = np.flatnonzero(words[first:low] != words[first + lag : low + lag])
        low = first + int(odd[-1]) + 1 if len(odd) else first
        if len(odd):
            break
        step *= 2
    return low, high


def _lag_runs(words: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the stretches of period ``lag`` that have at least ``least`` words."""
    same = np.flatnonzero(words[:-lag] == words[lag:])
    if not len(same):
        return []
    cut = np.flatnonzero(np.diff(same) != 1)
    first, last = same[np.concatenate([[0], cut + 1])], same[np.concatenate([cut, [len(same) - 1]])]
    length = last - first + 1 + lag
    long = length >= least
    return list(zip(first[long].tolist(), length[long].tolist(), strict=True))


def find_runs(texts: list[np.ndarray], shortest: int = SHORTEST, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period. Texts are arrays of word numbers from 0."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.empty(int(starts[-1]), np.int64)
    for k, i in enumerate(order):
        words[starts[k] : starts[k + 1] - 1] = texts[i]
        words[starts[k + 1] - 1] = -1 - k  # unlike all else, so that nothing extends over it
    best: dict[tuple[int, int], int] = {}

    def keep(start: int, length: int, period: int) -> None:
        held = best.get((start, length))
        if held is None or period < held:
            best[start, length] = period

    # texts of at least so many words stand together at the front
    front = lambda least: int(starts[np.searchsorted(-sizes, -least, side="right")])
    for lag in range(1, LAGS + 1):
        least = max(shortest, repeats * lag)
        for start, length in _lag_runs(words[: front(least)], lag, least):
            keep(start, length, lag)
    grams = None
    for low, gram in scales(int(sizes.max(initial=0)), repeats):
        stop = front(max(shortest, repeats * (low + 1)))
        if stop <= gram:
            continue
        grams = grams or Grams(words[:stop])
        window = (repeats - 1) * (low + 1) - gram + 1
        done = (0, 0)  # a lag, and where its last stretch ended
        for lag, at in _seeds(grams.of(gram, stop), window, low, gram):
            if lag == done[0] and at < done[1]:
                continue
            first, last = _extent(words, at, lag)
            done = (lag, last)
            if last - first + lag >= max(shortest, repeats * lag):
                keep(first, last - first + lag, lag)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, length), period in sorted(best.items(), key=lambda x: (x[0][0], x[1])):
        k = int(np.searchsorted(starts, start, side="right")) - 1
        out[order[k]].append((start - int(starts[k]), length, period))
    return out


def _run(shortest: int, repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # bytes.split() splits at the six ASCII white spaces, and nowhere else
            texts = [(x or b"").split() for x in batch.column(1).cast(pa.binary()).to_pylist()]
            known: dict[bytes, int] = {}
            fresh = count()
            numbered = [np.fromiter((known[w] if w in known else known.setdefault(w, next(fresh)) for w in t), np.int64, len(t)) for t in texts]
            found = find_runs(numbered, shortest, repeats)
            kept = []
            for words, runs in zip(texts, found, strict=True):
                if runs:
                    stay = np.ones(len(words), bool)
                    for start, length, period in runs:
                        stay[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(stay)]
                kept.append(b" ".join(words))
            runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], _RUN)
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text, and its words joined by spaces without those that any run holds
    after its first period. ``repeats`` is three or more: with less, a scale's windows would have no room."""
    if repeats < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), _run(shortest, repeats), RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the crc32 of its id, repeats its words from a place on with a period; both follow from
    the crc32 as well. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h_")).withColumn("g_", F.expr("h_ div 10"))
    hit = F.coalesce(F.col("h_") % 10 == 0, F.lit(False))
    some = rows.filter(hit).withColumn("w_", F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    some = some.filter("size(w_) > 0").withColumn("a_", F.expr("g_ % size(w_)"))
    some = some.withColumn("p_", F.expr("1 + (size(w_) - a_) div (3 + g_ % 8)"))
    moved = F.expr("transform(sequence(0L, CAST(size(w_) AS bigint) - 1), i -> IF(i < a_, i, a_ + (i - a_) % p_))")
    some = some.withColumn("i_", moved).select("doc_id", F.array_join(F.expr("transform(i_, i -> w_[CAST(i AS int)])"), " ").alias("text"))
    # texts without words have nothing to repeat
    return rows.filter(~hit | F.coalesce(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(True))).select("doc_id", "text").unionByName(some)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    runs = periodic_runs(planted(documents(spark, sf_dir)))
    greatest = F.expr("""array_sort(runs, (a, b) -> CASE WHEN a.length * b.period > b.length * a.period THEN -1 WHEN a.length * b.period < b.length * a.period THEN 1
        WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 WHEN a.period < b.period THEN -1 ELSE 1 END)""")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = runs.withColumn("best_", F.get(greatest, F.lit(0)))
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best_.start", "best_.length", "best_.period",
        F.expr("1000 * best_.length div best_.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
