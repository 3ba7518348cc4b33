"""Operator 5, packing: bounded-space online best fit.

Every task encodes the documents of its partition as they come and keeps a fixed number of open windows. Whole
windows of a document are emitted at once; the rest is placed in the open window where it fits best. When none fits, the
fullest is topped up with the piece's first tokens (unless the cut-off part were shorter than ``MIN_CUT``) and
emitted. What a task has open at its end is merged in a second, distributed step, in groups
of a bounded number of windows. So memory is bounded by ``OPEN_WINDOWS`` windows in a task, whatever the input,
and only the pieces' descriptions are shuffled, never tokens or texts.

Defined cases: a null or empty text has the end token alone; a text of any length is cut as often as needed;
documents with equal ids are packed each by itself; a null ``doc_id`` stays null, ids of all 64 bits stay as they are; an empty table gives no piece; only
``doc_id`` and ``text`` are read. Ids are those of the tokenizers file, added tokens included; the tiktoken library makes them
from the same vocabulary (tests hold them against tokenizers). Its splitter gives up on very long white space: texts with such go
through the encoder of operator 1, which splits without backtracking.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, Vocabulary, default_path, pack_tables
from .storage import Workspace, documents, map_batches

CAPACITY = 1024
OPEN_WINDOWS = 64
MIN_CUT = 16
END_ID = 0
#: White space of this length, at which tiktoken's splitter is quadratic, goes to the encoder of operator 1. It is looked for where a stretch begins only.
_LONG_SPACE = re.compile(r"(?:^|\S)\s{256}")
#: Left-over windows that are merged in one group, about.
MERGE_GROUP = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"
_COLUMNS = [x.split()[0] for x in PIECES.split(", ")]


class Tokens:
    """Ids of texts, made by tiktoken from a tokenizers file."""

    _held: dict[str, Tokens] = {}

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        vocab = Vocabulary(path)
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={b: i for i, b in vocab.tokens.items()}, special_tokens=vocab.added)
        self.added = set(vocab.added)
        self.path, self.encoder = path, None

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            found = ()
        elif _LONG_SPACE.search(text):
            self.encoder = self.encoder or Encoder(pack_tables(Vocabulary(self.path)))
            found = np.frombuffer(self.encoder.encode(text), "<u4")
        else:
            found = self.encoding.encode_to_numpy(text, allowed_special=self.added, disallowed_special=())
        out = np.empty(len(found) + 1, "<u4")
        out[:-1] = found
        out[-1] = END_ID
        return out


class Windows:
    """The open windows of a task. ``pieces``: rows of a window, as (document, start, length, crc, document's tokens, offset)."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.open: list[tuple[int, list[tuple]]] = []  # filled, pieces

    def close(self, pieces: list[tuple]) -> list[tuple]:
        window, self.next_id = self.next_id, self.next_id + 1
        return [(*p[:5], window, p[5], False) for p in pieces]

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        """Places a document; returns the rows of the windows that were emitted."""
        out, total, start = [], len(ids), 0
        piece = lambda n, at: (doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), total, at)
        while total - start >= self.capacity:
            out += self.close([piece(self.capacity, 0)])
            start += self.capacity
        while left := total - start:
            fits = [i for i, (filled, _) in enumerate(self.open) if filled + left <= self.capacity]
            if fits:
                i = max(fits, key=lambda i: self.open[i][0])
            elif len(self.open) < self.most:
                self.open.append((0, []))
                i = len(self.open) - 1
            else:
                i = max(range(len(self.open)), key=lambda i: self.open[i][0])
                filled, pieces = self.open.pop(i)
                gap = self.capacity - filled
                if gap >= MIN_CUT and left - gap >= MIN_CUT:
                    pieces = [*pieces, piece(gap, filled)]
                    start += gap
                out += self.close(pieces)
                continue
            filled, pieces = self.open[i]
            pieces.append(piece(left, filled))
            self.open[i] = (filled + left, pieces)
            start = total
            if filled + left == self.capacity:
                out += self.close(self.open.pop(i)[1])
        return out

    def rest(self) -> list[tuple]:
        """Rows of the windows that are still open, each under an id of its own."""
        return [(*row[:7], True) for _, pieces in self.open for row in self.close(pieces)]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.bool_()]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _COLUMNS)


def _place(path: str, capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(path)
        windows = Windows(capacity, most, TaskContext.get().partitionId() << 32)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += windows.add(doc, tokens.ids(text.as_py()))
            yield _table(rows)
        yield _table(windows.rest())

    return run


def _merge(capacity: int):
    """Whole left-over windows of a group into as few as best fit, largest first, needs."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        # Arrow and not pandas, which would turn a column of ids with a null into floats
        sizes: dict[int, int] = {}
        for old, length in zip(rows["sequence_id"].to_pylist(), rows["length"].to_pylist(), strict=True):
            sizes[old] = sizes.get(old, 0) + length
        by_room: dict[int, list[int]] = {}
        window_of, shift_of, windows = {}, {}, 0
        for old, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            room = next((r for r in range(size, capacity + 1) if by_room.get(r)), None)
            if room is None:
                window, room, windows = windows, capacity, windows + 1
            else:
                window = by_room[room].pop()
            window_of[old], shift_of[old] = window, capacity - room
            by_room.setdefault(room - size, []).append(window)
        first = (1 << 62) | (key[0].as_py() << 32)
        old = rows["sequence_id"].to_pylist()
        new = {
            "sequence_id": pa.array([first + window_of[w] for w in old], pa.int64()), "open": pa.array([False] * len(old)),
            "offset": pa.array([at + shift_of[w] for at, w in zip(rows["offset"].to_pylist(), old, strict=True)], pa.int64()),
        }
        return pa.table({c: new.get(c, rows[c]) for c in _COLUMNS})

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """A row per piece: which tokens of which document stand in which sequence, and where."""
    with Workspace(docs.sparkSession) as w:
        placed = map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), _place(path or default_path(), capacity, open_windows), PIECES)
        placed = w.write(placed, "packed")
        left = placed.filter("open")
        n = left.select("sequence_id").distinct().count()
        groups = max(1, round(n / MERGE_GROUP))
        grouped = left.withColumn("pk_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
        merged = grouped.groupBy("pk_group").applyInArrow(_merge(capacity), PIECES)
        return w.result(placed.filter("not open").unionByName(merged).drop("open"), placed)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
