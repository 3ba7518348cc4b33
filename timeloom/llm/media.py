"""Operator 6, media columns: ISO base media containers.

``store_payload`` writes bytes losslessly as one 8-bit mono sound track of an ISO media file; ``walk_boxes``
walks nested boxes, ``read_track`` decodes the sample tables, and ``describe`` gives codec, duration and the
byte ranges of the keyframes without decoding a sample. Reading works on any file of the format
with one track of interest: sizes of 0 and of 64 bits, ``stco`` or ``co64``, ``stsz`` with and without a
common size, several ``stsc`` runs, a missing ``stss`` (every sample is then a keyframe), and fragmented files, whose
samples are in the runs (``trun``) of ``moof`` boxes.

Every size, count, index and range is held against the file before it is used, so that a broken file costs no more
than its own size; boxes nest ``DEEPEST`` deep at most, and are walked without recursion.

Defined cases: a null text is the empty payload, 64 zero bytes; equal texts give equal files (no clock, no
row number is stored); a file that is broken or has no track raises ``ContainerError`` from the readers, and ``describe_column``
returns its message in ``error`` and null figures; further columns pass through, whatever their names, repeated rows each by itself.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import documents, map_batches

UNIT = 64
TIMESCALE = 8000
SAMPLES_PER_CHUNK = 256
KEYFRAME_EVERY = 32
#: Boxes that hold boxes, and how deep they may.
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
DEEPEST = 32


class ContainerError(ValueError):
    pass


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``UNIT``."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def store_payload(payload: bytes) -> bytes:
    """A file with one ``raw `` sound track of 8-bit samples: each access unit is ``UNIT`` samples of a byte."""
    if not payload or len(payload) % UNIT:
        raise ContainerError(f"a payload of {len(payload)} bytes is no positive multiple of {UNIT}")
    units = len(payload) // UNIT
    chunks = -(-units // SAMPLES_PER_CHUNK)
    ticks, rest = len(payload), units % SAMPLES_PER_CHUNK
    runs = [(1, SAMPLES_PER_CHUNK, 1)] if units >= SAMPLES_PER_CHUNK else []
    if rest:
        runs.append((chunks, rest, 1))
    keys = range(1, units + 1, KEYFRAME_EVERY)

    def moov(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
        offsets = [first + i * SAMPLES_PER_CHUNK * UNIT for i in range(chunks)]
        stbl = _box(
            b"stbl",
            _full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, 0, struct.pack(">III", 1, units, UNIT)),
            _full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", 0, 0, struct.pack(">II", UNIT, units)),
            _full(b"stco", 0, 0, struct.pack(f">I{chunks}I", chunks, *offsets)),
        )
        dref = _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1))
        minf = _box(b"minf", _full(b"smhd", 0, 0, bytes(4)), _box(b"dinf", dref), stbl)
        mdhd = _full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0))
        hdlr = _full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(12), b"payload\0")
        tkhd = _full(b"tkhd", 0, 7, struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, bytes(8))
        mvhd = _full(b"mvhd", 0, 0, struct.pack(">IIIIIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    first = len(_FTYP) + len(moov(0)) + 8
    return b"".join((_FTYP, moov(first), struct.pack(">I4s", len(payload) + 8, b"mdat"), payload))


def walk_boxes(data: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """(depth, kind, start of the body, end) of every box, parents before what they hold."""
    start, ends = 0, [len(data)]
    while True:
        while ends and start == ends[-1]:
            ends.pop()
        if not ends:
            return
        end = ends[-1]
        if end - start < 8:
            raise ContainerError(f"{end - start} bytes at {start} are no box")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ContainerError(f"the box at {start} lacks its long size")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if not body <= stop <= end:
            raise ContainerError(f"the box at {start} says it has {size} bytes")
        yield len(ends) - 1, kind, body, stop
        if kind in NESTS:
            if len(ends) > DEEPEST:
                raise ContainerError(f"boxes are nested more than {DEEPEST} deep")
            ends.append(stop)
            start = body
        else:
            start = stop


class Body:
    """What is in a box; reading past its end is a ``ContainerError``."""

    def __init__(self, data: bytes, kind: bytes, start: int, end: int):
        self.data, self.kind, self.start, self.end = data, kind.decode("latin-1"), start, end

    def read(self, form: str, at: int) -> tuple:
        if self.start + at + struct.calcsize(f">{form}") > self.end:
            raise ContainerError(f"{self.kind} is cut off")
        return struct.unpack_from(f">{form}", self.data, self.start + at)

    def flags(self) -> int:
        return self.read("I", 0)[0] & 0xFFFFFF

    def rows(self, form: str, at: int, n: int) -> Iterator[tuple]:
        """``n`` rows from ``at`` on."""
        first, size = self.start + at, n * struct.calcsize(f">{form}")
        if first + size > self.end:
            raise ContainerError(f"{self.kind} counts {n} rows and is cut off")
        return struct.iter_unpack(f">{form}", self.data[first : first + size])

    def table(self, form: str) -> list[tuple]:
        """The rows of a full box that counts them."""
        return list(self.rows(form, 8, self.read("I", 4)[0]))


@dataclass
class Track:
    codec: str
    handler: str
    timescale: int
    ticks: int
    sizes: list[int]
    chunks: list[tuple[int, int]]  # byte offset, samples
    keyframes: list[int] | None  # from 0; None: all

    @property
    def count(self) -> int:
        return len(self.sizes)

    def ranges(self) -> list[tuple[int, int]]:
        """(offset, length) of every sample."""
        out, at = [], 0
        for offset, n in self.chunks:
            for length in self.sizes[at : at + n]:
                out.append((offset, length))
                offset += length
            at += n
        return out

    def chunk_ranges(self) -> list[tuple[int, int]]:
        out, at = [], 0
        for offset, n in self.chunks:
            out.append((offset, sum(self.sizes[at : at + n])))
            at += n
        return out


def _boxes(data: bytes) -> tuple[list[dict[bytes, Body]], dict[int, Body], list[tuple[int, dict[bytes, list[Body]]]]]:
    """The boxes of each track, ``trex`` by track, and (start of its moof, boxes) of each track fragment."""
    tracks, extends, fragments, path, moof = [], {}, [], [], 0
    for depth, kind, start, end in walk_boxes(data):
        del path[depth:]
        path.append(kind)
        box = Body(data, kind, start, end)
        if path == [b"moov", b"trak"]:
            tracks.append({})
        elif path[:2] == [b"moov", b"trak"]:
            tracks[-1].setdefault(kind, box)
        elif path == [b"moov", b"mvex", b"trex"]:
            extends[box.read("I", 4)[0]] = box
        elif path == [b"moof"]:
            moof = start - 8
        elif path == [b"moof", b"traf"]:
            fragments.append((moof, {}))
        elif path[:2] == [b"moof", b"traf"]:
            fragments[-1][1].setdefault(kind, []).append(box)
    return tracks, extends, fragments


def _handler(boxes: dict[bytes, Body]) -> str:
    return boxes[b"hdlr"].read("4s", 8)[0].decode("latin-1") if b"hdlr" in boxes else ""


def read_track(data: bytes, handler: str | None = None) -> Track:
    """The first track with sample tables (of that handler), these decoded and held against the file."""
    tracks, extends, fragments = _boxes(data)
    for boxes in tracks:
        if b"stbl" in boxes and (handler is None or _handler(boxes) == handler):
            break
    else:
        raise ContainerError(f"no track{f' of {handler}' if handler else ''}")
    missing = [k.decode() for k in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz") if k not in boxes]
    if missing or not (b"stco" in boxes or b"co64" in boxes):
        raise ContainerError(f"a track without {', '.join(missing) or 'stco'}")
    track = _decode(boxes, len(data))
    number = boxes[b"tkhd"].read("I", 20 if boxes[b"tkhd"].read("B", 0)[0] == 1 else 12)[0] if b"tkhd" in boxes else 0
    _add_fragments(track, number, extends.get(number), [f for f in fragments if _of_track(f[1]) == number], len(data))
    for offset, n in track.chunk_ranges():
        if not 0 <= offset <= offset + n <= len(data):
            raise ContainerError(f"{n} bytes at {offset} are not in the file")
    return track


def _decode(boxes: dict[bytes, Body], size: int) -> Track:
    mdhd = boxes[b"mdhd"]
    scale, ticks = mdhd.read("Iq", 20) if mdhd.read("B", 0)[0] == 1 else mdhd.read("II", 12)
    if ticks < 0:  # all ones: unknown
        ticks = 0
    codec = boxes[b"stsd"].read("4s", 12)[0].decode("latin-1")
    stsz = boxes[b"stsz"]
    common, count = stsz.read("II", 4)
    if common * count > size:
        raise ContainerError(f"{count} samples of {common} bytes are not in the file")
    sizes = [common] * count if common else [x for (x,) in stsz.rows("I", 12, count)]
    offsets = [x for (x,) in (boxes[b"stco"].table("I") if b"stco" in boxes else boxes[b"co64"].table("Q"))]
    runs = boxes[b"stsc"].table("III")
    firsts = [first for first, *_ in runs]
    afters = [*firsts[1:], len(offsets) + 1] if runs else []
    if offsets and firsts[:1] != [1] or any(a >= b for a, b in zip(firsts, afters, strict=True)):
        raise ContainerError("stsc is not in order, or names chunks that there are not")
    chunks = []
    for (first, per, _), after in zip(runs, afters, strict=True):
        chunks += [(o, per) for o in offsets[first - 1 : after - 1]]
    if sum(n for _, n in chunks) != count:
        raise ContainerError("the chunks do not hold the samples that are counted")
    if sum(n for n, _ in boxes[b"stts"].table("II")) != count:
        raise ContainerError("the times are not those of the samples")
    keys = [x - 1 for (x,) in boxes[b"stss"].table("I")] if b"stss" in boxes else None
    if keys and not (keys[0] >= 0 and keys[-1] < count and all(a < b for a, b in zip(keys, keys[1:], strict=False))):
        raise ContainerError("stss is not in order, or names samples that there are not")
    return Track(codec, _handler(boxes), scale, ticks, sizes, chunks, keys)


def _of_track(boxes: dict[bytes, list[Body]]) -> int:
    if b"tfhd" not in boxes:
        raise ContainerError("a track fragment without tfhd")
    return boxes[b"tfhd"][0].read("I", 4)[0]


def _add_fragments(track: Track, number: int, trex: Body | None, fragments: list, size: int) -> None:
    """The samples of a track's fragments: each run is a chunk. A sample is a keyframe unless its flags say otherwise."""
    if not fragments:
        return
    defaults = trex.read("III", 12) if trex else (0, 0, 0)  # duration, size, flags
    keys = list(range(track.count)) if track.keyframes is None else track.keyframes
    lasts = bare = 0
    for moof, boxes in fragments:
        tfhd = boxes[b"tfhd"][0]
        flags, at, own, base = tfhd.flags(), 8, list(defaults), moof
        if flags & 0x1:
            base, at = tfhd.read("Q", at)[0], at + 8
        at += 4 if flags & 0x2 else 0
        for i, bit in enumerate((0x8, 0x10, 0x20)):
            if flags & bit:
                own[i], at = tfhd.read("I", at)[0], at + 4
        offset = base
        for trun in boxes.get(b"trun", ()):
            n, flags, at = trun.read("I", 4)[0], trun.flags(), 8
            if flags & 0x1:
                offset, at = base + trun.read("i", at)[0], at + 4
            first = own[2]
            if flags & 0x4:
                first, at = trun.read("I", at)[0], at + 4
            held = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            # such samples have no bytes of tables; together they are no more than the file has bytes
            bare += 0 if held else n
            if bare > size:
                raise ContainerError(f"runs of {bare} samples are longer than the file")
            rows = trun.rows("I" * len(held), at, n) if held else ((),) * n
            was = track.count
            for i, row in enumerate(rows):
                said = dict(zip(held, row, strict=True))
                lasts += said.get(0x100, own[0])
                track.sizes.append(said.get(0x200, own[1]))
                if not said.get(0x400, first if i == 0 else own[2]) & 0x10000:
                    keys.append(was + i)
            track.chunks.append((offset, n))
            offset += sum(track.sizes[was:])
    track.ticks = max(track.ticks, lasts)
    track.keyframes = keys


def load_payload(data: bytes) -> bytes:
    """The track's bytes, read from the file by its own tables."""
    return b"".join(data[o : o + n] for o, n in read_track(data).chunk_ranges())


def describe(data: bytes) -> dict:
    """Codec, duration and keyframe byte ranges; reads tables only."""
    track = read_track(data)
    at = track.ranges()
    keys = at if track.keyframes is None else [at[i] for i in track.keyframes]
    return {"codec": track.codec, "timescale": track.timescale, "duration_ticks": track.ticks, "n_samples": track.count, "keyframes": keys}


def feature_of(about: dict) -> str:
    """``describe``'s result in one line; the keyframe ranges by count, first, last and a hash of all."""
    keys = about["keyframes"]
    all_of = hashlib.sha256(b"".join(struct.pack("<QQ", *k) for k in keys)).hexdigest()[:16]
    ends = f"{keys[0][0]}+{keys[0][1]}..{keys[-1][0]}+{keys[-1][1]}" if keys else "none"
    return f"codec={about['codec'].strip()};duration={about['duration_ticks']}/{about['timescale']};samples={about['n_samples']};keyframes={len(keys)};ranges={ends};sha={all_of}"


def describe_column(files: DataFrame, column: str, new: str = "media") -> DataFrame:
    """``files`` with the struct ``new`` of ``codec, timescale, duration_ticks, n_samples, keyframes, error`` for the containers in
    ``column``. A column that has that name is replaced, as ``withColumn`` does."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([
            ("codec", pa.string()), ("timescale", pa.int64()), ("duration_ticks", pa.int64()), ("n_samples", pa.int64()),
            ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))), ("error", pa.string()),
        ])
        for batch in batches:
            rows = []
            for x in batch["media_"]:
                try:
                    about = describe(x.as_py() or b"")
                    about["keyframes"] = [{"offset": o, "length": n} for o, n in about["keyframes"]]
                    rows.append(about | {"error": None})
                except ContainerError as e:
                    rows.append({"error": str(e)})
            yield pa.record_batch([batch["row_"], pa.array(rows, kind)], ["row_", "about_"])

    boxed = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("row_"), F.col(f"`{column}`").cast("binary").alias("media_"))
    about = "struct<codec:string,timescale:bigint,duration_ticks:bigint,n_samples:bigint,keyframes:array<struct<offset:bigint,length:bigint>>,error:string>"
    out = map_batches(boxed, run, f"row_ {boxed.schema['row_'].dataType.simpleString()}, about_ {about}")
    names = [*files.columns, new] if new not in files.columns else files.columns
    return out.select(*[(F.col("about_") if c == new else F.col("row_").getField(c)).alias(c) for c in names])


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            media = store_payload(pad(raw))
            back = load_payload(media)
            rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(describe(media))))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in DIGEST.split(", ")]
        yield pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))], names)


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    return map_batches(documents(spark, sf_dir).select("doc_id", "text"), _digest, DIGEST)
