import hashlib
import struct
import zlib

import pytest

from timeloom.llm import media as M

from .cases import TEXTS, frame


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 64 * 255, 64 * 256, 64 * 256 + 1, 64 * 600 + 5])
def test_round_trip_and_ranges(n):
    data = bytes(i * 7 % 251 for i in range(n))
    file = M.store_payload(M.pad(data))
    assert M.load_payload(file) == M.pad(data)
    about = M.describe(file)
    units = len(M.pad(data)) // 64
    assert (about["codec"], about["n_samples"], about["duration_ticks"]) == ("raw ", units, units * 64)
    assert [file[o : o + k] for o, k in about["keyframes"]] == [M.pad(data)[i * 64 : i * 64 + 64] for i in range(0, units, M.KEYFRAME_EVERY)]
    kinds = [k for _, k, *_ in M.walk_boxes(file)]
    assert kinds[:3] == [b"ftyp", b"moov", b"mvhd"] and kinds[-1] == b"mdat"


def test_broken_files_raise():
    file = M.store_payload(M.pad(b"abc"))
    for bad in (b"", b"1234", file[:100], file.replace(b"stsz", b"free"), struct.pack(">I4s", 3, b"moov")):
        with pytest.raises(M.ContainerError):
            M.read_track(bad)


def test_varied_tables():
    """Sizes of each sample, 64-bit offsets, a long box size, and no stss."""
    file = M.store_payload(M.pad(b"x" * 200))
    track = M.read_track(file)
    assert track.count == 4
    stss = next((b, e) for _, k, b, e in M.walk_boxes(file) if k == b"stss")
    assert len(M.describe(file[: stss[0] - 4] + b"skip" + file[stss[0] :])["keyframes"]) == 4
    big = struct.pack(">I4sQ", 1, b"free", 20) + b"1234"
    assert M.load_payload(file + big) == M.pad(b"x" * 200)


def test_query_digest(spark):
    rows = {r.doc_id: r for r in frame(spark).select("doc_id", "text").mapInArrow(M._digest, M.DIGEST).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        r, payload = rows[i], M.pad(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        file = M.store_payload(payload)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert rows[0].media_sha256 == rows[1].media_sha256
    assert frame(spark, []).select("doc_id", "text").mapInArrow(M._digest, M.DIGEST).count() == 0


def test_describe_column(spark):
    rows = [(1, bytearray(M.store_payload(M.pad(b"q" * 5000)))), (2, bytearray(b"junk")), (3, None)]
    out = {r.doc_id: r for r in M.describe_column(spark.createDataFrame(rows, "doc_id long, blob binary"), "blob").collect()}
    assert out[1].media.codec == "raw " and out[1].media.keyframes[0].length == 64 and out[1].media.error is None
    assert out[2].media.error and out[3].media.error and out[2].media.codec is None


def plain_read(file):
    """The payload, codec and keyframe ranges of a stored file, by a search for its tables and nothing of the module."""
    at = lambda kind: file.index(kind) + 4
    word = lambda i: int.from_bytes(file[i : i + 4], "big")
    size, count = word(at(b"stsz") + 4), word(at(b"stsz") + 8)
    offsets = [word(at(b"stco") + 8 + 4 * i) for i in range(word(at(b"stco") + 4))]
    runs = [[word(at(b"stsc") + 8 + 12 * i + 4 * k) for k in (0, 1)] for i in range(word(at(b"stsc") + 4))]
    per = [next(n for first, n in reversed(runs) if first <= i + 1) for i in range(len(offsets))]
    samples = [(o + size * k, size) for o, n in zip(offsets, per, strict=True) for k in range(n)]
    assert len(samples) == count
    keys = [samples[word(at(b"stss") + 8 + 4 * i) - 1] for i in range(word(at(b"stss") + 4))]
    return b"".join(file[o : o + n] for o, n in samples), file[at(b"stsd") + 12 : at(b"stsd") + 16].decode(), keys, word(at(b"mdhd") + 16), word(at(b"mdhd") + 12)


@pytest.mark.parametrize("n", [0, 64 * 255, 64 * 256 + 1, 64 * 1500])
def test_stored_form_by_an_independent_reader(n):
    data = bytes(i * 11 % 253 for i in range(n))
    file = M.store_payload(M.pad(data))
    payload, codec, keys, ticks, scale = plain_read(file)
    assert payload == M.pad(data) and codec == "raw "
    text = hashlib.sha256(b"".join(struct.pack("<QQ", *k) for k in keys)).hexdigest()[:16]
    first, last = keys[0], keys[-1]
    assert M.feature_of(M.describe(file)) == f"codec=raw;duration={ticks}/{scale};samples={len(payload) // 64};keyframes={len(keys)};ranges={first[0]}+64..{last[0]}+64;sha={text}"


def read_or_error(file):
    for read in (M.describe, M.load_payload):
        try:
            read(file)
        except M.ContainerError:
            pass


def test_every_flipped_or_missing_byte_is_read_or_an_error():
    for file in (M.store_payload(M.pad(b"abc" * 50)), fragmented()[0]):
        for i in range(len(file)):
            read_or_error(file[:i])
            for x in (0x00, 0x01, 0x7F, 0x80, 0xFF):
                read_or_error(file[:i] + bytes([x]) + file[i + 1 :])
            read_or_error(file[:i] + b"\xff\xff\xff\xff" + file[i + 4 :])


def test_ranges_that_are_not_in_the_file():
    file = bytearray(M.store_payload(M.pad(b"abc" * 500)))
    for kind, at, value in ((b"stco", 8, 100_000_000), (b"stss", 8, 0), (b"stss", 8, 1 << 20), (b"stsz", 4, 1 << 31), (b"stsc", 8, 2)):
        bad = bytearray(file)
        i = bad.index(kind) + 4 + at
        bad[i : i + 4] = struct.pack(">I", value)
        with pytest.raises(M.ContainerError):
            M.describe(bytes(bad))
    nested = b"x"
    for _ in range(3000):
        nested = M._box(b"udta", nested)
    with pytest.raises(M.ContainerError):
        M.read_track(nested)


def fragmented():
    """A file of two fragments: the first with sizes and flags of its own, the second with those of its header."""
    full, box = M._full, M._box
    stbl = box(b"stbl", full(b"stsd", 0, 0, struct.pack(">I", 1), box(b"avc1", bytes(78))), *(full(k, 0, 0, bytes(4)) for k in (b"stts", b"stsc", b"stco")), full(b"stsz", 0, 0, bytes(8)))
    tkhd = full(b"tkhd", 0, 7, struct.pack(">III", 0, 0, 5), bytes(68))
    mdhd, hdlr = full(b"mdhd", 0, 0, struct.pack(">IIIII", 0, 0, 1000, 0, 0)), full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(12), b"v\0")
    trex = full(b"trex", 0, 0, struct.pack(">IIIII", 5, 1, 40, 10, 0x10000))
    init = M._FTYP + box(b"moov", box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", stbl))), box(b"mvex", trex))

    def fragment(trun_flags, head, rows, data):
        def moof(offset):
            trun = full(b"trun", 0, trun_flags, struct.pack(">Ii", len(rows) or 4, offset), head, *rows)
            return box(b"moof", full(b"mfhd", 0, 0, struct.pack(">I", 1)), box(b"traf", full(b"tfhd", 0, 0x20000, struct.pack(">I", 5)), trun))

        return moof(len(moof(0)) + 8) + box(b"mdat", data)

    one = fragment(0x1 | 0x200 | 0x400, b"", [struct.pack(">II", 7, 0), struct.pack(">II", 9, 0x10000), struct.pack(">II", 4, 0)], b"A" * 7 + b"B" * 9 + b"C" * 4)
    two = fragment(0x1 | 0x4, struct.pack(">I", 0), [], b"D" * 40)
    return init + one + two, init


def test_fragmented_files():
    file, init = fragmented()
    about = M.describe(init)
    assert (about["codec"], about["n_samples"], about["keyframes"]) == ("avc1", 0, [])
    about = M.describe(file)
    assert (about["codec"], about["n_samples"], about["duration_ticks"]) == ("avc1", 7, 7 * 40)
    assert [file[o : o + n] for o, n in about["keyframes"]] == [b"A" * 7, b"C" * 4, b"D" * 10]
    assert M.load_payload(file) == b"A" * 7 + b"B" * 9 + b"C" * 4 + b"D" * 40


def test_columns_of_clashing_names(spark):
    rows = [("mine", bytearray(M.store_payload(M.pad(b"x"))), 3, "r")]
    df = spark.createDataFrame(rows, "codec string, blob binary, error long, row_ string")
    out = M.describe_column(df, "blob")
    r = out.first()
    assert out.columns == [*df.columns, "media"] and (r.codec, r.error, r.row_, r.media.codec) == ("mine", 3, "r", "raw ")


def test_very_long_texts(spark):
    text = "long text " * 900_000
    r = frame(spark, [text]).select("doc_id", "text").mapInArrow(M._digest, M.DIGEST).first()
    assert r.n_bytes == len(text) and r.payload_sha256 == hashlib.sha256(M.pad(text.encode())).hexdigest()
