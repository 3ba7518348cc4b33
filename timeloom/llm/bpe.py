"""Operator 1, BPE encoding and decoding, by dynamic programming over prefixes.

For every prefix of a piece (a pre-tokenised stretch of text) there is exactly one token that can be the last of its
encoding. It is found among the tokens that end there, which a suffix automaton of the vocabulary gives, as the one
whose predecessor, the last token of the shorter prefix, is compatible with it: byte-pair merging of the two tokens'
bytes must leave the seam between them unmerged. The tokens are stored per prefix, and following them back
from the end emits the ids. No merge loop runs over texts. Different pieces do not depend on each other, so the prefixes of
one length of all new pieces of a batch are taken in one step, on arrays; long pieces are walked one by one.

Vocabulary, merges, added tokens and byte alphabet are read from a tokenizers file on the driver and are sent to the
executors as one broadcast, whose size is that of the vocabulary. Pieces come from the file's pattern: texts within
Latin-1 use a plain regular expression with those classes, others the tokenizers library's own pre-tokeniser.

Defined cases: a null text is encoded as an empty one (no ids, decoded to ""); a piece of any length takes time in
proportion; results of pieces and of pair tests are kept in bounded tables per worker, which change no result; added tokens that stand
in a text are encoded as their ids; repeated rows are encoded each by itself. ``encode_column`` and ``decode_column`` pass all further
columns through, whatever their names; a column that has the name of the new one is replaced, as ``withColumn`` does.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import documents, map_batches

#: Pieces and token pairs whose results a worker keeps at most (pairs have a slot each, so a prime number), characters of a piece that is
#: kept, pieces that are encoded and ids that are decoded at once.
KEPT_PIECES, KEPT_PAIRS, LONGEST_KEPT, PIECES_AT_ONCE, IDS_AT_ONCE = 400_000, 1_000_003, 64, 1 << 15, 1 << 16
_NEVER = 1 << 30

# The pre-tokenisation pattern, with its classes written out for U+0000 to U+00FF.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest in turn from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a tokenizers file says: tokens as bytes, merges in order, added tokens."""

    def __init__(self, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            about = json.load(f)
        model, pre = about["model"], about["pre_tokenizer"] or {}
        odd = [x for x in about["added_tokens"] if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or about["normalizer"] or odd or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        letters = _byte_alphabet()
        self.added = {x["content"]: x["id"] for x in about["added_tokens"]}
        self.tokens = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in self.added}
        ids = {b: i for i, b in self.tokens.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = []
        for a, b in pairs:
            left, right = (bytes(letters[c] for c in x) for x in (a, b))
            self.merges.append((ids[left], ids[right], ids[left + right]))


def suffix_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Of several words: for each state its transitions, its suffix link and the length of its longest string."""
    out: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for word in words:
        last = 0
        for c in word:
            to = out[last].get(c)
            if to is not None and length[to] == length[last] + 1:
                last = to
                continue
            new = -1
            if to is None:
                new = len(out)
                out.append({})
                length.append(length[last] + 1)
                link.append(0)
            p = last
            while new >= 0 and p >= 0 and c not in out[p]:
                out[p][c] = new
                p = link[p]
            if p >= 0:
                q = out[p][c]
                if length[q] != length[p] + 1:
                    twin = len(out)
                    out.append(dict(out[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = twin
                    while p >= 0 and out[p].get(c) == q:
                        out[p][c] = twin
                        p = link[p]
                    q = twin
                if new >= 0:
                    link[new] = q
                else:
                    new = q
            last = new
    return out, link, length


def merge_parts(vocab: Vocabulary, side: int) -> tuple[array, array]:
    """What stands at an end (side 0: left, 1: right) of each token while it is merged: (token, from which rank on, until which
    rank), and where each token's rows begin."""
    made: dict[int, tuple[int, int, int]] = {}
    for rank, (a, b, ab) in enumerate(vocab.merges):
        made.setdefault(ab, (a, b, rank))
    first, rows = array("i", [0]), array("i")
    for token in range(max(vocab.tokens) + 1):
        until, part = _NEVER, token
        while part in made:
            born = made[part][2]
            rows.extend((part, born, until))
            until, part = born, made[part][side]
        rows.extend((part, -1, until))
        first.append(len(rows) // 3)
    return first, rows


def pack_tables(vocab: Vocabulary) -> dict:
    """Flat arrays for the broadcast."""
    ids = sorted(vocab.tokens)
    out, link, length = suffix_automaton([vocab.tokens[i] for i in ids])
    own: dict[int, list[tuple[int, int]]] = {}
    for i in ids:
        state = 0
        for c in vocab.tokens[i]:
            state = out[state][c]
        own.setdefault(state, []).append((len(vocab.tokens[i]), i))
    # The longest token that ends in a state, and the next shorter one that ends a token: all that end in the state, longest first.
    longest, shorter = array("i", [-1]) * len(out), array("i", [-1]) * (ids[-1] + 1)
    for state in sorted(range(len(out)), key=length.__getitem__):
        below = longest[link[state]] if state else -1
        for _, i in sorted(own.get(state, ())):
            shorter[i], below = below, i
        longest[state] = below
    edges = sorted((state << 8 | c, t) for state, to in enumerate(out) for c, t in to.items())
    merges = sorted({a << 20 | b: rank for rank, (a, b, _) in enumerate(vocab.merges)}.items())
    return {
        "ids": array("i", ids), "bytes": [vocab.tokens[i] for i in ids], "keys": array("q", [k for k, _ in edges]), "to": array("i", [t for _, t in edges]),
        "link": array("i", link), "length": array("i", length), "longest": longest, "shorter": shorter,
        "merge_keys": array("q", [k for k, _ in merges]), "merge_ranks": array("i", [r for _, r in merges]), "left": merge_parts(vocab, 0), "right": merge_parts(vocab, 1), "added": vocab.added,
    }


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted keys, -1 for those that are not among the sorted ``keys``."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], -1)


class Encoder:
    def __init__(self, tables: dict):
        self.token = dict(zip(tables["ids"], tables["bytes"], strict=True))
        self.keys, self.to, self.link, self.length, self.longest, self.shorter = (np.asarray(tables[k]) for k in ("keys", "to", "link", "length", "longest", "shorter"))
        self.merge_keys, self.merge_ranks = np.asarray(tables["merge_keys"]), np.asarray(tables["merge_ranks"])
        (self.left_first, self.left), (self.right_first, self.right) = ((np.asarray(first), np.asarray(rows).reshape(-1, 3)) for first, rows in (tables["left"], tables["right"]))
        self.added = tables["added"]
        text_of = self.token | {i: s.encode() for s, i in self.added.items()}
        self.sizes = np.zeros(max(text_of) + 1, np.int64)
        self.sizes[list(text_of)] = [len(b) for b in text_of.values()]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(text_of[i] for i in sorted(text_of)), np.uint8)
        self.pairs = np.full(KEPT_PAIRS, -1, np.int64)
        self.split_added = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.latin = re.compile(LATIN)
        self.library = None
        self.pieces: dict[str, bytes] = {}

    def _judged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of ``a`` and ``b`` gives ``a, b``: no merge across the seam may come up before one of
        the two parts at the seam is merged away. Of equal ranks the left one comes first."""
        a_first, b_first = self.right_first[a], self.left_first[b]
        b_parts = self.left_first[b + 1] - b_first
        each = (self.right_first[a + 1] - a_first) * b_parts
        pair = np.repeat(np.arange(len(a)), each)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        x, x_from, x_until = self.right[a_first[pair] + nth // b_parts[pair]].T
        y, y_from, y_until = self.left[b_first[pair] + nth % b_parts[pair]].T
        rank = _found(self.merge_keys, self.merge_ranks, x.astype(np.int64) << 20 | y)
        merged = (x_from < rank) & (rank < x_until) & (y_from < rank) & (rank <= y_until)
        return np.bincount(pair[merged], minlength=len(a)) == 0

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``_judged``; each slot of the table keeps the last pair that was asked for there."""
        keys = a.astype(np.int64) << 20 | b
        slots = keys % len(self.pairs)
        kept = self.pairs[slots]
        new = np.flatnonzero(kept >> 1 != keys)
        if len(new):
            pairs, back = np.unique(keys[new], return_inverse=True)
            kept[new] = (pairs << 1 | self._judged(pairs >> 20, pairs & 0xFFFFF))[back]
            self.pairs[slots[new]] = kept[new]
        return kept & 1 == 1

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """ids of pieces as little-endian 32-bit words: step by step, the last token of every piece's prefix of that length."""
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        begins = np.cumsum(sizes) - sizes
        letters = np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8)
        last = np.zeros(len(letters), np.int32)
        state, matched = np.zeros(len(pieces), np.int32), np.zeros(len(pieces), np.int32)
        for done in range(sizes[0]):
            n = np.searchsorted(-sizes, -done)  # pieces that are longer
            c = letters[begins[:n] + done].astype(np.int64)
            to = _found(self.keys, self.to, state[:n].astype(np.int64) << 8 | c)
            open_ = np.flatnonzero(to < 0)
            while len(open_):
                back = self.link[state[open_]]
                if back.min() < 0:
                    raise ValueError(f"byte {c[open_[back.argmin()]]} is not in the vocabulary")
                state[open_], matched[open_] = back, self.length[back]
                to[open_] = _found(self.keys, self.to, back.astype(np.int64) << 8 | c[open_])
                open_ = open_[to[open_] < 0]
            state[:n] = to
            matched[:n] += 1
            open_, token = np.arange(n), self.longest[to]
            while len(open_):
                before = done + 1 - self.sizes[token]
                fits = self.sizes[token] <= matched[open_]
                ask = np.flatnonzero(fits & (before > 0))
                fits[ask] = self.compatible(last[begins[open_[ask]] + before[ask] - 1], token[ask])
                last[begins[open_[fits]] + done] = token[fits]
                open_, token = open_[~fits], self.shorter[token[~fits]]
        chosen = np.zeros(len(letters), bool)
        end, open_ = begins + sizes, np.arange(len(pieces))
        while len(open_):
            chosen[end[open_] - 1] = True
            end[open_] -= self.sizes[last[end[open_] - 1]]
            open_ = open_[end[open_] > begins[open_]]
        ids = last[chosen].astype("<u4").tobytes()
        ends = np.add.accumulate(np.add.reduceat(chosen, begins, dtype=np.int64) * 4).tolist()
        out = [b""] * len(pieces)
        for i, start, end in zip(order.tolist(), [0, *ends], ends, strict=False):
            out[i] = ids[start:end]
        return out

    @cached_property
    def _walk(self) -> tuple:
        """The tables as Python's own, for pieces that are walked one by one."""
        return dict(zip(self.keys.tolist(), self.to.tolist(), strict=True)), self.link.tolist(), self.length.tolist(), self.longest.tolist(), self.shorter.tolist(), self.sizes.tolist(), {}

    @cached_property
    def _merge(self) -> dict[int, int]:
        return dict(zip(self.merge_keys.tolist(), self.merge_ranks.tolist(), strict=True))

    def _judged_one(self, a: int, b: int) -> bool:
        """``_judged`` of one pair, which costs arrays too much."""
        rights = self.right[self.right_first[a] : self.right_first[a + 1]].tolist()
        for y, y_from, y_until in self.left[self.left_first[b] : self.left_first[b + 1]].tolist():
            for x, x_from, x_until in rights:
                rank = self._merge.get(x << 20 | y)
                if rank is not None and x_from < rank < x_until and y_from < rank <= y_until:
                    return False
        return True

    def encode_bytes(self, piece: bytes) -> list[int]:
        """ids of one piece of any length."""
        go, link, length, longest, shorter, sizes, pairs = self._walk
        last = [0] * (len(piece) + 1)
        state = matched = 0
        for end, c in enumerate(piece, 1):
            to = go.get(state << 8 | c)
            while to is None:
                state = link[state]
                if state < 0:
                    raise ValueError(f"byte {c} is not in the vocabulary")
                matched = length[state]
                to = go.get(state << 8 | c)
            state = to
            matched += 1
            t = longest[state]
            while True:
                before = end - sizes[t]
                if sizes[t] <= matched:
                    if not before:
                        break
                    key = last[before] << 20 | t
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= KEPT_PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self._judged_one(last[before], t)
                    if fits:
                        break
                t = shorter[t]
            last[end] = t
        ids, end = [], len(piece)
        while end:
            ids.append(last[end])
            end -= sizes[last[end]]
        ids.reverse()
        return ids

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.library is None:
                from tokenizers.pre_tokenizers import ByteLevel

                self.library = ByteLevel(add_prefix_space=False, use_regex=True)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.latin.findall(text)

    def parts(self, text: str | None) -> list[str]:
        """The text's pieces and added tokens, in order."""
        if not text:
            return []
        if self.split_added is None or not any(s in text for s in self.added):
            return self.split(text)
        return [p for part in self.split_added.split(text) for p in ([part] if part in self.added else self.split(part))]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        kept, new = self.pieces, set(parts)
        missing = new.difference(kept)
        if len(kept) + len(missing) > KEPT_PIECES:
            kept.clear()
        else:
            new = missing
        kept.update((p, array("I", [self.added[p]]).tobytes()) for p in new & self.added.keys())
        new -= self.added.keys()
        long = [p for p in new if len(p) > LONGEST_KEPT]
        kept.update((p, array("I", self.encode_bytes(p.encode())).tobytes()) for p in long)
        short = list(new.difference(long))
        for i in range(0, len(short), PIECES_AT_ONCE):
            some = short[i : i + PIECES_AT_ONCE]
            kept.update(zip(some, self.encode_pieces([p.encode() for p in some]), strict=True))
        out = list(map(kept.__getitem__, parts))
        for p in long:
            del kept[p]
        return out

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.parts(x) for x in texts]
        every = list(chain.from_iterable(parts))
        found = iter([x for i in range(0, len(every), KEPT_PIECES) for x in self.encode_parts(every[i : i + KEPT_PIECES])])
        return [b"".join(islice(found, len(x))) for x in parts]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        out, every = [], np.frombuffer(ids, "<u4")
        for i in range(0, len(every), IDS_AT_ONCE):
            some = every[i : i + IDS_AT_ONCE]
            sizes = self.sizes[some]
            if not sizes.all():
                raise KeyError(int(some[sizes.argmin()]))
            shift = self.begins[some] - (np.cumsum(sizes) - sizes)
            out.append(self.letters[np.repeat(shift, sizes) + np.arange(sizes.sum())].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class _Tables:
    """A broadcast under a key that stays the same wherever a worker unpickles it."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.id = hash((path or "", spark.sparkContext.applicationId))
        self.sent = spark.sparkContext.broadcast(pack_tables(Vocabulary(path)))

    @property
    def value(self) -> dict:
        return self.sent.value


_SENT: dict[tuple[str, str | None], _Tables] = {}


def tables_for(spark: SparkSession, path: str | None = None) -> _Tables:
    key = (spark.sparkContext.applicationId, path)
    if key not in _SENT:
        _SENT[key] = _Tables(spark, path)
    return _SENT[key]


def _mapped(df: DataFrame, column: str, new: str, kind: str, arrow: pa.DataType, shared: _Tables, of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            yield pa.record_batch([batch["row_"], pa.array(of(encoder, batch["in_"].to_pylist()), arrow)], ["row_", "out_"])

    others = [F.col(f"`{c}`") for c in df.columns if c != new] or [F.lit(0).alias("none_")]
    boxed = df.select(F.struct(*others).alias("row_"), F.col(f"`{column}`").alias("in_"))
    out = map_batches(boxed, run, f"row_ {boxed.schema['row_'].dataType.simpleString()}, out_ {kind}")
    names = [*df.columns, new] if new not in df.columns else df.columns
    return out.select(*[(F.col("out_") if c == new else F.col("row_").getField(c)).alias(c) for c in names])


def encode_column(df: DataFrame, column: str = "text", new: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the ids of a text column as ``array<int>``."""
    return _mapped(df, column, new, "array<int>", pa.list_(pa.int32()), tables_for(df.sparkSession, path), lambda e, texts: [list(memoryview(x).cast("I")) for x in e.encode_all(texts)])


def decode_column(df: DataFrame, column: str = "ids", new: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of an ``array<int>`` of ids; null ids give an empty text."""
    return _mapped(df, column, new, "string", pa.string(), tables_for(df.sparkSession, path), lambda e, rows: [e.decode(array("I", x or []).tobytes()) for x in rows])


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes each text, decodes the ids again, and gives both as hashes."""
    shared = tables_for(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            every = encoder.encode_all(batch.column(1).to_pylist())
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids).encode()).hexdigest()) for ids in every]
            kinds = [pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, DIGEST)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
