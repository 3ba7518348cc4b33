"""Operator 2, language ID by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of labelled text is built. A text is parsed into phrases,
each the longest match in that language's sample; the language that needs the fewest phrases, normalised by the
sample's size (Ziv and Merhav: phrases * log2(sample) / characters), wins. The automata are flattened to
tables, or sorted transitions where a sample has many letters, in which a step that ends a phrase says so, and whole batches are
parsed in step, one character of every block at a time; blocks of ``BLOCK`` characters end a phrase.

Learning reads rows whose crc32(doc_id as text) mod 3 is not 1, with a language and a text, from which it takes at most
``DOCS_PER_LANGUAGE`` documents, of the smallest hashes, and ``CHARS_PER_LANGUAGE`` characters a language (fewer where there
are more than ``LANGUAGES_AT_FULL`` languages). Of more than ``MOST_LANGUAGES`` languages those with the most rows are learned, of equal
counts those that sort first. Predictions read the text alone.

Defined cases: a null text, or one without letters, is ``und`` with score 0; ties go to the name that sorts first; with
nothing to learn from, every text is ``und``; texts of any length are read whole; repeated rows are predicted each by itself; further
columns pass through whatever their names; a null ``doc_id`` is neither learned from nor held out. Upper and lower case
are alike; all that is no letter is one character; letters of no sample match nothing in any language.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import suffix_automaton
from .storage import documents, map_batches

CHARS_PER_LANGUAGE = 48_000
DOCS_PER_LANGUAGE = 96
LANGUAGES_AT_FULL = 6
MOST_LANGUAGES = 512
BLOCK = 512
UNKNOWN = "und"
#: Codes of the end of a block, of what is no letter, and of letters of no sample.
_PAD, _GAP, _OTHER = 0, 1, 2
_SHIFT = 29
#: Codes of a sample up to which its table has a column for each; beyond, its transitions are searched.
DENSE_WIDTH = 256


def bucket_of(doc_id) -> F.Column:
    """crc32 of the id as text, mod 3; 1: held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


def learning_sample(docs: DataFrame) -> dict[str, str]:
    """A bounded text per language. At most ``DOCS_PER_LANGUAGE`` documents of ``MOST_LANGUAGES`` languages reach the driver."""
    labelled = docs.filter(F.col("lang").isNotNull() & (bucket_of(F.col("doc_id")) != 1))
    # counted without a look at the texts, so that their column is not read for it
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r.lang: r.n for r in counts.collect()}
    rows = labelled.filter(F.col("text").isNotNull())
    if not counts:
        return {}
    # a share of the hash range that holds four times what is taken, so that ranking sees few rows
    share = [(lang, min(1.0, 4 * DOCS_PER_LANGUAGE / n)) for lang, n in counts.items()]
    share = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, li_share double"))
    spread = F.xxhash64("doc_id", F.lit(17))
    hashed = rows.select("lang", "text", spread.alias("li_h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("li_h", "text"))

    def first(near: DataFrame) -> list:
        best = near.withColumn("li_r", rank).filter(F.col("li_r") <= DOCS_PER_LANGUAGE)
        return best.select("lang", "li_h", F.substring("text", 1, CHARS_PER_LANGUAGE).alias("text")).collect()

    taken = first(hashed.join(share, "lang").filter(F.shiftrightunsigned("li_h", 1) / F.lit(float(1 << 63)) <= F.col("li_share")))
    # null texts were counted too: a language that has most of them may miss documents in its share, and is ranked whole
    got = Counter(r.lang for r in taken)
    short = [lang for lang, n in counts.items() if n > 4 * DOCS_PER_LANGUAGE and got[lang] < DOCS_PER_LANGUAGE]
    if short:
        taken = [r for r in taken if r.lang not in short] + first(hashed.filter(F.col("lang").isin(short)))
    limit = min(CHARS_PER_LANGUAGE, CHARS_PER_LANGUAGE * LANGUAGES_AT_FULL // len(counts))
    texts: dict[str, list[str]] = {}
    for r in sorted(taken, key=lambda r: (r.lang, r.li_h, r.text)):
        own = texts.setdefault(r.lang, [])
        if r.text not in own:
            own.append(r.text)
    return {lang: "\n".join(own)[:limit] for lang, own in texts.items()}


class Alphabet:
    """Codes of characters after lower-casing."""

    def __init__(self, samples: list[str]):
        letters = sorted({c for s in samples for c in s.lower() if c.isalpha()})
        self.letters = letters
        self.size = len(letters) + 3
        self.dtype = np.min_scalar_type(self.size - 1)
        self.code_of = {c: i + 3 for i, c in enumerate(letters)}

    def table(self) -> np.ndarray:
        """A code for each code point. Letters are those that Python says are."""
        out = np.full(0x110000, _GAP, self.dtype)
        for start in range(0, 0x110000, 256):
            if start in range(0xD800, 0xE000, 256):
                continue
            page = [chr(c).isalpha() for c in range(start, start + 256)]
            if any(page):
                out[start : start + 256][page] = _OTHER
        for c, i in self.code_of.items():
            out[ord(c)] = i
        return out


def encode(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]


def parse_table(codes: Sequence[int], width: int) -> np.ndarray:
    """For state s and code c, at [s * width + c]: the next state times ``width``, and above bit 29 the phrases that end."""
    out, _, _ = suffix_automaton([codes])
    first = np.zeros(width, np.int32)
    for c in range(width):
        to = out[0].get(c)
        first[c] = to * width if to is not None else 1 << _SHIFT  # a character that the sample lacks is a phrase
    first[_PAD] = 0
    table = np.empty((len(out), width), np.int32)
    table[:] = first + (1 << _SHIFT)
    table[0] = first
    for state, edges in enumerate(out):
        for c, to in edges.items():
            table[state, c] = to * width
    table[1:, _PAD] = 1 << _SHIFT
    return table.reshape(-1)


class DenseSteps:
    """Steps of lanes by a table; states are multiples of its width."""

    def __init__(self, codes: np.ndarray, width: int):
        self.table = parse_table(codes.tolist(), width)

    def __call__(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = self.table.take(state + codes)
        return step & ((1 << _SHIFT) - 1), step >> _SHIFT


class SparseSteps:
    """The same steps by a search of the transitions, of which there are at most three a character of the sample."""

    def __init__(self, codes: np.ndarray, width: int):
        out, _, _ = suffix_automaton([codes.tolist()])
        self.width = width
        self.first = np.zeros(width, np.int32)
        self.known = np.zeros(width, bool)
        for c, to in out[0].items():
            self.first[c], self.known[c] = to, True
        edges = sorted((state * width + c, to) for state, own in enumerate(out) if state for c, to in own.items())
        self.keys = np.array([k for k, _ in edges] + [np.iinfo(np.int64).max], np.int64)
        self.to = np.array([to for _, to in edges] + [0], np.int32)

    def __call__(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.known[codes]
        to, ended = self.first[codes], (state > 0).astype(np.int32)
        inner = np.flatnonzero(known & (state > 0))
        keys = state[inner].astype(np.int64) * self.width + codes[inner]
        at = np.searchsorted(self.keys, keys)
        found = self.keys[at] == keys
        to[inner[found]], ended[inner[found]] = self.to[at[found]], 0
        ended += ~known & (codes != _PAD)  # a character that the sample lacks is a phrase
        return to, ended


def steps_of(codes: np.ndarray, width: int) -> tuple[DenseSteps | SparseSteps, np.ndarray | None]:
    """Steps in a sample, and what its codes are there (None: the same): those it lacks are ``_OTHER``."""
    if width <= DENSE_WIDTH:
        return DenseSteps(codes, width), None
    own = np.unique(codes)
    own = own[own > _OTHER]
    to_own = np.full(width, _OTHER, np.min_scalar_type(len(own) + 2))
    to_own[: _OTHER + 1] = range(_OTHER + 1)
    to_own[own] = np.arange(len(own)) + _OTHER + 1
    kind = DenseSteps if len(own) + 3 <= DENSE_WIDTH else SparseSteps
    return kind(to_own[codes], len(own) + 3), to_own


class Model:
    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.alphabet = Alphabet([samples[x] for x in self.langs])
        table = self.alphabet.table()
        coded = [encode(samples[x], table) for x in self.langs]
        self.samples = [c.tobytes() for c in coded]
        self.weights = np.array([math.log2(max(2, len(c))) for c in coded])

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "letters": self.alphabet, "samples": self.samples, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.langs, self.alphabet, self.samples, self.weights = state["langs"], state["letters"], state["samples"], state["weights"]
        self.prepare()

    def prepare(self) -> Model:
        self.codes = self.alphabet.table()
        self.steps = [steps_of(np.frombuffer(s, self.alphabet.dtype), self.alphabet.size) for s in self.samples]
        return self

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each coded text in each language."""
        blocks = [max(1, -(-len(t) // BLOCK)) for t in texts]
        lanes = np.zeros((sum(blocks), BLOCK + 1), self.alphabet.dtype)
        at = 0
        for t, n in zip(texts, blocks, strict=True):
            padded = np.zeros(n * BLOCK, self.alphabet.dtype)
            padded[: len(t)] = t
            lanes[at : at + n, :BLOCK] = padded.reshape(n, BLOCK)
            at += n
        # long blocks first: the lanes that still run are a prefix
        lengths = (lanes != _PAD).sum(axis=1)
        order = np.argsort(-lengths, kind="stable")
        steps = np.ascontiguousarray(lanes[order].T)
        running = np.searchsorted(-lengths[order], -np.arange(BLOCK + 1), side="right")
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        of_text = np.repeat(np.arange(len(texts)), blocks)[order]
        for k, (stepped, to_own) in enumerate(self.steps):
            state = np.zeros(len(lanes), np.int32)
            ended = np.zeros(len(lanes), np.int32)
            for i in range(BLOCK + 1):
                n = running[i]
                if not n:
                    break
                codes = steps[i, :n] if to_own is None else to_own[steps[i, :n]]
                state[:n], more = stepped(state[:n], codes)
                ended[:n] += more
            out[:, k] = np.bincount(of_text, ended, len(texts))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        coded = [encode(t or "", self.codes) for t in texts]
        lettered = [bool((c != _GAP).any()) for c in coded]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        count = self.phrases(coded)
        out = []
        for k, yes in enumerate(lettered):
            if not yes:
                out.append((UNKNOWN, 0.0))
                continue
            entropy = count[k] * self.weights / max(1, len(coded[k]))
            best = int(np.argmin(entropy))
            out.append((self.langs[best], float(1 / ((entropy[best] / np.maximum(entropy, 1e-12)) ** 8).sum())))
        return out


def learn(docs: DataFrame) -> Model:
    return Model(learning_sample(docs))


_MODELS: dict[int, Model] = {}


def _held(shared) -> Model:
    """The broadcast's model, built once in a worker."""
    if shared.id not in _MODELS:
        _MODELS.clear()
        _MODELS[shared.id] = shared.sent.value
    return _MODELS[shared.id]


class _Sent:
    def __init__(self, sent, key: int):
        self.sent, self.id = sent, key


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` as one struct ``li_row``, with ``li_lang`` and ``li_score``."""
    key = zlib.crc32(repr(model.langs).encode() + b"".join(model.samples))
    shared = _Sent(docs.sparkSession.sparkContext.broadcast(model), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(shared)
        for batch in batches:
            found = held.predict(batch["li_text"].to_pylist())
            langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array(array("d", [s for _, s in found]), pa.float64())
            yield pa.record_batch([batch["li_row"], langs, scores], ["li_row", "li_lang", "li_score"])

    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("li_row"), F.col("text").alias("li_text"))
    return map_batches(boxed, run, f"li_row {boxed.schema['li_row'].dataType.simpleString()}, li_lang string, li_score double")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are ``und``; a null ``lang`` gets the prediction. With nothing to learn from, only texts that are null or without letters go."""
    model = learn(docs)
    field = lambda c: F.col("li_row").getField(c)
    out = predict(docs, model)
    out = out.filter(F.col("li_lang") != UNKNOWN) if model.langs else out.filter(field("text").rlike("\\p{L}"))
    return out.select(*[(F.coalesce(field(c), "li_lang") if c == "lang" else field(c)).alias(c) for c in docs.columns])


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs)
    held_out = F.coalesce(bucket_of(F.col("doc_id")) == 1, F.lit(False))
    out = predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("li_row.doc_id", "li_row.held_out", F.col("li_lang").alias("lang_pred"), F.col("li_score").alias("score"))
