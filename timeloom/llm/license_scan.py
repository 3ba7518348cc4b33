"""Operator 3, licence scans: a positional rare-token index of licence templates.

A first pass counts in how many documents each licence word stands; every document counts, and the result has at most one
row per word of the templates. Each template is then indexed under its words of the highest inverse document frequency
(IDF), with their positions. All words of a file that are keys of the index, which are the licence words of the highest IDF, are looked
up there, rarest first; the postings of a template are intersected by relative position (position in the file less position in the template), and each
alignment is accepted only if the template's mandatory key phrases stand word for word where it puts them.

Templates are a parameter: pairs of label and text, or a table of such, as of whole licence texts (``MOST_TEMPLATES`` at most). Brackets mark the phrases
that must stand word for word. A text without any has one chosen by IDF: of ``KEY_WORDS`` words in a row those that are rarest in all documents
and in the fewest templates, so that what licences share does not tell one from another.

Short base phrases go through the same index: each is looked up under its rarest word and verified in place.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case. Defined cases: a null or empty text has
no words, no label and score 0; repeated rows are scanned each by itself; only ``doc_id`` and ``text`` are read; a phrase at several places counts each; overlapping places of different
phrases all count; texts of any length are read whole, in time proportional to their words; a null ``doc_id`` stays null; an empty
table gives an empty table; a template without words, or with a null label or text, is none.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import documents, map_batches

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of public licences; in brackets the parts that must stand word for word.
TEMPLATES = [
    ("apache", "[licensed under the apache license version 2 0]"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at [http www apache org licenses license 2 0]"),
    ("bsd", "[redistribution and use in source and binary forms with or without modification are permitted] provided that the following conditions are met"),
    ("cc-by", "[licensed under cc by 4 0]"),
    ("cc-by", "this work is licensed under a [creative commons attribution 4 0 international license]"),
    ("cc-by-nc", "[licensed under cc by nc 4 0]"),
    ("cc-by-nc", "this work is licensed under a [creative commons attribution noncommercial 4 0 international license]"),
    ("cc-by-sa", "[licensed under cc by sa 4 0]"),
    ("cc0", "[cc0 1 0 universal]"),
    ("gpl", "this work is licensed under the [gnu general public license version 3]"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license as published by the free software foundation]"),
    ("isc", "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted]"),
    ("lgpl", "[gnu lesser general public license]"),
    ("mit", "[released under the mit license]"),
    ("mit", "[permission is hereby granted free of charge to any person obtaining a copy of this software] and associated documentation files"),
    ("mpl", "this source code form is [subject to the terms of the mozilla public license v 2 0]"),
    ("unlicense", "[this is free and unencumbered software released into the public domain]"),
]
#: Words of a template that it is indexed under. A file must hold all of them.
ANCHORS = 2
#: Words of the phrase that must stand word for word, where a template marks none.
KEY_WORDS = 12
#: Templates that a scan takes; they are held in every task.
MOST_TEMPLATES = 10_000

# Bytes to words: all but 0-9, a-z, A-Z and bytes of other characters is a space, A-Z is lower-cased.
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    mandatory: list[tuple[int, list[bytes]]]  # start, words
    anchors: dict[bytes, list[int]] = field(default_factory=dict)


def parse_template(label: str, text: str) -> Template:
    """Marked phrases are mandatory; without any the list is empty, and ``Index`` chooses one."""
    words, mandatory, opened = [], [], None
    for part in re.split(r"([\[\]])", text):
        if part == "[":
            opened = len(words)
        elif part == "]" and opened is not None and len(words) > opened:
            mandatory.append((opened, words[opened:]))
            opened = None
        elif part not in ("[", "]"):
            words += words_of(part)
    return Template(label, words, mandatory)


def parsed(templates: list[tuple[str, str]] | DataFrame | None) -> list[Template]:
    """Templates of a list or of a table (label, text); None: the notices of this module."""
    if isinstance(templates, DataFrame):
        rows = templates.select("label", "text").distinct().orderBy("label", "text").limit(MOST_TEMPLATES + 1).collect()
        if len(rows) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        templates = [(r.label, r.text) for r in rows]
    made = [parse_template(label, text) for label, text in (TEMPLATES if templates is None else templates) if label and text]
    return [t for t in made if t.words]


def vocabulary(templates: list[Template]) -> list[bytes]:
    return sorted({w for t in templates for w in t.words} | {w for p in BASE for w in p.encode().split()})


class Index:
    """Templates and base phrases by their rarest words. ``frequency``: documents that hold each word, of ``total``."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int], total: int):
        self.idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary(templates)}
        rarest = lambda ws: sorted(set(ws), key=lambda w: (-self.idf[w], w))
        self.templates = self._with_phrases(templates)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            for a in rarest(w for _, ws in t.mandatory for w in ws)[:ANCHORS]:
                t.anchors[a] = [i for start, ws in t.mandatory for i, w in enumerate(ws, start) if w == a]
                self.postings[a] += [(k, i) for i in t.anchors[a]]
        self.base: dict[bytes, list[tuple[int, list[bytes], str]]] = defaultdict(list)
        for phrase, label in BASE.items():
            ws = phrase.encode().split()
            a = rarest(ws)[0]
            self.base[a].append((ws.index(a), ws, label))
        self.keys = self.postings.keys() | self.base.keys()

    def _with_phrases(self, templates: list[Template]) -> list[Template]:
        """Templates that mark no phrase with the one that tells them best: the words with the highest sum of IDF over documents
        and over templates, the first of equals."""
        held = Counter(w for t in templates for w in set(t.words))
        worth = {w: self.idf[w] + math.log((len(templates) + 1) / n) for w, n in held.items()}
        out = []
        for t in templates:
            if not t.mandatory:
                n = min(KEY_WORDS, len(t.words))
                sums = [0.0, *accumulate(worth[w] for w in t.words)]
                start = max(range(len(t.words) - n + 1), key=lambda i: (round(sums[i + n] - sums[i], 9), -i))
                t = Template(t.label, t.words, [(start, t.words[start : start + n])])
            out.append(t)
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], set[str], float]:
        """Base places with their labels, the labels of verified templates, and the score."""
        there = self.keys & set(words)
        if not there:
            return [], set(), 0.0
        looked_up = sorted(there, key=lambda w: (-self.idf[w], w))
        at: dict[bytes, list[int]] = {w: [] for w in there}
        for i, w in enumerate(words):
            if w in at:
                at[w].append(i)
        places = []
        for a in there & self.base.keys():
            for shift, ws, label in self.base[a]:
                places += [(i - shift, label) for i in at[a] if i >= shift and words[i - shift : i - shift + len(ws)] == ws]
        shifts: dict[int, Counter] = defaultdict(Counter)
        for a in looked_up:
            for k, i in self.postings.get(a, ()):
                shifts[k].update(p - i for p in at[a])
        labels, best = set(), 1.0 if places else 0.0
        for k, votes in shifts.items():
            t = self.templates[k]
            wanted = sum(map(len, t.anchors.values()))
            for shift, n in votes.items():
                if n < wanted:
                    continue
                if all(0 <= shift + s and words[shift + s : shift + s + len(ws)] == ws for s, ws in t.mandatory):
                    labels.add(t.label)
                    same = sum(0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(t.words))
                    best = max(best, same / len(t.words))
        return sorted(places), labels, best


def word_frequencies(docs: DataFrame, templates: list[Template] | None = None) -> tuple[dict[bytes, int], int]:
    """Document frequency of every licence word over all documents, and their number. At most a row per licence word arrives here."""
    known = frozenset(vocabulary(parsed(None) if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                count.update(known.intersection(words_of(text.as_py())))
            total += batch.num_rows
        yield pa.record_batch([pa.array([*count, b""], pa.binary()), pa.array([*count.values(), total], pa.int64())], ["w", "n"])

    rows = map_batches(docs.select("text"), run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r.w): r.n for r in rows}
    return found, found.pop(b"", 0)


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """A row per document: base places and labels, all labels, and the share of the best template's words that match. ``templates``: (label, text)."""
    known = parsed(templates)
    index = Index(known, *word_frequencies(docs, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                places, labels, score = index.scan(words)
                base = {x for _, x in places}
                starts = [i for i, _ in places]
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, RESULT)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
