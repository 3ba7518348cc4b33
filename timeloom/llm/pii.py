"""Operator 7, PII: pattern spans and information-theoretic sanitisation.

Base spans (e-mail, IP, card and phone numbers) are found by pattern. From the corpus, the words that stand near protected
entities are then rated by how much they tell about one: with document counts, P(entity | word) and
log2(P(entity | word) / P(entity)) bits. Words of enough distinct contexts that are over both thresholds disclose the
entity wherever they stand; they become ``term`` spans and are generalised, or removed over the higher threshold.

Only DataFrame functions are used. Matching is linear in a text: the patterns are written with possessive
quantifiers and start a match only where one can start, which changes no result. Per entity at most
``2 * NEAR_WORDS`` rows are made, never pairs of a document's words; counts are combined before each shuffle. The words near an
entity are looked for in a stretch of text that is widened until it holds ``NEAR_WORDS`` whole words, however long these are.

Defined cases: a null text is an empty one; spans count code points, ends are exclusive; overlapping spans of several
kinds are all reported, and the sanitised text replaces what they cover together by the tag of the first; copies of one
passage (the entity with ``NEAR_WORDS`` at either side) are one context, so that mere copying discloses nothing, while
near copies that differ there are contexts of their own; a null ``doc_id`` counts for no document, but disclosing words
are replaced in its text as in any other; rows that repeat a ``doc_id`` count as one document, so that a table that is repeated gives the same words; texts of any length are read whole; in ``sanitise`` further columns pass through
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, documents

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words at each side of an entity that are rated; distinct contexts that a word needs with an entity.
NEAR_WORDS, MIN_CONTEXTS = 8, 3
#: Characters beside an entity that are read until they hold as many words; the last is more than a text has.
REACHES = (192, 1536, 12288, 98304, 1 << 30)
#: Thresholds of disclosure: P(entity | word), bits; at the last probability a word is removed instead of generalised.
MIN_PROBABILITY, MIN_BITS, REMOVE_PROBABILITY = 0.5, 6.0, 0.9
#: Rows of candidates, or of documents with disclosing words, up to which they are broadcast; beyond, what they are joined with is shuffled.
BROADCAST_ROWS = 100_000

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# The given patterns; a mail address begins where a run of its characters or the search begins.
PATTERNS = {
    "email": f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@{_HOST}++(?:\\.{_HOST}++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
# A word is a whole run of letters, marks and digits with a letter in it, of any length.
_RUN = "[\\p{L}\\p{M}\\p{N}]"
_WORD = f"(?<!{_RUN})[\\p{{M}}\\p{{N}}]*+\\p{{L}}{_RUN}*+"
SPAN = "array<struct<s:int,e:int>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.substring(back, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(x, "\\."), lambda p: (F.length(part(p)) <= 3) & (F.try_element_at(F.array(part(p).try_cast("int")), F.lit(1)) <= 255))
    if kind == "card":
        d = _digits(x)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


# Functions of a span, for ``transform`` and ``filter``; a lambda with a default value would get the index there.
def _validator(kind: str):
    return lambda p: _valid(kind, p["v"])


def _labelled(label: Column, value: str):
    return lambda p: F.struct(label, p["s"].alias("s"), p["e"].alias("e"), p[value].alias(value))


def _told(kind: str):
    return lambda p: F.concat_ws(":", F.lit(kind), p["s"], p["e"])


def _tagged(tag: str):
    return lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.lit(tag).alias("tag"))


def _may_have(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    return needs.get(kind, text.rlike("[0-9][.\\x20-]?[0-9]"))


def _gaps_and_hits(text: Column, pattern: Column, may: Column) -> tuple[Column, Column]:
    none = F.array().cast("array<string>")
    return F.when(may, F.split(text, pattern)).otherwise(none), F.when(may, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none)


def _let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once, also where ``body`` uses it in a function of array elements."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


#: Hits that are placed together; keeps placing near linear in the hits of a text.
_CHUNK = 256


def _spans(gaps: Column, hits: Column) -> Column:
    """Places of all hits: each follows its gap. Lengths are summed within and over chunks of hits."""
    n = F.size(hits)
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int"))
    none = F.array().cast(SPAN)

    def offsets(lengths):
        sums = F.transform(chunks, lambda j: F.aggregate(F.slice(lengths, j * _CHUNK + 1, F.lit(_CHUNK)), F.lit(0), lambda a, x: a + x))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sums, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def step(acc, i):
        s = acc["at"] + F.length(F.get(gaps, i))
        e = s + F.length(F.get(hits, i))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    def placed(before):
        def chunk(j):
            start = F.struct(F.get(before, j).alias("at"), none.alias("out"))
            return F.aggregate(F.sequence(j * _CHUNK, F.least(n, (j + 1) * _CHUNK) - 1), start, step, lambda acc: acc["out"])

        return F.flatten(F.transform(chunks, chunk))

    lengths = F.zip_with(F.slice(gaps, F.lit(1), n), hits, lambda g, h: F.length(g) + F.length(h))
    return F.when(n > 0, _let(_let(lengths, offsets), placed)).otherwise(none)


def find_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pi_text`` (the text, never null), and for each kind ``pi_<kind>``: valid spans as (s, e, v), v being what stands there."""
    df = docs.withColumn("pi_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({f"pi_may_{k}": _may_have(k, F.col("pi_text")) for k in KINDS})
    for k in KINDS:
        gaps, hits = _gaps_and_hits(F.col("pi_text"), F.lit(PATTERNS[k]), F.col(f"pi_may_{k}"))
        df = df.withColumn("pi_g", gaps).withColumn("pi_h", hits).withColumn("pi_s", _spans(F.col("pi_g"), F.col("pi_h")))
        whole = F.zip_with("pi_s", "pi_h", lambda p, v: F.struct(p["s"].alias("s"), p["e"].alias("e"), v.alias("v")))
        df = df.withColumn(f"pi_{k}", F.when(F.size("pi_h") > 0, F.filter(whole, _validator(k))).otherwise(whole)).drop("pi_g", "pi_h", "pi_s")
    return df.drop(*[f"pi_may_{k}" for k in KINDS])


def _all_base() -> Column:
    return F.concat(*[F.transform(f"pi_{k}", _labelled(F.lit(k).alias("k"), "v")) for k in KINDS])


def _near(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(_WORD), F.lit(0))


def _beside(text: Column, start: Column, end: Column, left: bool, step: int = 0) -> Column:
    """The words at one side of an entity, nearest first. A stretch reaches one character into the entity and one further off: a
    run of letters that these cut is no word of it."""
    width = REACHES[step]
    if left:
        cut = start > width
        x = F.substring(text, F.greatest(F.lit(1), start - width), F.least(start, F.lit(width + 1)) + 1)
        x = F.when(cut, F.regexp_replace(x, f"^{_RUN}++", "")).otherwise(x)
        words = F.reverse(_near(F.regexp_replace(x, f"(?<!{_RUN}){_RUN}++\\z", "")))
    else:
        cut = F.length(text) - end > width
        x = F.regexp_replace(F.substring(text, end, F.lit(width + 2)), f"^{_RUN}++", "")
        words = _near(F.when(cut, F.regexp_replace(x, f"(?<!{_RUN}){_RUN}++\\z", "")).otherwise(x))
    if step + 1 == len(REACHES):
        return F.slice(words, 1, NEAR_WORDS)
    further = _beside(text, start, end, left, step + 1)
    return _let(words, lambda found: F.when(~cut | (F.size(found) >= NEAR_WORDS), F.slice(found, 1, NEAR_WORDS)).otherwise(further))


def near_words(found: DataFrame) -> DataFrame:
    """A row per document, entity and word near it, with the words beside that and a fingerprint of the passage: ``NEAR_WORDS`` at either side."""
    hits = found.filter(" or ".join(f"size(pi_{k}) > 0" for k in KINDS)).select("doc_id", "pi_text", F.explode(_all_base()).alias("p"))
    sides = hits.select(
        "doc_id",
        F.concat_ws(":", "p.k", F.lower("p.v")).alias("entity"),
        F.array(*[_beside(F.col("pi_text"), F.col("p.s"), F.col("p.e"), left) for left in (True, False)]).alias("sides"),
    )
    sides = sides.select("doc_id", "entity", F.xxhash64("sides").alias("passage"), F.explode("sides").alias("w"))
    beside = lambda i: F.coalesce(F.get("w", i), F.lit("^"))
    word = lambda x, i: F.struct(x.alias("term"), beside(i - 1).alias("before"), beside(i + 1).alias("after"))
    each = sides.select("doc_id", "entity", "passage", F.explode(F.transform("w", word)).alias("x"))
    return each.select("doc_id", "entity", "passage", "x.*")


def _doc_words(docs: DataFrame) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0)))
    return docs.select("doc_id", F.xxhash64("text").alias("pi_hash"), F.explode(words).alias("term"))


def _few(table: DataFrame, w: Workspace) -> DataFrame:
    """The table, written, and to be broadcast if its rows, which are counted, are few enough; else both sides are shuffled."""
    table = w.write(table, "pii-few")
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _rated(docs: DataFrame, found: DataFrame, w: Workspace) -> tuple[DataFrame, DataFrame] | None:
    """The words over the thresholds, and (doc_id, pi_hash, term) of all documents that hold a word of enough contexts; None if there is none."""
    near = w.write(near_words(found.filter("doc_id is not null")), "pii-near")
    # contexts are distinct if they differ at both sides, or if whole passages of several documents differ: beside its entity, or
    # in a fixed name, a word has the same neighbour everywhere. A document gives one passage, so that copies give one together
    beside = near.groupBy("term", "entity").agg(F.least(F.countDistinct("before"), F.countDistinct("after")).alias("beside"))
    passages = near.groupBy("term", "entity", "doc_id").agg(F.min("passage").alias("passage"))
    passages = passages.groupBy("term", "entity").agg(F.countDistinct("passage").alias("passages"), F.countDistinct("doc_id").alias("both"))
    pairs = passages.join(beside, ["term", "entity"]).withColumn("contexts", F.greatest("beside", "passages")).drop("beside", "passages")
    # a word stands in at least as many documents as it stands near entities in: common words are out before texts are read for counts
    seen = near.groupBy("term").agg(F.countDistinct("doc_id").alias("seen"))
    pairs = pairs.filter(F.col("contexts") >= MIN_CONTEXTS).join(seen, "term").filter(F.col("both") >= MIN_PROBABILITY * F.col("seen")).drop("seen")
    pairs = w.write(pairs, "pii-pairs")
    if pairs.isEmpty():
        return None
    # documents are distinct ids, in all four counts: repeated rows and rows without an id change nothing
    total = docs.select("doc_id").agg(F.countDistinct("doc_id")).head()[0]
    of_entity = near.groupBy("entity").agg(F.countDistinct("doc_id").alias("with_entity"))
    held = w.write(_doc_words(docs).join(_few(pairs.select("term").distinct(), w), "term", "left_semi"), "pii-held")
    of_term = held.groupBy("term").agg(F.countDistinct("doc_id").alias("with_term"))
    p = F.col("both") / F.col("with_term")
    rated = pairs.join(of_term, "term").join(of_entity, "entity").withColumns({"probability": p, "bits": F.log2(p * F.lit(float(total)) / F.col("with_entity"))})
    over = rated.filter((F.col("probability") >= MIN_PROBABILITY) & (F.col("bits") >= MIN_BITS))
    over = over.select("term", "entity", "probability", "bits", (F.col("probability") >= REMOVE_PROBABILITY).alias("remove"))
    return w.write(over, "pii-over"), held


def disclosures(docs: DataFrame) -> DataFrame | None:
    """(term, entity, probability, bits, remove) of the words that are over the thresholds; None if no word has enough contexts."""
    with Workspace(docs.sparkSession) as w:
        rated = _rated(docs, find_base(docs.select("doc_id", "text")), w)
        return rated and w.result(rated[0], rated[0])


def find_all(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs``: its columns as the struct ``pi_row``, ``doc_id``, what ``find_base`` adds, ``pi_term``: spans (s, e, v) of
    disclosing words, and ``pi_removed``, those among them to remove."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("pi_row"), "doc_id", F.xxhash64("text").alias("pi_of"), "text")
    none = {"pi_term": F.array().cast("array<struct<s:int,e:int,v:string>>"), "pi_removed": F.array().cast("array<string>")}
    with Workspace(docs.sparkSession) as w:
        rated = _rated(docs, find_base(docs.select("doc_id", "text")), w)
        if rated is None:
            return find_base(rows.drop("pi_of")).withColumns(none)
        over, words = rated
        terms = over.groupBy("term").agg(F.max("remove").alias("remove"))
        held = words.join(_few(terms, w), "term").groupBy("doc_id", "pi_hash")
        held = held.agg(F.array_sort(F.collect_set("term")).alias("pi_terms"), F.array_sort(F.collect_set(F.when(F.col("remove"), F.col("term")))).alias("pi_removed"))
        written = w.write(held.withColumnRenamed("doc_id", "pi_doc"), "pi-held")
        n = written.count()
        if not n:
            return find_base(rows.drop("pi_of")).withColumns(none)
        held = F.broadcast(written) if n <= BROADCAST_ROWS else written
        df = find_base(rows.join(held, rows["doc_id"].eqNullSafe(held["pi_doc"]) & (rows["pi_of"] == held["pi_hash"]), "left").drop("pi_doc", "pi_hash", "pi_of"))
        pattern = F.concat(F.lit(f"(?iu)(?<!{_RUN})(?:"), F.array_join("pi_terms", "|"), F.lit(f")(?!{_RUN})"))
        gaps, hits = _gaps_and_hits(F.col("pi_text"), pattern, F.coalesce(F.size("pi_terms") > 0, F.lit(False)))
        df = df.withColumn("pi_g", gaps).withColumn("pi_h", hits)
        df = df.withColumn("pi_term", F.zip_with(_spans(F.col("pi_g"), F.col("pi_h")), "pi_h", lambda p, v: F.struct(p["s"].alias("s"), p["e"].alias("e"), v.alias("v"))))
        df = df.withColumn("pi_removed", F.coalesce("pi_removed", none["pi_removed"])).drop("pi_g", "pi_h", "pi_terms")
        return w.result(df, written)


def _joined(kinds: tuple[str, ...]) -> Column:
    each = [F.transform(f"pi_{k}", _told(k)) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def sanitised(found: DataFrame) -> Column:
    """The text with every stretch of spans replaced by a tag, or by nothing for removed words."""
    tagged = [F.transform(f"pi_{k}", _tagged(f"[{k.upper()}]")) for k in KINDS]
    gone = F.transform("pi_term", lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.when(F.array_contains("pi_removed", F.lower(p["v"])), F.lit("")).otherwise(F.lit("[TERM]")).alias("tag")))
    spans = F.array_sort(F.concat(*tagged, gone))
    text = F.col("pi_text")

    def step(acc, p):
        inside = p["s"] < acc["at"]
        s = F.greatest(p["s"], acc["at"])
        added = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s - acc["at"]), p["tag"]))
        return F.struct(F.greatest(acc["at"], p["e"]).alias("at"), F.when(inside, acc["out"]).otherwise(added).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts; null texts stay null, ``n_chars``, where there is one, is counted anew."""
    df = find_all(docs)
    df = df.select("pi_row", F.when(F.col("pi_row.text").isNotNull(), sanitised(df)).alias("pi_new"))
    new = {"text": F.col("pi_new"), "n_chars": F.length("pi_new").cast("bigint")}
    return df.select(*[(new[c] if c in new else F.col("pi_row").getField(c)).alias(c) for c in docs.columns])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    df = find_all(documents(spark, sf_dir).select("doc_id", "text"))
    return df.select(
        "doc_id",
        *[F.size(f"pi_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.encode(_joined(KINDS), "UTF-8"), 256).alias("base_sha256"),
        _joined((*KINDS, TERM)).alias("spans"),
    )
