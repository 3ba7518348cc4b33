"""Operator 10, quality rules: a rule bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule, so a policy (a named, versioned set of rules) is a mask that is
applied without reading texts again, and ablations are bitwise aggregations of the ledger.

Only DataFrame functions are used. Defined cases: a null text has no words and fails the word-count
rule; texts of any length are read whole, in n log n; an empty table gives an empty ledger; repeated rows are rated each by itself; columns other than
``doc_id`` and ``text`` are not read and can have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Bits of a packed (hash, position) value that hold the position of a window: as many as an array can have positions.
POSITION_BITS = 32


@dataclass(frozen=True)
class Rule:
    """``bit``: place in the mask, never reused. ``fails``: a boolean expression over the measurements."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", 2, "word_chars < 2 * n_words"),
    Rule("long_words", 3, "word_chars > 15 * n_words"),
    Rule("many_symbols", 4, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 5, "10 * n_dup_lines > 3 * n_lines"),
    Rule("few_letters", 6, "2 * n_letters < word_chars"),
    Rule("very_long_word", 7, "longest_word > 200"),
    Rule("shouting", 8, "2 * n_upper > n_letters"),
)
_BASE = ("few_words", "repeated_windows")
#: Versioned policies. A policy never changes once published; a new one gets a new name.
POLICIES = {
    "base-1": _BASE,
    "web-1": (*_BASE, "short_words", "long_words", "many_symbols", "duplicate_lines", "few_letters", "very_long_word", "shouting"),
    "web-2": (*_BASE, "short_words", "long_words", "many_symbols", "few_letters", "very_long_word", "shouting"),
    "strict-1": (*_BASE, "short_words", "long_words", "many_symbols", "duplicate_lines", "few_letters", "very_long_word", "shouting"),
}
DEFAULT_POLICY = "web-2"


def mask_of(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _windows(words: Column) -> Column:
    """64-bit fingerprints of the 3-word windows, in order."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, each).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame) -> DataFrame:
    """One row per document with the measurements that the rules read.

    Words in repeated windows: a primitive sort of (high fingerprint bits, position) finds the windows that
    may repeat, and only those are grouped by whole fingerprints. The work is n log n in the words of a
    text, whatever repeats in it.
    """
    low = (1 << POSITION_BITS) - 1
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t_"))
    df = df.withColumn("w_", F.array_remove(F.split("t_", SPACE), ""))
    df = df.withColumn("l_", F.filter(F.split("t_", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("h_", _windows(F.col("w_")))
    # a text without any repeated window needs no sort
    df = df.withColumn("p_", F.when(
        F.size(F.array_distinct("h_")) < F.size("h_"),
        F.sort_array(F.transform("h_", lambda h, i: F.shiftleft(F.shiftright(h, POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("bigint")))),
    ).otherwise(F.array().cast("array<bigint>")))
    same = lambda a, b: F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)
    df = df.withColumn("c_", F.filter("p_", lambda x, i: F.coalesce(same(x, F.get("p_", i + 1)), F.lit(False)) | F.coalesce(same(x, F.get("p_", i - 1)), F.lit(False))))
    df = df.withColumn("s_", F.sort_array(F.transform("c_", lambda x: F.struct(F.get("h_", x.bitwiseAND(low).cast("int")).alias("h"), x.bitwiseAND(low).cast("int").alias("i")))))
    again = lambda x, i: F.coalesce(x["h"] == F.get("s_", i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("s_", i - 1)["h"], F.lit(False))
    df = df.withColumn("r_", F.sort_array(F.transform(F.filter("s_", again), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("r_", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("r_", i + 1) - x, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)
    joined = F.array_join("w_", "")
    return df.select(
        "doc_id",
        F.size("w_").cast("bigint").alias("n_words"),
        F.length(joined).cast("bigint").alias("word_chars"),
        F.regexp_count("t_", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("l_").cast("bigint").alias("n_lines"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        (F.length(joined) - F.length(F.regexp_replace(joined, "\\p{L}+", ""))).cast("bigint").alias("n_letters"),
        (F.length(joined) - F.length(F.regexp_replace(joined, "\\p{Lu}+", ""))).cast("bigint").alias("n_upper"),
        F.coalesce(F.array_max(F.transform("w_", lambda w: F.length(w))), F.lit(0)).cast("bigint").alias("longest_word"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``fail_bits``: bit ``r.bit`` is set where rule ``r`` fails."""
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint")
    return measure(docs).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``policy`` to a ledger."""
    failed = lambda name: F.col("fail_bits").bitwiseAND(F.lit(mask_of(name)).cast("bigint")) != 0
    return led.withColumns({"base_failed": failed("base-1"), "kept": ~failed("base-1") & ~failed(policy), "policy": F.lit(policy)})


def ablation(led: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only it drops.

    The ledger is first counted by its bits (at most 2 ** len(RULES) groups, combined before the
    shuffle), then every rule is one bit test on those counts.
    """
    by_bits = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    inside = F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("bigint"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("b")) for r in RULES if r.name in POLICIES[policy]])
    return (
        by_bits.select("n", inside.alias("bits"), F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.b")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.b"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .storage import documents

    rated = apply_policy(ledger(documents(spark, sf_dir)))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
OP10_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS x, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || chr(31) || ws[i + 1] || chr(31) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(array_to_string(ws, '')) - length(regexp_replace(array_to_string(ws, ''), '\\p{{L}}+', '', 'g')) AS n_letters, length(array_to_string(ws, '')) - length(regexp_replace(array_to_string(ws, ''), '\\p{{Lu}}+', '', 'g')) AS n_upper,
         coalesce(list_max(list_transform(ws, lambda s: length(s))), 0) AS longest_word FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask_of("base-1")} <> 0 AS base_failed, fail_bits & {mask_of(DEFAULT_POLICY)} = 0 AS kept, fail_bits FROM b
"""
