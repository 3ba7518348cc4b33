"""Operator 4, line dedup: lines that many documents share are kept in one of them.

Lines are exploded to 128-bit hashes of their normalised form, distinct documents are counted per
hash (with partial aggregation, so a line of a third of all documents arrives as a few rows per task),
and documents are reassembled by line position without the lines that are over the threshold.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. Keys shorter
than ``min_chars`` code points never drop a line. Of a key that ``min_docs`` documents or more hold, all lines
go except those of the largest ``doc_id`` that holds it.

Defined cases: a null or empty text is one empty line; a null ``doc_id`` counts for no document and keeps no
shared line; texts of any length are read whole; rows that repeat a ``doc_id`` count as one document and each is reassembled: lines to drop
are listed by id and hash of the text, so that rows without an id, or many with one, are as many keys as they have texts; an empty table gives an
empty table; further columns pass through ``dedup_lines`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, documents, map_batches

MIN_CHARS = 40
MIN_DOCS = 5
#: Documents with lines to drop up to which their ids are broadcast to the texts; beyond, texts are shuffled to them.
BROADCAST_IDS = 500_000


def line_key(line: str, min_chars: int) -> bytes | None:
    """16-byte hash of a line's key; None if the key is shorter than ``min_chars`` code points."""
    if len(line) < min_chars:
        return None
    key = line.strip(" \t\n\x0b\x0c\r")
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, keys = [], [], []
            for doc, text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = {line_key(x, min_chars) for x in (text.as_py() or "").split("\n")} - {None}
                ids += [doc] * len(found)
                texts += [text_hash] * len(found)
                keys += found
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(keys, pa.binary())], ["ld_doc", "ld_hash", "ld_key"])

    return run


def _reassemble(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drops in zip(batch["ld_text"], batch["ld_drops"], strict=True):
                lines = (text.as_py() or "").split("\n")
                gone = set(drops.as_py() or ())
                kept = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                texts.append("\n".join(kept) if text.is_valid else None)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            rest = [batch.column(i) for i in range(batch.num_columns - 2)]
            names = batch.schema.names[:-2]
            yield pa.record_batch(
                [*rest, pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                [*names, "ld_text", "ld_lines", "ld_dropped"],
            )

    return run


def shared_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """``ld_key``s that at least ``min_docs`` documents hold, with the document that keeps them."""
    return (
        keys.groupBy("ld_key")
        .agg(F.countDistinct("ld_doc").alias("ld_n"), F.max("ld_doc").alias("ld_keeper"))
        .filter(F.col("ld_n") >= min_docs)
    )


def drop_shared(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The columns of ``docs`` but ``text`` as one struct ``ld_row``, with ``ld_text`` (what is left of the text, null
    if it was null), ``ld_lines`` (before dropping) and ``ld_dropped``."""
    with Workspace(docs.sparkSession) as w:
        keys = map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("ld_hash")), _keys(min_chars), "ld_doc long, ld_hash long, ld_key binary")
        keys = w.write(keys, "line-keys")
        # both sides are tables, so the join has nothing but exchanges below it and a hot key's rows are split at run time
        shared = w.write(shared_lines(keys, min_docs), "line-shared")
        drops = (
            keys.join(shared, "ld_key")
            .filter(~F.col("ld_doc").eqNullSafe(F.col("ld_keeper")))
            .groupBy("ld_doc", "ld_hash")
            .agg(F.collect_set("ld_key").alias("ld_drops"))
        )
        drops = w.write(drops, "line-drops")
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("ld_row"), F.col("doc_id").alias("ld_id"), F.xxhash64("text").alias("ld_of"), F.col("text").alias("ld_text"))
        kind = rows.schema["ld_row"].dataType.simpleString()
        whole = lambda df: map_batches(df.select("ld_row", "ld_text", "ld_drops"), _reassemble(min_chars), f"ld_row {kind}, ld_text string, ld_lines long, ld_dropped long")
        same = F.col("ld_id").eqNullSafe(F.col("ld_doc")) & (F.col("ld_of") == F.col("ld_hash"))
        if drops.count() > BROADCAST_IDS:
            return w.result(whole(rows.join(drops, same, "left")), drops)
        # texts without shared lines stay where they are; lists of lines are never broadcast, however few, as they grow with the input
        ids = F.broadcast(drops.select("ld_doc", "ld_hash"))
        some = rows.join(ids, same, "left_semi").join(drops.hint("merge"), same)
        none = rows.join(ids, same, "left_anti").withColumn("ld_drops", F.array().cast("array<binary>"))
        return w.result(whole(some).unionByName(whole(none)), drops)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with shared lines removed from ``text``, and ``n_chars``, where there is one, counted anew."""
    out = drop_shared(docs, min_chars, min_docs)
    new = {"text": F.col("ld_text"), "n_chars": F.length("ld_text").cast("bigint")}
    return out.select(*[(new[c] if c in new else F.col("ld_row").getField(c)).alias(c) for c in docs.columns])


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return drop_shared(docs).select(
        F.col("ld_row.doc_id").alias("doc_id"),
        F.col("ld_lines").alias("n_lines"),
        F.col("ld_dropped").alias("n_dropped"),
        F.sha2(F.encode(F.coalesce("ld_text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


_TRIMMED = "trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate({_TRIMMED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (
  SELECT doc_id, pos, line, hot.k IS NOT NULL AND doc_id <> hot.keeper AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
