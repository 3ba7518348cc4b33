"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup, PII, packing.

Each stage takes all that the one before kept, as a table that was written and is read again, and its decisions take
effect on the rows that it hands on. All but the last return the columns of ``documents``; the last one returns
the pieces of the packed sequences. SQL can express neither the models nor the sketches, so ``ORACLE_SQL`` is None and the
tests hold each stage against a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timeloom.llm.language_id import keep_known
from timeloom.llm.line_dedup import dedup_lines
from timeloom.llm.near_dedup import drop_near_copies
from timeloom.llm.packing import pack
from timeloom.llm.pii import sanitise
from timeloom.llm.storage import Workspace, documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told go; a missing ``lang`` is filled in."""
    return keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that 5 documents or more hold stay in one of them."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: shingles of five words, a similarity of 0.8 or more."""
    return drop_near_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and words that disclose it are replaced by tags."""
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with Workspace(spark) as w:
        for name, stage in STAGES[:-1]:
            docs = w.settle(stage(spark, docs, sf_dir), f"stage-{name}")
        return w.result(STAGES[-1][1](spark, docs, sf_dir), docs)
