"""Candidate intervals: validation, labels, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_LABEL, KNOBS, LABELS, Knobs
from ..functions.text import strip
from .folds import CHUNK_MS, fold_chunks

ERROR_ORDER = ("not_object", "not_numeric", "not_finite", "inverted", "outside", "too_short", "too_long", "unknown_label", "bad_score", "bad_cues")


def parse_candidates(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Submitted candidates, JSON in ``raw``, as the columns that ``validate`` reads, with ``first_error`` and ``last_error``: what is
    wrong with the JSON itself, to be told before and after the other rules. Seconds become whole milliseconds; numbers may be strings."""
    df = rows.withColumn("v_", F.try_parse_json(raw))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v_", path, "variant"))
    # truth values are numbers; lists, objects and other strings are none
    number = lambda path: F.when(kind(path) == "BOOLEAN", F.try_variant_get("v_", path, "boolean").cast("double")).otherwise(strip(F.try_variant_get("v_", path, "string")).try_cast("double"))
    df = df.withColumns({"s_": number("$.start"), "e_": number("$.end"), "n_": number("$.score"), "object_": F.coalesce(F.schema_of_variant("v_").startswith("OBJECT"), F.lit(False))})
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    first = F.when(~F.col("object_"), "not_object").when(F.col("s_").isNull() | F.col("e_").isNull(), "not_numeric").when(~(finite("s_") & finite("e_")), "not_finite")
    cues = F.coalesce(kind("$.cues").startswith("OBJECT") | kind("$.cues").isin("VOID") | F.try_variant_get("v_", "$.cues", "string").isin("", "0", "false", "[]"), F.lit(True))
    last = F.when(F.col("n_").isNull() & kind("$.score").isNotNull(), "bad_score").when(~cues, "bad_cues")
    ms = lambda c: F.when(finite(c), F.round(F.col(c) * 1000).cast("bigint"))
    text = lambda path: F.try_variant_get("v_", path, "string")
    out = df.withColumns({"first_error": first, "last_error": last, "start_ms": ms("s_"), "end_ms": ms("e_"), "label": text("$.label"), "score": F.col("n_"), "reason": text("$.reason")})
    return out.drop("v_", "s_", "e_", "n_", "object_")


def validate(raw: DataFrame, duration_ms: Column, knobs: Knobs = KNOBS) -> DataFrame:
    """``raw`` with the label trimmed and in lower case, the score defaulted to 5 and clamped, the reason cut to 400, and
    ``error_code``: the first rule that a row breaks, or null; ``parse_candidates`` may have told of rules before and after these."""
    length = F.col("end_ms") - F.col("start_ms")
    label = F.lower(strip(F.coalesce(F.col("label"), F.lit(""))))
    told = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    code = (
        F.when(told("first_error").isNotNull(), told("first_error"))
        .when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), F.lit("not_numeric"))
        .when(length <= 0, F.lit("inverted"))
        .when((F.col("start_ms") < 0) | (F.col("end_ms") > duration_ms + 1000), F.lit("outside"))
        .when(length < knobs.candidate_min_ms, F.lit("too_short"))
        .when(length > knobs.candidate_max_ms, F.lit("too_long"))
        .when(~label.isin(list(LABELS)), F.lit("unknown_label"))
        .otherwise(told("last_error"))
    )
    score = F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce(F.col("score"), F.lit(5.0))))
    return raw.withColumns({"error_code": code, "label": label, "score": score, "reason": F.substring(strip(F.coalesce("reason", F.lit(""))), 1, 400)})


def validate_batches(validated: DataFrame, batch: str, index: str, knobs: Knobs = KNOBS) -> DataFrame:
    """All or nothing: a batch is accepted if no row has an error and it is not too large; else the first bad row is named."""
    return validated.groupBy(batch).agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("error_code").isNotNull(), F.col(index))).alias("first_bad"),
        ((F.count("*") <= knobs.ops_per_call) & (F.count("error_code") == 0)).alias("accepted"),
    )


def with_label_params(df: DataFrame) -> DataFrame:
    """The registry's columns for each label, those of the default for unknown ones. The registry is a constant of six rows."""
    rows = [F.struct(F.lit(k).alias("l"), *[F.lit(x).alias(n) for x, n in zip((v[0], v[1], v[2], v[3], v[4], v[5] * 1000), ("reframe", "trim", "caption_style", "silence_db", "pad_ms", "max_ms"), strict=True)]) for k, v in LABELS.items()]
    known = F.map_from_entries(F.array(*[F.struct(r["l"], r) for r in rows]))
    spec = F.coalesce(F.try_element_at(known, F.col("label")), F.try_element_at(known, F.lit(DEFAULT_LABEL)))
    df = df.withColumn("spec_", spec)
    long = {"silence_db", "pad_ms", "max_ms"}
    return df.withColumns({n: F.col(f"spec_.{n}").cast("bigint") if n in long else F.col(f"spec_.{n}") for n in ("reframe", "trim", "caption_style", "silence_db", "pad_ms", "max_ms")}).drop("spec_")


def overlap_metrics(df: DataFrame) -> DataFrame:
    """Each interval with the one before it in its source: milliseconds they share, the shorter length, and whether more than half is shared."""
    w = Window.partitionBy("source_id").orderBy("start_ms", "end_ms", "candidate_id")
    before = lambda c: F.lag(c).over(w)
    inter = F.greatest(F.least(before("end_ms"), F.col("end_ms")) - F.greatest(before("start_ms"), F.col("start_ms")), F.lit(0))
    shorter = F.least(before("end_ms") - before("start_ms"), F.col("end_ms") - F.col("start_ms"))
    some = before("end_ms").isNotNull()
    out = df.select("*", F.when(some, inter).alias("shared_ms"), F.when(some, shorter).alias("shorter_ms"))
    return out.withColumn("fuses", F.coalesce(2 * F.col("shared_ms") > F.when(F.col("shorter_ms") > 0, F.col("shorter_ms")), F.lit(False)))


def fuse(df: DataFrame, cues: str | None = None, knobs: Knobs = KNOBS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Overlapping intervals of a source become one where they share more than half of the shorter one.

    Intervals are taken by (start, end, id), and each is fused into the last kept one or kept itself: the union, cut to the
    longest length, with the higher score, and label, reason and id of the winner (the earlier one of equals).
    Cues are merged, the winner's values first. Adds ``n_fused``, the intervals in each.

    What is folded in one piece is a chunk of a source's time, however hot the source.
    """
    fields = ["start_ms", "end_ms", "candidate_id", "label", "score", "reason", *([cues] if cues else [])]
    wins = "p.score >= x.score"
    one = ", ".join(f"x.{c} AS {c}" for c in fields)
    winner = ", ".join(f"IF({wins}, p.{c}, x.{c}) AS {c}" for c in ("candidate_id", "label", "score", "reason"))
    merged = f", map_zip_with(IF({wins}, p.{cues}, x.{cues}), IF({wins}, x.{cues}, p.{cues}), (k, a, b) -> coalesce(a, b)) AS {cues}" if cues else ""
    inter = "(least(p.end_ms, x.end_ms) - greatest(p.start_ms, x.start_ms))"
    shorter = "least(p.end_ms - p.start_ms, x.end_ms - x.start_ms)"
    start = "least(p.start_ms, x.start_ms)"
    fused = f"struct({start} AS start_ms, least(greatest(p.end_ms, x.end_ms), {start} + {knobs.candidate_max_ms}L) AS end_ms, {winner}{merged}, p.n_fused + 1L AS n_fused)"
    return fold_chunks(
        df, ["source_id"], ["start_ms", "end_ms", "candidate_id"], fields,
        first=f"struct({one}, 1L AS n_fused)", joins=f"{inter} > 0 AND 2 * {inter} > {shorter}", merged=fused, width=chunk_ms,
    )
