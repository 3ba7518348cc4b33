"""Knobs and the label registry. Times are milliseconds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Knobs:
    """Call-time settings; ``constrained()`` gives those of small machines. The defaults are fixed values."""

    window_ms: int = 600_000
    overlap_ms: int = 120_000
    segment_cap: int = 240
    candidates_returned: int = 100
    frame_budget: int = 60
    frames_per_call: int = 20
    ops_per_call: int = 50
    candidate_min_ms: int = 3_000
    candidate_max_ms: int = 180_000
    clip_min_ms: int = 5_000
    clip_max_ms: int = 60_000
    intro_guard_ms: int = 8_000
    crossfade_ms: int = 150
    min_segment_ms: int = 250
    min_drop_ms: int = 250
    ttl_hours: int = 168
    source_age_hours: int = 24


def constrained() -> Knobs:
    return Knobs(window_ms=300_000, segment_cap=120, candidates_returned=30, frame_budget=24, frames_per_call=8)


KNOBS = Knobs()

# The label registry and the drop thresholds of its trims.
LABELS = {
    # label: (reframe, trim, caption style, silence dB, pad ms, max s)
    "quote": ("speaker", "tight", "key_phrase", -30, 150, 60),
    "joke": ("speaker", "very_tight", "punchline", -30, 120, 45),
    "story": ("speaker", "gentle", "minimal", -32, 200, 60),
    "argument": ("stacked", "medium", "dual_speaker", -30, 150, 60),
    "hot_take": ("speaker", "tight", "key_phrase", -30, 150, 50),
    "reaction": ("speaker", "tight", "sparse", -28, 250, 30),
}
DROP_MS = {"very_tight": 600, "tight": 800, "medium": 1100, "gentle": 1800}
DEFAULT_DROP_MS = 500
DEFAULT_LABEL = "quote"
# Modes, and words of a caption line by style.
REFRAME_MODES = ("speaker", "center", "stacked", "fit")
PLAN_MODES = ("auto", "by_label", "by_topic", "montage", "supercut")
WORDS_PER_LINE = {"key_phrase": 4, "punchline": 4, "dual_speaker": 5, "minimal": 3, "sparse": 3}
DEFAULT_WORDS_PER_LINE = 4
