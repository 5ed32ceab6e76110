"""Outcomes as texts, for values rather than columns; ``scalar`` has the same rules as expressions."""

from __future__ import annotations


def causes_text(outcome: dict) -> str:
    causes = (("retention", "retention_lost_frames"), ("cleared", "cleared_frames"), ("capture-dropped", "capture_dropped_frames"))
    return ", ".join(f"{label} {outcome[k]}" for label, k in causes if outcome.get(k))


def outcome_text(outcome: dict) -> str:
    frames, lost = outcome.get("frames", 0), outcome.get("lost_frames", 0)
    text = {"written": f"written: {frames} frames", "skipped_silent": f"skipped exact-zero audio: {frames} frames"}.get(outcome["kind"], "no new audio")
    return f"{text}; warning: {lost} frames lost before persistence ({causes_text(outcome)})" if lost else text
