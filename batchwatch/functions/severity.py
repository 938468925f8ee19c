"""Severity scale: text to rank, rank to text, and score to severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scale, lowest first, and the score at which each level starts.
LEVELS = ("low", "medium", "high", "critical")
DRIFT_LEVELS = ((0.5, "critical"), (0.3, "high"), (0.2, "medium"))


def rank(severity: Column) -> Column:
    """0..3 for the four levels, case-insensitive; unknown or null counts as low."""
    text = F.lower(F.trim(severity))
    out = F.lit(0)
    for position, level in enumerate(LEVELS[1:], start=1):
        out = F.when(text == level, position).otherwise(out)
    return out


def label(rank_value: Column) -> Column:
    out = F.lit(LEVELS[0])
    for position, level in enumerate(LEVELS[1:], start=1):
        out = F.when(rank_value == position, level).otherwise(out)
    return out


def worst(severity: Column) -> Column:
    """Aggregate: highest severity of a group."""
    return label(F.max(rank(severity)))


def of_drift_score(score: Column) -> Column:
    out = F.lit(LEVELS[0])
    for start, level in reversed(DRIFT_LEVELS):
        out = F.when(score >= start, level).otherwise(out)
    return out
