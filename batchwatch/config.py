"""Decision thresholds shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass


# The default limits every decision is checked against.
@dataclass(frozen=True)
class Thresholds:
    null_ratio: float = 0.30
    row_issue_ratio: float = 0.70
    min_clean_rows: int = 10
    min_clean_ratio: float = 0.50
    categorical_limit: int = 50
    high_cardinality_limit: int = 200
    high_cardinality_ratio: float = 0.20
    text_sample: int = 20
    candidate_sample: int = 10
    candidate_ratio_min_rows: int = 50
    drift_detected: float = 0.2
    min_training_rows: int = 25
    max_target_null_ratio: float = 0.10
    max_class_count: int = 20
    max_class_unique_ratio: float = 0.35
    min_class_count: int = 3
    test_size: float = 0.20
    heartbeat_seconds: int = 120


DEFAULTS = Thresholds()
