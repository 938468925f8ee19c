"""batchwatch: data-quality, drift and incident analytics for model inputs, written as Spark jobs."""

from batchwatch.config import DEFAULTS, Thresholds

__all__ = ["DEFAULTS", "Thresholds"]
