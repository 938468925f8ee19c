"""Quality selection by cumulative-link regression; see :mod:`batchwatch.llm.ordinal` for the method and the defined cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwatch.llm import ordinal

#: Smallest probability of the best grade for a document to be kept.
MIN_TAIL = 0.5


def rating(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 toxic, 1 of bad quality, 2 good."""
    return labels.select("doc_id", F.expr("if(toxic = 1, 0, 1 + quality)").cast("long").alias("grade"))


def select(docs: DataFrame, labels: DataFrame, min_tail: float = MIN_TAIL) -> DataFrame:
    """doc_id, expected_grade, tail (probability of the best grade) and kept, one row for each row of ``docs``."""
    scored = ordinal.score(docs, ordinal.fit(docs, rating(labels)))
    return scored.select("doc_id", F.col("expected").alias("expected_grade"), "tail", (F.col("tail") >= min_tail).alias("kept"))
