"""Toxicity severity by cumulative-link regression; see :mod:`batchwatch.llm.ordinal` for the method and the defined cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwatch.llm import ordinal

#: Expected severity from which a document counts as toxic.
MIN_SEVERITY = 0.5


def severity(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 clean, 1 toxic, 2 toxic and of bad quality."""
    return labels.select("doc_id", F.expr("toxic + if(toxic = 1 and quality = 0, 1, 0)").cast("long").alias("grade"))


def grade(docs: DataFrame, labels: DataFrame, min_severity: float = MIN_SEVERITY) -> DataFrame:
    """doc_id, expected_severity, tail (probability of the worst grade) and toxic, one row for each row of ``docs``."""
    scored = ordinal.score(docs, ordinal.fit(docs, severity(labels)))
    return scored.select("doc_id", F.col("expected").alias("expected_severity"), "tail", (F.col("expected") >= min_severity).alias("toxic"))
