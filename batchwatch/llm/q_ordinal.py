"""Queries of the two ordinal models; the tests measure them on labels that were held out."""

from batchwatch.llm import quality, toxicity
from batchwatch.llm.common import table


def op6_toxicity_severity(spark, sf_dir):
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_grade(spark, sf_dir):
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_toxicity_severity": op6_toxicity_severity, "op8_quality_grade": op8_quality_grade}
