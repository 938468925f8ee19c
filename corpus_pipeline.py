"""From raw documents to token ids: language, near duplicates, benchmark leaks, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``. Rows with null columns, empty texts, repeated rows and empty tables are
defined by the operators' docstrings; extra columns are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwatch.llm import bpe, decontaminate, jaccard_join, language, secrets
from batchwatch.llm.common import ship, small_batches, table, written


def ready(spark: SparkSession) -> None:
    """The executors run all stages in the same processes, so what one stage takes stays taken in the next ones."""
    ship(spark)
    small_batches(spark)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go."""
    ready(spark)
    return language.accepted(docs, language.learn(docs))


def keep_first_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest id."""
    ready(spark)
    return jaccard_join.first_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    ready(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text become the name of their kind; ``n_chars`` follows the text."""
    ready(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the text, their number and the hash of the text that they decode to."""
    ready(spark)
    return bpe.round_trip(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_first_of_class),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]
#: Fitted models and automata have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
