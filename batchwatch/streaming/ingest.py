"""Arrival of batch files: validate, clean, store and keep a ledger; and the sweep for runs to analyse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwatch.operators import clean
from batchwatch.operators.profile import ColumnRule
from batchwatch.sources.sinks import write_by_run
from batchwatch.sources.storage import stored
from batchwatch.streaming import feeds

# Outcome of a file in the ledger.
PROCESSED, FAILED = "processed", "failed"
LEDGER = "run_id string, rows_in bigint, rows_out bigint, rows_removed bigint, status string"


def incoming(spark: SparkSession, folder: str, columns: Sequence[str], pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Stream of the CSV files in a folder; ``run_id`` is the name of the file's own folder. A file whose header is not ``columns`` fails
    the stream instead of being read by position; ``assemble`` reads files by the names in their own headers."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).option("recursiveFileLookup", True)
    files = reader.option("multiLine", True).option("quote", '"').option("escape", '"').csv(folder)
    return files.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def ingest(stream: DataFrame, rules: Sequence[ColumnRule], work: str, keep: Sequence[str] = ()) -> DataFrame:
    """Clean every arriving batch against the baseline; returns the ledger (one row per run and micro-batch).

    Accepted and quarantined rows go to ``work``/accepted and ``work``/quarantine. A batch without a usable row
    counts as failed.
    """

    def handle(df: DataFrame, epoch: int) -> None:
        # written once: fills, accepted rows, quarantine and audit would each read and parse the files again
        flagged = stored(clean.flag_rows(df, rules, keep=["run_id", *keep]), "flagged")
        cleaned = clean.clean_batch(flagged, rules, keys=["run_id"], keep=keep)
        write_by_run(cleaned, f"{work}/accepted/epoch={epoch}")
        write_by_run(
            clean.quarantined(flagged, rules, ["run_id", *keep]),
            f"{work}/quarantine/epoch={epoch}",
        )
        audit = clean.cleaning_audit(flagged, ["run_id"]).withColumn(
            "status", F.when(F.col("rows_out") > 0, PROCESSED).otherwise(FAILED)
        )
        feeds.batch_writer(f"{work}/ledger")(audit, epoch)

    # an entry without rows, so that the ledger can be read before anything has arrived
    start = stream.sparkSession.createDataFrame([], LEDGER)
    feeds.batch_writer(f"{work}/ledger")(start, -1)
    feeds.run_available(stream, work, handle)
    ledger = stream.sparkSession.read.schema(LEDGER).parquet(f"{work}/ledger")
    return ledger.groupBy("run_id").agg(
        F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"),
        F.sum("rows_removed").alias("rows_removed"),
        F.when(F.sum("rows_out") > 0, PROCESSED).otherwise(FAILED).alias("status"),
    )


def sweep(runs: DataFrame, models: DataFrame, analysed: DataFrame, work: str) -> DataFrame:
    """Follow a stream of runs and return the latest run of each tenant that still needs an analysis.

    Each micro-batch stores only its newest run per tenant; the final answer is the newest of those.
    """
    owner = models.select("model_id", "tenant_id")
    newest = lambda df: feeds.latest_state(
        df, ["tenant_id"], ["run_id", "model_id", "created_at"], ["created_at", "run_id"]
    )

    def handle(df: DataFrame, epoch: int) -> None:
        feeds.batch_writer(f"{work}/newest")(newest(df.join(owner, "model_id")), epoch)

    feeds.run_available(runs, work, handle)
    stored = runs.sparkSession.read.parquet(f"{work}/newest")
    return newest(stored).join(analysed.select("run_id").distinct(), "run_id", "left_anti")
