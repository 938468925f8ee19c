"""Writers: accepted and quarantined rows, findings, prediction logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwatch.functions.cells import finite
from batchwatch.sources.storage import stored

# Stores on disk are laid out by them. Up to 200 pieces, Spark writes a shuffle without sorting it first.
FOLDER, FOLDERS = "run_folder", 200


def write_by_run(df: DataFrame, path: str, run: str = "run_id", shared: bool = False) -> None:
    """Parquet partitioned by run; a rerun replaces only the runs it holds.

    The rebalance hint lets Spark split a run that is far larger than the rest and merge tiny ones, so files
    stay of even size however rows are spread over runs. Every run has its folder. In a ``shared`` store the runs are
    dealt to ``FOLDERS`` folders by their hash and lie sorted in the files, so that the number of files follows the bytes and not the
    number of runs; the run is a column of the files there. A store is shared in all its writes or in none, and a shared one has one
    writer at a time, as a rerun also writes the runs in the same folders again.
    """
    if shared:
        # the same hash as that of the folder: a piece holds one folder until small ones are merged
        dealt = _with_neighbours(df, path, run).withColumn("_run", F.col(run).cast("string")).hint("rebalance", FOLDERS, "_run")
        rows, folder = dealt.withColumn(FOLDER, _folder(F.col("_run"))).drop("_run").sortWithinPartitions(FOLDER, run), FOLDER
    else:
        rows, folder = df.hint("rebalance", run), run
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(path)


def _folder(run: Column) -> Column:
    return F.pmod(F.hash(run.cast("string")), F.lit(FOLDERS))


def _with_neighbours(df: DataFrame, path: str, run: str) -> DataFrame:
    """The rows and, of a shared store that is there already, those of all other runs in the folders that the rows go to."""
    try:
        there = df.sparkSession.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException:  # nothing there yet
        return df
    df = stored(df, "rerun")
    runs = df.select(F.col(run).alias("_run")).distinct()
    folders = [r[0] for r in runs.select(_folder(F.col("_run"))).distinct().collect()]  # at most FOLDERS numbers
    others = there.filter(F.col(FOLDER).isin(folders)).join(runs, F.col(run).eqNullSafe(F.col("_run")), "left_anti")
    return df.unionByName(others.drop(FOLDER), allowMissingColumns=True)


def read_run(spark: SparkSession, path: str, run: object, column: str = "run_id") -> DataFrame:
    """One run's accepted rows: only that run's folder, or the one that it shares, is listed and read. A run whose folder may have
    another name than its plain value (or has none) is looked for among all folders."""
    inside = spark.read.option("basePath", path)
    if (isinstance(run, int) and not isinstance(run, bool)) or (isinstance(run, str) and re.fullmatch(r"[A-Za-z][\w-]*", run, re.ASCII)):
        try:
            return inside.parquet(f"{path}/{column}={run}").filter(F.col(column) == run)
        except AnalysisException:  # no such folder, or none with files
            pass
    try:
        folder = spark.range(1).select(_folder(F.lit(run))).first()[0]
        return inside.parquet(f"{path}/{FOLDER}={folder}").filter(F.col(column) == run).drop(FOLDER)
    except AnalysisException:  # no shared store, or no run in that folder
        return spark.read.parquet(path).filter(F.col(column) == run).drop(FOLDER)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def dq_finding_rows(
    checks: DataFrame, types: DataFrame, diffs: DataFrame | None = None, keys: Sequence[str] = (), unseen: DataFrame | None = None
) -> DataFrame:
    """Findings to store: every check, every type mismatch, and one row each for extra and missing columns.

    A category check holds counts and the first values only; with ``unseen`` (from ``unseen_values``) every unseen value
    is stored, too, as a row of kind ``unseen_value`` that neither passes nor fails."""
    rows = checks.select(*keys, "column_name", "check_type", "success", "info", "details")
    mismatch = types.filter(~F.col("compatible")).select(
        *keys, "column_name", F.lit("schema_type_mismatch").alias("check_type"), F.lit(False).alias("success"),
        F.concat(F.col("column_name"), F.lit(": expected "), F.col("expected_type"), F.lit(", got "), F.col("actual_type"))
        .alias("info"),
        F.to_json(F.struct("expected_type", "actual_type")).alias("details"),
    )
    out = rows.unionByName(mismatch)
    if unseen is not None:
        out = out.unionByName(unseen.select(
            *keys, "column_name", F.lit("unseen_value").alias("check_type"), F.lit(None).cast("boolean").alias("success"),
            F.col("upper_value").alias("info"), F.to_json(F.struct(F.col("upper_value").alias("value"), "row_count")).alias("details"),
        ))
    if diffs is not None:
        for name, source in (("extra_columns", "extra_columns"), ("missing_columns", "missing_columns")):
            out = out.unionByName(
                diffs.filter(F.size(source) > 0).select(
                    *keys, F.lit(None).cast("string").alias("column_name"), F.lit(name).alias("check_type"),
                    F.lit(False).alias("success"), F.array_join(source, ", ").alias("info"),
                    F.to_json(F.struct(F.col(source).alias("columns"))).alias("details"),
                )
            )
    return out


def prediction_log(scored: DataFrame, features: Sequence[str], prediction: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per prediction: feature values and the predicted value, non-finite numbers as null."""
    return scored.select(
        *keep, F.array(*[finite(F.col(c).cast("double")) for c in features]).alias("features"),
        finite(F.col(prediction).cast("double")).alias("value"),
    )


