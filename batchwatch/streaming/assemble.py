"""Runs that arrive in pieces: files are noted as they come, and a run is processed once, when all files of its manifest are there.

The stream carries file names only. Each run has a folder (its name, or what follows ``=`` in it, is the run's id) with CSV files and a JSON
file, the manifest, that lists them: ``{"files": ["a.csv", ...]}``. Every micro-batch stores
what arrived under its own number; a run is due in the micro-batch that brought the last missing piece. That is a function of the stored
arrivals, so a micro-batch that is run again after a failure handles the same runs and replaces their results. Cells are read by the names
in each file's header; files of a run may order their columns differently. A file that cannot be read fails its run, with the reason in
the ledger, and no other.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwatch.operators import run
from batchwatch.operators.profile import ColumnRule
from batchwatch.streaming import feeds

# Kind of the files that list a run's files; outcome of a run that could not be read, and of one whose files are
# not all there.
MANIFEST, UNREADABLE, WAITING = ".json", "unreadable", "waiting"
LEDGER = (
    "run_id string, total_rows bigint, cleaned_rows bigint, rows_removed bigint, extra_columns array<string>, missing_columns array<string>, "
    "raw_failures bigint, schema_errors bigint, failed_checks bigint, clean_row_ratio double, blocking_reasons array<string>, status string"
)
FILES = "path string, modificationTime timestamp, length bigint, content binary"
ARRIVALS = "path string, run_id string, name string, length bigint, epoch int"
EXPECTED = "run_id string, name string, epoch int"


def run_of(path: str) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -2), "^[^=]*=", "")


def arrivals(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Stream of the files below ``folder``: path, run_id (the file's folder), name and length. No content is read."""
    files = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", True).options(**options).load(folder)
    return files.select("path", run_of("path").alias("run_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def due_runs(arrived: DataFrame, expected: DataFrame, epoch: int) -> DataFrame:
    """run_id of the runs whose last piece, manifest or file, came in ``epoch``. A file that comes again counts when it first came."""
    first = arrived.groupBy("run_id", "name").agg(F.min("epoch").alias("came"))
    listed = expected.groupBy("run_id", "name").agg(F.min("epoch").alias("asked"))
    pieces = listed.join(first, ["run_id", "name"], "left")
    whole = pieces.groupBy("run_id").agg(F.count_if(F.col("came").isNull()).alias("open"), F.max(F.greatest("came", "asked")).alias("due"))
    return whole.filter(f"open = 0 AND due = {int(epoch)}").select("run_id")


def waiting_runs(arrived: DataFrame, expected: DataFrame) -> DataFrame:
    """Ledger rows of runs that are held back, with the files they wait for. Files of no bytes never arrive in Spark's file streams, so a run
    that lists one is found here."""
    came = arrived.select("run_id", "name").distinct()
    missing = expected.select("run_id", "name").distinct().join(came, ["run_id", "name"], "left_anti")
    listed = missing.groupBy("run_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("File is missing or empty: "), "name"))).alias("blocking_reasons"))
    given = {"blocking_reasons", "run_id"}
    fields = T.StructType.fromDDL(LEDGER).fields
    return listed.withColumn("status", F.lit(WAITING)).select(
        *[F.col(f.name) if f.name in given or f.name == "status" else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    )


def headers(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """First line of each file; one row for each file comes back."""
    lines = spark.read.text(files).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )
    return {r["file"]: r["head"] for r in lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "place").alias("head")).collect()}


def why_unreadable(name: str, length: int, head: str | None) -> str | None:
    if not name.lower().endswith(".csv"):
        return f"Unsupported file type: {name}"
    if not length or not (head or "").strip():
        return f"File is empty: {name}"
    names = next(csv.reader([head]))
    return f"Column names repeat: {name}" if len(set(names)) < len(names) else None


def read_by_name(spark: SparkSession, by_header: dict[str, list[str]], wanted: Sequence[str]) -> DataFrame:
    """run_id and the ``wanted`` cells, as text, of files with any of the headers; columns that a file lacks are null."""
    parts = []
    for head, files in sorted(by_header.items()):
        names = next(csv.reader([head]))
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True)
        rows = reader.option("quote", '"').option("escape", '"').csv(files)
        parts.append(rows.select(run_of("_metadata.file_path").alias("run_id"), *[F.col(f"`{c}`") if c in names else F.lit(None).cast("string").alias(c) for c in wanted]))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in ("run_id", *wanted)]))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def process(spark: SparkSession, due: list, rules: Sequence[ColumnRule], keep: Sequence[str]) -> tuple[DataFrame, run.BatchRun | None]:
    """Ledger rows of due runs, given their files (path, run_id, name, length), and the results of those that could be read."""
    plain = {f["path"]: f for f in due}
    heads = headers(spark, [p for p, f in plain.items() if f["length"] and f["name"].lower().endswith(".csv")]) if plain else {}
    heads = {p.removeprefix("file://").removeprefix("file:"): h for p, h in heads.items()}
    bad: dict[str, list[str]] = {}
    by_header: dict[str, list[str]] = {}
    head_of = lambda f: heads.get(f["path"].removeprefix("file://").removeprefix("file:"))
    for f in plain.values():
        reason = why_unreadable(f["name"], f["length"], head_of(f))
        if reason:
            bad.setdefault(f["run_id"], []).append(reason)
    present = []
    for f in plain.values():
        if f["run_id"] not in bad:
            by_header.setdefault(head_of(f), []).append(f["path"])
            present += [(f["run_id"], c) for c in next(csv.reader([head_of(f)])) if c not in keep]
    failed = spark.createDataFrame([(r, 0, 0, 0, [], [], 0, 0, 0, 0.0, sorted(why), UNREADABLE) for r, why in bad.items()], LEDGER)
    readable = sorted({f["run_id"] for f in plain.values()} - set(bad))
    if not readable:
        return failed, None
    runs = spark.createDataFrame([(r,) for r in readable], "run_id string")
    rows = read_by_name(spark, by_header, [*dict.fromkeys([*keep, *[r.name for r in rules]])])
    result = run.run_batches(runs, rows, spark.createDataFrame(present, "run_id string, column_name string"), rules, keep)
    return failed.unionByName(result.runs), result


def ingest_runs(spark: SparkSession, folder: str, rules: Sequence[ColumnRule], work: str, keep: Sequence[str] = (), **options) -> DataFrame:
    """Processes what has arrived below ``folder``; returns the ledger, one row for each run that is complete or held back.

    Accepted rows, quarantined rows and findings go to ``work``, by micro-batch. Call it again when more files have come."""

    def handle(df: DataFrame, epoch: int) -> None:
        is_manifest = F.col("name").endswith(MANIFEST)
        feeds.batch_writer(f"{work}/arrivals")(df.filter(~is_manifest), epoch)
        manifests = [r["path"] for r in df.filter(is_manifest).select("path").collect()]
        listed = (
            spark.read.schema("files array<string>").json(manifests, multiLine=True)
            .select(run_of("_metadata.file_path").alias("run_id"), F.explode("files").alias("name"))
            if manifests else spark.createDataFrame([], "run_id string, name string")
        )
        feeds.batch_writer(f"{work}/expected")(listed, epoch)
        arrived = spark.read.schema(ARRIVALS).parquet(f"{work}/arrivals")
        expected = spark.read.schema(EXPECTED).parquet(f"{work}/expected")
        runs = due_runs(arrived, expected, epoch)
        files = arrived.join(expected.select("run_id", "name").distinct(), ["run_id", "name"], "left_semi").join(runs, "run_id", "left_semi")
        due = files.groupBy("run_id", "name").agg(F.min_by(F.struct("path", "length"), "epoch").alias("f")).select("run_id", "name", "f.path", "f.length").collect()
        ledger, result = process(spark, due, rules, keep)
        feeds.batch_writer(f"{work}/ledger")(ledger, epoch)
        if result is not None:
            feeds.batch_writer(f"{work}/accepted")(result.accepted, epoch)
            feeds.batch_writer(f"{work}/quarantine")(result.quarantined, epoch)
            feeds.batch_writer(f"{work}/findings")(result.findings, epoch)

    for name, schema in (("ledger", LEDGER), ("arrivals", ARRIVALS), ("expected", EXPECTED)):  # so that they can be read before anything has come
        feeds.batch_writer(f"{work}/{name}")(spark.createDataFrame([], schema.replace(", epoch int", "")), -1)
    feeds.run_available(arrivals(spark, folder, **options), work, handle)
    known = {name: spark.read.schema(schema).parquet(f"{work}/{name}") for name, schema in (("arrivals", ARRIVALS), ("expected", EXPECTED))}
    done = spark.read.schema(LEDGER).parquet(f"{work}/ledger").drop("epoch")
    return done.unionByName(waiting_runs(known["arrivals"], known["expected"]))
