"""Batch readers: CSV, Parquet and JSON files with one documented type inference."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwatch.functions.cells import strip, to_number, without_markers
from batchwatch.operators import profile

# Accepted file kinds.
READERS = (".csv", ".parquet", ".json")
CORRUPT_COLUMN = "_corrupt_record"


def file_kind(path: str) -> str:
    """Lower-cased extension; unknown kinds are refused before any job starts."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind not in READERS:
        raise ValueError(f"Unsupported file type: {kind}")
    return kind


def csv_reader(spark: SparkSession, path: str, columns: Sequence[str] | None, multi_line: bool) -> tuple[object, list[str]]:
    """Reader for quoted cells (doubled quotes, line breaks), its schema being the header and a column for records
    that do not fit. A file whose header differs from ``columns`` (or from the first file's) fails instead of being
    read by position."""
    plain = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    names = list(columns or plain.csv(path).columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, CORRUPT_COLUMN)])
    reader = plain.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_COLUMN).option("enforceSchema", False)
    return reader.schema(schema), names


def load_batch(
    spark: SparkSession, path: str, kind: str | None = None, columns: Sequence[str] | None = None, multi_line: bool = True
) -> DataFrame:
    """Read a batch. CSV cells arrive as text (types are a separate, whole-data decision); NaN becomes null.

    ``columns`` is the file's header where it is known, which saves Spark from opening the files to learn it.
    ``multi_line=False`` lets Spark split large CSV files that have no line breaks inside cells. Records with more
    or fewer cells than the header keep the cells that fit; :func:`unfitting_records` returns them as they stand.
    JSON may be lines of records or one array of records for each file.
    """
    kind = kind or file_kind(path)
    if kind == ".csv":
        reader, names = csv_reader(spark, path, columns, multi_line)
        return reader.csv(path).select(*names)
    if kind == ".parquet":
        return nan_to_null(spark.read.parquet(path))
    return load_json(spark, path)


def unfitting_records(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = True) -> DataFrame:
    """The whole text of CSV records that have more or fewer cells than the header, in ``CORRUPT_COLUMN``."""
    reader, names = csv_reader(spark, path, columns, multi_line)
    # all columns take part, as a reader of the corrupt column alone would parse nothing
    seen = reader.csv(path).withColumn("_cells", F.struct(*names))
    return seen.filter(F.col(CORRUPT_COLUMN).isNotNull() & F.col("_cells").isNotNull()).select(CORRUPT_COLUMN, *names)


def json_array_files(spark: SparkSession, path: str) -> dict[str, bool]:
    """For each file whether it holds one array (its first line that is not blank begins with a bracket). Only the first block of a
    file counts; one row for each file comes back."""
    lines = spark.read.text(path).select(
        F.ltrim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    first = lines.filter("block = 0 AND value <> ''").groupBy("file").agg(F.min_by(F.substring("value", 1, 1), "place").alias("head"))
    return {r["file"]: r["head"] == "[" for r in first.collect()}


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON files, each of them lines of records or one array of records."""
    is_array = json_array_files(spark, path)
    parts = []
    for arrays in (True, False):
        files = sorted(f for f, found in is_array.items() if found == arrays)
        if files:
            parts.append(spark.read.json(files, multiLine=arrays))
    if not parts:
        return spark.read.json(path)
    merged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return nan_to_null(merged.select(*sorted(merged.columns)))


def load_json_array(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that each hold one array of records."""
    return nan_to_null(spark.read.json(path, multiLine=True))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere else, so it leaves here."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def typed_cell(c: Column, dtype: str) -> Column:
    text = without_markers(c)
    if dtype == "int":
        return strip(text).try_cast("bigint")
    if dtype == "float":
        return to_number(text)
    if dtype == "bool":
        return strip(text).try_cast("boolean")
    return text


def apply_types(df: DataFrame, dtypes: dict[str, str]) -> DataFrame:
    """Cast text columns to their inferred or contracted types."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[typed_cell(F.col(c), dtypes[c]).alias(c) if c in texts and c in dtypes else F.col(c) for c in df.columns]
    )


def infer_types(df: DataFrame) -> dict[str, str]:
    """Column -> contract type, from one aggregate over all cells (one row per column comes back)."""
    return {r["column_name"]: r["dtype"] for r in profile.extract_schema(df).select("column_name", "dtype").collect()}


def load_typed(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    raw = load_batch(spark, path, kind)
    return apply_types(raw, infer_types(raw))
