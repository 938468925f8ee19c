"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwatch.sources.storage import fresh_path

#: Characters that separate words: space and the ASCII controls from tab to carriage return (fixed values).
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: Bytes of a batch that goes to a Python worker, and rows that a Parquet reader decodes at once. Spark's own 10,000 and 4,096 rows of whole
#: texts are tens of MB, which a task holds several times over: in the heap, beside it and in the worker, which all keep what they grew to.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def hash_limit(share: float) -> int:
    """Keys with an ``xxhash64`` up to this number are about ``share`` of all keys, however small the share is."""
    return min(int(share * 2**64), 2**64 - 1) - 2**63


def runs_of(texts: pa.Array, size: int) -> list[tuple[int, int]]:
    """(start, number) of runs of texts that hold about ``size`` bytes each; a longer text stays whole."""
    return cut_runs(pc.binary_length(texts), size)


def cut_runs(lengths: pa.Array, size: int) -> list[tuple[int, int]]:
    """(start, number) of runs whose ``lengths`` (null: 0) sum up to about ``size`` each."""
    if not len(lengths):
        return []
    before = np.cumsum(pc.fill_null(lengths, 0).to_numpy().astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(before // size)) + 1).tolist(), len(lengths)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession) -> None:
    """``TEXT_BATCHES`` hold from now on where the session names no sizes of its own. No result depends on them."""
    for key, size in TEXT_BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, size)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the cluster, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_batchwatch_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="batchwatch-code-")) / "batchwatch.zip"  # Spark's file server hands it out
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.glob("batchwatch/**/*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(target))
    context._batchwatch_shipped = True
