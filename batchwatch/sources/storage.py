"""Where intermediate tables live: the shared folder that the cluster names. Only a local master may do without one."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local master gets a temporary folder, remembered for
    the session and removed when the driver ends; on a cluster executors could not see one another's files, so that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    remembered = "spark.batchwatch.workdir"
    made = spark.conf.get(remembered, None)
    if not made:
        made = tempfile.mkdtemp(prefix="batchwatch-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.conf.set(remembered, made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared root; never reused, so a rerun cannot meet old files."""
    return f"{shared_root(spark)}/batchwatch/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, however often they are read, and safe from lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
