"""Streams over files, and tables of latest states kept by them.

Every job writes through ``foreachBatch`` to a folder named after its micro-batch, which it replaces when the
batch is run again, so a restart or a lost executor leaves each result exactly once. Readers combine the
micro-batches with the same aggregate that made them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwatch.config import DEFAULTS

# Window of the rate metrics, event kinds that carry no news.
RATE_WINDOW = "1 minute"
PINGS = ("ping", "connected")


def file_stream(spark: SparkSession, path: str, like: DataFrame, kind: str = "parquet", **options) -> DataFrame:
    """Stream of the files at ``path`` with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema).format(kind)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def run_available(
    stream: DataFrame, work: str, handle: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    """Process everything that is there now and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{work}/checkpoint")
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Store a micro-batch under its own number; running it again replaces it."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def stream_to_table(stream: DataFrame, work: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and return all rows written, with their ``epoch``."""
    path = f"{work}/table"
    run_available(stream, work, batch_writer(path), mode)
    spark = stream.sparkSession
    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def newest_epoch(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update-mode tables hold a key once per batch that touched it: keep the last one."""
    rest = [c for c in table.columns if c not in keys and c != "epoch"]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")


def latest_state(changes: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest values per key; as a stream (update mode) or as a batch."""
    packed = F.max_by(F.struct(*values), F.struct(*order)).alias("_state")
    return changes.groupBy(*keys).agg(packed).select(*keys, "_state.*")


def close_steps(steps: DataFrame, run_events: DataFrame) -> DataFrame:
    """Final step states: a complete run finishes its pending and running steps, a failed run marks the running one.

    ``run_events``: run_id, event (run_complete / run_failed), one row per ended run.
    """
    joined = steps.join(run_events, "run_id", "left")
    open_step = F.col("status").isin("pending", "running")
    status = (
        F.when((F.col("event") == "run_complete") & open_step, "done")
        .when((F.col("event") == "run_failed") & (F.col("status") == "running"), "error")
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).drop("event")


def timed(events: DataFrame, time: str, lateness: str | None = None) -> DataFrame:
    """A stream with ``lateness`` (such as "10 minutes") gets a watermark: state is bounded, and events later than that
    are dropped. Without it nothing is ever late, which replays need, and state grows with the keys. Streams get a
    zoned event time; batches stay as they are."""
    if not events.isStreaming:
        return events
    zoned = events.withColumn(time, F.col(time).cast("timestamp"))
    return zoned.withWatermark(time, lateness) if lateness else zoned


def without_pings(events: DataFrame, event: str = "event") -> DataFrame:
    return events.filter(~F.col(event).isin(*PINGS))


def dedupe_live(events: DataFrame, keys: Sequence[str], time: str = "ts", lateness: str | None = None) -> DataFrame:
    """Stream form: a repeated event is dropped; with ``lateness`` only while its first copy is within that bound."""
    live = timed(without_pings(events), time, lateness)
    return live.dropDuplicatesWithinWatermark(list(keys)) if lateness else live.dropDuplicates(list(keys))


def dedupe_batch(events: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Batch form: first copy of every event."""
    return without_pings(events).groupBy(*keys).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def heartbeat_age(events: DataFrame, source: str, clock: Column, time: str = "ts") -> DataFrame:
    """Seconds since the last sign of life of every source, and whether that is still healthy."""
    last = events.groupBy(source).agg(F.max(time).alias("last_seen"))
    age = F.timestamp_diff("SECOND", F.col("last_seen"), clock)
    return last.withColumn("age_seconds", age).withColumn("healthy", age <= DEFAULTS.heartbeat_seconds)


def event_rate(events: DataFrame, handler: str, is_error: Column, time: str = "ts", lateness: str | None = None) -> DataFrame:
    """Events per second and error share per handler and minute; works on a stream (update mode) and a batch."""
    events = timed(events, time, lateness)
    counted = events.groupBy(F.window(time, RATE_WINDOW).alias("w"), handler).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(is_error).alias("errors")
    )
    return counted.select(
        F.col("w.start").cast("timestamp_ntz").alias("minute"), handler, "events", (F.col("events") / 60.0).alias("per_second"),
        (F.col("errors") / F.col("events")).alias("error_rate"),
    )


def latency_sketch(events: DataFrame, value: str, time: str = "ts", lateness: str | None = None) -> DataFrame:
    """Stream form of the latency quantiles: one bounded sketch per minute."""
    grid = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    return timed(events, time, lateness).groupBy(F.window(time, RATE_WINDOW).alias("w")).agg(
        F.count(value).alias("n"), F.percentile_approx(value, grid, F.lit(10000)).alias("q")
    ).select(F.col("w.start").cast("timestamp_ntz").alias("minute"), "n", "q")
