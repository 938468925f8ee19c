"""Two-pass external shuffle into shards.

Pass 1 scatters whole rows into memory-sized buckets by a seeded hash of the row's place in its input file, so neither equal ids,
equal texts nor repeated rows can swell a bucket. Pass 2 puts each bucket into a fixed order, Fisher-Yates shuffles it with the
bucket's own seed and writes it. Buckets stand behind each other; a row's place in that one order gives shard (place mod shards)
and slot (place div shards), so shard counts differ by one at most (law ``rows``).

A lost executor repeats its bucket with the same result: order, seed and offsets depend on rows and seed alone. Memory holds one
bucket for each running task. To the driver come the bucket counts: one long for each ``BUCKET_BYTES`` of text.

Defined cases: null texts count as no bytes and stay null; null ids are kept; repeated rows each get a slot; an empty table
gives an empty table; all columns are carried along, and the three added ones replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwatch.llm.common import free_name, written
from batchwatch.sources.storage import fresh_path

BUCKET_BYTES = 64 << 20


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """Adds as ``name`` a hash of (file, row number in it): the same for any split and any retry. Rows that do not come
    straight from Parquet files are written first."""
    if "FileScan parquet" not in docs._jdf.queryExecution().executedPlan().toString() or "_metadata" in docs.columns:
        docs = written(docs, "shard-input")
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018  only projections and filters of a file keep it
    except Exception:
        docs = written(docs, "shard-input")
    return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name))


def external_shuffle(docs: DataFrame, n_shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The written table: all rows with ``shard``, ``slot`` and ``place``, in shuffled order within each file."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "place")
    row_key, bucket_id = free_name(docs, "row"), free_name(docs, "bucket")
    keyed = with_row_key(docs, row_key)
    total = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    bucketed = keyed.withColumn(bucket_id, F.pmod(F.xxhash64(row_key, F.lit(seed)), F.lit(buckets)).cast("int"))
    sizes = dict(bucketed.groupBy(bucket_id).count().collect())
    offsets = np.zeros(buckets + 1, np.int64)
    np.cumsum([sizes.get(b, 0) for b in range(buckets)], out=offsets[1:])
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("place", T.LongType())])
    columns = docs.columns

    def shuffled(bucket: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        order = np.lexsort((np.arange(rows.num_rows), rows[row_key].to_numpy()))
        order = order[np.random.default_rng([seed & 0xFFFFFFFF, bucket]).permutation(rows.num_rows)]  # Fisher-Yates
        place = offsets[bucket] + np.arange(rows.num_rows)
        for start in range(0, rows.num_rows, 1000):
            part = rows.take(order[start:start + 1000]).select(columns)
            own = place[start:start + 1000]
            for name, values in (("shard", (own % n_shards).astype(np.int32)), ("slot", own // n_shards), ("place", own)):
                part = part.append_column(name, pa.array(values))
            yield from part.combine_chunks().to_batches()

    def shuffle_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            ids = batch.column(bucket_id).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and current != ids[a]:
                    yield from shuffled(current, held)
                    held = []
                current = int(ids[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from shuffled(current, held)

    path = fresh_path(spark, "shards")
    bucketed.repartition(buckets, bucket_id).sortWithinPartitions(bucket_id).mapInArrow(shuffle_buckets, schema).write.parquet(path)
    return spark.read.parquet(path)
