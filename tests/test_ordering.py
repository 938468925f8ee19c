"""Range-split ranks and previous rows against plain windows, with a hot key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from batchwatch.functions import ordering


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 20).cast("string")))
    return spark.range(4000).select(key.alias("k"), (F.col("id") * 7919 % 100003).alias("v"), (F.col("id") % 11).cast("string").alias("s"))


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_row_numbers(rows, buckets):
    mine = ordering.row_numbers(rows, ["k"], ["v"], "n", value="v", buckets=buckets)
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v")).cast("bigint"))
    assert mine.exceptAll(plain.select(mine.columns)).count() == 0 and mine.count() == 4000


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_previous_value(rows, buckets):
    mine = ordering.previous_value(rows, ["k"], "v", "s", "p", buckets)
    plain = rows.withColumn("p", F.lag("s").over(Window.partitionBy("k").orderBy("v")))
    assert mine.exceptAll(plain.select(mine.columns)).count() == 0 and mine.count() == 4000


def test_binary_search(spark):
    for cuts in ([], [1.0], [1.0, 2.0, 3.0], [float(i) for i in range(16)]):
        df = spark.createDataFrame([(cuts, x / 2) for x in range(-4, 40)], "cuts array<double>, v double")
        out = ordering.count_at_or_below(df, "cuts", "v", 16, "n").collect()
        assert [r["n"] for r in out] == [sum(c <= r["v"] for c in r["cuts"]) for r in out]


def test_a_group_is_spread_over_buckets(rows):
    bucketed = ordering.with_bucket(rows, ["k"], "v", 32)
    sizes = bucketed.filter("k = 'hot'").groupBy("_bucket").count()
    assert sizes.count() > 16 and sizes.agg(F.max("count")).first()[0] < 1334 / 3


def test_rows_with_null_keys_stay(spark):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", 3, "c"), ("x", 1, "d")], "k string, v long, s string")
    got = sorted(tuple(r) for r in ordering.row_numbers(rows, ["k"], ["v"], "n", value="v").select("s", "n").collect())
    assert got == [("a", 1), ("b", 2), ("c", 2), ("d", 1)]
    got = sorted((r["s"], r["p"]) for r in ordering.previous_value(rows, ["k"], "v", "s", "p").collect())
    assert got == [("a", None), ("b", "a"), ("c", "d"), ("d", None)]


def test_a_hot_group_is_not_shuffled_to_its_cuts(spark):
    """Nine tenths of the rows have one key: with broadcasts by size off, no partition behind the join holds twice the mean."""
    key = F.when(F.col("id") % 10 != 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))
    rows = spark.range(0, 40_000, 1, 8).select(key.alias("k"), (F.col("id") * 7919 % 100_003).alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = ordering.with_bucket(rows, ["k"], "v", 16)
        sizes = [r["count"] for r in joined.filter("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8 and joined.count() == 40_000
        mine = ordering.row_numbers(rows, ["k"], ["v"], "n", value="v", buckets=16)
        plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v")).cast("bigint"))
        assert mine.exceptAll(plain.select(mine.columns)).count() == 0 and mine.count() == 40_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
