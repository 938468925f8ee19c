"""Exact ordered computations (ranks, running totals, previous row) without one task per group.

A window partitioned by a hot key puts that key's rows into one task. Here each group is first cut into
value ranges, so that only ranges are ordered by one task and range totals (a few rows per group) are
carried forward:

1. cut points: group rows by (keys, hash class of the value) and keep the value with the smallest hash
   of each class. That is a uniform sample of the distinct values, at most ``buckets`` per group, found
   with map-side combining, and it is a pure function of the data, so a recomputed task gives the same cuts;
2. bucket of a row = number of cut points <= its value;
3. per-bucket totals -> offsets of each bucket (window over at most ``buckets + 1`` rows);
4. window inside (keys, bucket), plus the offset.

``bounded=True`` says the number of key groups is limited by metadata (one group per column): the
per-group helper tables are then at most (columns x buckets) rows and are broadcast. Otherwise rows meet their group's cut points in
:func:`join_groups`: fewer than ``HEAVY`` groups can hold more than 1 / ``HEAVY`` of all rows each, so the cut points of these are
broadcast and their rows stay where they are; the rest is shuffled, with no group above that share.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 1024
#: Groups with more than this fraction of all rows (its inverse) are heavy.
HEAVY = 1000


def default_buckets(df: DataFrame) -> int:
    """Follow the cluster's own shuffle width, within a bound on the helper tables."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(MAX_BUCKETS, width))


def hint(df: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(df) if bounded else df


def join_groups(rows: DataFrame, table: DataFrame, keys: Sequence[str], sizes: str, how: str = "inner") -> DataFrame:
    """Rows with their group's row of ``table``, which has one row for each group and the number of its rows in ``sizes`` (dropped).

    A group of any size is spread: heavy groups are joined by a broadcast of fewer than ``HEAVY`` rows, the others by a shuffle.
    ``how="left"`` keeps rows of groups that the table lacks."""
    total = table.agg(F.sum(sizes)).scalar()
    is_heavy = F.col(sizes) * HEAVY > total
    heavy = F.broadcast(table.filter(is_heavy).drop(sizes))
    light = table.filter(~is_heavy | F.col(sizes).isNull()).drop(sizes)
    few = rows.join(heavy.select(*keys), list(keys), "left_anti").join(light, list(keys), how)
    many = rows.join(heavy, list(keys))
    return few.select(*many.columns).union(many)


def count_at_or_below(df: DataFrame, cuts: str, value: str, longest: int, out: str) -> DataFrame:
    """Add how many entries of the sorted array ``cuts`` are <= ``value``: a binary search in
    log2(longest) generated-code steps, instead of visiting every entry."""
    step = 1 << max(longest, 1).bit_length() - 1
    df = df.withColumn(out, F.lit(0))
    while step:
        fits = f"get(`{cuts}`, `{out}` + {step - 1}) <= `{value}`"
        df = df.withColumn(out, F.expr(f"CASE WHEN {fits} THEN `{out}` + {step} ELSE `{out}` END"))
        step >>= 1
    return df


def cut_points(
    rows: DataFrame, keys: Sequence[str], value: str, buckets: int, totals: Sequence[str] = ()
) -> DataFrame:
    """One row per group: sorted cut points, number of rows, and the group total of every column in ``totals``."""
    digest = F.xxhash64(value)
    sampled = rows.groupBy(*keys, F.pmod(digest, F.lit(buckets)).alias("_class")).agg(
        F.min_by(value, digest).alias("_cut"), F.count(F.lit(1)).alias("_rows"), *[F.sum(t).alias(f"_all_{t}") for t in totals]
    )
    cuts = sampled.groupBy(*keys).agg(
        F.array_sort(F.collect_list("_cut")).alias("_cuts"), F.sum("_rows").alias("_rows"),
        *[F.sum(f"_all_{t}").alias(f"_all_{t}") for t in totals],
    )
    for t in totals:  # stated here so that every use of the cuts is the same plan and runs once
        cuts = cuts.filter(F.col(f"_all_{t}").isNotNull())
    return cuts


def with_bucket(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    buckets: int | None = None,
    totals: Sequence[str] = (),
    bounded: bool = False,
) -> DataFrame:
    """Add ``_bucket`` (order-preserving) and ``_all_<t>`` group totals to every row."""
    buckets = buckets or default_buckets(rows)
    cuts = cut_points(rows, keys, value, buckets, totals)
    joined = rows.join(F.broadcast(cuts.drop("_rows")), list(keys)) if bounded else join_groups(rows, cuts, keys, "_rows")
    return count_at_or_below(joined, "_cuts", value, buckets, "_bucket").drop("_cuts")


def bucket_offsets(bucketed: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Per (keys, bucket, group totals): total and sum of all lower buckets, for every count column."""
    group = [*keys, "_bucket", *group_total_columns(bucketed)]
    sums = bucketed.groupBy(*group).agg(*[F.sum(c).alias(f"_in_{c}") for c in counts])
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns(
        {f"_below_{c}": F.coalesce(F.sum(f"_in_{c}").over(below), F.lit(0)) for c in counts}
    )


def group_total_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_all_")]


def within_bucket(keys: Sequence[str], *order: str | Column):
    """Running window inside one value range of a group."""
    return (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def attach_offsets(
    bucketed: DataFrame, offsets: DataFrame, keys: Sequence[str], counts: Sequence[str], bounded: bool
) -> DataFrame:
    """Join rows with their bucket's offsets.

    The group totals are part of the join key although (keys, bucket) decides the match: both sides then read
    the same columns of the same shuffled rows, so Spark reuses that shuffle instead of computing it again.
    """
    on = [*keys, "_bucket", *group_total_columns(bucketed)]
    return bucketed.join(hint(offsets.select(*on, *[f"_below_{c}" for c in counts]), bounded), on)


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    counts: Sequence[str],
    buckets: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add ``upto_<c>`` (running sum by value, exact) and ``_all_<c>``; one row per (keys, value) expected."""
    bucketed = with_bucket(rows, keys, value, buckets, counts, bounded)
    joined = attach_offsets(bucketed, bucket_offsets(bucketed, keys, counts), keys, counts, bounded)
    inside = within_bucket(keys, value)
    return joined.withColumns(
        {f"upto_{c}": F.col(f"_below_{c}") + F.sum(c).over(inside) for c in counts}
    ).drop("_bucket", *[f"_below_{c}" for c in counts])


def with_null_keys(compute):
    """Rows with a null key are groups, too (nulls are equal), but an equality join would lose them. They go through
    ``compute`` apart, keyed by the text of their keys."""

    @functools.wraps(compute)
    def both(rows: DataFrame, keys: Sequence[str], *args, **kwargs) -> DataFrame:
        nullable = [k for k in keys if rows.schema[k].nullable]
        if not nullable:
            return compute(rows, keys, *args, **kwargs)
        missing = functools.reduce(operator.or_, [F.col(k).isNull() for k in nullable])
        apart = rows.filter(missing).withColumn("_null_key", F.to_json(F.struct(*keys)))
        return compute(rows.filter(~missing), keys, *args, **kwargs).unionByName(
            compute(apart, ["_null_key"], *args, **kwargs).drop("_null_key")
        )

    return both


@with_null_keys
def row_numbers(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str = "row_number",
    bucket: Column | None = None,
    value: str | None = None,
    buckets: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Exact 1-based row number per group. Give ``bucket`` (an order-preserving expression) or a numeric ``value``."""
    bucketed = (
        rows.withColumn("_bucket", bucket)
        if bucket is not None
        else with_bucket(rows, keys, value, buckets, bounded=bounded)
    )
    bucketed = bucketed.withColumn("_one", F.lit(1).cast("bigint"))
    offsets = bucket_offsets(bucketed, keys, ["_one"])
    return (
        attach_offsets(bucketed, offsets, keys, ["_one"], bounded)
        .withColumn(out, F.col("_below__one") + F.row_number().over(within_bucket(keys, *order)))
        .drop("_bucket", "_one", "_below__one")
    )


@with_null_keys
def previous_value(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
    buckets: int | None = None,
) -> DataFrame:
    """``lag(value)`` per group ordered by the numeric, unique ``order`` column, bucket by bucket."""
    bucketed = with_bucket(rows, keys, order, buckets)
    last = bucketed.groupBy(*keys, "_bucket").agg(F.max_by(value, order).alias("_last"))
    carried = last.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))
    ).drop("_last")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        bucketed.join(carried, [*keys, "_bucket"])
        .withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.lag(value).over(inside)))
        .drop("_bucket", "_carry", "_first")
    )
