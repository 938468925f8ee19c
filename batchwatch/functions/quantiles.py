"""Exact linear-interpolation quantiles of many columns at once, from value histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwatch.functions import ordering
from batchwatch.functions.cells import stripped_to_number, to_number, with_stripped


def numeric_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, value) rows for the non-null numeric cells of ``columns``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    number = lambda c: (
        stripped_to_number(F.col(c)) if isinstance(types[c], T.StringType) else to_number(F.col(c), types[c])
    )
    cells = [x for c in columns for x in (F.lit(c), number(c))]
    trimmed = with_stripped(df.select(*keys, *columns), columns)
    long = trimmed.select(*keys, F.stack(F.lit(len(columns)), *cells).alias("feature", "value"))
    return long.filter(F.col("value").isNotNull())


def value_histogram(
    long: DataFrame, keys: Sequence[str], counts: dict[str, Column] | None = None, value: str = "value"
) -> DataFrame:
    """One row per (keys, value) with occurrence counts. Repeated values are combined before the shuffle,
    so a value that fills a column costs one row per task."""
    counts = counts or {"n": F.lit(1)}
    present = long.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, value]))
    return present.groupBy(*keys, value).agg(
        *[F.sum(c.cast("bigint")).alias(name) for name, c in counts.items()]
    )


# The expressions below repeat per probability; they are written as SQL text, which reaches the JVM in one call.


def spot(probability: float, total: str) -> str:
    """SQL of the zero-based, possibly fractional rank of a probability."""
    return f"{float(probability)!r}D * (`{total}` - 1)"


def rank_hits(probabilities: Sequence[float], total: str, value: str, count: str, upto: str) -> list[Column]:
    """Aggregates that pick the two values around every wanted rank from rows with running counts."""
    hit = "max(CASE WHEN {r} < `{u}` AND {r} >= `{u}` - `{c}` THEN `{v}` END)"
    out = []
    for i, p in enumerate(probabilities):
        for name, rounding in ((f"_lo{i}", "floor"), (f"_hi{i}", "ceil")):
            rank = f"{rounding}({spot(p, total)})"
            out.append(F.expr(hit.format(r=rank, u=upto, c=count, v=value)).alias(name))
    return out


def interpolate(probabilities: Sequence[float], total: str) -> Column:
    """Array of linear-interpolation quantiles from the ``rank_hits`` columns."""
    parts = [
        f"CASE WHEN _hi{i} = _lo{i} THEN _lo{i} "
        f"ELSE _lo{i} + (_hi{i} - _lo{i}) * ({spot(p, total)} - floor({spot(p, total)})) END"
        for i, p in enumerate(probabilities)
    ]
    return F.expr(f"array({', '.join(parts)})")


def exact_quantiles(
    hist: DataFrame,
    keys: Sequence[str],
    probabilities: Sequence[float],
    count: str = "n",
    value: str = "value",
    buckets: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """keys, group total of the count column, and ``q``: one quantile per probability.

    Only the value ranges that hold a wanted rank are ordered; all other rows stop at their bucket total.
    """
    bucketed = ordering.with_bucket(hist, keys, value, buckets, [count], bounded)
    offsets = ordering.bucket_offsets(bucketed, keys, [count])
    total = f"_all_{count}"
    ranks = [f"{rounding}({spot(p, total)})" for p in probabilities for rounding in ("floor", "ceil")]
    inside = "{r} >= `_below_{c}` AND {r} < `_below_{c}` + `_in_{c}`"
    wanted = F.expr(" OR ".join(f"({inside.format(r=r, c=count)})" for r in ranks))
    kept = ordering.attach_offsets(bucketed, offsets.filter(wanted), keys, [count], bounded)
    running = F.sum(count).over(ordering.within_bucket(keys, value))
    found = (
        kept.withColumn("_upto", F.col(f"_below_{count}") + running)
        .groupBy(*keys, total)
        .agg(*rank_hits(probabilities, total, value, count, "_upto"))
    )
    return found.select(*keys, F.col(total).alias(count), interpolate(probabilities, total).alias("q"))


def approximate_quantiles(
    long: DataFrame, keys: Sequence[str], probabilities: Sequence[float], accuracy: int = 10000
) -> DataFrame:
    """Same shape from one bounded sketch per group; rank error about 1/accuracy, no value shuffle."""
    grid = F.array(*[F.lit(float(p)) for p in probabilities])
    return long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.percentile_approx("value", grid, F.lit(accuracy)).alias("q")
    )


def ks_pvalue(statistic: str, n: str, m: str) -> Column:
    """Two-sided asymptotic Smirnov probability; 1 where a side is empty or the statistic is about zero."""
    lam = f"(`{statistic}` * sqrt(CAST(`{n}` AS DOUBLE) * `{m}` / (`{n}` + `{m}`)))"
    return F.expr(
        f"""CASE WHEN `{n}` = 0 OR `{m}` = 0 OR {lam} < 0.2 THEN 1.0D
        ELSE greatest(0.0D, least(1.0D, 2.0D * aggregate(sequence(1, 100), 0.0D,
          (acc, k) -> acc + pow(-1.0D, k - 1) * exp(-2.0D * k * k * {lam} * {lam})))) END"""
    )


def linspace(parts: int) -> list[float]:
    return [i / parts for i in range(parts + 1)]
