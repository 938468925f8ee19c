"""Exact quantiles and gaps of distribution functions without shuffling every value.

A value histogram moves each distinct value once, which for near-unique numbers is the whole column. Most of them are never looked at: a
quantile needs the values at its rank, the largest gap of two distribution functions those around it. Three scans find these:

1. *Cuts.* A mergeable sample of the distinct values (smallest hash of each hash class, :func:`ordering.cut_points`) cuts every feature into
   cells of about equally many distinct values. It is a pure function of the data, so all scans agree on it.
2. *Counts.* Rows by cell, a few hundred per task and feature. They tell exactly which cell holds a wanted rank, and in which cells the gap
   may exceed the largest one found at a cell's end.
3. *Values.* Only the open cells keep their values; every other cell becomes one row, at its smallest value.

The result is a histogram like any other, in the same order, and exact for the ranks it was made for. It has one row for each closed cell
and the distinct values of the open ones: of 1,024 cells about a thousandth of the values for each rank. Cells stay open for the gap
where they hold more of either side than the gaps found so far differ; for two samples that hardly differ that may be many.

Only for features, whose number is bounded by metadata, as the cuts are broadcast; many groups go through ``ordering``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchwatch.functions import ordering
from batchwatch.functions.quantiles import spot

CELLS = 1024
#: Below this estimate of the input (bytes), moving all values once is cheaper than three scans. The result is the same.
LEAST_BYTES = 1 << 30


def worthwhile(df: DataFrame, bracketed: bool | None = None) -> bool:
    """``bracketed`` where it is given, else by the optimizer's estimate of the input."""
    if bracketed is not None:
        return bracketed
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= LEAST_BYTES


def cells_of(long: DataFrame, group: Sequence[str], value: str, cells: int) -> DataFrame:
    """Rows with ``_cell``, the number of cuts at or below their value."""
    cuts = F.broadcast(ordering.cut_points(long.filter(F.col(value).isNotNull()), group, value, cells).drop("_rows"))
    return ordering.count_at_or_below(long.join(cuts, list(group)), "_cuts", value, cells, "_cell").drop("_cuts")


def holds_rank(probabilities: Sequence[float], count: str) -> Column:
    """Whether a cell holds a rank next to one of the probabilities, or lies between two such ranks."""
    rank = lambda rounding, p: f"{rounding}({spot(p, f'_all_{count}')})"
    inside = f"(`_all_{count}` > 0 AND `_below_{count}` + `{count}` > {{lo}} AND `_below_{count}` <= {{hi}})"
    return F.expr(" OR ".join(inside.format(lo=rank("floor", p), hi=rank("ceil", p)) for p in probabilities))


def may_hold_gap(one: str, other: str, group: Sequence[str]) -> Column:
    """Whether the gap of the two distribution functions may be larger inside a cell than at the end of any cell."""
    share = lambda c, before: F.expr(f"coalesce(try_divide(`_below_{c}`{'' if before else f' + `{c}`'}, `_all_{c}`), 0D)")
    found = F.max(F.abs(share(one, False) - share(other, False))).over(Window.partitionBy(*group))
    return F.greatest(share(one, False) - share(other, True), share(other, False) - share(one, True)) > found


def bracketed_histogram(
    long: DataFrame,
    group: Sequence[str],
    counts: dict[str, Column],
    ranks: dict[str, Sequence[float]],
    gap: tuple[str, str] | None = None,
    sums: dict[str, Column] | None = None,
    value: str = "value",
    cells: int = CELLS,
) -> DataFrame:
    """Histogram of ``long`` (group, value): ``counts`` are summed for each row, ``sums`` likewise without a say in the cells.

    Exact for the probabilities ``ranks`` of each count column and, with ``gap``, for the largest difference of two of them."""
    present = long.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in [*group, value]))
    placed = cells_of(present, group, value, cells)
    totals = [F.sum(c.cast("bigint")).alias(name) for name, c in counts.items()]
    by_group = Window.partitionBy(*group)  # at most cells + 1 rows
    below = by_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sized = placed.groupBy(*group, "_cell").agg(*totals).withColumns(
        {f"_below_{c}": F.coalesce(F.sum(c).over(below), F.lit(0)) for c in counts} | {f"_all_{c}": F.sum(c).over(by_group) for c in counts}
    )
    wanted = [holds_rank(p, c) for c, p in ranks.items()] + ([may_hold_gap(*gap, group)] if gap else [])
    flagged = sized.select(*group, "_cell", F.greatest(*[F.coalesce(w, F.lit(False)).cast("int") for w in wanted], F.lit(0)).alias("_open"))
    opened = flagged.groupBy(*group).agg(F.collect_set(F.when(F.col("_open") > 0, F.col("_cell"))).alias("_list"))
    every = F.sequence(F.lit(0), F.lit(cells))
    flags = F.broadcast(opened.select(*group, F.transform(every, lambda c: F.array_contains("_list", c)).alias("_flags")))
    kept = F.when(F.expr("get(_flags, _cell)"), F.col(value)).alias("_kept")
    extra = [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    out = placed.join(flags, list(group)).groupBy(*group, "_cell", kept).agg(*totals, *extra, F.min(value).alias("_least"))
    return out.select(*group, F.coalesce("_kept", "_least").alias(value), *counts, *(sums or {}))
