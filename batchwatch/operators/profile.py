"""Baselines: inferred types, numeric and categorical column profiles, and the baseline table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwatch.config import DEFAULTS
from batchwatch.functions import brackets, quantiles
from batchwatch.functions.cells import (
    INTEGER_PATTERN,
    is_identifier,
    is_identifier_col,
    strip,
    stripped_is_marker,
    stripped_to_number,
    to_number,
)

# Spellings read as a boolean column, profile modes that carry no list of allowed values.
BOOLEAN_SPELLINGS = ("true", "false", "True", "False", "TRUE", "FALSE")
OPEN_MODES = ("identifier", "high_cardinality", "text")
PROFILE_QUANTILES = (0.0, 0.01, 0.5, 0.99, 1.0)


@dataclass(frozen=True)
class ColumnRule:
    """One column of a baseline: its contract type and its profile."""

    name: str
    dtype: str
    type: str | None = None
    validation_mode: str | None = None
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    median: float | None = None
    p01: float | None = None
    p99: float | None = None
    unique_values: tuple[str, ...] = ()
    sample_values: tuple[str, ...] = ()

    @property
    def is_numeric(self) -> bool:
        return self.min is not None and self.max is not None

    @property
    def is_enum(self) -> bool:
        return bool(self.unique_values) and not is_identifier(self.name) and self.validation_mode not in OPEN_MODES

    def bounds(self, kind: str = "percentile") -> tuple[float, float] | None:
        """Accepted range: p01..p99 where known, else min..max; ``kind='minmax'`` ignores the percentiles."""
        if not self.is_numeric or is_identifier(self.name):
            return None
        if kind == "minmax":
            return float(self.min), float(self.max)
        lo = self.min if self.p01 is None else self.p01
        hi = self.max if self.p99 is None else self.p99
        return float(lo), float(hi)

    def allowed(self) -> list[str]:
        return sorted({str(v).strip().upper() for v in self.unique_values})


def contract_type(dtype: T.DataType) -> str:
    """Spark type to contract type; everything that is not a number, flag or time is ``object``."""
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "object"


def column_class(dtype: Column) -> Column:
    return (
        F.when(dtype.isin("int", "float"), "numeric")
        .when(dtype == "bool", "boolean")
        .when(dtype == "datetime", "datetime")
        .otherwise("categorical")
    )


def extract_schema(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """keys, column_name, dtype and the cell counts behind it, for all columns in one pass.

    Typed columns keep their contract type. A text column is ``int`` when every cell is an integer and none is
    missing, ``bool`` when every cell is a boolean spelling and none is missing, ``float`` when every non-missing
    cell is a number, else ``object`` (also when all cells are missing). Missing means null or a missing marker.
    """
    columns = [c for c in (columns or df.columns) if c not in keys]
    types = {f.name: f.dataType for f in df.schema.fields}
    is_text = [isinstance(types[c], T.StringType) for c in columns]
    # One row for each cell: the same short code judges all columns, where an aggregate over all of them at once is too long to be compiled.
    cells = []
    for i, (name, text) in enumerate(zip(columns, is_text)):
        raw, none = F.col(name), F.lit(None)
        number = none if text else to_number(raw, types[name])
        cells += [F.lit(i), raw if text else none.cast("string"), (none if text else raw.isNotNull()).cast("boolean"), number.cast("double")]
    if not columns:
        cells = [F.lit(-1), *[F.lit(None).cast(t) for t in ("string", "boolean", "double")]]
    long = df.select(*keys, F.stack(F.lit(max(len(columns), 1)), *cells).alias("_i", "_raw", "_present", "_typed"))
    trimmed = long.withColumn("_text", strip(F.col("_raw"))).withColumn("_number", F.coalesce("_typed", stripped_to_number(F.col("_text"))))
    text, number = F.col("_text"), F.col("_number")
    staged = trimmed.withColumn("_long", F.when(number.isNotNull() & text.rlike(INTEGER_PATTERN), text.try_cast("bigint").isNotNull()))
    counted = staged.groupBy(*keys, "_i").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("_present", text.isNotNull() & ~stripped_is_marker(text))).alias("p"), F.count(number).alias("n"),
        F.count_if(number % 1 == 0).alias("i"), F.count_if("_long").alias("w"), F.count_if(~F.col("_long")).alias("d"),
        F.count_if(text.isin(*BOOLEAN_SPELLINGS)).alias("b"),
    )
    found = F.map_from_entries(F.collect_list(F.struct("_i", F.struct("rows", "p", "n", "i", "w", "d", "b")))).alias("_c")
    wide = counted.groupBy(*keys).agg(found)  # without keys one row, also of an empty table
    records = []
    for i, name in enumerate(columns):
        own = F.try_element_at("_c", F.lit(i))
        rows, present, numbers, int_like, whole, digits, flags = (F.coalesce(own[c], F.lit(0)) for c in ("rows", "p", "n", "i", "w", "d", "b"))
        if is_text[i]:
            dtype = (
                F.when(present == 0, "object")
                .when((whole == present) & (present == rows), "int")
                .when((flags == present) & (present == rows), "bool")
                .when(digits > 0, "object")  # digits that neither a long nor a double can hold
                .when(numbers == present, "float")
                .otherwise("object")
            )
        else:
            dtype = F.lit(contract_type(types[name]))
        records.append(
            F.struct(
                F.lit(name).alias("column_name"), dtype.alias("dtype"), rows.alias("row_count"),
                present.alias("present_count"), numbers.alias("numeric_count"), int_like.alias("int_like_count"),
            )
        )
    return wide.select(*keys, F.inline(F.array(*records)))


def classify_columns(schema: DataFrame) -> DataFrame:
    return schema.withColumn("column_class", column_class(F.col("dtype")))


def text_histogram(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), cell=lambda c: c
) -> DataFrame:
    """(keys, column_name, value, n): occurrences of every distinct cell text, combined before the shuffle."""
    cells = [x for c in columns for x in (F.lit(c), cell(F.col(c).cast("string")))]
    long = df.select(*keys, F.stack(F.lit(len(columns)), *cells).alias("column_name", "value"))
    return long.filter(F.col("value").isNotNull()).groupBy(*keys, "column_name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def high_cardinality(distinct: Column, present: Column) -> Column:
    return (present > 0) & (
        (distinct >= DEFAULTS.high_cardinality_limit)
        | (distinct / F.greatest(present, F.lit(1)) >= DEFAULTS.high_cardinality_ratio)
    )


def cardinality(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    counts = hist.groupBy(*keys, "column_name").agg(
        F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("present_count")
    )
    return counts.withColumn(
        "high_cardinality", high_cardinality(F.col("distinct_count"), F.col("present_count"))
    )


def profile_numeric(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), approximate: bool = False, bracketed: bool | None = None
) -> DataFrame:
    """min, max, mean, median, p01, p99 per numeric column; columns without a number are absent. Of a large input only the values at the
    wanted ranks are shuffled (``bracketed`` overrules the estimate of the size)."""
    group = [*keys, "feature"]
    long = quantiles.numeric_long(df, columns, keys)
    if approximate:
        spread = quantiles.approximate_quantiles(long, group, PROFILE_QUANTILES)
        means = long.groupBy(*group).agg(F.avg("value").alias("mean"))
    else:
        total = {"total": F.col("value")}
        if keys or not brackets.worthwhile(long, bracketed):
            hist = quantiles.value_histogram(long, group).withColumn("total", F.col("value") * F.col("n"))
        else:
            hist = brackets.bracketed_histogram(long, group, {"n": F.lit(1)}, {"n": PROFILE_QUANTILES}, sums=total)
        spread = quantiles.exact_quantiles(hist, group, PROFILE_QUANTILES, bounded=not keys)
        means = hist.groupBy(*group).agg((F.sum("total") / F.sum("n")).alias("mean"))
    q = lambda i: F.get("q", F.lit(i))
    return spread.join(means, group).select(
        *keys, F.col("feature").alias("column_name"), F.col("n").alias("value_count"),
        q(0).alias("min"), q(4).alias("max"), "mean", q(2).alias("median"), q(1).alias("p01"), q(3).alias("p99"),
    )


def first_values(hist: DataFrame, keys: Sequence[str], limit: int, order: str = "value") -> DataFrame:
    """The first ``limit`` distinct values per column in a fixed order, as a sorted array."""
    place = F.row_number().over(Window.partitionBy(*keys, "column_name").orderBy(order))
    head = hist.select(*keys, "column_name", "value", *([order] if order != "value" else []), place.alias("_p"))
    return (
        head.filter(F.col("_p") <= limit)
        .groupBy(*keys, "column_name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "value"))), lambda s: s["value"]).alias("values"))
    )


def profile_categorical(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Type, mode and values per non-numeric column.

    Identifier: no values. High cardinality: 20 sample values. Else: the first 50 distinct values.
    """
    hist = text_histogram(df, columns, keys)
    stats = cardinality(hist, keys)
    values = first_values(hist, keys, DEFAULTS.categorical_limit)
    ident = is_identifier_col(F.col("column_name"))
    wide = F.col("high_cardinality")
    kind = F.when(ident, "identifier").when(wide, "text").otherwise("categorical")
    mode = F.when(ident, "identifier").when(wide, "high_cardinality").otherwise("enum")
    return stats.join(values, [*keys, "column_name"]).select(
        *keys, "column_name", kind.alias("type"), mode.alias("validation_mode"), "distinct_count",
        F.when(~ident & ~wide, F.col("values")).alias("unique_values"),
        F.when(~ident & wide, F.slice("values", 1, DEFAULTS.text_sample)).alias("sample_values"),
    )


def create_baseline(df: DataFrame, keys: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Contract and profile of every column, one row per column (per key group)."""
    columns = [c for c in df.columns if c not in keys]
    types = {f.name: contract_type(f.dataType) for f in df.schema.fields}
    numeric = [c for c in columns if types[c] in ("int", "float")]
    other = [c for c in columns if c not in numeric]
    dtype = F.lit(None).cast("string")
    for name in columns:
        dtype = F.when(F.col("column_name") == name, types[name]).otherwise(dtype)
    parts = []
    if numeric:
        parts.append(
            profile_numeric(df, numeric, keys, approximate)
            .withColumn("type", F.lit("numeric"))
            .drop("value_count")
        )
    if other:
        parts.append(profile_categorical(df, other, keys).drop("distinct_count"))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    wanted = {
        "type": "string", "validation_mode": "string", "min": "double", "max": "double", "mean": "double",
        "median": "double", "p01": "double", "p99": "double",
        "unique_values": "array<string>", "sample_values": "array<string>",
    }
    return table.select(
        *keys, "column_name", dtype.alias("dtype"),
        *[(F.col(c) if c in table.columns else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()],
    )


def load_rules(baseline: DataFrame, order: Sequence[str]) -> list[ColumnRule]:
    """Bring one baseline (one row per column, lists capped at 50) to the driver, in contract order."""
    found = {}
    for r in baseline.collect():
        found[r["column_name"]] = ColumnRule(
            r["column_name"], r["dtype"], r["type"], r["validation_mode"], r["min"], r["max"], r["mean"],
            r["median"], r["p01"], r["p99"], tuple(r["unique_values"] or ()), tuple(r["sample_values"] or ()),
        )
    return [found[c] for c in order if c in found]
