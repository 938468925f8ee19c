"""Checks of a batch against a baseline, the validation summary and the quality gate.

All per-column counts of one kind come from a single aggregate over the batch; the wide result row is then
turned into one row per column, so no check scans the data again for its column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwatch.config import DEFAULTS
from batchwatch.functions.cells import strip, to_number, without_markers
from batchwatch.operators import profile
from batchwatch.operators.profile import ColumnRule


def cell(df: DataFrame, name: str) -> Column:
    """A batch cell with missing markers already null."""
    is_text = isinstance(df.schema[name].dataType, T.StringType)
    return without_markers(F.col(name)) if is_text else F.col(name)


def _aggregate(df: DataFrame, keys: Sequence[str], aggregates: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def check_null_ratio(df: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = ()) -> DataFrame:
    threshold = DEFAULTS.null_ratio
    names = [r.name for r in rules if r.name in df.columns]
    wide = _aggregate(
        df, keys,
        [F.count(F.lit(1)).alias("_rows"), *[F.count(cell(df, c)).alias(f"_p{i}") for i, c in enumerate(names)]],
    )
    rows = F.col("_rows")
    records = []
    for i, name in enumerate(names):
        missing = rows - F.col(f"_p{i}")
        ratio = F.when(rows == 0, 1.0).otherwise(missing / F.greatest(rows, F.lit(1)))
        records.append(
            F.struct(
                F.lit(name).alias("column_name"), F.lit("null_ratio").alias("check_type"),
                (ratio <= threshold).alias("success"), ratio.alias("ratio"), F.lit(threshold).alias("threshold"),
                missing.alias("missing_count"), rows.alias("row_count"),
            )
        )
    return wide.select(*keys, F.inline(F.array(*records)))


def check_range(
    df: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = (), bounds: str = "percentile"
) -> DataFrame:
    """Observed min/max against the accepted range; identifiers and columns without numbers are skipped."""
    limits = {
        r.name: r.bounds(bounds)
        for r in rules
        if r.name in df.columns and not r.name.startswith("_") and r.bounds(bounds)
    }
    numbers = df.select(*keys, *[to_number(F.col(c), df.schema[c].dataType).alias(c) for c in limits])
    aggregates, records = [], []
    for i, (name, (lo, hi)) in enumerate(limits.items()):
        v = F.col(name)
        aggregates += [
            F.count(v).alias(f"_n{i}"), F.min(v).alias(f"_mn{i}"), F.max(v).alias(f"_mx{i}"),
            F.count_if(v < lo).alias(f"_lo{i}"), F.count_if(v > hi).alias(f"_hi{i}"),
        ]
        mn, mx = F.col(f"_mn{i}"), F.col(f"_mx{i}")
        records.append(
            F.struct(
                F.lit(name).alias("column_name"), F.lit("range").alias("check_type"),
                ((mn >= lo) & (mx <= hi)).alias("success"), mn.alias("observed_min"), mx.alias("observed_max"),
                F.lit(lo).alias("baseline_min"), F.lit(hi).alias("baseline_max"),
                F.col(f"_lo{i}").alias("below_min_count"), F.col(f"_hi{i}").alias("above_max_count"),
            )
        )
    wide = _aggregate(numbers, keys, aggregates)
    return wide.select(*keys, F.inline(F.array(*records))).filter(F.col("observed_min").isNotNull())


def _enum_rules(df: DataFrame, rules: Sequence[ColumnRule]) -> list[ColumnRule]:
    return [r for r in rules if r.is_enum and r.name in df.columns and not r.name.startswith("_")]


def category_histogram(df: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = ()) -> DataFrame:
    """Distinct trimmed values of the enumerated columns, with the upper-case form and whether it is allowed."""
    enums = _enum_rules(df, rules)
    marked = df.select(*keys, *[strip(cell(df, r.name).cast("string")).alias(r.name) for r in enums])
    hist = profile.text_histogram(marked, [r.name for r in enums], keys)
    upper = F.upper("value")
    known = F.lit(False)
    for r in enums:
        known = F.when(F.col("column_name") == r.name, upper.isin(*r.allowed())).otherwise(known)
    return hist.withColumn("upper_value", upper).withColumn("allowed", known)


def categorical_eligibility(df: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = ()) -> DataFrame:
    """Whether a category check makes sense: not when the allowed list is at its cap and the batch column is
    itself of high cardinality."""
    stats = profile.cardinality(category_histogram(df, rules, keys), keys)
    size = F.lit(0)
    for r in _enum_rules(df, rules):
        size = F.when(F.col("column_name") == r.name, len(r.unique_values)).otherwise(size)
    capped = F.col("allowed_count") >= DEFAULTS.categorical_limit
    return stats.withColumn("allowed_count", size.cast("bigint")).withColumn(
        "should_validate", ~(capped & F.col("high_cardinality"))
    )


def unseen_values(df: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = ()) -> DataFrame:
    """Every value that the baseline does not list, with its row count (whole result, one row per value)."""
    return (
        category_histogram(df, rules, keys)
        .filter(~F.col("allowed"))
        .groupBy(*keys, "column_name", "upper_value")
        .agg(F.sum("n").alias("row_count"))
    )


def check_categorical(df: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = ()) -> DataFrame:
    """Unseen categories per enumerated column: distinct values, rows, and the first 20 values.

    The full list is ``unseen_values``; it may be long and is never gathered into one row.
    """
    group = [*keys, "column_name"]
    values = (
        category_histogram(df, rules, keys)
        .groupBy(*group, "upper_value")
        .agg(F.sum("n").alias("n"), F.first("allowed").alias("allowed"))
    )
    place = F.row_number().over(Window.partitionBy(*group).orderBy("upper_value"))
    sample = (
        values.filter(~F.col("allowed"))
        .select(*group, "upper_value", place.alias("_p"))
        .filter(F.col("_p") <= DEFAULTS.text_sample)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list("upper_value")).alias("unseen_sample"))
    )
    counts = values.groupBy(*group).agg(
        F.count_if(~F.col("allowed")).alias("unseen_distinct"),
        F.coalesce(F.sum(F.when(~F.col("allowed"), F.col("n"))), F.lit(0)).alias("unseen_count"),
    )
    eligible = categorical_eligibility(df, rules, keys).filter("should_validate").select(*group)
    listed = F.array().cast("array<string>")
    for r in _enum_rules(df, rules):
        head = F.array(*[F.lit(v) for v in r.allowed()[: DEFAULTS.text_sample]])
        listed = F.when(F.col("column_name") == r.name, head).otherwise(listed)
    return (
        counts.join(eligible, group)
        .join(sample, group, "left")
        .select(
            *group, F.lit("categorical").alias("check_type"), (F.col("unseen_distinct") == 0).alias("success"),
            "unseen_distinct", "unseen_count",
            F.coalesce("unseen_sample", F.array().cast("array<string>")).alias("unseen_sample"),
            listed.alias("allowed_sample"),
        )
    )


def check_schema_types(df: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = ()) -> DataFrame:
    """Expected against actual contract type: equal, or safely readable as the expected one."""
    rules = [r for r in rules if r.name in df.columns]
    actual = profile.extract_schema(df, keys, [r.name for r in rules])
    expected = F.lit("object")
    for r in rules:
        expected = F.when(F.col("column_name") == r.name, r.dtype).otherwise(expected)
    present, number, whole = F.col("present_count"), F.col("numeric_count"), F.col("int_like_count")
    compatible = (
        (F.col("dtype") == F.col("expected_type"))
        | ((F.col("expected_type") == "int") & F.col("dtype").isin("float", "object") & (whole == present))
        | ((F.col("expected_type") == "float") & (F.col("dtype") == "int"))
        | ((F.col("expected_type") == "float") & (F.col("dtype") == "object") & (number == present))
    )
    return actual.withColumn("expected_type", expected).select(
        *keys, "column_name", "expected_type", F.col("dtype").alias("actual_type"), compatible.alias("compatible")
    )


def all_checks(df: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = (), bounds="percentile") -> DataFrame:
    """Null, range and category checks as one table: keys, column_name, check_type, success, info, details (JSON)."""
    base = [*keys, "column_name", "check_type", "success"]
    detail = lambda d: F.to_json(F.struct(*[c for c in d.columns if c not in base]))
    nulls = check_null_ratio(df, rules, keys)
    share = F.format_string("%.2f (threshold=%s)", "ratio", "threshold")
    out = nulls.select(*base, share.alias("info"), detail(nulls).alias("details"))
    if any(r.name in df.columns and not r.name.startswith("_") and r.bounds(bounds) for r in rules):
        ranges = check_range(df, rules, keys, bounds)
        span = F.format_string("%s-%s vs %s-%s", "observed_min", "observed_max", "baseline_min", "baseline_max")
        out = out.unionByName(ranges.select(*base, span.alias("info"), detail(ranges).alias("details")))
    if _enum_rules(df, rules):
        categories = check_categorical(df, rules, keys)
        listed = F.concat(F.lit("unseen=["), F.array_join("unseen_sample", ", "), F.lit("]"))
        out = out.unionByName(categories.select(*base, listed.alias("info"), detail(categories).alias("details")))
    return out


def validation_summary(
    checks: DataFrame, types: DataFrame, keys: Sequence[str] = (), changed: DataFrame | None = None
) -> DataFrame:
    """Totals and PASS/FAIL per key group. ``changed`` (keys, extra_columns, missing_columns) forces FAIL."""
    counts = _aggregate(
        checks, keys, [F.count(F.lit(1)).alias("total_checks"), F.count_if(~F.col("success")).alias("failed_checks")]
    )
    errors = _aggregate(types, keys, [F.count_if(~F.col("compatible")).alias("schema_errors")])
    if keys:
        both = counts.join(errors, list(keys), "full")
    else:  # two single-row aggregates
        both = counts.select("*", errors.scalar().alias("schema_errors"))
    drifted = F.lit(False)
    if changed is not None:
        both = both.join(changed, list(keys), "left")
        drifted = (F.coalesce(F.size("extra_columns"), F.lit(0)) > 0) | (
            F.coalesce(F.size("missing_columns"), F.lit(0)) > 0
        )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    ratio = F.coalesce(F.try_divide("failed_checks", "total_checks"), F.lit(0.0))
    bad = (zero("schema_errors") > 0) | (zero("failed_checks") > 0) | drifted
    return both.select(
        *keys, zero("total_checks").alias("total_checks"), zero("failed_checks").alias("failed_checks"),
        ratio.alias("failed_check_ratio"), zero("schema_errors").alias("schema_errors"),
        F.when(bad, "FAIL").otherwise("PASS").alias("status"),
    )


def quality_gate(runs: DataFrame) -> DataFrame:
    """May a cleaned batch be used? Adds status, clean_row_ratio and blocking_reasons.

    Input columns: cleaned_rows, total_rows, missing_columns (count), schema_errors, failed_checks.
    """
    cleaned, total = F.col("cleaned_rows"), F.col("total_rows")
    ratio = F.coalesce(F.try_divide(cleaned.cast("double"), total.cast("double")), F.lit(0.0))
    # Wording of the blocking reasons.
    reasons = F.array_compact(
        F.array(
            F.when(
                F.col("missing_columns") > 0,
                "The incoming dataset is missing baseline-required columns and cannot "
                "be treated as production-safe input.",
            ),
            F.when(cleaned == 0, "No usable rows remained after cleaning."),
            F.when(
                cleaned < DEFAULTS.min_clean_rows,
                F.format_string(
                    f"The cleaned dataset is below the minimum accepted row count (%d < {DEFAULTS.min_clean_rows}).",
                    cleaned,
                ),
            ),
            F.when(
                (total > 0) & (ratio < DEFAULTS.min_clean_ratio),
                F.format_string(
                    "The cleaned dataset retained too few rows after quarantine "
                    f"(%.2f%%%% < {DEFAULTS.min_clean_ratio * 100:.0f}%%%%).".replace("%%%%", "%%"),
                    ratio * 100,
                ),
            ),
            F.when(
                F.col("schema_errors") > 0, "The cleaned dataset still has schema/type mismatches after coercion."
            ),
            F.when(
                F.col("failed_checks") > 0,
                F.format_string("The cleaned dataset still failed %d validation checks.", F.col("failed_checks")),
            ),
        )
    )
    return (
        runs.withColumn("clean_row_ratio", ratio)
        .withColumn("blocking_reasons", reasons)
        .withColumn("status", F.when(F.size("blocking_reasons") == 0, "success").otherwise("failed"))
    )
