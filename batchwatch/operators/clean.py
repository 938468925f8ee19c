"""Cleaning: per-cell rules, issue counts, quarantine split, imputation, coercion, normalisation.

Every cell rule is a column expression, so flagging is one projection over the scan. Imputation needs one
aggregate of the accepted rows (medians and modes); its few values come back as scalar subqueries, or as a
join on the run key when many runs are cleaned together. Nothing row-sized reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwatch.config import DEFAULTS
from batchwatch.functions import brackets, quantiles
from batchwatch.functions.cells import (
    is_identifier,
    strip,
    stripped_is_marker,
    stripped_to_number,
    to_boolean,
    to_number,
    with_stripped,
    without_markers,
)
from batchwatch.operators import profile
from batchwatch.operators.profile import ColumnRule

# Fill texts for missing non-numeric cells.
UNKNOWN = "UNKNOWN"
UNKNOWN_ID = "UNKNOWN_ID"
PREVIEW_ROWS = 10


@dataclass(frozen=True)
class CellRule:
    """Masked value of a cell and whether it had an issue."""

    value: Column
    issue: Column


def _no_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def coerce_numeric(raw: Column, dtype: T.DataType) -> CellRule:
    """Number or null; a present cell that is not a number is an issue."""
    present = without_markers(raw) if isinstance(dtype, T.StringType) else raw
    number = to_number(raw, dtype)
    return CellRule(number, present.isNotNull() & number.isNull())


def mask_out_of_range(number: Column, bounds: tuple[float, float] | None) -> CellRule:
    if bounds is None:
        return CellRule(number, F.lit(False))
    outside = _no_null((number < bounds[0]) | (number > bounds[1]))
    return CellRule(F.when(~outside, number), outside)


def sanitize_boolean(raw: Column, dtype: T.DataType) -> CellRule:
    present = without_markers(raw) if isinstance(dtype, T.StringType) else raw
    flag = to_boolean(present)
    return CellRule(flag, present.isNotNull() & flag.isNull())


def mask_unseen_enum(text: Column, allowed: Sequence[str]) -> CellRule:
    unseen = _no_null(~F.upper(text).isin(*allowed))
    return CellRule(F.when(~unseen, text), unseen)


def issue_name(column: str) -> str:
    return f"_issue_{column}"


def flag_rows(
    df: DataFrame, rules: Sequence[ColumnRule], keep: Sequence[str] = (), bounds: str = "percentile"
) -> DataFrame:
    """Masked cells, one issue flag per column, ``issue_count`` and ``is_quarantined``.

    Written as a chain of projections - trim, parse, apply the rule - because each step's result is read several
    times by the next: Spark then computes it once per cell, all inside one generated stage. A cell has at most
    one issue: a missing marker, an unreadable value, or a value that is not allowed.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    rules_here = [r for r in rules if r.name in types]
    is_text = {r.name: isinstance(types[r.name], T.StringType) for r in rules_here}
    trimmed = with_stripped(df.select(*keep, *[r.name for r in rules_here]), [r.name for r in rules_here])

    parsed, values, issues = [], {}, {}
    for r in rules_here:
        raw, value = F.col(r.name), F.col(f"_value_{r.name}")
        marker = stripped_is_marker(raw) if is_text[r.name] else F.lit(False)
        parsed.append(parse_cell(raw, r, types[r.name], marker).alias(f"_value_{r.name}"))
        unreadable = raw.isNotNull() & value.isNull()  # a missing marker is unreadable, too
        values[r.name], issues[r.name] = value, unreadable
        if r.dtype in ("int", "float"):
            masked = mask_out_of_range(value, r.bounds(bounds))
        elif r.is_enum and r.dtype != "bool":
            masked = mask_unseen_enum(value, r.allowed())
        else:
            continue
        values[r.name], issues[r.name] = masked.value, unreadable | masked.issue

    staged = trimmed.select("*", *parsed)
    flagged = staged.select(
        *keep,
        *[values[r.name].alias(r.name) for r in rules_here],
        *[issues[r.name].cast("int").alias(issue_name(r.name)) for r in rules_here],
    )
    total = sum((F.col(issue_name(r.name)) for r in rules_here), F.lit(0))
    return flagged.withColumn("issue_count", total.cast("bigint")).withColumn(
        "is_quarantined", F.col("issue_count") / max(len(rules), 1) >= DEFAULTS.row_issue_ratio
    )


def parse_cell(text: Column, rule: ColumnRule, dtype: T.DataType, marker: Column) -> Column:
    """Value of a trimmed cell in its contract type; null when missing or unreadable."""
    is_text = isinstance(dtype, T.StringType)
    if rule.dtype in ("int", "float"):
        return stripped_to_number(text) if is_text else to_number(text, dtype)
    if rule.dtype == "bool":
        return to_boolean(text)
    if rule.dtype == "datetime" and not is_text:
        return text
    return F.when(~marker, text) if is_text else text.cast("string")


def only_rows(flagged: DataFrame, condition: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that meet a condition on computed columns.

    A plain filter would be pushed below the projections and evaluate every cell rule a second time; emitting
    each row from an array that is null for the others keeps the condition where its inputs already are.
    """
    columns = list(columns or flagged.columns)
    return flagged.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))


def accepted(flagged: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return only_rows(flagged, ~F.col("is_quarantined"), columns)


def quarantined(flagged: DataFrame, rules: Sequence[ColumnRule], keep: Sequence[str] = ()) -> DataFrame:
    """Removed rows with their masked values."""
    names = [r.name for r in rules if r.name in flagged.columns]
    return only_rows(flagged, F.col("is_quarantined"), [*dict.fromkeys([*keep, *names]), "issue_count"])


def medians(rows: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = (), bracketed: bool | None = None) -> DataFrame:
    """keys, column_name, median of the accepted, masked numeric cells. Of a large input only the values around the middle are shuffled."""
    names = [r.name for r in rules if r.dtype in ("int", "float") and r.name in rows.columns]
    group = [*keys, "feature"]
    long = quantiles.numeric_long(rows, names, keys)
    if keys or not brackets.worthwhile(long, bracketed):
        hist = quantiles.value_histogram(long, group)
    else:
        hist = brackets.bracketed_histogram(long, group, {"n": F.lit(1)}, {"n": (0.5,)})
    found = quantiles.exact_quantiles(hist, group, (0.5,), bounded=not keys)
    return found.select(*keys, F.col("feature").alias("column_name"), F.get("q", F.lit(0)).alias("median"))


def modes(rows: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = ()) -> DataFrame:
    """keys, column_name, most frequent value (smallest on a tie) of flag and enumerated columns."""
    names = [r.name for r in rules if (r.dtype == "bool" or r.is_enum) and r.name in rows.columns]
    hist = profile.text_histogram(rows, names, keys, cell=strip)
    return hist.groupBy(*keys, "column_name").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")
    )


def as_map(pairs: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """One map per key group (at most one entry per column)."""
    entries = F.map_from_entries(F.collect_list(F.struct("column_name", value))).alias(out)
    return pairs.groupBy(*keys).agg(entries) if keys else pairs.agg(entries)


def with_fallbacks(rows: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = ()):
    """Rows plus a function from column name to its batch median / mode expression."""
    numeric = [r for r in rules if r.dtype in ("int", "float")]
    listed = [r for r in rules if r.dtype == "bool" or r.is_enum]
    tables = {}
    if numeric:
        tables["_medians"] = as_map(medians(rows, rules, keys), keys, "median", "_medians")
    if listed:
        tables["_modes"] = as_map(modes(rows, rules, keys), keys, "mode", "_modes")
    out, source = rows, {}
    for name, table in tables.items():
        if keys:
            out = out.join(table, list(keys), "left")
            source[name] = F.col(name)
        else:
            source[name] = table.scalar()
    lookup = lambda kind, column: F.try_element_at(source[kind], F.lit(column))
    return out, lookup


def baseline_number(rule: ColumnRule) -> float:
    for candidate in (rule.median, rule.mean):
        if candidate is not None:
            return float(candidate)
    return (float(rule.min) + float(rule.max)) / 2 if rule.is_numeric else 0.0


def imputed(rule: ColumnRule, lookup) -> Column:
    """Cell with its missing value filled."""
    c = F.col(rule.name)
    if rule.dtype in ("int", "float"):
        return F.coalesce(c, lookup("_medians", rule.name), F.lit(baseline_number(rule)))
    if rule.dtype == "bool":
        return F.coalesce(c, lookup("_modes", rule.name).cast("boolean"), F.lit(False))
    if rule.is_enum:
        first = str(rule.unique_values[0]).strip() or UNKNOWN
        return F.coalesce(c.cast("string"), lookup("_modes", rule.name), F.lit(first))
    if rule.dtype == "datetime":
        return c
    return F.coalesce(c.cast("string"), F.lit(UNKNOWN_ID if is_identifier(rule.name) else UNKNOWN))


def coerced(rule: ColumnRule, c: Column) -> Column:
    """Contract type; whole numbers round half to even."""
    if rule.dtype == "int":
        return F.bround(c, 0).cast("bigint")
    if rule.dtype == "float":
        return c.cast("double")
    return c.cast("boolean") if rule.dtype == "bool" else c


def normalized(rule: ColumnRule, c: Column) -> Column:
    if rule.dtype in ("int", "float", "bool", "datetime"):
        return c
    return F.upper(strip(c)) if rule.is_enum else strip(c)


def impute(
    flagged: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Accepted rows with missing cells filled, types not yet coerced."""
    names = [r for r in rules if r.name in flagged.columns]
    kept = accepted(flagged, [*dict.fromkeys([*keys, *keep]), *[r.name for r in names]])
    rows, lookup = with_fallbacks(kept, rules, keys)
    return rows.select(*dict.fromkeys([*keys, *keep]), *[imputed(r, lookup).alias(r.name) for r in names])


def clean_batch(
    flagged: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Accepted rows, imputed, coerced and normalised."""
    names = [r for r in rules if r.name in flagged.columns]
    kept = accepted(flagged, [*dict.fromkeys([*keys, *keep]), *[r.name for r in names]])
    rows, lookup = with_fallbacks(kept, rules, keys)
    final = [normalized(r, coerced(r, imputed(r, lookup))).alias(r.name) for r in names]
    return rows.select(*dict.fromkeys([*keys, *keep]), *final)


def cleaning_audit(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """rows_in, rows_out, rows_removed and the threshold used."""
    gone = F.count_if(F.col("is_quarantined"))
    aggregates = [
        F.count(F.lit(1)).alias("rows_in"),
        (F.count(F.lit(1)) - gone).alias("rows_out"),
        gone.alias("rows_removed"),
    ]
    out = flagged.groupBy(*keys).agg(*aggregates) if keys else flagged.agg(*aggregates)
    return out.withColumn("row_issue_threshold", F.lit(DEFAULTS.row_issue_ratio))


def column_issue_counts(flagged: DataFrame, rules: Sequence[ColumnRule], keys: Sequence[str] = ()) -> DataFrame:
    names = [r.name for r in rules if issue_name(r.name) in flagged.columns]
    sums = [F.coalesce(F.sum(issue_name(n)), F.lit(0)).alias(n) for n in names]
    wide = flagged.groupBy(*keys).agg(*sums) if keys else flagged.agg(*sums)
    cells = [x for n in names for x in (F.lit(n), F.col(n))]
    return wide.select(*keys, F.stack(F.lit(len(names)), *cells).alias("column_name", "issue_count"))


def quarantine_preview(flagged: DataFrame, rules: Sequence[ColumnRule], keep: Sequence[str] = ()) -> DataFrame:
    """A look at a few removed rows (the audit's preview, not a result)."""
    return quarantined(flagged, rules, keep).limit(PREVIEW_ROWS)


def scoring_features(df: DataFrame, expected: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Model input: expected features matched without case, in that order, null as 0.0; else the first three
    numeric columns."""
    by_lower = {c.lower(): c for c in df.columns}
    if expected:
        chosen = [by_lower[f.lower()] for f in expected if f.lower() in by_lower]
    else:
        numeric = [f.name for f in df.schema.fields
                   if isinstance(f.dataType, T.NumericType) and f.name not in keep]
        chosen = numeric[:3]
    number = lambda c: to_number(F.col(c), df.schema[c].dataType)
    return df.select(*keep, *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in chosen])
