"""Many models at once: the rules of all baselines as a table, joined to rows by model.

Where one batch belongs to one model, its rules are compiled into column expressions (``clean``, ``validate``). Here each row brings the
name of its model and its cells as a map of texts; the rules of a model are one row of a table, a map from column to rule, as long as a
contract is wide. A row therefore meets all its rules in one join, and is flagged where it stands: no cell is shuffled to find its rule
or its row again. Models that hold a large share of all rows are spread (:func:`ordering.join_groups`).

Rules that need the whole batch (medians, modes, counts of the checks) are aggregates by model and column, combined before the shuffle.

Defined cases: rows of models without a baseline, or without a model, are quarantined without an issue; columns that the contract lacks are
ignored; columns that the row lacks count as missing, not as an issue.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwatch.config import DEFAULTS
from batchwatch.functions import ordering, quantiles
from batchwatch.functions.cells import is_identifier_col, strip, stripped_is_marker, stripped_to_number, to_boolean
from batchwatch.operators import profile
from batchwatch.operators.clean import UNKNOWN, UNKNOWN_ID
from batchwatch.operators.profile import OPEN_MODES
from batchwatch.sources.storage import stored

RULE = (
    "struct<dtype: string, kind: string, lo: double, hi: double, allowed: array<string>, fallback: string, identifier: boolean>"
)
# Kinds of a rule.
NUMBER, FLAG, LISTED, MOMENT, TEXT = "number", "flag", "listed", "datetime", "text"


def rule_table(baselines: DataFrame, key: str = "model_id") -> DataFrame:
    """One row for each model: ``rules``, from column name to rule. ``baselines`` has the columns of ``profile.create_baseline`` with
    the model in ``key``. Identifiers have no range; ``fallback`` fills a missing cell where the batch itself cannot."""
    ident = is_identifier_col(F.col("column_name"))
    listed = (F.size("unique_values") > 0) & ~ident & ~F.coalesce(F.col("validation_mode").isin(*OPEN_MODES), F.lit(False))
    number = F.col("dtype").isin("int", "float")
    kind = (
        F.when(number, NUMBER).when(F.col("dtype") == "bool", FLAG).when(F.coalesce(listed, F.lit(False)), LISTED)
        .when(F.col("dtype") == "datetime", MOMENT).otherwise(TEXT)
    )
    bound = lambda tight, wide: F.when(number & ~ident, F.coalesce(tight, wide))
    middle = F.coalesce("median", "mean", (F.col("min") + F.col("max")) / 2, F.lit(0.0)).cast("string")
    first = F.coalesce(F.nullif(strip(F.get("unique_values", F.lit(0))), F.lit("")), F.lit(UNKNOWN))
    fallback = (
        F.when(kind == NUMBER, middle).when(kind == FLAG, "false").when(kind == LISTED, first)
        .when(kind == TEXT, F.when(ident, UNKNOWN_ID).otherwise(UNKNOWN))
    )
    rule = F.struct(
        "dtype", kind.alias("kind"), bound("p01", "min").alias("lo"), bound("p99", "max").alias("hi"),
        F.when(listed, F.transform("unique_values", lambda v: F.upper(strip(v)))).alias("allowed"),
        fallback.alias("fallback"), ident.alias("identifier"),
    ).cast(RULE)
    return baselines.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column_name", rule))).alias("rules"))


def as_cells(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``cells``, a map from column name to the cell as text, of the columns that the row has (``None`` cells included)."""
    entries = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(*keep, F.create_map(*entries).alias("cells"))


def judged(text: Column, rule: Column) -> Column:
    """struct(value, issue) of one trimmed cell: its masked value as canonical text, and whether something was wrong with it."""
    kind = rule["kind"]
    read = F.struct(
        text.alias("text"), stripped_is_marker(text).alias("marker"), F.when(kind == NUMBER, stripped_to_number(text)).alias("number"),
        F.when(kind == FLAG, to_boolean(text)).alias("flag"),
    )

    def masked(cell: Column) -> Column:
        outside = F.coalesce((cell["number"] < rule["lo"]) | (cell["number"] > rule["hi"]), F.lit(False))
        unseen = ~F.coalesce(F.array_contains(rule["allowed"], F.upper(cell["text"])), F.lit(False))
        value = (
            F.when(kind == NUMBER, F.when(~outside, cell["number"].cast("string")))
            .when(kind == FLAG, cell["flag"].cast("string"))
            .when(kind == LISTED, F.when(~cell["marker"] & ~unseen, cell["text"]))
            .otherwise(F.when(~cell["marker"], cell["text"]))
        )
        return F.struct(cell["text"].alias("text"), cell["marker"].alias("marker"), value.alias("value"))

    def result(cell: Column) -> Column:
        missing = cell["text"].isNull() | cell["marker"]
        return F.struct(cell["value"].alias("value"), (cell["text"].isNotNull() & cell["value"].isNull()).alias("issue"), missing.alias("missing"))

    return given(given(read, masked), result)


def given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read; inside a lambda Spark finds no common expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_rules(rows: DataFrame, table: DataFrame, key: str = "model_id") -> DataFrame:
    """Rows with the map of their model's rules, null where there is none."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    present = rows.filter(F.col(key).isNotNull())
    known = ordering.join_groups(present, table.join(sizes, key), [key], "_rows", how="left")
    alone = rows.filter(F.col(key).isNull()).withColumn("rules", F.lit(None).cast(f"map<string, {RULE}>"))
    return known.unionByName(alone)


def flag_rows(rows: DataFrame, table: DataFrame, key: str = "model_id") -> DataFrame:
    """``rows`` (key, ..., cells) with ``rules``, ``judged`` (column -> value, issue, missing), ``issue_count`` and ``is_quarantined``."""
    ruled = with_rules(rows, table, key)
    trimmed = F.transform_values("cells", lambda _, v: strip(v))
    found = ruled.withColumn("cells", trimmed).withColumn("judged", F.transform_values("rules", lambda c, r: judged(F.element_at(F.col("cells"), c), r)))
    issues = F.size(F.filter(F.map_values("judged"), lambda j: j["issue"])).cast("bigint")
    known = F.col("rules").isNotNull()
    return found.withColumn("issue_count", F.when(known, issues).otherwise(0)).withColumn(
        "is_quarantined", F.when(known, F.col("issue_count") / F.greatest(F.size("rules"), F.lit(1)) >= DEFAULTS.row_issue_ratio).otherwise(True)
    )


def fallbacks(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ``fills``: from column to the median or most frequent value (smallest of equals), as text, of a histogram of cells (keys,
    column_name, kind, value, n)."""
    group = [*keys, "column_name"]
    numbers = hist.filter(F.col("kind") == NUMBER).select(*group, F.col("value").cast("double").alias("value"), "n")
    medians = quantiles.exact_quantiles(numbers, group, (0.5,)).select(*group, F.get("q", F.lit(0)).cast("string").alias("fill"))
    others = hist.filter(F.col("kind") != NUMBER).groupBy(*group)
    modes = others.agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("fill"))
    return medians.unionByName(modes).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("column_name", "fill"))).alias("fills"))


def final_value(rule: Column, value: Column, fill: Column) -> Column:
    """The cell as text of its contract type: filled, coerced and normalised."""
    filled = F.coalesce(value, fill, rule["fallback"])
    whole = F.bround(filled.try_cast("double"), 0).cast("bigint").cast("string")
    return (
        F.when((rule["kind"] == NUMBER) & (rule["dtype"] == "int"), whole)
        .when(rule["kind"] == LISTED, F.upper(strip(filled)))
        .otherwise(filled)
    )


def clean_by_model(flagged: DataFrame, table: DataFrame, key: str = "model_id", runs: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Accepted rows of all models: key, runs, keep and ``cells``, cleaned. Each model, or each of its ``runs``, is filled from its own
    accepted rows. These are written once; one histogram of their cells gives medians and most frequent values."""
    own, group = [*dict.fromkeys([key, *runs, *keep])], ["_group"]
    cell = F.transform_values("judged", lambda c, j: F.struct(F.element_at("rules", c)["kind"].alias("kind"), j["value"].alias("value")))
    named = F.to_json(F.struct(key, *runs)).alias("_group")  # rows without a run are a group, too
    accepted = stored(flagged.filter(~F.col("is_quarantined")).select(*own, named, cell.alias("masked")), "accepted")
    cells = accepted.select("_group", F.explode(F.map_entries("masked")).alias("e")).select("_group", F.col("e.key").alias("column_name"), "e.value.kind", "e.value.value")
    counted = cells.filter(F.col("kind").isin(NUMBER, FLAG, LISTED) & F.col("value").isNotNull()).groupBy("_group", "column_name", "kind", "value")
    hist = stored(counted.agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = accepted.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"), F.any_value(key).alias(key))
    groups = sizes.join(stored(fallbacks(hist, group), "fills"), group, "left").join(table, key).drop(key)
    filled = ordering.join_groups(accepted, groups, group, "_rows")
    final = lambda c, j: final_value(F.element_at("rules", c), j["value"], F.try_element_at("fills", c))
    return filled.select(*own, F.transform_values("masked", final).alias("cells"))


def ruled_cells(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each cell that its row has and its model has a rule for: keys, column_name, rule, text, seen (null for a marker)."""
    long = flagged.select(*keys, "cells", F.explode("rules").alias("column_name", "rule")).filter(F.map_contains_key("cells", F.col("column_name")))
    text = F.element_at("cells", F.col("column_name"))
    return long.select(*keys, "column_name", "rule", text.alias("text"), F.when(~stripped_is_marker(text), text).alias("seen"))


def checks_by_model(flagged: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Null, range and category checks of all models: keys, column_name, check_type, success, and the numbers behind them.

    Unseen categories are counted; :func:`unseen_by_model` lists them. A list of allowed values at its cap is not checked against a column
    of high cardinality."""
    group = [*keys, "column_name"]
    cells, rule, seen = ruled_cells(flagged, keys), F.col("rule"), F.col("seen")
    number = F.when(rule["lo"].isNotNull(), stripped_to_number(F.col("text")))
    unseen = F.when(seen.isNotNull() & ~F.array_contains(rule["allowed"], F.upper(seen)), True)
    stats = cells.groupBy(*group).agg(
        F.count(F.lit(1)).alias("row_count"), (F.count(F.lit(1)) - F.count(seen)).alias("missing_count"), F.count(number).alias("_numbers"),
        F.min(number).alias("observed_min"), F.max(number).alias("observed_max"), F.count_if((number < rule["lo"]) | (number > rule["hi"])).alias("outside_count"),
        # only numbers and flags: a text or a list among the aggregates would make Spark sort all cells
        F.any_value(rule["lo"]).alias("_lo"), F.any_value(rule["hi"]).alias("_hi"), F.any_value(rule["allowed"].isNotNull()).alias("_listed"),
        F.count(unseen).alias("unseen_count"),
    )
    capped = cells.filter((F.size(rule["allowed"]) >= DEFAULTS.categorical_limit) & seen.isNotNull()).groupBy(*group, "seen").agg(F.count(F.lit(1)).alias("n"))
    wide = profile.cardinality(capped.withColumnRenamed("seen", "value"), keys).filter("high_cardinality").select(*group, F.lit(True).alias("_skip"))
    ratio, none = F.col("missing_count") / F.col("row_count"), lambda t: F.lit(None).cast(t)
    spread = (F.col("observed_min"), F.col("observed_max"), F.col("_lo"), F.col("_hi"))

    def record(kind: str, success: Column, bad: str, share: Column | None = None, numbers: Sequence[Column] = ()) -> Column:
        names = ("observed_min", "observed_max", "baseline_min", "baseline_max")
        return F.struct(
            F.lit(kind).alias("check_type"), success.alias("success"), F.col(bad).alias("bad_count"), (none("double") if share is None else share).alias("ratio"),
            *[(numbers[i] if numbers else none("double")).alias(c) for i, c in enumerate(names)],
        )

    records = F.array_compact(F.array(
        record("null_ratio", ratio <= DEFAULTS.null_ratio, "missing_count", ratio),
        F.when(F.col("_numbers") > 0, record("range", (spread[0] >= spread[2]) & (spread[1] <= spread[3]), "outside_count", numbers=spread)),
        F.when(F.col("_listed") & F.col("_skip").isNull(), record("categorical", F.col("unseen_count") == 0, "unseen_count")),
    ))
    return stats.join(wide, group, "left").select(*group, F.inline(records))


def unseen_by_model(flagged: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Every value that its model's baseline does not list, with its number of rows."""
    upper = ruled_cells(flagged, keys).select(*keys, "column_name", "rule.allowed", F.upper("seen").alias("upper_value"))
    unseen = upper.filter(F.col("upper_value").isNotNull() & ~F.array_contains("allowed", F.col("upper_value")))
    return unseen.groupBy(*keys, "column_name", "upper_value").agg(F.count(F.lit(1)).alias("row_count"))
