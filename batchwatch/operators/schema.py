"""Contracts: alignment, schema difference, model matching, feature candidates and contract evolution.

Column lists per run or per model are metadata (as long as a table is wide), so they are held as arrays and
compared with array functions; rows are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwatch.config import DEFAULTS
from batchwatch.functions.cells import is_identifier_col
from batchwatch.operators import profile

# Contract type to Spark type; weights of the match score.
SPARK_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp_ntz", "object": "string"}
MISSING_WEIGHT = 2.0
EXTRA_WEIGHT = 0.25
#: Columns that more contract sets than this have are common: contracts are told apart by their other columns.
COMMON = 64


def empty_list() -> Column:
    return F.array().cast("array<string>")


def align_to_contract(df: DataFrame, contract: Sequence[tuple[str, str]]) -> DataFrame:
    """Contract columns in contract order: extra ones dropped, missing ones added as null."""
    return df.select(
        *[
            F.col(name) if name in df.columns else F.lit(None).cast(SPARK_TYPES[dtype]).alias(name)
            for name, dtype in contract
        ]
    )


def column_lists(columns: DataFrame, key: str, out: str) -> DataFrame:
    return columns.groupBy(key).agg(F.array_sort(F.collect_set("column_name")).alias(out))


def schema_diff(batch_columns: DataFrame, runs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Sorted extra and missing columns of every run against the contract of its model."""
    have = column_lists(batch_columns, "run_id", "_have")
    want = column_lists(contracts, "model_id", "_want")
    both = runs.select("run_id", "model_id").join(have, "run_id").join(want, "model_id")
    return both.select(
        "run_id", "model_id",
        F.array_except("_have", "_want").alias("extra_columns"),
        F.array_except("_want", "_have").alias("missing_columns"),
    ).withColumn("schema_changed", (F.size("extra_columns") > 0) | (F.size("missing_columns") > 0))


def match_model(batch_columns: DataFrame, contracts: DataFrame, common: int = COMMON) -> DataFrame:
    """Find the model whose active contract fits a batch best, ignoring case.

    score = overlap - 2 * missing - 0.25 * extra. Equal column sets behave alike, so both sides are reduced to
    distinct sets first. A set that equals a contract's set scores its own size, which nothing else can reach, so
    it is settled by an equality join; the remaining sets meet the contracts that share a rare column with them, and classes of
    contracts by their common columns. Contracts that share no column can still score higher (few columns), which means "no match";
    they are covered by counting contracts per size.
    """
    lowered = lambda df: df.withColumn("column_name", F.lower("column_name"))
    runs = column_lists(lowered(batch_columns), "run_id", "column_set")
    models = column_lists(lowered(contracts), "model_id", "column_set")
    batch_sets = runs.select("column_set").distinct()
    contract_sets = models.groupBy("column_set").agg(
        F.count(F.lit(1)).alias("model_count"), F.min("model_id").alias("model_id")
    )
    size = F.size("column_set")
    exact = batch_sets.join(contract_sets, "column_set").select(
        "column_set", size.cast("double").alias("score"), F.col("model_count").alias("top_models"), "model_id",
        size.alias("matched_columns"), F.lit(None).cast("double").alias("rival"),
    )
    inexact = _closest_contracts(batch_sets.join(contract_sets, "column_set", "left_anti"), contract_sets, common)
    best, rival = F.col("score"), F.col("rival")
    no_match = best.isNull() | F.coalesce(rival > best, F.lit(False))
    tie = (F.col("top_models") > 1) | F.coalesce(rival == best, F.lit(False))
    found = exact.unionByName(inexact).withColumn(
        "status", F.when(no_match, "no_match").when(tie, "ambiguous").otherwise("matched")
    )
    known = F.col("status") != "no_match"
    return runs.join(found, "column_set").select(
        "run_id", "status", F.when(F.col("status") == "matched", F.col("model_id")).alias("model_id"),
        F.when(known, best).alias("score"), F.when(known, F.col("matched_columns").cast("bigint")).alias("matched_columns"),
    )


def common_columns(contract_sets: DataFrame, common: int) -> Column:
    """Names that more than ``common`` contract sets have; at most (sum of their widths) / ``common``."""
    frequent = contract_sets.select(F.explode("column_set").alias("c")).groupBy("c").count().filter(F.col("count") > common)
    return F.coalesce(frequent.agg(F.sort_array(F.collect_list("c"))).scalar(), empty_list())


def contract_index(contract_sets: DataFrame, names: Column) -> DataFrame:
    """``contract_sets`` with their common columns (``pattern``), the other ones (``rare``) and ``size``."""
    return contract_sets.withColumn("_common", names).select(
        "*", F.array_intersect("column_set", "_common").alias("pattern"), F.array_except("column_set", "_common").alias("rare"),
        F.size("column_set").alias("size"),
    )


def rare_pairs(batch_sets: DataFrame, index: DataFrame) -> DataFrame:
    """(column_set, contract_set, ...): batch and contract sets that share a rare column, once each. A rare column leads to ``common``
    contracts at most, so their number grows with the widths of the batch sets alone."""
    offered = index.select(
        F.explode("rare").alias("_c"), F.col("column_set").alias("contract_set"), F.col("pattern").alias("contract_pattern"), "size", "model_count", "model_id"
    )
    asked = batch_sets.select("column_set", "pattern", F.explode("column_set").alias("_c"))
    return asked.join(offered, "_c").drop("_c").distinct()


def pattern_pairs(batch_sets: DataFrame, index: DataFrame) -> DataFrame:
    """(pattern, contract_pattern, size, models, model_id, n): classes of contracts by common columns and size, each next to the distinct
    patterns of the batches that it shares ``n`` columns with."""
    classes = index.groupBy(F.col("pattern").alias("contract_pattern"), "size").agg(F.sum("model_count").alias("models"), F.min("model_id").alias("model_id"))
    asked = batch_sets.select("pattern").distinct().select("pattern", F.explode("pattern").alias("_c"))
    return (
        asked.join(classes.select("*", F.explode("contract_pattern").alias("_c")), "_c")
        .groupBy("pattern", "contract_pattern", "size", "models", "model_id").agg(F.count(F.lit(1)).alias("n"))
    )


def _closest_contracts(batch_sets: DataFrame, contract_sets: DataFrame, common: int = COMMON) -> DataFrame:
    """Best overlapping contract per batch set, and the best score of a contract without overlap (``rival``).

    Contracts that share a rare column with the batch are met one by one. All others overlap in common columns alone, so their score follows
    from their class (common columns and size); for a contract of that class with a rare overlap it is too low, and then it is not the
    best, as the same contract scores higher by itself. So the higher of both, and how many contracts have it, are exact.
    """
    names = common_columns(contract_sets, common)
    index = contract_index(contract_sets, names)
    batches = batch_sets.withColumn("pattern", F.sort_array(F.array_intersect("column_set", names)))
    gain = lambda n, size: n * (1 + MISSING_WEIGHT + EXTRA_WEIGHT) - MISSING_WEIGHT * size  # the score without the batch's own width
    pairs = rare_pairs(batches, index).withColumn("n", F.size(F.array_intersect("column_set", "contract_set")))
    alone = pairs.groupBy("column_set", gain(F.col("n"), F.col("size")).alias("gain")).agg(
        F.sum("model_count").alias("top_models"), F.min("model_id").alias("model_id"), F.max("n").cast("int").alias("matched_columns")
    )
    classes = pattern_pairs(batches, index)
    by_pattern = classes.groupBy("pattern", gain(F.col("n"), F.col("size")).alias("gain")).agg(
        F.sum("models").alias("top_models"), F.min("model_id").alias("model_id"), F.max("n").cast("int").alias("matched_columns")
    )
    best_class = by_pattern.groupBy("pattern").agg(F.max_by(F.struct("gain", "top_models", "model_id", "matched_columns"), "gain").alias("_b"))
    in_class = batches.join(best_class, "pattern").select("column_set", "_b.*")
    best = (
        alone.unionByName(in_class).groupBy("column_set", "gain")
        .agg(F.sum("top_models").alias("top_models"), F.min("model_id").alias("model_id"), F.max("matched_columns").alias("matched_columns"))
        .groupBy("column_set").agg(F.max_by(F.struct("gain", "top_models", "model_id", "matched_columns"), "gain").alias("best"))
    )
    as_map = lambda df, key: df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("size", "n"))).alias("m"))
    met_by_class = as_map(classes.groupBy("pattern", "size").agg(F.sum("models").alias("n")), "pattern")
    no_common = F.size(F.array_intersect("pattern", "contract_pattern")) == 0
    met_alone = as_map(pairs.filter(no_common).groupBy("column_set", "size").agg(F.sum("model_count").alias("n")), "column_set")
    totals = contract_sets.groupBy(F.size("column_set").alias("size")).agg(F.sum("model_count").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("size", "n")))).scalar()
    met = lambda name, width: F.coalesce(F.try_element_at(name, width), F.lit(0))
    free = lambda width, count: count > met("_class", width) + met("_alone", width)
    width = EXTRA_WEIGHT * F.size("column_set")
    return (
        batches.join(best, "column_set", "left")
        .join(met_by_class.withColumnRenamed("m", "_class"), "pattern", "left")
        .join(met_alone.withColumnRenamed("m", "_alone"), "column_set", "left")
        .withColumn("totals", totals)
        .withColumn("smallest", F.array_min(F.map_keys(F.map_filter("totals", free))))
        .select(
            "column_set", (F.col("best.gain") - width).alias("score"), "best.top_models", "best.model_id", "best.matched_columns",
            (-MISSING_WEIGHT * F.col("smallest") - width).alias("rival"),
        )
    )


def feature_candidates(df: DataFrame, new_columns: Sequence[str]) -> DataFrame:
    """Statistics and a recommended decision for columns that the contract does not know yet."""
    schema = profile.classify_columns(profile.extract_schema(df.select(*new_columns)))
    hist = profile.text_histogram(df, new_columns)
    stats = hist.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    samples = profile.first_values(hist, [], DEFAULTS.candidate_sample)
    joined = schema.join(stats, "column_name", "left").join(samples, "column_name", "left")
    present = F.col("present_count")
    base = joined.select(
        "column_name", "dtype", F.col("column_class").alias("inferred_type"),
        F.coalesce((F.col("row_count") - present) / F.nullif(F.col("row_count"), F.lit(0)), F.lit(0.0)).alias("missing_ratio"),
        F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"), "row_count", "present_count",
        F.coalesce("values", empty_list()).alias("sample_values"),
    )
    return decide_candidates(base)


def decide_candidates(stats: DataFrame) -> DataFrame:
    """Add semantic_type, recommended_decision, encoding_strategy and safe_as_feature."""
    unique, present = F.col("unique_count"), F.col("present_count")
    wide = (unique >= DEFAULTS.high_cardinality_limit) | (
        (present >= DEFAULTS.candidate_ratio_min_rows)
        & (unique / F.greatest(present, F.lit(1)) >= DEFAULTS.high_cardinality_ratio)
    )
    semantic = (
        F.when(is_identifier_col(F.col("column_name")), "identifier")
        .when(F.col("inferred_type").isin("numeric", "boolean"), "numeric_feature")
        .when((F.col("inferred_type") == "categorical") & wide, "high_cardinality_text")
        .when(F.col("inferred_type") == "categorical", "categorical_feature")
    )
    kind = F.col("semantic_type")
    # Decision and encoding names.
    decision = (
        F.when(kind.isin("identifier", "high_cardinality_text"), "reject_as_feature")
        .when(kind == "numeric_feature", "approve_as_feature")
        .when(kind == "categorical_feature", "approve_with_encoding")
        .otherwise("monitor_only")
    )
    encoding = (
        F.when(kind == "numeric_feature", "none")
        .when(kind == "high_cardinality_text", "custom_required")
        .when(kind == "categorical_feature", "one_hot")
    )
    return (
        stats.withColumn("semantic_type", semantic)
        .withColumn("recommended_decision", decision)
        .withColumn("encoding_strategy", encoding)
        .withColumn("safe_as_feature", F.coalesce(kind.isin("numeric_feature", "categorical_feature"), F.lit(False)))
    )


def candidate_profile(candidates: DataFrame) -> DataFrame:
    """Profile row that a candidate gets once it joins the contract."""
    kind, inferred = F.col("semantic_type"), F.col("inferred_type")
    direct = inferred.isin("numeric", "boolean")
    rule_type = (
        F.when(inferred == "numeric", "numeric")
        .when(inferred == "boolean", "categorical")
        .when(kind == "high_cardinality_text", "text")
        .when(kind == "identifier", "identifier")
        .otherwise("categorical")
    )
    mode = (
        F.when(inferred == "numeric", "range")
        .when(inferred == "boolean", "enum")
        .when(kind == "high_cardinality_text", "high_cardinality")
        .when(kind == "identifier", "identifier")
        .otherwise("enum")
    )
    listed = ~direct & ~F.coalesce(kind.isin("high_cardinality_text", "identifier"), F.lit(False))
    return candidates.select(
        "column_name", "dtype", rule_type.alias("type"), mode.alias("validation_mode"),
        (direct | F.coalesce(kind != "identifier", F.lit(True))).alias("feature_candidate"),
        F.when(listed, F.coalesce("encoding_strategy", F.lit("one_hot"))).otherwise(F.col("encoding_strategy"))
        .alias("encoding_strategy"),
        F.when(listed, F.slice("sample_values", 1, DEFAULTS.categorical_limit)).alias("unique_values"),
    )


def approved_features(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per event: requested columns that are safe candidates (trimmed, once each, in request order) and the rest.

    ``requests``: id, position, column_name. ``candidates``: id, column_name, safe_as_feature.
    """
    asked = requests.withColumn("column_name", F.trim("column_name"))
    first = asked.groupBy("id", "column_name").agg(F.min("position").alias("position"))
    judged = first.join(
        candidates.select("id", "column_name", "safe_as_feature"), ["id", "column_name"], "left"
    ).withColumn("_ok", F.coalesce("safe_as_feature", F.lit(False)))
    listed = F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("position", "column_name"))))
    return judged.groupBy("id").agg(
        F.transform(listed, lambda s: s["column_name"]).alias("approved_feature_columns"),
        F.array_sort(F.collect_set(F.when(~F.col("_ok"), F.col("column_name")))).alias("rejected_requested_columns"),
    )


def evolve_contract(contracts: DataFrame, versions: DataFrame, approved: DataFrame) -> DataFrame:
    """Next contract version of every model with approved new columns.

    ``contracts``: model_id, column_name, dtype; ``versions``: model_id, version; ``approved``: model_id,
    column_name, dtype. A known column keeps its place; its type follows the approval.
    """
    touched = approved.select("model_id").distinct()
    old = contracts.join(touched, "model_id", "left_semi").withColumn("_new", F.lit(0))
    new = approved.select("model_id", "column_name", "dtype").withColumn("_new", F.lit(1))
    merged = old.select("model_id", "column_name", "dtype", "_new").unionByName(new).groupBy(
        "model_id", "column_name"
    ).agg(F.max_by("dtype", F.struct("_new", "dtype")).alias("dtype"), F.max("_new").cast("boolean").alias("added"))
    last = versions.groupBy("model_id").agg(F.max("version").alias("_last"))
    return merged.join(last, "model_id", "left").select(
        "model_id", (F.coalesce("_last", F.lit(0)) + 1).cast("bigint").alias("version"),
        "column_name", "dtype", F.coalesce("added", F.lit(False)).alias("added"),
    )


def new_schema_events(diffs: DataFrame, events: DataFrame) -> DataFrame:
    """One new pending event per model whose schema changed and that has no pending event: its first run."""
    pending = events.filter(F.col("status") == "pending").select("model_id").distinct()
    changed = diffs.filter("schema_changed").join(pending, "model_id", "left_anti")
    return (
        changed.groupBy("model_id")
        .agg(F.min_by(F.struct("run_id", "extra_columns", "missing_columns"), "run_id").alias("e"))
        .select("model_id", "e.run_id", F.col("e.extra_columns").alias("new_columns"), "e.missing_columns",
                F.lit("pending").alias("status"))
    )


def schema_change_rows(events: DataFrame) -> DataFrame:
    """(id, column, change_type) rows from the list form of schema-change events."""
    tagged = lambda c, kind: F.transform(
        F.coalesce(F.col(c), empty_list()), lambda v: F.struct(v.alias("column_name"), F.lit(kind).alias("change_type"))
    )
    return events.select(
        "id", F.inline(F.concat(tagged("new_columns", "new_column"), tagged("missing_columns", "missing_column")))
    )


def events_as_lists(rows: DataFrame) -> DataFrame:
    """The list form: one row per event with its new and missing columns."""
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("change_type") == kind, F.col("column_name"))))
    return rows.groupBy("id", "model_id", "run_id", "status").agg(
        pick("new_column").alias("new_columns"), pick("missing_column").alias("missing_columns")
    )
