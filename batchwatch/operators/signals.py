"""Signals of a run from its findings, issue groups, and rules that read analysis text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwatch.functions import severity

# Severity of a failed check as a signal.
SIGNAL_SEVERITY = {
    "missing_columns": "high", "schema_type_mismatch": "high",
    "extra_columns": "medium", "range": "medium", "categorical": "medium",
}
# Signal type -> issue key, and issue key -> failure type.
ISSUE_KEYS = {
    "null_ratio": "null_spike", "range": "range_violation", "categorical": "categorical_shift",
}
FAILURE_OF_ISSUE = {
    "data_drift": "DATA_DRIFT", "concept_drift": "CONCEPT_DRIFT", "schema_type_mismatch": "SCHEMA_MISMATCH",
    "missing_columns": "MISSING_COLUMNS", "extra_columns": "EXTRA_COLUMNS", "null_spike": "NULL_SPIKE",
    "range_violation": "RANGE_VIOLATION", "categorical_shift": "CATEGORICAL_SHIFT",
}
# Failure type -> words that point to it in free text.
TEXT_RULES = {
    "DATA_DRIFT": ("data_drift", "data drift", "psi", "population stability", "feature drift"),
    "CONCEPT_DRIFT": ("concept_drift", "concept drift", "prediction_output", "prediction output", "model output"),
    "SCHEMA_MISMATCH": ("schema_type_mismatch", "type mismatch", "expected", "got"),
    "MISSING_COLUMNS": ("missing_columns", "missing columns", "missing column"),
    "EXTRA_COLUMNS": ("extra_columns", "extra columns", "new columns"),
    "NULL_SPIKE": ("null_ratio", "null spike", "missing data"),
    "RANGE_VIOLATION": ("range", "outside", "out of range"),
    "CATEGORICAL_SHIFT": ("categorical", "unseen"),
}
FAILURE_TYPES = (*TEXT_RULES, "DATA_QUALITY")
FALLBACK_FAILURE = "DATA_QUALITY"
SENTENCE_LIMIT = 240
# Default texts of a parsed note.
NO_TEXT = "No root-cause reasoning was produced."
DEFAULT_RECOMMENDATION = "Review the flagged checks and compare the current batch against the active baseline."

# Issue titles.
ISSUE_TITLES = {
    "schema_type_mismatch": "Column types do not match the baseline",
    "extra_columns": "Unexpected columns were added",
    "missing_columns": "Required columns are missing",
    "null_spike": "Missing values exceeded the quality threshold",
    "range_violation": "Numeric values moved outside the baseline range",
    "categorical_shift": "New categorical values appeared",
    "data_drift": "Feature distributions drifted from the baseline",
    "concept_drift": "Model output distribution drifted",
}
DEFAULT_TITLE = "Data quality issue"
# Recommended actions per issue.
ISSUE_ACTIONS = {
    "schema_type_mismatch": "Inspect sample bad rows, fix invalid tokens upstream, and keep prediction blocked for affected required features if coercion is unsafe.",
    "extra_columns": "Approve a new baseline only if the columns are expected and downstream consumers are ready for them.",
    "missing_columns": "Restore the missing columns or deploy a compatible model/baseline before using this batch for prediction.",
    "null_spike": "Check ingestion completeness and upstream joins; only rely on imputation if the missingness is expected and monitored.",
    "range_violation": "Review outlier rows and confirm whether the baseline range is stale or the source values are malformed.",
    "categorical_shift": "Confirm whether the new categories are valid business values; update the baseline/category mapping if expected.",
    "data_drift": "Compare the batch source and time window with the baseline, then retrain or refresh the baseline if the population shift is expected.",
    "concept_drift": "Compare model predictions against recent labels and consider retraining if performance has degraded.",
}
DEFAULT_ACTION = "Review the flagged rows and compare them with the active baseline contract."
# Likely causes per issue.
ISSUE_CAUSES = {
    "schema_type_mismatch": "The source system changed formatting, introduced invalid tokens, or exported blanks in a way that changed type inference.",
    "extra_columns": "The upstream dataset contract evolved, or a newer/wrong file version was uploaded.",
    "missing_columns": "The upstream export removed or renamed expected fields.",
    "null_spike": "A source extraction problem, mapping issue, or incomplete upstream data load introduced missing values.",
    "range_violation": "The batch contains outliers, unit/currency changes, stale baseline limits, or records from a different population.",
    "categorical_shift": "A new business category/region/status appeared, or category normalization changed upstream.",
    "data_drift": "The current batch distribution differs from the baseline population; this can happen after traffic mix changes, seasonality, or source changes.",
    "concept_drift": "The relationship between features and model output has shifted, or the serving model/data path changed.",
}
DEFAULT_CAUSE = "The current batch differs from the active baseline."


def by_key(key: Column, table: dict[str, str], default: str | Column) -> Column:
    """Value of a small fixed table, as a CASE expression."""
    out = default if isinstance(default, Column) else F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


SIGNAL_COLUMNS = {
    "run_id": "bigint", "source": "string", "type": "string", "column_name": "string", "severity": "string",
    "drift_score": "double", "psi_score": "double", "ks_score": "double", "observed_min": "double",
    "observed_max": "double", "baseline_min": "double", "baseline_max": "double", "ratio": "double",
    "threshold": "double", "unseen": "string", "info": "string", "columns": "array<string>", "unseen_values": "array<string>",
}
# What stored findings keep as JSON in ``details``.
DETAILS = {
    "observed_min": "double", "observed_max": "double", "baseline_min": "double", "baseline_max": "double", "ratio": "double",
    "threshold": "double", "unseen_values": "array<string>", "unseen_sample": "array<string>",
}


def _signal(df: DataFrame, **given: Column) -> DataFrame:
    """Signal rows with the common columns; what is neither given nor present is null."""
    return df.select(
        *[
            given.get(name, F.col(name) if name in df.columns else F.lit(None)).cast(t).alias(name)
            for name, t in SIGNAL_COLUMNS.items()
        ]
    )


def unpack_details(findings: DataFrame) -> DataFrame:
    """Findings as stored (numbers and lists inside the JSON text ``details``) with these as columns; given ones stay."""
    if "details" not in findings.columns:
        return findings
    stored = F.from_json("details", ", ".join(f"{n} {t}" for n, t in DETAILS.items()))
    opened = findings.withColumn("_details", stored)
    value = {n: F.col("_details")[n].cast(t) for n, t in DETAILS.items()}
    value["unseen_values"] = F.coalesce(value["unseen_values"], value.pop("unseen_sample"))
    return opened.withColumns(
        {n: F.coalesce(F.col(n).cast(DETAILS[n]), v) if n in findings.columns else v for n, v in value.items()}
    ).drop("_details")


def with_unseen_rows(findings: DataFrame) -> DataFrame:
    """Category findings with all their unseen values, where these are stored as rows of their own (kind ``unseen_value``, the value in
    ``info``); a finding itself keeps the first ones only. The number of values is that of one enumerated column's of one run."""
    if not {"check_type", "info", "unseen_values"} <= set(findings.columns):
        return findings
    own = F.col("check_type") == "unseen_value"
    listed = findings.filter(own).groupBy("run_id", "column_name").agg(F.array_sort(F.collect_set("info")).alias("_listed"))
    keyed = listed.select(F.col("run_id").alias("_run"), F.col("column_name").alias("_column"), F.lit("categorical").alias("_kind"), "_listed")
    same = (
        findings["run_id"].eqNullSafe(keyed["_run"]) & findings["column_name"].eqNullSafe(keyed["_column"])
        & (findings["check_type"] == keyed["_kind"])
    )
    both = findings.filter(~own | F.col("check_type").isNull()).join(keyed, same, "left")
    return both.withColumn("unseen_values", F.coalesce("_listed", "unseen_values")).drop("_run", "_column", "_kind", "_listed")


def build_signals(quality: DataFrame, drift: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Everything that went wrong in a run: failed checks, detected drift, and one signal each for all added and all
    missing columns. ``quality`` may be findings as stored."""
    quality = with_unseen_rows(unpack_details(quality))
    own = F.when(F.col("column_name").isNotNull(), F.array("column_name"))
    unseen = F.when(F.col("unseen").isNotNull(), F.array("unseen")) if "unseen" in quality.columns else F.lit(None).cast("array<string>")
    listed = F.coalesce(F.col("unseen_values"), unseen) if "unseen_values" in quality.columns else unseen
    failed = _signal(
        quality.filter(~F.col("success")), source=F.lit("data_quality"), type=F.col("check_type"),
        severity=by_key(F.col("check_type"), SIGNAL_SEVERITY, "low"), columns=own, unseen_values=listed,
    )
    drifted = _signal(
        drift.filter("drift_detected"), source=F.lit("drift"),
        type=F.when(F.col("feature_name") == "prediction_output", "concept_drift").otherwise("data_drift"),
        column_name=F.col("feature_name"), severity=F.coalesce("severity", F.lit("medium")), columns=F.array("feature_name"),
    )
    out = failed.unionByName(drifted)
    if changes is not None:
        added = F.col("change_type") == "new_column"
        kinds = changes.groupBy("run_id", added.alias("_added")).agg(F.array_sort(F.collect_set("column_name")).alias("columns"))
        out = out.unionByName(
            _signal(
                kinds, source=F.lit("schema"),
                type=F.when(F.col("_added"), "extra_columns").otherwise("missing_columns"),
                severity=F.when(F.col("_added"), "medium").otherwise("high"),
            )
        )
    return out


# Likely cause and recommended action of a signal, by type; "schema" ones are those of added and missing columns.
SIGNAL_CAUSES = {
    "extra_columns": "A producer added fields, or the wrong file version was uploaded.",
    "missing_columns": "A producer removed or renamed fields, or the wrong export was uploaded.",
    "range": "Outliers, unit changes, mixed populations, or stale baseline limits.",
    "categorical": "New business values appeared, or upstream normalization changed.",
    "null_ratio": "Incomplete extraction, broken join, or source field not populated.",
    "schema_type_mismatch": "Invalid tokens, formatting change, or a source contract change.",
    "concept_drift": "Model behavior shifted because input mix changed or the model/data path changed.",
    "data_drift": "Population mix, seasonality, upstream source changes, or stale baseline data.",
}
SIGNAL_ACTIONS = {
    "extra_columns": "Approve the schema change only if these columns are expected; otherwise ask the upstream producer to restore the contract.",
    "missing_columns": "Block prediction until the missing columns are restored or a new model/baseline is approved.",
    "range": "Inspect rows above/below the baseline limits and decide whether to fix data or refresh the baseline.",
    "categorical": "Validate the new category values, then update mappings or baseline if they are expected.",
    "null_ratio": "Check upstream completeness before trusting imputed values.",
    "schema_type_mismatch": "Inspect raw values that could not be coerced and fix them upstream.",
    "concept_drift": "Compare predictions with labels and review model performance before retraining.",
    "data_drift": "Compare current batch sampling window/source with baseline and refresh baseline only if this shift is expected.",
}
SIGNAL_CAUSE = "The incoming batch differs from the active baseline."
SIGNAL_ACTION = "Inspect the affected rows and compare against the source contract."


def describe(signals: DataFrame, digits: int | None = None) -> DataFrame:
    """Title, explanation, likely cause and recommended action of each signal. ``digits`` fixes the decimals of drift scores."""
    kind = F.col("type")
    column = F.coalesce("column_name", F.when(F.col("source") == "drift", "prediction output").otherwise("dataset"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    # Wording of the signal texts.
    title = (
        F.when(F.col("source") == "schema", by_key(kind, {
            "extra_columns": "New columns appeared in the incoming dataset",
            "missing_columns": "Required baseline columns are missing"}, ""))
        .when(kind == "concept_drift", "Prediction output distribution changed")
        .when(kind == "data_drift", F.concat(column, F.lit(" distribution drifted")))
        .when(kind == "range", F.concat(column, F.lit(" is outside the baseline range")))
        .when(kind == "categorical", F.concat(column, F.lit(" contains unseen categories")))
        .when(kind == "null_ratio", F.concat(column, F.lit(" has too many missing values")))
        .when(kind == "schema_type_mismatch", F.concat(column, F.lit(" has an incompatible type")))
        .otherwise(F.concat(column, F.lit(" failed "), kind))
    )
    shown = lambda c: text(c) if digits is None else F.when(F.col(c).isNull(), "None").otherwise(F.format_string(f"%.{digits}f", c))
    metrics = F.concat(F.lit("PSI="), shown("psi_score"), F.lit(", KS="), shown("ks_score"), F.lit("."))
    listed = F.concat(F.lit("["), F.array_join(F.transform("unseen_values", lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))
    explanation = (
        F.when(F.col("source") == "schema", by_key(kind, {
            "extra_columns": "The file contains columns that are not part of the active baseline schema.",
            "missing_columns": "The model or downstream pipeline may not receive features it expects."}, ""))
        .when(kind == "concept_drift", F.concat(F.lit("Concept drift signal on "), column, F.lit("; "), metrics))
        .when(kind == "data_drift", F.concat(F.lit("Current distribution differs from baseline; "), metrics))
        .when(kind == "range", F.concat(
            F.lit("Observed range "), text("observed_min"), F.lit("-"), text("observed_max"),
            F.lit(" versus baseline "), text("baseline_min"), F.lit("-"), text("baseline_max"), F.lit(".")))
        .when(kind == "categorical", F.concat(F.lit("Unseen values: "), F.coalesce("unseen", listed, F.lit("None")), F.lit(".")))
        .when(kind == "null_ratio", F.concat(
            F.lit("Missing ratio "), text("ratio"), F.lit(" exceeded threshold "), text("threshold"), F.lit(".")))
        .when(kind == "schema_type_mismatch",
              F.coalesce("info", F.lit("The incoming type differs from the baseline.")))
        .otherwise(F.coalesce("info", F.lit("A data quality check failed.")))
    )
    bad_check = (F.col("source") != "data_quality") | ~kind.isin("extra_columns", "missing_columns")
    return signals.withColumns({
        "title": title, "explanation": explanation,
        "likely_cause": F.when(bad_check, by_key(kind, SIGNAL_CAUSES, SIGNAL_CAUSE)).otherwise(SIGNAL_CAUSE),
        "recommended_action": F.when(bad_check, by_key(kind, SIGNAL_ACTIONS, SIGNAL_ACTION)).otherwise(SIGNAL_ACTION),
    })


def issue_key(kind: Column) -> Column:
    return by_key(kind, ISSUE_KEYS, F.coalesce(kind, F.lit("data_quality")))


def issue_findings(signals: DataFrame) -> DataFrame:
    """Signals of a run grouped by issue: worst severity, affected columns, texts, number of signals.

    Column and category lists are sets, deduplicated before the shuffle and as long as a table is wide.
    """
    grouped = signals.groupBy("run_id", issue_key(F.col("type")).alias("issue")).agg(
        F.max(severity.rank(F.col("severity"))).alias("severity_rank"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("columns")))).alias("affected_columns"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.max(F.coalesce("drift_score", F.lit(0.0))).alias("_top_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("unseen_values")))).alias("_unseen"),
    )
    key = F.col("issue")
    names = F.array_join("affected_columns", ", ")
    where = F.when(F.size("affected_columns") > 0, names).otherwise("the dataset")
    head = F.array_join(F.slice("affected_columns", 1, 3), ", ")
    title = F.concat(
        by_key(key, ISSUE_TITLES, DEFAULT_TITLE),
        F.when(F.size("affected_columns") > 0, F.concat(F.lit(": "), head)).otherwise(""),
    )
    quoted = F.array_join(F.transform(F.slice("_unseen", 1, 8), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")
    count = F.col("evidence_count").cast("string")
    # Wording of the issue summaries.
    summary = (
        F.when(key == "range_violation", F.concat(count, F.lit(" numeric range check(s) failed for "), where, F.lit(".")))
        .when(key == "categorical_shift",
              F.concat(F.lit("Observed unseen category value(s) ["), quoted, F.lit("] in "), where, F.lit(".")))
        .when(key == "null_spike",
              F.concat(F.lit("Missing-value ratio exceeded the configured threshold for "), where, F.lit(".")))
        .when(key == "schema_type_mismatch",
              F.concat(F.lit("Incoming data types are incompatible with the active baseline for "), where, F.lit(".")))
        .when(key == "data_drift",
              F.format_string("Distribution drift was detected for %s; max drift score is %.3f.", where, "_top_score"))
        .when(key == "concept_drift",
              F.lit("Prediction output distribution changed compared with the reference behavior."))
        .when(key == "extra_columns", F.concat(F.lit("The incoming file includes new column(s): "), where, F.lit(".")))
        .when(key == "missing_columns",
              F.concat(F.lit("The incoming file is missing required column(s): "), where, F.lit(".")))
        .otherwise(F.concat(count, F.lit(" issue(s) detected for "), where, F.lit(".")))
    )
    return grouped.select(
        "run_id", "issue", severity.label(F.col("severity_rank")).alias("severity"), "severity_rank",
        title.alias("title"), summary.alias("summary"),
        by_key(key, ISSUE_CAUSES, DEFAULT_CAUSE).alias("likely_root_cause"),
        by_key(key, ISSUE_ACTIONS, DEFAULT_ACTION).alias("recommended_action"),
        "affected_columns", "evidence_count",
    )


def run_rca(runs: DataFrame, signals: DataFrame) -> DataFrame:
    """Deterministic summary per run: failure types (by signal type), worst severity and texts.

    A run without signals is low and opens no incident.
    """
    kind = by_key(issue_key(F.col("type")), FAILURE_OF_ISSUE, FALLBACK_FAILURE)
    per_run = signals.groupBy("run_id").agg(
        F.array_sort(F.collect_set(kind)).alias("failure_types"), severity.worst(F.col("severity")).alias("severity"),
        F.count(F.lit(1)).alias("signal_count"),
    )
    joined = runs.select("run_id", "model_id").join(per_run, "run_id", "left")
    none = F.col("signal_count").isNull()
    return joined.select(
        "run_id", "model_id",
        F.coalesce("failure_types", F.array().cast("array<string>")).alias("failure_types"),
        F.coalesce("severity", F.lit("low")).alias("severity"),
        F.coalesce("signal_count", F.lit(0)).cast("bigint").alias("signal_count"),
        F.when(none, "No failed detection signals required RCA reporting.").otherwise(
            F.concat(F.lit("Detected "), F.col("signal_count").cast("string"), F.lit(" pipeline risk signal(s): "),
                     F.array_join("failure_types", ", "), F.lit("."))).alias("summary"),
        F.when(none, "Continue monitoring future runs.").otherwise(
            "Inspect the highest-severity signal first, then update the baseline only if the upstream change is expected."
        ).alias("recommendation"),
        (~none).alias("opens_incident"),
    )


# ---- analysis text ---------------------------------------------------------------------------------------------


def failure_types_in_text(text: Column) -> Column:
    """Failure types whose words occur in the text, in rule order; a failing text without any is DATA_QUALITY."""
    hay = F.lower(text)
    any_word = lambda words: F.lit(False) if not words else _any([hay.contains(w) for w in words])
    found = F.array_compact(F.array(*[F.when(any_word(w), name) for name, w in TEXT_RULES.items()]))
    bare = F.regexp_replace(hay, '"\\w+":', "")
    fallback = F.when(
        bare.contains("fail") | bare.contains("quality"), F.array(F.lit(FALLBACK_FAILURE))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def severity_in_text(text: Column) -> Column:
    hay = F.lower(text)
    out = F.lit("medium")
    for level in severity.LEVELS:  # later, that is higher, levels win
        out = F.when(hay.contains(level), level).otherwise(out)
    return out


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def first_sentence(text: Column) -> Column:
    clean = squeeze(text)
    return F.when(clean == "", NO_TEXT).otherwise(F.left(F.substring_index(clean, ". ", 1), F.lit(SENTENCE_LIMIT)))


def parse_notes(notes: DataFrame, text: str = "text") -> DataFrame:
    """Failure types, severity, summary and recommendation of analysis notes.

    A fenced or embedded JSON object supplies the fields where it is valid; the text rules fill the rest.
    """
    body = F.col(text)
    fenced = F.nullif(F.regexp_extract(body, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))
    as_map = lambda c: F.from_json(c, "map<string,string>")
    payload = F.coalesce(as_map(fenced), as_map(outer))
    parsed = notes.withColumn("_payload", payload)
    field = lambda name: F.nullif(F.try_element_at("_payload", F.lit(name)), F.lit(""))
    raw_types = F.try_element_at("_payload", F.lit("failure_types"))
    listed = F.coalesce(F.from_json(raw_types, "array<string>"), F.array(raw_types))
    tidy = F.array_distinct(
        F.filter(
            F.transform(listed, lambda v: F.regexp_replace(F.upper(F.trim(v)), "[ -]", "_")),
            lambda v: v.isin(*FAILURE_TYPES),
        )
    )
    level = F.lower(F.trim(field("severity")))
    return parsed.withColumns(
        {
            "failure_types": F.when(raw_types.isNotNull(), tidy).otherwise(failure_types_in_text(body)),
            "severity": F.when(level.isin(*severity.LEVELS), level).otherwise(severity_in_text(body)),
            "summary": F.coalesce(field("summary"), first_sentence(body)),
            "recommendation": F.coalesce(field("recommendation"), F.lit(DEFAULT_RECOMMENDATION)),
        }
    ).drop("_payload")
