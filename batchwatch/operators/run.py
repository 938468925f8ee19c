"""The batch pipeline as one job over many runs: schema difference, alignment, raw checks, cleaning, checks of the cleaned rows, gate.

Every step is keyed by run. Accepted rows are written once, since the checks after cleaning and all later consumers read them again; the
decision of the gate rests on these checks, not on the raw ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwatch.operators import clean, validate
from batchwatch.operators.profile import ColumnRule
from batchwatch.operators.schema import SPARK_TYPES, empty_list
from batchwatch.sources import sinks
from batchwatch.sources.storage import stored

KEY = "run_id"


@dataclass(frozen=True)
class BatchRun:
    """What a pipeline run leaves: one row for each run, the findings to store, accepted and quarantined rows."""

    runs: DataFrame
    findings: DataFrame
    accepted: DataFrame
    quarantined: DataFrame


def column_diffs(runs: DataFrame, present: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """run_id, extra_columns, missing_columns of every run against the contract; ``present`` (run_id, column_name)."""
    contract = F.array(*[F.lit(r.name) for r in rules])
    have = present.groupBy(KEY).agg(F.array_sort(F.collect_set("column_name")).alias("_have"))
    both = runs.select(KEY).distinct().join(have, KEY, "left").withColumn("_have", F.coalesce("_have", empty_list()))
    return both.select(
        KEY, F.array_sort(F.array_except("_have", contract)).alias("extra_columns"), F.array_sort(F.array_except(contract, "_have")).alias("missing_columns")
    )


def aligned(rows: DataFrame, rules: Sequence[ColumnRule], keep: Sequence[str]) -> DataFrame:
    """Contract columns in contract order, null where the batch lacks them."""
    cell = lambda r: F.col(r.name) if r.name in rows.columns else F.lit(None).cast(SPARK_TYPES[r.dtype]).alias(r.name)
    return rows.select(*dict.fromkeys([KEY, *keep]), *[cell(r) for r in rules])


def totals(checks: DataFrame, types: DataFrame, prefix: str) -> DataFrame:
    """Failed checks and type mismatches of each run."""
    failed = checks.groupBy(KEY).agg(F.count_if(~F.col("success")).alias(f"{prefix}failed_checks"))
    errors = types.groupBy(KEY).agg(F.count_if(~F.col("compatible")).alias(f"{prefix}schema_errors"))
    return failed.join(errors, KEY, "full")


def run_batches(runs: DataFrame, rows: DataFrame, present: DataFrame, rules: Sequence[ColumnRule], keep: Sequence[str] = ()) -> BatchRun:
    """Takes the rows (run_id, cells) of all ``runs`` (run_id) through the pipeline. A run without rows fails at the gate."""
    diffs = column_diffs(runs, present, rules)
    batch = stored(aligned(rows, rules, keep), "batch")  # read by every check and by the cleaning; files or joins behind it are read once
    raw_checks, raw_types = validate.all_checks(batch, rules, [KEY]), validate.check_schema_types(batch, rules, [KEY])
    flagged = clean.flag_rows(batch, rules, keep=[*dict.fromkeys([KEY, *keep])])
    accepted = stored(clean.clean_batch(flagged, rules, keys=[KEY], keep=keep), "accepted")
    audit = clean.cleaning_audit(flagged, [KEY]).select(KEY, "rows_in", "rows_out", "rows_removed")
    after = totals(validate.all_checks(accepted, rules, [KEY]), validate.check_schema_types(accepted, rules, [KEY]), "")
    unseen = validate.unseen_values(batch, rules, [KEY]) if any(r.is_enum for r in rules) else None
    findings = sinks.dq_finding_rows(raw_checks, raw_types, diffs, [KEY], unseen)
    found = stored(findings, "findings")
    before = found.groupBy(KEY).agg(F.count_if(~F.col("success")).alias("raw_failures"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    counted = diffs.join(audit, KEY, "left").join(after, KEY, "left").join(before, KEY, "left")
    gated = validate.quality_gate(counted.select(
        KEY, "extra_columns", F.col("missing_columns").alias("absent"), F.size("missing_columns").alias("missing_columns"), zero("rows_in").alias("total_rows"),
        zero("rows_out").alias("cleaned_rows"), zero("rows_removed").alias("rows_removed"), zero("raw_failures").alias("raw_failures"),
        zero("schema_errors").alias("schema_errors"), zero("failed_checks").alias("failed_checks"),
    ))
    decided = gated.select(
        KEY, "total_rows", "cleaned_rows", "rows_removed", "extra_columns", F.col("absent").alias("missing_columns"), "raw_failures", "schema_errors",
        "failed_checks", "clean_row_ratio", "blocking_reasons", "status",
    )
    return BatchRun(stored(decided, "runs"), found, accepted, clean.quarantined(flagged, rules, [*dict.fromkeys([KEY, *keep])]))


def usable(result: BatchRun) -> DataFrame:
    """Accepted rows of the runs that passed the gate: what may be scored and compared for drift."""
    return result.accepted.join(result.runs.filter("status = 'success'").select(KEY), KEY, "left_semi")
