"""Remediation: policy, state of a run as a fold over its log, and report fields per state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwatch.functions import ordering

# Failure types that decide the policy.
SOURCE_DATA_FAILURES = (
    "SCHEMA_MISMATCH", "MISSING_COLUMNS", "EXTRA_COLUMNS", "DATA_QUALITY", "NULL_SPIKE", "RANGE_VIOLATION",
    "CATEGORICAL_SHIFT",
)
RETRAINING_SIGNALS = ("DATA_DRIFT", "CONCEPT_DRIFT", "MODEL_DEGRADATION")

# Outcome of each policy case.
# case: action_type, action_mode, requires_approval, allowed_to_execute, manual_only, recommended_action, reason
POLICIES = {
    "source_data": (
        "manual_data_correction", "manual_only", False, False, True,
        "Fix or validate the upstream/incoming data first, then run the DAG again. "
        "Only consider retraining after the follow-up run proves the data contract is clean.",
        "This incident contains source-data quality or schema failures. "
        "Retraining on malformed data is blocked by production safety policy.",
    ),
    "critical": (
        "manual_investigation", "manual_only", False, False, True,
        "Manual investigation required before any model or baseline change.",
        "Critical incidents are alert-only in the current production safety policy.",
    ),
    "retrain": (
        "retrain_model", "approval_required", True, True, False,
        "Prepare a controlled retraining run and require admin approval before execution.",
        "The failure pattern suggests population or concept change that may require model refresh.",
    ),
    "high": (
        "manual_review", "approval_required", True, False, True,
        "Review the issue manually and approve a remediation only after validating the source change.",
        "High-severity incidents are not auto-executed without human approval.",
    ),
    "medium": (
        "review_and_refresh_baseline", "suggestion_only", False, False, True,
        "Investigate the incident and refresh the baseline only if the shift is confirmed as expected.",
        "Medium-severity incidents only prepare remediation guidance in the current MVP.",
    ),
    "low": (
        "observe", "none", False, False, False,
        "No immediate remediation is required. Keep monitoring future runs.",
        "Low-severity incidents should not trigger remediation execution.",
    ),
}
POLICY_FIELDS = (
    "action_type", "action_mode", "requires_approval", "allowed_to_execute", "manual_only", "recommended_action",
    "reason",
)

# Report status, whether manual action is still needed, and action text per remediation status.
REPORT_STATUS = {
    "queued": ("queued_for_execution", True, "Remediation was approved and queued for execution."),
    "running": ("remediation_running", True, "Approved remediation is running in the background."),
    "rejected": ("remediation_rejected", True, "Remediation was rejected before execution."),
    "cancel_requested": (
        "remediation_cancel_requested", True, "Cancellation was requested for the running remediation."),
    "canceled": (
        "remediation_canceled", True, "Remediation execution was canceled before candidate promotion."),
    "blocked": ("remediation_blocked", True, "Remediation was blocked by policy or a missing prerequisite."),
    "failed": (
        "remediation_failed", True,
        "Remediation execution failed before a candidate model could be finalized."),
    "pending_promotion": (
        "candidate_ready_for_review", True,
        "Candidate retraining completed and now requires human review before promotion."),
    "completed": (
        "candidate_ready_for_review", True,
        "Candidate retraining completed and now requires human review before promotion."),
    "staged": (
        "candidate_staged_for_deployment", True, "Candidate model was approved and staged for deployment."),
    "deployed": (
        "remediation_deployed", False, "Deployment was confirmed and the champion alias was updated."),
    "promotion_rejected": (
        "candidate_rejected", True,
        "Candidate model was reviewed and rejected; the existing live model remains active."),
}

# Allowed changes of a remediation status, states that block a second run, and final states.
TRANSITIONS = {
    "approved": ("queued",),
    "queued": ("running", "blocked", "rejected"),
    "running": ("pending_promotion", "cancel_requested", "canceled", "failed"),
    "cancel_requested": ("canceled", "failed"),
    "pending_promotion": ("staged", "promotion_rejected"),
    "completed": ("staged", "promotion_rejected"),
    "staged": ("deployed", "promotion_rejected"),
}
ACTIVE_STATES = ("approved", "queued", "running", "cancel_requested", "pending_promotion", "staged")


def policy_case(severity: Column, failure_types: Column) -> Column:
    level = F.lower(F.coalesce(severity, F.lit("medium")))
    kinds = F.transform(F.coalesce(failure_types, F.array().cast("array<string>")), F.upper)
    has = lambda names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(F.coalesce(has(SOURCE_DATA_FAILURES), F.lit(False)), "source_data")
        .when(level == "critical", "critical")
        .when(F.coalesce(has(RETRAINING_SIGNALS), F.lit(False)), "retrain")
        .when(level.isin("high", "medium"), level)
        .otherwise("low")
    )


def remediation_policy(df: DataFrame, severity: str = "severity", failure_types: str = "failure_types") -> DataFrame:
    """Add the policy fields for each (severity, failure types)."""
    out = df.withColumn("_case", policy_case(F.col(severity), F.col(failure_types)))
    for position, field in enumerate(POLICY_FIELDS):
        value = F.lit(POLICIES["low"][position])
        for case, outcome in POLICIES.items():
            value = F.when(F.col("_case") == case, outcome[position]).otherwise(value)
        out = out.withColumn(field, value)
    return out.drop("_case")


def report_fields(df: DataFrame, status: str = "status") -> DataFrame:
    """Add report_status, manual_action_required and action_taken for a remediation status."""
    name = F.lower(F.col(status))
    columns = {}
    for position, field in enumerate(("report_status", "manual_action_required", "action_taken")):
        value = F.lit(None)
        for state, outcome in REPORT_STATUS.items():
            value = F.when(name == state, outcome[position]).otherwise(value)
        columns[field] = value
    return df.withColumns(columns)


def remediation_state(log: DataFrame) -> DataFrame:
    """Current state of every remediation run: status of its newest log entry, and whether it is still active."""
    state = log.groupBy("remediation_run_id").agg(
        F.max_by("status", "id").alias("status"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("entries"),
        F.max("created_at").alias("updated_at"),
    )
    return state.withColumn("is_active", F.col("status").isin(*ACTIVE_STATES))


def checked_transitions(log: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each log entry with the status before it and whether that change is allowed."""
    steps = ordering.previous_value(log, ["remediation_run_id"], "id", "status", "previous_status", buckets)
    allowed = F.lit(False)
    for before, after in TRANSITIONS.items():
        allowed = F.when(F.col("previous_status") == before, F.col("status").isin(*after)).otherwise(allowed)
    start = F.col("previous_status").isNull() | (F.col("previous_status") == F.col("status"))
    return steps.withColumn("allowed", start | allowed)
