"""Incidents: creation from drift and root causes, groups per run, reports, explanations and alert routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchwatch.functions import severity
from batchwatch.operators import remediation
from batchwatch.operators.signals import squeeze

ROOT_CAUSE = "ai_root_cause"
ALERT_LIMIT = 500
# Number of items quoted in texts.
GROUP_TYPES = 4
REPORT_FINDINGS = 12


def drift_incidents(findings: DataFrame) -> DataFrame:
    """One incident per high or critical drift finding."""
    concept = F.col("feature_name") == "prediction_output"
    # Wording of drift incidents.
    title = F.when(concept, "Concept Drift Detected: Prediction Output").otherwise(
        F.concat(F.lit("Data Drift Detected: "), F.col("feature_name"))
    )
    text = F.when(
        concept,
        F.format_string(
            "Model output distribution shifted significantly. Severity '%s'. PSI: %.3f, KS: %.3f",
            "severity", "psi_score", "ks_score"),
    ).otherwise(
        F.format_string(
            "Drift detected on feature '%s' with severity '%s'. PSI: %.3f, KS: %.3f",
            "feature_name", "severity", "psi_score", "ks_score")
    )
    return findings.filter(F.col("severity").isin("high", "critical")).select(
        "run_id", F.col("id").alias("finding_id"), title.alias("title"), text.alias("description"),
        F.when(concept, "concept_drift").otherwise("data_drift").alias("failure_type"),
        F.lit("drift").alias("finding_type"), "severity",
    )


def rca_incidents(existing: DataFrame, analysed: DataFrame) -> DataFrame:
    """Root-cause incident per run after new analyses: an existing one (lowest id) is updated, else one is created.

    Analyses without failure types open none. ``analysed``: run_id, failure_types, severity, summary.
    """
    kept = analysed.filter(F.size("failure_types") > 0).select(
        "run_id", F.col("severity").alias("_severity"), F.col("summary").alias("_summary"),
    )
    old = (
        existing.filter(F.col("failure_type") == ROOT_CAUSE)
        .groupBy("run_id")
        .agg(F.min("id").alias("id"), F.min_by("severity", "id").alias("_old_severity"),
             F.min_by("status", "id").alias("_old_status"))
    )
    merged = old.join(kept, "run_id", "full")
    return merged.select(
        "run_id", "id", F.coalesce("_severity", "_old_severity").alias("severity"),
        F.coalesce("_old_status", F.lit("open")).alias("status"), F.col("_summary").alias("summary"),
        F.when(F.col("id").isNull(), "create").when(F.col("_severity").isNull(), "keep").otherwise("update").alias("action"),
    )


def primary_order() -> Column:
    """Root-cause incidents first (latest wins), then severity, time, id."""
    is_rca = F.coalesce(F.col("failure_type") == ROOT_CAUSE, F.lit(False))
    return F.struct(
        is_rca.alias("a"), F.when(is_rca, -1).otherwise(severity.rank(F.col("severity"))).alias("b"),
        F.col("created_at").alias("c"), F.col("id").alias("d"),
    )


def primary_incident(incidents: DataFrame) -> DataFrame:
    """The incident that stands for its run."""
    rest = [c for c in incidents.columns if c != "run_id"]
    return incidents.groupBy("run_id").agg(F.max_by(F.struct(*rest), primary_order()).alias("_p")).select(
        "run_id", "_p.*"
    )


def representative_incident(incidents: DataFrame, primaries: DataFrame) -> DataFrame:
    """Per run the stored primary (run_id, primary_id) where it still exists, else the newest incident."""
    marked = incidents.join(primaries, "run_id", "left").withColumn(
        "is_primary", F.coalesce(F.col("id") == F.col("primary_id"), F.lit(False))
    )
    order = F.struct("is_primary", "created_at", "id")
    return marked.groupBy("run_id").agg(F.max_by(F.struct("id", "severity", "is_primary"), order).alias("_r")).select(
        "run_id", "_r.*"
    )


def json_text(payload: Column, *paths: str) -> Column:
    """First non-empty JSON field of a text that is a JSON object."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.{p}"), F.lit("")) for p in paths])


def is_json_object(c: Column) -> Column:
    return F.coalesce(F.trim(c).startswith("{") & F.get_json_object(c, "$").isNotNull(), F.lit(False))


def incident_groups(incidents: DataFrame) -> DataFrame:
    """One alert per run: primary incident, title, summary, worst severity and overall status."""
    kind = F.nullif(F.col("failure_type"), F.lit(""))
    state = F.nullif(F.col("status"), F.lit(""))
    per_run = incidents.groupBy("run_id").agg(
        F.max_by(F.struct("id", "title", "description", "failure_type"), primary_order()).alias("p"),
        severity.worst(F.col("severity")).alias("severity"),
        F.array_sort(F.collect_set(kind)).alias("_types"), F.array_sort(F.collect_set(state)).alias("_states"),
        F.count(F.lit(1)).alias("incident_count"),
    )
    run = F.col("run_id").cast("string")
    alert = F.concat(F.lit("Run "), run, F.lit(" monitoring alert"))
    text = F.nullif(F.col("p.description"), F.lit(""))
    plain = squeeze(
        F.coalesce(text, F.concat(F.col("incident_count").cast("string"), F.lit(" monitoring incident(s) detected.")))
    )
    signals = F.array_join(F.slice("_types", 1, GROUP_TYPES), ", ")
    status = (
        F.when(F.array_contains("_states", "open"), "open")
        .when(F.array_contains("_states", "investigating"), "investigating")
        .otherwise(F.coalesce(F.get("_states", F.lit(0)), F.lit("open")))
    )
    return per_run.select(
        "run_id", F.col("p.id").alias("primary_incident_id"),
        F.when(F.col("p.failure_type") == ROOT_CAUSE,
               F.coalesce(F.nullif(F.col("p.title"), F.lit("")), F.concat(F.lit("Run "), run, F.lit(" root cause alert"))))
        .otherwise(alert).alias("title"),
        F.when(is_json_object(text), F.coalesce(json_text(text, "summary", "recommendation"), text))
        .when(F.size("_types") > 0, F.concat(plain, F.lit(" Signals: "), signals, F.lit(".")))
        .otherwise(plain).alias("summary"),
        "severity", status.alias("status"), "incident_count",
    )


def incident_failure_types(incidents: DataFrame) -> DataFrame:
    """Failure types stored in the incident's JSON payload (own, then final report, then report), else its own type."""
    read = lambda path: F.from_json(F.get_json_object("description", path), "array<string>")
    stored = F.coalesce(read("$.failure_types"), read("$.final_report.failure_types"), read("$.report.failure_types"))
    own = F.array_compact(F.array(F.nullif(F.col("failure_type"), F.lit(""))))
    some = F.filter(stored, lambda v: v.isNotNull() & (v != ""))
    return incidents.withColumn("failure_types", F.when(F.size(F.coalesce(some, F.array().cast("array<string>"))) > 0, some).otherwise(own))


def final_reports(analysed: DataFrame, evidence: DataFrame) -> DataFrame:
    """Report status and texts per run from its remediation policy and first evidence.

    ``analysed``: run_id, severity, failure_types, summary. ``evidence``: run_id, place, title, severity.
    """
    ranked = evidence.withColumn(
        "_p", F.row_number().over(Window.partitionBy("run_id").orderBy("place"))
    ).filter(F.col("_p") <= 3)  # three quoted signals: the rank filter also runs before the shuffle
    snippet = F.concat(F.col("title"), F.lit(" ("), F.coalesce("severity", F.lit("unknown")), F.lit(")"))
    quoted = ranked.groupBy("run_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_p", snippet.alias("s")))), lambda x: x["s"]), ", "
        ).alias("_quoted")
    )
    decided = remediation.remediation_policy(analysed).join(quoted, "run_id", "left")
    manual, ask = F.col("manual_only"), F.col("requires_approval")
    # Report wording.
    return decided.select(
        "run_id", "severity", "failure_types", "action_type", "action_mode", "recommended_action", "requires_approval",
        F.when(manual, "manual_action_required").when(ask, "awaiting_approval").otherwise("report_ready")
        .alias("report_status"),
        F.when(manual, "No automated remediation was executed.")
        .when(ask, "Remediation was prepared but is waiting for human approval.")
        .otherwise("No automated remediation was executed in this flow.").alias("action_taken"),
        manual.alias("manual_action_required"), F.col("summary").alias("incident_summary"),
        F.coalesce(
            F.concat(F.lit("Primary evidence signals: "), F.col("_quoted"), F.lit(".")),
            F.lit("No structured evidence was stored for this incident."),
        ).alias("evidence_summary"),
    )


def incident_reports(reports: DataFrame, issues: DataFrame, runs: DataFrame, models: DataFrame) -> DataFrame:
    """Stored report content per run: context, risk, next actions, narrative, and up to 12 findings.

    ``reports``: output of :func:`final_reports`; ``issues``: run_id, issue, severity_rank, title, severity, summary.
    """
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("severity_rank"), "issue"))
    entry = F.struct("_p", "title", "severity", "summary")
    listed = (
        issues.withColumn("_p", place).filter(F.col("_p") <= REPORT_FINDINGS)
        .groupBy("run_id").agg(F.array_sort(F.collect_list(entry)).alias("_f"))
    )
    total = issues.groupBy("run_id").agg(F.count(F.lit(1)).alias("issue_count"))
    context = runs.select("run_id", "model_id", "baseline_version", F.col("status").alias("run_status")).join(
        models.select("model_id", F.col("name").alias("model_name"), F.col("version").alias("model_version")),
        "model_id", "left",
    )
    joined = (
        reports.join(context, "run_id", "left").join(listed, "run_id", "left").join(total, "run_id", "left")
    )
    grave = F.lower("severity").isin("critical", "high")
    # Report wording.
    actions = F.array_compact(
        F.array(
            F.col("recommended_action"),
            F.when(F.col("requires_approval"),
                   "Review the remediation approval console before creating or staging a candidate model."),
            F.when(F.col("manual_action_required"),
                   "Keep the incident open until the owner documents the manual investigation outcome."),
        )
    )
    narrative = F.concat(
        F.col("incident_summary"), F.lit("\n\nRoot cause analysis: "), F.col("incident_summary"),
        F.lit("\n\nCurrent severity is "), F.col("severity"), F.lit(". The remediation lifecycle status is "),
        F.col("report_status"), F.lit(". "),
        F.lit("Monitoring evidence stays the source of truth; the narrative only explains that evidence."),
        F.lit("\n\nRecommended next step: "), F.col("recommended_action"),
    )
    return joined.select(
        "run_id", "model_id", "model_name", "model_version", "baseline_version", "run_status", "severity",
        "report_status", "failure_types",
        F.when(grave, "production-impacting").otherwise("watch").alias("risk_level"),
        F.when(grave, "Do not promote or refresh production baselines until the evidence is reviewed.")
        .otherwise("Review the monitoring evidence and continue if the shift is expected.").alias("safety_posture"),
        actions.alias("next_actions"), narrative.alias("narrative"), "evidence_summary",
        F.coalesce(F.transform("_f", lambda f: f.dropFields("_p")),
                   F.array().cast("array<struct<title:string,severity:string,summary:string>>")).alias("findings"),
        F.coalesce("issue_count", F.lit(0)).cast("bigint").alias("raw_issue_count"),
    )


def evidence_hash(df: DataFrame, fields: list[str], out: str = "evidence_hash") -> DataFrame:
    """SHA-256 of the JSON of the fields in name order."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*sorted(fields))), 256))


# ---- explanations ----------------------------------------------------------------------------------------------


def _joined(names: str, count: int, empty: str) -> Column:
    return F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, count), ", ")).otherwise(empty)


def explain_quality(findings: DataFrame) -> DataFrame:
    """Summary, why it matters and what to do, per run with findings."""
    bad = ~F.col("success")
    per_run = findings.groupBy("run_id").agg(
        F.count_if(bad).alias("failed"),
        F.array_sort(F.collect_set(F.when(bad, F.col("check_type")))).alias("_types"),
        F.array_sort(F.collect_set(F.when(bad, F.col("column_name")))).alias("_columns"),
    )
    clean = F.col("failed") == 0
    has = lambda *names: F.arrays_overlap("_types", F.array(*[F.lit(n) for n in names]))
    # Explanation wording.
    summary = F.when(clean, "This run did not store any failed data quality checks.").otherwise(
        F.concat(F.lit("Run #"), F.col("run_id").cast("string"), F.lit(" failed stored "),
                 _joined("_types", 3, "data quality"), F.lit(" checks affecting "),
                 _joined("_columns", 4, "the incoming dataset"), F.lit("."))
    )
    why = (
        F.when(clean, "The current batch passed the stored validation checks, so there is no quality risk that needs explanation for this run.")
        .when(has("missing_columns", "schema_type_mismatch"),
              "These failures can break feature compatibility with the active model or downstream pipeline, so predictions may become unreliable even if the upload technically succeeds.")
        .when(has("range", "categorical"),
              "These failures suggest the current batch no longer matches the baseline profile, which can degrade model behavior or hide upstream source changes.")
        .otherwise("These failed checks indicate that the incoming batch differs from the validated baseline contract and should be reviewed before treating the run as trustworthy.")
    )
    action = (
        F.when(clean, "No action is required. Keep monitoring future runs and only investigate if new failed checks appear.")
        .when(F.size("_columns") > 0, F.concat(
            F.lit("Review the affected columns first ("), _joined("_columns", 5, ""),
            F.lit("), inspect a few failing rows, and decide whether the source data is malformed or the baseline needs to be refreshed.")))
        .otherwise("Inspect the failing run-level checks, compare the incoming file with the active baseline, and only update the baseline if the upstream change is expected.")
    )
    return per_run.select("run_id", "failed", summary.alias("summary"), why.alias("why"), action.alias("action"))


def explain_drift(findings: DataFrame) -> DataFrame:
    """Summary, interpretation and strongest movements, per run with drift findings."""
    hit = F.col("drift_detected")
    per_run = findings.groupBy("run_id").agg(
        F.count_if(hit).alias("drifted"),
        F.array_sort(F.collect_set(F.when(hit, F.col("feature_name")))).alias("_features"),
        F.bool_or(hit & F.lower("severity").isin("high", "critical")).alias("_severe"),
    )
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("drift_score"), "id"))
    part = F.format_string("%s (score %.3f, PSI %.3f)", "feature_name", "drift_score", "psi_score")
    top = (
        findings.filter(hit).withColumn("_p", place).filter(F.col("_p") <= 3)
        .groupBy("run_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", part.alias("s")))), lambda x: x["s"]), ", ").alias("_top"))
    )
    none = F.col("drifted") == 0
    # Explanation wording.
    summary = F.when(none, "This run did not store any active drift signals.").otherwise(
        F.concat(F.lit("Run #"), F.col("run_id").cast("string"), F.lit(" stored active drift signals for "),
                 _joined("_features", 4, "multiple features"), F.lit("."))
    )
    meaning = (
        F.when(none, "The monitored feature distributions are currently close to the baseline, so this run does not show a meaningful population shift.")
        .when(F.col("_severe"), "The batch appears to come from a meaningfully different population than the baseline, which can happen after source changes, seasonality, traffic mix changes, or stale reference data.")
        .otherwise("The batch shows measurable distribution change versus baseline, but the signal should still be interpreted alongside source context and recent business changes.")
    )
    change = F.when(
        none,
        "No material distribution change was stored for this run. Continue monitoring future runs for emerging drift trends.",
    ).otherwise(
        F.concat(F.lit("Compared with the baseline, the strongest movement was observed in "), F.col("_top"),
                 F.lit(". Review whether the batch source, population, or time window changed."))
    )
    return per_run.join(top, "run_id", "left").select(
        "run_id", "drifted", summary.alias("summary"), meaning.alias("interpretation"), change.alias("change")
    )


# ---- alerts ----------------------------------------------------------------------------------------------------


def alert_text(description: Column) -> Column:
    """Text of an alert: the JSON summary or recommendation, else the raw text; squeezed, at most 500 characters."""
    raw = F.coalesce(description, F.lit(""))
    text = squeeze(F.when(is_json_object(raw), F.coalesce(json_text(raw, "summary", "recommendation"), raw)).otherwise(raw))
    return F.when(F.length(text) > ALERT_LIMIT, F.concat(F.left(text, F.lit(ALERT_LIMIT - 3)), F.lit("..."))).otherwise(text)


def alert_routes(incidents: DataFrame, runs: DataFrame, models: DataFrame) -> DataFrame:
    """Incident -> tenant that must be told (one row per incident)."""
    owner = runs.select("run_id", "model_id").join(models.select("model_id", "tenant_id"), "model_id")
    return incidents.select("id", "run_id", "severity", "created_at").join(owner, "run_id")


def alert_recipients(routes: DataFrame, users: DataFrame) -> DataFrame:
    """Verified recipients with an address and what waits for each of them.

    Alerts are summed per tenant before they meet the users, so the work is routes + users, never their product.
    """
    waiting = routes.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.max("created_at").alias("latest_alert_at"),
        severity.worst(F.col("severity")).alias("worst_severity"),
    )
    reachable = users.filter(F.col("is_verified") & F.col("email").isNotNull() & (F.col("email") != ""))
    return reachable.select("tenant_id", "user_id", "email").join(waiting, "tenant_id")
