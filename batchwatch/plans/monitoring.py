"""Queries for joins, paging, search, roll-ups and remediation state."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchwatch.operators import lookups, remediation, rollups
from batchwatch.plans.registry import query
from batchwatch.plans.sqltext import level, rank
from batchwatch.plans.views import view, with_views

TENANT = "tenant_3"


def _views(spark, sf_dir, *names):
    return [view(spark, sf_dir, n) for n in names]


# ---- joins and scoping -----------------------------------------------------------------------------------------


@query("findings_by_model", with_views("""SELECT f.id, f.run_id, f.feature_name, r.model_id, m.tenant_id, m.name AS model_name
  FROM drift_findings f JOIN pipeline_runs r ON f.run_id = r.run_id JOIN ml_models m ON r.model_id = m.model_id"""))
def findings_by_model(spark, sf_dir):
    found = lookups.findings_by_model(*_views(spark, sf_dir, "drift_findings", "pipeline_runs", "ml_models"))
    return found.select("id", "run_id", "feature_name", "model_id", "tenant_id", "model_name")


@query("runs_for_tenant", with_views(f"""SELECT run_id, model_id, status FROM pipeline_runs WHERE model_id IN (SELECT model_id FROM ml_models WHERE tenant_id = '{TENANT}')"""))
def runs_for_tenant(spark, sf_dir):
    found = lookups.runs_for_tenant(*_views(spark, sf_dir, "pipeline_runs", "ml_models"), TENANT)
    return found.select("run_id", "model_id", "status")


@query("tenant_scope", with_views("SELECT r.run_id, r.model_id, r.status, m.tenant_id FROM pipeline_runs r JOIN ml_models m ON r.model_id = m.model_id"))
def tenant_scope(spark, sf_dir):
    found = lookups.tenant_scope(*_views(spark, sf_dir, "pipeline_runs", "ml_models"))
    return found.select("run_id", "model_id", "status", "tenant_id")


_ANALYSES = """SELECT run_id, CASE WHEN max(seq) % 3 = 0 THEN 'failed' WHEN max(seq) % 3 = 1 THEN 'completed' ELSE 'running' END AS status
  FROM agent_steps GROUP BY run_id UNION ALL SELECT run_id, 'completed' AS status FROM pipeline_runs WHERE model_id % 2 = 0"""


@query("runs_to_analyze", with_views(f"""SELECT tenant_id, run_id, model_id FROM (SELECT r.run_id, r.model_id, m.tenant_id, row_number() OVER (PARTITION BY tenant_id
    ORDER BY created_at DESC, run_id DESC) AS p FROM pipeline_runs r JOIN ml_models m ON r.model_id = m.model_id) WHERE p = 1
  AND run_id NOT IN (SELECT run_id FROM ({_ANALYSES}) WHERE status IN ('running', 'completed'))"""))
def runs_to_analyze(spark, sf_dir):
    for name in ("agent_steps", "pipeline_runs"):
        view(spark, sf_dir, name).createOrReplaceTempView(name)
    found = lookups.runs_to_analyze(*_views(spark, sf_dir, "pipeline_runs", "ml_models"), spark.sql(_ANALYSES))
    return found.select("tenant_id", "run_id", "model_id")


@query("incident_details", with_views("""SELECT i.id, i.run_id, i.finding_type, f.feature_name, round(f.drift_score, 6) AS drift_score
  FROM incidents i LEFT JOIN drift_findings f ON i.finding_type = 'drift' AND i.finding_id = f.id"""))
def incident_details(spark, sf_dir):
    found = lookups.incident_details(*_views(spark, sf_dir, "incidents", "drift_findings"))
    return found.select("id", "run_id", "finding_type", "feature_name", F.round("drift_score", 6).alias("drift_score"))


@query("incident_delta", with_views("""WITH joined AS (SELECT i.run_id, i.severity, i.status = 'resolved' AS now_done, b.was FROM incidents i
    LEFT JOIN (SELECT id, CASE WHEN id % 5 = 0 THEN status <> 'resolved' ELSE status = 'resolved' END AS was FROM incidents WHERE created_at < TIMESTAMP '2024-01-15 00:00:00') b ON i.id = b.id)
  SELECT run_id, count(*) FILTER (NOT now_done AND coalesce(was, true)) AS new_open, count(*) FILTER (NOT now_done AND coalesce(was, true) AND severity = 'critical') AS new_critical,
    count(*) FILTER (now_done AND NOT coalesce(was, true)) AS newly_resolved FROM joined GROUP BY run_id HAVING new_open > 0 OR newly_resolved > 0"""))
def incident_delta(spark, sf_dir):
    """Snapshot of 15 January against now; every fifth incident had the opposite state then."""
    after = view(spark, sf_dir, "incidents")
    flipped = F.when(F.col("status") == "resolved", "open").otherwise("resolved")
    before = after.filter(F.col("created_at") < F.lit("2024-01-15").cast("timestamp_ntz")).withColumn(
        "status", F.when(F.col("id") % 5 == 0, flipped).otherwise(F.col("status"))
    )
    return lookups.incident_delta(before, after)


@query("run_context", with_views("""SELECT r.run_id, r.model_id, r.status, coalesce(d.n, 0) AS drift_count, round(d.s, 6) AS max_drift_score, coalesce(q.n, 0) AS quality_count,
    coalesce(q.bad, 0) AS failed_count, coalesce(c.n, 0) AS schema_change_count FROM pipeline_runs r
  LEFT JOIN (SELECT run_id, count(*) AS n, max(drift_score) AS s FROM drift_findings GROUP BY run_id) d ON r.run_id = d.run_id
  LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (NOT success) AS bad FROM dq_findings GROUP BY run_id) q ON r.run_id = q.run_id
  LEFT JOIN (SELECT run_id, count(*) AS n FROM schema_events GROUP BY run_id) c ON r.run_id = c.run_id"""))
def run_context(spark, sf_dir):
    found = lookups.run_context(*_views(spark, sf_dir, "pipeline_runs", "drift_findings", "dq_findings", "schema_events"))
    return found.withColumn("max_drift_score", F.round("max_drift_score", 6))


@query("filter_findings", with_views("SELECT id, run_id, feature_name FROM drift_findings WHERE severity = 'high' AND feature_name = 'price'"))
def filter_findings(spark, sf_dir):
    found = lookups.filter_findings(view(spark, sf_dir, "drift_findings"), severity="high", feature_name="price", run_id=None)
    return found.select("id", "run_id", "feature_name")


@query("search_incidents", with_views("""SELECT id, run_id, failure_type FROM incidents
  WHERE lower(concat_ws(' ', title, description, failure_type, severity, status, CAST(run_id AS STRING))) LIKE '%feature f3%'"""))
def search_incidents(spark, sf_dir):
    found = lookups.search(
        view(spark, sf_dir, "incidents"), ["title", "description", "failure_type", "severity", "status", "run_id"], " Feature F3 "
    )
    return found.select("id", "run_id", "failure_type")


@query("page_findings", with_views("""SELECT id, run_id, feature_name FROM drift_findings
  WHERE run_id IN (SELECT DISTINCT run_id FROM drift_findings ORDER BY run_id DESC LIMIT 20 OFFSET 10)"""))
def page_findings(spark, sf_dir):
    return lookups.page_of_runs(view(spark, sf_dir, "drift_findings"), 10, 20).select("id", "run_id", "feature_name")


@query("page_runs", with_views("SELECT run_id, model_id, status FROM pipeline_runs ORDER BY run_id LIMIT 15 OFFSET 10"))
def page_runs(spark, sf_dir):
    runs = view(spark, sf_dir, "pipeline_runs").select("run_id", "model_id", "status")
    return lookups.page(runs, [F.asc("run_id")], 10, 15)


@query("step_timeline", with_views("SELECT run_id, step_index, max(seq) AS seq, arg_max(status, seq) AS status, count(*) AS updates FROM agent_steps GROUP BY run_id, step_index"))
def step_timeline(spark, sf_dir):
    return lookups.step_timeline(view(spark, sf_dir, "agent_steps"))


# ---- roll-ups --------------------------------------------------------------------------------------------------


@query("dq_stats", with_views("""SELECT model_id, count(*) FILTER (success) AS passed, count(*) FILTER (NOT success) AS failed, count(DISTINCT f.run_id) AS runs
  FROM dq_findings f JOIN pipeline_runs r ON f.run_id = r.run_id GROUP BY model_id"""))
def dq_stats(spark, sf_dir):
    runs = view(spark, sf_dir, "pipeline_runs").select("run_id", "model_id")
    return rollups.dq_stats(view(spark, sf_dir, "dq_findings").join(runs, "run_id"), ["model_id"])


@query("drift_stats", with_views("""SELECT count(*) AS total, count(*) FILTER (drift_detected) AS detected, round(avg(drift_score), 6) AS average_score,
  count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'critical') AS critical FROM drift_findings"""))
def drift_stats(spark, sf_dir):
    return rollups.drift_stats(view(spark, sf_dir, "drift_findings")).withColumn("average_score", F.round("average_score", 6))


@query("incident_stats", with_views("""WITH g AS (SELECT run_id, bool_and(status = 'resolved') AS done, max(%s) AS worst FROM incidents GROUP BY run_id)
  SELECT count(*) AS total, count(*) FILTER (NOT done) AS open, count(*) FILTER (done) AS resolved, count(*) FILTER (worst = 3) AS critical FROM g""" % rank("severity")))
def incident_stats(spark, sf_dir):
    from batchwatch.operators.incidents import incident_groups

    return rollups.incident_stats(incident_groups(view(spark, sf_dir, "incidents")))


@query("workspace_stats", with_views("""SELECT m.tenant_id, count(DISTINCT m.model_id) AS models, count(DISTINCT r.run_id) AS runs, count(DISTINCT i.id) AS open_incidents FROM ml_models m
  LEFT JOIN pipeline_runs r ON m.model_id = r.model_id LEFT JOIN incidents i ON r.run_id = i.run_id AND i.status = 'open' GROUP BY m.tenant_id"""))
def workspace_stats(spark, sf_dir):
    return rollups.workspace_stats(*_views(spark, sf_dir, "ml_models", "pipeline_runs", "incidents"))


@query("model_stats", with_views("SELECT count(*) AS models, count(version) AS registered_versions, count(DISTINCT framework) AS frameworks FROM ml_models"))
def model_stats(spark, sf_dir):
    return rollups.model_stats(view(spark, sf_dir, "ml_models"))


@query("tenant_table_counts", with_views("""SELECT tenant_id, count(*) AS row_count, 'ml_models' AS table_name FROM ml_models GROUP BY tenant_id
  UNION ALL SELECT tenant_id, count(*), 'users' FROM users GROUP BY tenant_id
  UNION ALL SELECT m.tenant_id, count(*), 'pipeline_runs' FROM pipeline_runs r JOIN ml_models m ON r.model_id = m.model_id GROUP BY m.tenant_id"""))
def tenant_table_counts(spark, sf_dir):
    models, users, runs = _views(spark, sf_dir, "ml_models", "users", "pipeline_runs")
    return rollups.tenant_table_counts(
        {"ml_models": models, "users": users, "pipeline_runs": lookups.tenant_scope(runs, models)}
    )


@query("dq_by_run", with_views("SELECT run_id, count(*) FILTER (success) AS passed, count(*) FILTER (NOT success) AS failed, max(created_at) AS latest_at FROM dq_findings GROUP BY run_id"))
def dq_by_run(spark, sf_dir):
    return rollups.dq_by_run(view(spark, sf_dir, "dq_findings"))


@query("drift_by_run", with_views(f"""SELECT run_id, findings, drifted, round(max_score, 6) AS max_score, {level('worst')} AS severity, latest_at FROM (SELECT run_id, count(*) AS findings,
  count(*) FILTER (drift_detected) AS drifted, greatest(0.0, max(drift_score)) AS max_score, max({rank('severity')}) AS worst, max(created_at) AS latest_at FROM drift_findings GROUP BY run_id)"""))
def drift_by_run(spark, sf_dir):
    return rollups.drift_by_run(view(spark, sf_dir, "drift_findings")).withColumn("max_score", F.round("max_score", 6))


@query("incidents_by_run", with_views(f"""SELECT run_id, open, resolved, {level('worst')} AS severity, latest_at FROM (SELECT run_id, count(*) FILTER (status <> 'resolved') AS open,
  count(*) FILTER (status = 'resolved') AS resolved, max({rank('severity')}) AS worst, max(created_at) AS latest_at FROM incidents GROUP BY run_id)"""))
def incidents_by_run(spark, sf_dir):
    return rollups.incidents_by_run(view(spark, sf_dir, "incidents"))


@query("dq_issue_groups", with_views("""SELECT run_id, check_type, count(*) AS findings, coalesce(string_agg(DISTINCT column_name, ',' ORDER BY column_name), '') AS columns,
  CASE WHEN check_type IN ('schema_type_mismatch', 'missing_columns') THEN 'high' ELSE 'medium' END AS severity FROM dq_findings WHERE NOT success GROUP BY run_id, check_type"""))
def dq_issue_groups(spark, sf_dir):
    return rollups.dq_issue_groups(view(spark, sf_dir, "dq_findings")).withColumn("columns", F.array_join("columns", ","))


@query("drift_run_summary", with_views("""SELECT run_id, count(*) FILTER (drift_detected) AS drifted, count(*) FILTER (NOT drift_detected) AS stable,
  arg_max(feature_name, (drift_score, feature_name)) FILTER (drift_detected) AS strongest_feature, round(max(drift_score) FILTER (drift_detected), 6) AS strongest_score
  FROM drift_findings GROUP BY run_id"""))
def drift_run_summary(spark, sf_dir):
    found = rollups.drift_run_summary(view(spark, sf_dir, "drift_findings"))
    return found.withColumn("strongest_score", F.round("strongest_score", 6))


@query("top_drift_features", with_views("""SELECT run_id, feature_name, place FROM (SELECT run_id, feature_name, row_number() OVER (PARTITION BY run_id
  ORDER BY drift_score DESC, feature_name) AS place FROM drift_findings WHERE drift_detected) WHERE place <= 3"""))
def top_drift_features(spark, sf_dir):
    found = rollups.top_drift_features(view(spark, sf_dir, "drift_findings"))
    return found.select("run_id", "feature_name", F.col("place").cast("bigint").alias("place"))


_MATRIX = ("f4", "f5", "f6", "f7", "prediction_output", "price", "quantity")


@query("drift_matrix", with_views("SELECT run_id, " + ", ".join(
    f"round(max(drift_score) FILTER (feature_name = '{f}'), 6) AS {f}" for f in _MATRIX) + """ FROM drift_findings
  WHERE run_id IN (SELECT DISTINCT run_id FROM drift_findings ORDER BY run_id DESC LIMIT 8) GROUP BY run_id"""))
def drift_matrix(spark, sf_dir):
    findings = view(spark, sf_dir, "drift_findings")
    features = rollups.matrix_features(findings)
    return rollups.drift_matrix(findings, features).withColumns({f: F.round(f, 6) for f in features})


@query("severity_distribution", with_views("SELECT severity, count(*) AS findings, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM drift_findings GROUP BY severity"))
def severity_distribution(spark, sf_dir):
    return rollups.severity_distribution(view(spark, sf_dir, "drift_findings")).withColumn("share", F.round("share", 6))


@query("failure_types_by_run", with_views("""SELECT run_id, array_to_string(k[:3], ',') AS failure_types, greatest(len(k) - 3, 0) AS more
  FROM (SELECT run_id, list_sort(list(DISTINCT failure_type)) AS k FROM incidents GROUP BY run_id)"""))
def failure_types_by_run(spark, sf_dir):
    return rollups.failure_types_by_run(view(spark, sf_dir, "incidents")).withColumn("failure_types", F.array_join("failure_types", ","))


# ---- remediation -----------------------------------------------------------------------------------------------


@query("remediation_state", with_views("""SELECT remediation_run_id, arg_max(status, id) AS status, max(id) AS last_id, count(*) AS entries, max(created_at) AS updated_at,
  arg_max(status, id) IN ('approved', 'queued', 'running', 'cancel_requested', 'pending_promotion', 'staged') AS is_active FROM action_log GROUP BY remediation_run_id"""))
def remediation_state(spark, sf_dir):
    return remediation.remediation_state(view(spark, sf_dir, "action_log"))


@query("remediation_transitions", with_views("""SELECT id, remediation_run_id, previous_status, status, previous_status IS NULL OR previous_status = status
    OR (previous_status = 'queued' AND status IN ('running', 'blocked', 'rejected'))
    OR (previous_status = 'running' AND status IN ('pending_promotion', 'cancel_requested', 'canceled', 'failed'))
    OR (previous_status = 'pending_promotion' AND status IN ('staged', 'promotion_rejected'))
    OR (previous_status = 'staged' AND status IN ('deployed', 'promotion_rejected')) AS allowed
  FROM (SELECT *, lag(status) OVER (PARTITION BY remediation_run_id ORDER BY id) AS previous_status FROM action_log)"""))
def remediation_transitions(spark, sf_dir):
    found = remediation.checked_transitions(view(spark, sf_dir, "action_log"))
    return found.select("id", "remediation_run_id", "previous_status", "status", "allowed")


@query("remediation_report_status", with_views("""SELECT remediation_run_id, status, CASE status WHEN 'queued' THEN 'queued_for_execution' WHEN 'running' THEN 'remediation_running'
    WHEN 'pending_promotion' THEN 'candidate_ready_for_review' WHEN 'staged' THEN 'candidate_staged_for_deployment' ELSE 'remediation_failed' END AS report_status,
  true AS manual_action_required FROM (SELECT remediation_run_id, arg_max(status, id) AS status FROM action_log GROUP BY 1)"""))
def remediation_report_status(spark, sf_dir):
    state = remediation.remediation_state(view(spark, sf_dir, "action_log"))
    return remediation.report_fields(state).select("remediation_run_id", "status", "report_status", "manual_action_required")
