"""Queries for signals, incidents, reports, explanations and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchwatch.operators import incidents, remediation, signals
from batchwatch.plans.registry import query
from batchwatch.plans.sqltext import level, rank
from batchwatch.plans.views import view, with_views

# ---- signals ---------------------------------------------------------------------------------------------------

_SIGNALS = """sig AS (
    SELECT run_id, 'data_quality' AS source, check_type AS type, column_name, CASE WHEN check_type IN ('missing_columns', 'schema_type_mismatch') THEN 'high'
      WHEN check_type IN ('extra_columns', 'range', 'categorical') THEN 'medium' ELSE 'low' END AS severity, CAST(NULL AS DOUBLE) AS drift_score,
      observed_min, observed_max, ratio, unseen, CAST(NULL AS DOUBLE) AS psi_score, CAST(NULL AS DOUBLE) AS ks_score, CASE WHEN column_name IS NOT NULL THEN [column_name] END AS columns FROM dq_findings WHERE NOT success
    UNION ALL SELECT run_id, 'drift', CASE WHEN feature_name = 'prediction_output' THEN 'concept_drift' ELSE 'data_drift' END, feature_name, severity, drift_score,
      NULL, NULL, NULL, NULL, psi_score, ks_score, [feature_name] FROM drift_findings WHERE drift_detected
    UNION ALL SELECT run_id, 'schema', CASE WHEN change_type = 'new_column' THEN 'extra_columns' ELSE 'missing_columns' END, NULL,
      CASE WHEN change_type = 'new_column' THEN 'medium' ELSE 'high' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, list_sort(list(DISTINCT column_name)) FROM schema_events WHERE status = 'pending'
      GROUP BY run_id, change_type)"""


def _quality(spark, sf_dir):
    return view(spark, sf_dir, "dq_findings").withColumns(
        {"baseline_min": F.lit(5.0), "baseline_max": F.lit(45.0), "threshold": F.lit(0.3)}
    )


def _signals(spark, sf_dir):
    changes = view(spark, sf_dir, "schema_events").filter("status = 'pending'")
    return signals.build_signals(_quality(spark, sf_dir), view(spark, sf_dir, "drift_findings"), changes)


@query("signals", with_views(f"WITH {_SIGNALS} SELECT run_id, source, type, column_name, severity, round(drift_score, 6) AS drift_score, coalesce(array_to_string(columns, ', '), '') AS columns FROM sig"))
def all_signals(spark, sf_dir):
    found = _signals(spark, sf_dir)
    return found.select("run_id", "source", "type", "column_name", "severity", F.round("drift_score", 6).alias("drift_score"),
                        F.coalesce(F.array_join("columns", ", "), F.lit("")).alias("columns"))


@query("signal_descriptions", with_views(f"""WITH {_SIGNALS}, named AS (SELECT *, coalesce(column_name, CASE WHEN source = 'drift' THEN 'prediction output' ELSE 'dataset' END) AS c FROM sig)
  SELECT run_id, type, column_name, CASE WHEN source = 'schema' AND type = 'extra_columns' THEN 'New columns appeared in the incoming dataset'
    WHEN source = 'schema' THEN 'Required baseline columns are missing' WHEN type = 'concept_drift' THEN 'Prediction output distribution changed'
    WHEN type = 'data_drift' THEN concat(c, ' distribution drifted') WHEN type = 'range' THEN concat(c, ' is outside the baseline range')
    WHEN type = 'categorical' THEN concat(c, ' contains unseen categories') WHEN type = 'null_ratio' THEN concat(c, ' has too many missing values')
    WHEN type = 'schema_type_mismatch' THEN concat(c, ' has an incompatible type') ELSE concat(c, ' failed ', type) END AS title,
  CASE WHEN source = 'schema' AND type = 'extra_columns' THEN 'The file contains columns that are not part of the active baseline schema.'
    WHEN source = 'schema' THEN 'The model or downstream pipeline may not receive features it expects.'
    WHEN type = 'concept_drift' THEN concat('Concept drift signal on ', c, '; PSI=', coalesce(printf('%.4f', psi_score), 'None'), ', KS=', coalesce(printf('%.4f', ks_score), 'None'), '.')
    WHEN type = 'data_drift' THEN concat('Current distribution differs from baseline; PSI=', coalesce(printf('%.4f', psi_score), 'None'), ', KS=', coalesce(printf('%.4f', ks_score), 'None'), '.')
    WHEN type = 'range' THEN concat('Observed range ', observed_min, '-', observed_max, ' versus baseline 5.0-45.0.')
    WHEN type = 'categorical' THEN concat('Unseen values: ', unseen, '.') WHEN type = 'null_ratio' THEN concat('Missing ratio ', ratio, ' exceeded threshold 0.3.')
    WHEN type = 'schema_type_mismatch' THEN 'The incoming type differs from the baseline.' ELSE 'A data quality check failed.' END AS explanation,
  CASE WHEN source = 'schema' AND type = 'extra_columns' THEN 'A producer added fields, or the wrong file version was uploaded.'
    WHEN source = 'schema' THEN 'A producer removed or renamed fields, or the wrong export was uploaded.'
    WHEN type = 'range' THEN 'Outliers, unit changes, mixed populations, or stale baseline limits.'
    WHEN type = 'categorical' THEN 'New business values appeared, or upstream normalization changed.'
    WHEN type = 'null_ratio' THEN 'Incomplete extraction, broken join, or source field not populated.'
    WHEN type = 'schema_type_mismatch' THEN 'Invalid tokens, formatting change, or a source contract change.'
    WHEN type = 'concept_drift' THEN 'Model behavior shifted because input mix changed or the model/data path changed.'
    WHEN type = 'data_drift' THEN 'Population mix, seasonality, upstream source changes, or stale baseline data.'
    ELSE 'The incoming batch differs from the active baseline.' END AS likely_cause,
  CASE WHEN source = 'schema' AND type = 'extra_columns' THEN 'Approve the schema change only if these columns are expected; otherwise ask the upstream producer to restore the contract.'
    WHEN source = 'schema' THEN 'Block prediction until the missing columns are restored or a new model/baseline is approved.'
    WHEN type = 'range' THEN 'Inspect rows above/below the baseline limits and decide whether to fix data or refresh the baseline.'
    WHEN type = 'categorical' THEN 'Validate the new category values, then update mappings or baseline if they are expected.'
    WHEN type = 'null_ratio' THEN 'Check upstream completeness before trusting imputed values.'
    WHEN type = 'schema_type_mismatch' THEN 'Inspect raw values that could not be coerced and fix them upstream.'
    WHEN type = 'concept_drift' THEN 'Compare predictions with labels and review model performance before retraining.'
    WHEN type = 'data_drift' THEN 'Compare current batch sampling window/source with baseline and refresh baseline only if this shift is expected.'
    ELSE 'Inspect the affected rows and compare against the source contract.' END AS recommended_action FROM named"""))
def signal_descriptions(spark, sf_dir):
    """Drift scores are shown with four digits here, as engines print unrounded floats differently."""
    found = signals.describe(_signals(spark, sf_dir), digits=4)
    return found.select("run_id", "type", "column_name", "title", "explanation", "likely_cause", "recommended_action")


_ISSUE = """CASE type WHEN 'null_ratio' THEN 'null_spike' WHEN 'range' THEN 'range_violation' WHEN 'categorical' THEN 'categorical_shift' ELSE type END"""
_ISSUES = f"""iss AS (SELECT run_id, {_ISSUE} AS issue, max({rank('severity')}) AS severity_rank, array_to_string(list_sort(list_distinct(flatten(list(columns) FILTER (columns IS NOT NULL)))), ', ') AS cols,
    array_to_string(list_sort(list_distinct(flatten(list(columns) FILTER (columns IS NOT NULL))))[:3], ', ') AS cols3,
    count(*) AS n, max(coalesce(drift_score, 0.0)) AS top, list_sort(list(DISTINCT unseen) FILTER (unseen IS NOT NULL))[:8] AS unseen8 FROM sig GROUP BY run_id, issue),
  issues AS (SELECT *, coalesce(nullif(cols, ''), 'the dataset') AS c, {level('severity_rank')} AS severity FROM iss),
  issue_texts AS (SELECT run_id, issue, severity_rank, severity, n AS evidence_count, coalesce(cols, '') AS affected_columns,
    concat(CASE issue WHEN 'schema_type_mismatch' THEN 'Column types do not match the baseline' WHEN 'extra_columns' THEN 'Unexpected columns were added'
      WHEN 'missing_columns' THEN 'Required columns are missing' WHEN 'null_spike' THEN 'Missing values exceeded the quality threshold'
      WHEN 'range_violation' THEN 'Numeric values moved outside the baseline range' WHEN 'categorical_shift' THEN 'New categorical values appeared'
      WHEN 'data_drift' THEN 'Feature distributions drifted from the baseline' WHEN 'concept_drift' THEN 'Model output distribution drifted' END,
      CASE WHEN coalesce(cols3, '') <> '' THEN concat(': ', cols3) ELSE '' END) AS title,
    CASE issue WHEN 'range_violation' THEN concat(n, ' numeric range check(s) failed for ', c, '.') WHEN 'categorical_shift' THEN concat('Observed unseen category value(s) [''',
      array_to_string(unseen8, ''', '''), '''] in ', c, '.') WHEN 'null_spike' THEN concat('Missing-value ratio exceeded the configured threshold for ', c, '.')
      WHEN 'schema_type_mismatch' THEN concat('Incoming data types are incompatible with the active baseline for ', c, '.')
      WHEN 'data_drift' THEN concat('Distribution drift was detected for ', c, '; max drift score is ', printf('%.3f', top), '.')
      WHEN 'concept_drift' THEN 'Prediction output distribution changed compared with the reference behavior.'
      WHEN 'extra_columns' THEN concat('The incoming file includes new column(s): ', c, '.') WHEN 'missing_columns' THEN concat('The incoming file is missing required column(s): ', c, '.') END AS summary FROM issues)"""


@query("issue_findings", with_views(f"WITH {_SIGNALS}, {_ISSUES} SELECT run_id, issue, severity, evidence_count, affected_columns, title, summary FROM issue_texts"))
def issue_findings(spark, sf_dir):
    found = signals.issue_findings(_signals(spark, sf_dir))
    return found.select("run_id", "issue", "severity", "evidence_count",
                        F.array_join("affected_columns", ", ").alias("affected_columns"), "title", "summary")


_FAILURE = f"""CASE {_ISSUE} WHEN 'data_drift' THEN 'DATA_DRIFT' WHEN 'concept_drift' THEN 'CONCEPT_DRIFT' WHEN 'schema_type_mismatch' THEN 'SCHEMA_MISMATCH'
  WHEN 'missing_columns' THEN 'MISSING_COLUMNS' WHEN 'extra_columns' THEN 'EXTRA_COLUMNS' WHEN 'null_spike' THEN 'NULL_SPIKE'
  WHEN 'range_violation' THEN 'RANGE_VIOLATION' WHEN 'categorical_shift' THEN 'CATEGORICAL_SHIFT' ELSE 'DATA_QUALITY' END"""
_RCA = f"""per AS (SELECT run_id, list_sort(list(DISTINCT {_FAILURE})) AS kinds, max({rank('severity')}) AS worst, count(*) AS n FROM sig GROUP BY run_id),
  rca AS (SELECT r.run_id, r.model_id, coalesce(array_to_string(kinds, ','), '') AS failure_types, {level('coalesce(worst, 0)')} AS severity, coalesce(n, 0) AS signal_count,
    CASE WHEN n IS NULL THEN 'No failed detection signals required RCA reporting.' ELSE concat('Detected ', n, ' pipeline risk signal(s): ', array_to_string(kinds, ', '), '.') END AS summary,
    n IS NOT NULL AS opens_incident, kinds FROM pipeline_runs r LEFT JOIN per p ON r.run_id = p.run_id)"""


def _rca(spark, sf_dir):
    return signals.run_rca(view(spark, sf_dir, "pipeline_runs"), _signals(spark, sf_dir))


@query("run_rca", with_views(f"WITH {_SIGNALS}, {_RCA} SELECT run_id, model_id, failure_types, severity, signal_count, summary, opens_incident FROM rca"))
def run_rca(spark, sf_dir):
    return _rca(spark, sf_dir).drop("recommendation").withColumn("failure_types", F.array_join("failure_types", ","))


# ---- text rules ------------------------------------------------------------------------------------------------


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


# Fixed values, written out here so that the operator's own table is checked.
_TEXT_WORDS = {
    "DATA_DRIFT": ("data_drift", "data drift", "psi", "population stability", "feature drift"),
    "CONCEPT_DRIFT": ("concept_drift", "concept drift", "prediction_output", "prediction output", "model output"),
    "SCHEMA_MISMATCH": ("schema_type_mismatch", "type mismatch", "expected", "got"),
    "MISSING_COLUMNS": ("missing_columns", "missing columns", "missing column"),
    "EXTRA_COLUMNS": ("extra_columns", "extra columns", "new columns"),
    "NULL_SPIKE": ("null_ratio", "null spike", "missing data"),
    "RANGE_VIOLATION": ("range", "outside", "out of range"),
    "CATEGORICAL_SHIFT": ("categorical", "unseen"),
}
_TEXT_TYPES = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {_has(*words)} THEN '{name}' END" for name, words in _TEXT_WORDS.items()
) + ")"
_TEXT_FALLBACK = """CASE WHEN contains(regexp_replace(lower(text), '"\\w+":', '', 'g'), 'fail') OR contains(regexp_replace(lower(text), '"\\w+":', '', 'g'), 'quality') THEN 'DATA_QUALITY' ELSE '' END"""
_TEXT_SEVERITY = "CASE " + " ".join(f"WHEN {_has(s)} THEN '{s}'" for s in ("critical", "high", "medium", "low")) + " ELSE 'medium' END"
_SQUEEZED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_SENTENCE = f"CASE WHEN {_SQUEEZED} = '' THEN 'No root-cause reasoning was produced.' ELSE left(split_part({_SQUEEZED}, '. ', 1), 240) END"


@query("classify_failure_text", with_views(f"SELECT note_id, coalesce(nullif({_TEXT_TYPES}, ''), {_TEXT_FALLBACK}) AS failure_types FROM notes"))
def classify_failure_text(spark, sf_dir):
    notes = view(spark, sf_dir, "notes")
    return notes.select("note_id", F.array_join(signals.failure_types_in_text(F.col("text")), ",").alias("failure_types"))


@query("text_severity", with_views(f"SELECT note_id, {_TEXT_SEVERITY} AS severity, {_SENTENCE} AS sentence FROM notes"))
def text_severity(spark, sf_dir):
    notes = view(spark, sf_dir, "notes")
    return notes.select("note_id", signals.severity_in_text(F.col("text")).alias("severity"),
                        signals.first_sentence(F.col("text")).alias("sentence"))


@query("parse_rca_notes", with_views(f"""WITH e AS (SELECT note_id, text, CASE WHEN note_id LIKE 'event-%' THEN CAST(substring(note_id, 7) AS BIGINT) END AS event_id FROM notes)
  SELECT note_id, CASE WHEN event_id % 6 = 3 THEN 'DATA_DRIFT,NULL_SPIKE' ELSE coalesce(nullif({_TEXT_TYPES}, ''), {_TEXT_FALLBACK}) END AS failure_types,
    CASE WHEN event_id % 6 = 3 THEN 'high' WHEN event_id % 6 = 4 THEN 'critical' ELSE {_TEXT_SEVERITY} END AS severity,
    CASE WHEN event_id % 6 = 3 THEN concat('Event ', event_id) ELSE {_SENTENCE} END AS summary,
    CASE WHEN event_id % 6 = 4 THEN 'Compare labels' ELSE 'Review the flagged checks and compare the current batch against the active baseline.' END AS recommendation FROM e"""))
def parse_rca_notes(spark, sf_dir):
    return signals.parse_notes(view(spark, sf_dir, "notes")).drop("text").withColumn(
        "failure_types", F.array_join("failure_types", ",")
    )


# ---- incidents -------------------------------------------------------------------------------------------------


@query("drift_incidents", with_views("""SELECT run_id, id AS finding_id, CASE WHEN feature_name = 'prediction_output' THEN 'Concept Drift Detected: Prediction Output'
    ELSE concat('Data Drift Detected: ', feature_name) END AS title,
  CASE WHEN feature_name = 'prediction_output' THEN concat('Model output distribution shifted significantly. Severity ''', severity, '''. PSI: ', printf('%.3f', psi_score), ', KS: ', printf('%.3f', ks_score))
    ELSE concat('Drift detected on feature ''', feature_name, ''' with severity ''', severity, '''. PSI: ', printf('%.3f', psi_score), ', KS: ', printf('%.3f', ks_score)) END AS description,
  CASE WHEN feature_name = 'prediction_output' THEN 'concept_drift' ELSE 'data_drift' END AS failure_type, 'drift' AS finding_type, severity
  FROM drift_findings WHERE severity IN ('high', 'critical')"""))
def drift_incidents(spark, sf_dir):
    return incidents.drift_incidents(view(spark, sf_dir, "drift_findings"))


@query("rca_incidents", with_views(f"""WITH {_SIGNALS}, {_RCA}, old AS (SELECT run_id, min(id) AS id, arg_min(severity, id) AS s, arg_min(status, id) AS st FROM incidents WHERE failure_type = 'ai_root_cause' GROUP BY run_id),
  fresh AS (SELECT * FROM rca WHERE opens_incident)
  SELECT coalesce(f.run_id, o.run_id) AS run_id, o.id, coalesce(f.severity, o.s) AS severity, coalesce(o.st, 'open') AS status, f.summary,
    CASE WHEN o.id IS NULL THEN 'create' WHEN f.run_id IS NULL THEN 'keep' ELSE 'update' END AS action FROM old o FULL JOIN fresh f ON o.run_id = f.run_id"""))
def rca_incidents(spark, sf_dir):
    return incidents.rca_incidents(view(spark, sf_dir, "incidents"), _rca(spark, sf_dir))


_PRIMARY = f"""primaries AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (failure_type = 'ai_root_cause') DESC,
    CASE WHEN failure_type = 'ai_root_cause' THEN -1 ELSE {rank('severity')} END DESC, created_at DESC, id DESC) AS p FROM incidents) WHERE p = 1)"""


@query("primary_incident", with_views(f"WITH {_PRIMARY} SELECT run_id, id, failure_type, severity FROM primaries"))
def primary_incident(spark, sf_dir):
    found = incidents.primary_incident(view(spark, sf_dir, "incidents"))
    return found.select("run_id", "id", "failure_type", "severity")


@query("representative_incident", with_views("""WITH chosen AS (SELECT run_id, min(id) AS primary_id FROM incidents GROUP BY run_id),
  marked AS (SELECT i.run_id, i.id, i.severity, i.created_at, coalesce(i.id = c.primary_id AND i.run_id % 2 = 0, false) AS is_primary FROM incidents i LEFT JOIN chosen c ON i.run_id = c.run_id)
  SELECT run_id, id, severity, is_primary FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY is_primary DESC, created_at DESC, id DESC) AS p FROM marked) WHERE p = 1"""))
def representative_incident(spark, sf_dir):
    """Runs with an even id have a stored primary; the others fall back to the newest incident."""
    rows = view(spark, sf_dir, "incidents")
    stored = rows.filter("run_id % 2 = 0").groupBy("run_id").agg(F.min("id").alias("primary_id"))
    return incidents.representative_incident(rows, stored)


@query("incident_groups", with_views(f"""WITH {_PRIMARY}, g AS (SELECT run_id, max({rank('severity')}) AS worst, list_sort(list(DISTINCT failure_type)) AS kinds, count(*) AS incident_count,
    bool_or(status = 'open') AS any_open, bool_or(status = 'investigating') AS any_inv, min(status) AS first_state FROM incidents GROUP BY run_id)
  SELECT g.run_id, p.id AS primary_incident_id, CASE WHEN p.failure_type = 'ai_root_cause' THEN p.title ELSE concat('Run ', g.run_id, ' monitoring alert') END AS title,
    CASE WHEN p.description LIKE '{{%' THEN json_extract_string(p.description, '$.summary') ELSE concat(trim(regexp_replace(coalesce(p.description, concat(incident_count, ' monitoring incident(s) detected.')), '\\s+', ' ', 'g')),
      ' Signals: ', array_to_string(kinds[:4], ', '), '.') END AS summary, {level('worst')} AS severity,
    CASE WHEN any_open THEN 'open' WHEN any_inv THEN 'investigating' ELSE first_state END AS status, incident_count FROM g JOIN primaries p ON g.run_id = p.run_id""".replace("{{%", "{%")))
def incident_groups(spark, sf_dir):
    return incidents.incident_groups(view(spark, sf_dir, "incidents"))


@query("incident_failure_types", with_views("""SELECT id, run_id, CASE WHEN failure_type = 'ai_root_cause' THEN 'DATA_DRIFT,NULL_SPIKE' ELSE failure_type END AS failure_types FROM incidents"""))
def incident_failure_types(spark, sf_dir):
    found = incidents.incident_failure_types(view(spark, sf_dir, "incidents"))
    return found.select("id", "run_id", F.array_join("failure_types", ",").alias("failure_types"))


_POLICY = """CASE WHEN list_has_any(kinds, ['SCHEMA_MISMATCH', 'MISSING_COLUMNS', 'EXTRA_COLUMNS', 'DATA_QUALITY', 'NULL_SPIKE', 'RANGE_VIOLATION', 'CATEGORICAL_SHIFT']) THEN 'manual_data_correction'
  WHEN severity = 'critical' THEN 'manual_investigation' WHEN list_has_any(kinds, ['DATA_DRIFT', 'CONCEPT_DRIFT', 'MODEL_DEGRADATION']) THEN 'retrain_model'
  WHEN severity = 'high' THEN 'manual_review' WHEN severity = 'medium' THEN 'review_and_refresh_baseline' ELSE 'observe' END"""
_MODE = """CASE action_type WHEN 'manual_data_correction' THEN 'manual_only' WHEN 'manual_investigation' THEN 'manual_only' WHEN 'retrain_model' THEN 'approval_required'
  WHEN 'manual_review' THEN 'approval_required' WHEN 'review_and_refresh_baseline' THEN 'suggestion_only' ELSE 'none' END"""


@query("remediation_policy", with_views(f"""WITH k AS (SELECT id, run_id, severity, CASE WHEN failure_type = 'ai_root_cause' THEN ['DATA_DRIFT', 'NULL_SPIKE'] WHEN failure_type = 'data_quality' AND id % 2 = 0 THEN ['OTHER'] ELSE [upper(failure_type)] END AS kinds FROM incidents),
  d AS (SELECT *, {_POLICY} AS action_type FROM k)
  SELECT id, run_id, severity, action_type, {_MODE} AS action_mode, action_type IN ('retrain_model', 'manual_review') AS requires_approval, action_type = 'retrain_model' AS allowed_to_execute,
    action_type NOT IN ('retrain_model', 'observe') AS manual_only FROM d"""))
def remediation_policy(spark, sf_dir):
    rows = incidents.incident_failure_types(view(spark, sf_dir, "incidents"))
    other = (F.col("failure_type") == "data_quality") & (F.col("id") % 2 == 0)
    rows = rows.withColumn("failure_types", F.when(other, F.array(F.lit("OTHER"))).otherwise(F.col("failure_types")))
    found = remediation.remediation_policy(rows)
    return found.select("id", "run_id", "severity", "action_type", "action_mode", "requires_approval", "allowed_to_execute", "manual_only")


_REPORT = f"""ev AS (SELECT run_id, title, severity, row_number() OVER (PARTITION BY run_id ORDER BY severity_rank DESC, issue) AS p FROM issue_texts),
  quoted AS (SELECT run_id, string_agg(concat(title, ' (', severity, ')'), ', ' ORDER BY p) AS q FROM ev WHERE p <= 3 GROUP BY run_id),
  decided AS (SELECT rca.run_id, severity, failure_types, summary, coalesce(kinds, []) AS kinds FROM rca),
  acted AS (SELECT *, {_POLICY} AS action_type FROM decided),
  rep AS (SELECT a.run_id, a.severity, a.failure_types, action_type, {_MODE} AS action_mode, action_type NOT IN ('retrain_model', 'observe') AS manual, action_type IN ('retrain_model', 'manual_review') AS ask, a.summary,
    CASE WHEN q IS NULL THEN 'No structured evidence was stored for this incident.' ELSE concat('Primary evidence signals: ', q, '.') END AS evidence_summary FROM acted a LEFT JOIN quoted ON a.run_id = quoted.run_id),
  rep2 AS (SELECT *, CASE WHEN manual THEN 'manual_action_required' WHEN ask THEN 'awaiting_approval' ELSE 'report_ready' END AS report_status FROM rep)"""


def _issues(spark, sf_dir):
    return signals.issue_findings(_signals(spark, sf_dir))


def _reports(spark, sf_dir):
    evidence = _issues(spark, sf_dir).select(
        "run_id", F.struct((-F.col("severity_rank")).alias("r"), "issue").alias("place"), "title", "severity"
    )
    return incidents.final_reports(_rca(spark, sf_dir), evidence)


@query("final_reports", with_views(f"""WITH {_SIGNALS}, {_ISSUES}, {_RCA}, {_REPORT} SELECT run_id, severity, failure_types, action_type, action_mode, report_status,
  summary AS incident_summary, evidence_summary FROM rep2"""))
def final_reports(spark, sf_dir):
    found = _reports(spark, sf_dir).withColumn("failure_types", F.array_join("failure_types", ","))
    return found.select("run_id", "severity", "failure_types", "action_type", "action_mode", "report_status", "incident_summary", "evidence_summary")


@query("incident_reports", with_views(f"""WITH {_SIGNALS}, {_ISSUES}, {_RCA}, {_REPORT}, n AS (SELECT run_id, count(*) AS c, min(title) FILTER (p = 1) AS t FROM ev GROUP BY run_id)
  SELECT r.run_id, m.model_id, m.name AS model_name, m.version AS model_version, CAST(pr.baseline_version AS BIGINT) AS baseline_version, r.severity, r.report_status,
    CASE WHEN r.severity IN ('critical', 'high') THEN 'production-impacting' ELSE 'watch' END AS risk_level, CAST(1 + CAST(ask AS INTEGER) + CAST(manual AS INTEGER) AS BIGINT) AS action_count,
    coalesce(n.c, 0) AS raw_issue_count, n.t AS first_finding FROM rep2 r JOIN pipeline_runs pr ON r.run_id = pr.run_id LEFT JOIN ml_models m ON pr.model_id = m.model_id LEFT JOIN n ON r.run_id = n.run_id"""))
def incident_reports(spark, sf_dir):
    found = incidents.incident_reports(
        _reports(spark, sf_dir), _issues(spark, sf_dir), view(spark, sf_dir, "pipeline_runs"), view(spark, sf_dir, "ml_models")
    )
    return found.select(
        "run_id", "model_id", "model_name", "model_version", F.col("baseline_version").cast("bigint").alias("baseline_version"),
        "severity", "report_status", "risk_level", F.size("next_actions").cast("bigint").alias("action_count"),
        "raw_issue_count", F.get("findings", F.lit(0))["title"].alias("first_finding"),
    )


@query("evidence_hash", with_views("""SELECT id, sha256(concat('{"failure_type":"', failure_type, '","id":', id, ',"run_id":', run_id, ',"severity":"', severity, '"}')) AS evidence_hash FROM incidents"""))
def evidence_hash(spark, sf_dir):
    found = incidents.evidence_hash(view(spark, sf_dir, "incidents"), ["severity", "id", "run_id", "failure_type"])
    return found.select("id", "evidence_hash")


_DQ_LISTS = """SELECT run_id, count(*) FILTER (NOT success) AS failed, list_sort(list(DISTINCT check_type) FILTER (NOT success)) AS t,
  list_sort(list(DISTINCT column_name) FILTER (NOT success AND column_name IS NOT NULL)) AS c FROM dq_findings GROUP BY run_id"""


@query("explain_dq", with_views(f"""SELECT run_id, failed, CASE WHEN failed = 0 THEN 'This run did not store any failed data quality checks.'
    ELSE concat('Run #', run_id, ' failed stored ', array_to_string(t[:3], ', '), ' checks affecting ', coalesce(nullif(array_to_string(c[:4], ', '), ''), 'the incoming dataset'), '.') END AS summary,
  CASE WHEN failed = 0 THEN 'none' WHEN list_has_any(t, ['missing_columns', 'schema_type_mismatch']) THEN 'compatibility' WHEN list_has_any(t, ['range', 'categorical']) THEN 'profile' ELSE 'contract' END AS why_kind FROM ({_DQ_LISTS})"""))
def explain_dq(spark, sf_dir):
    found = incidents.explain_quality(view(spark, sf_dir, "dq_findings"))
    kind = (
        F.when(F.col("failed") == 0, "none").when(F.col("why").contains("feature compatibility"), "compatibility")
        .when(F.col("why").contains("baseline profile"), "profile").otherwise("contract")
    )
    return found.select("run_id", "failed", "summary", kind.alias("why_kind"))


@query("explain_drift", with_views("""WITH s AS (SELECT run_id, count(*) FILTER (drift_detected) AS drifted, list_sort(list(DISTINCT feature_name) FILTER (drift_detected)) AS f,
    coalesce(bool_or(drift_detected AND severity IN ('high', 'critical')), false) AS severe FROM drift_findings GROUP BY run_id),
  t AS (SELECT run_id, string_agg(concat(feature_name, ' (score ', printf('%.3f', drift_score), ', PSI ', printf('%.3f', psi_score), ')'), ', ' ORDER BY p) AS top
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY drift_score DESC, id) AS p FROM drift_findings WHERE drift_detected) WHERE p <= 3 GROUP BY run_id)
  SELECT s.run_id, drifted, CASE WHEN drifted = 0 THEN 'This run did not store any active drift signals.' ELSE concat('Run #', s.run_id, ' stored active drift signals for ', array_to_string(f[:4], ', '), '.') END AS summary,
    CASE WHEN drifted = 0 THEN 'close' WHEN severe THEN 'different population' ELSE 'measurable' END AS meaning,
    CASE WHEN drifted = 0 THEN 'No material distribution change was stored for this run. Continue monitoring future runs for emerging drift trends.'
      ELSE concat('Compared with the baseline, the strongest movement was observed in ', top, '. Review whether the batch source, population, or time window changed.') END AS change
  FROM s LEFT JOIN t ON s.run_id = t.run_id"""))
def explain_drift(spark, sf_dir):
    found = incidents.explain_drift(view(spark, sf_dir, "drift_findings"))
    meaning = (
        F.when(F.col("drifted") == 0, "close").when(F.col("interpretation").contains("different population"), "different population")
        .otherwise("measurable")
    )
    return found.select("run_id", "drifted", "summary", meaning.alias("meaning"), "change")


@query("alert_text", with_views("""SELECT note_id, CASE WHEN length(t) > 500 THEN concat(left(t, 497), '...') ELSE t END AS alert FROM (SELECT note_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM notes)
  UNION ALL SELECT concat('incident-', id), CASE WHEN description LIKE '{%' THEN concat('Run ', run_id, ' cause') ELSE coalesce(trim(regexp_replace(description, '\\s+', ' ', 'g')), '') END FROM incidents"""))
def alert_text(spark, sf_dir):
    notes = view(spark, sf_dir, "notes").select("note_id", "text")
    stored = view(spark, sf_dir, "incidents").select(
        F.concat(F.lit("incident-"), F.col("id").cast("string")).alias("note_id"), F.col("description").alias("text")
    )
    return notes.unionByName(stored).select("note_id", incidents.alert_text(F.col("text")).alias("alert"))


@query("alert_recipients", with_views(f"""WITH routes AS (SELECT i.id, i.severity, i.created_at, m.tenant_id FROM incidents i JOIN pipeline_runs r ON i.run_id = r.run_id JOIN ml_models m ON r.model_id = m.model_id),
  waiting AS (SELECT tenant_id, count(*) AS alerts, max(created_at) AS latest_alert_at, max({rank('severity')}) AS worst FROM routes GROUP BY tenant_id)
  SELECT u.tenant_id, user_id, email, alerts, latest_alert_at, {level('worst')} AS worst_severity FROM users u JOIN waiting w ON u.tenant_id = w.tenant_id WHERE is_verified AND email IS NOT NULL"""))
def alert_recipients(spark, sf_dir):
    routes = incidents.alert_routes(*[view(spark, sf_dir, v) for v in ("incidents", "pipeline_runs", "ml_models")])
    return incidents.alert_recipients(routes, view(spark, sf_dir, "users"))


@query("alert_routes", with_views("""SELECT i.id, i.run_id, r.model_id, m.tenant_id FROM incidents i JOIN pipeline_runs r ON i.run_id = r.run_id JOIN ml_models m ON r.model_id = m.model_id"""))
def alert_routes(spark, sf_dir):
    routes = incidents.alert_routes(*[view(spark, sf_dir, v) for v in ("incidents", "pipeline_runs", "ml_models")])
    return routes.select("id", "run_id", "model_id", "tenant_id")
