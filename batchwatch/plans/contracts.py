"""Queries for contracts, schema changes, baselines, reports and aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchwatch.operators import lookups, registry, schema
from batchwatch.plans.registry import query
from batchwatch.plans.sqltext import identifier
from batchwatch.plans.views import base, view, with_views


@query("align_schema", """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(NULL AS DOUBLE) AS price, l_quantity, CAST(NULL AS STRING) AS flag,
  l_returnflag FROM lineitem""")
def align_schema(spark, sf_dir):
    contract = [("l_orderkey", "int"), ("price", "float"), ("l_quantity", "float"), ("flag", "object"), ("l_returnflag", "object")]
    return schema.align_to_contract(base(spark, sf_dir, "lineitem"), contract)


_DIFF_SQL = """diff AS (SELECT r.run_id, r.model_id,
    (SELECT 1) AS one, list_sort(list_filter(b.cols, lambda c: NOT list_contains(m.cols, c))) AS extra_columns,
    list_sort(list_filter(m.cols, lambda c: NOT list_contains(b.cols, c))) AS missing_columns
  FROM pipeline_runs r JOIN (SELECT run_id, list(column_name) AS cols FROM batch_columns GROUP BY run_id) b ON r.run_id = b.run_id
  JOIN (SELECT model_id, list(DISTINCT column_name) AS cols FROM baseline_columns GROUP BY model_id) m ON r.model_id = m.model_id)"""


def _diffs(spark, sf_dir):
    return schema.schema_diff(*(view(spark, sf_dir, v) for v in ("batch_columns", "pipeline_runs", "baseline_columns")))


@query("schema_diff", with_views(f"""WITH {_DIFF_SQL} SELECT run_id, model_id, array_to_string(extra_columns, ',') AS extra_columns,
  array_to_string(missing_columns, ',') AS missing_columns, len(extra_columns) + len(missing_columns) > 0 AS schema_changed FROM diff"""))
def schema_diff(spark, sf_dir):
    return _diffs(spark, sf_dir).withColumns(
        {c: F.array_join(c, ",") for c in ("extra_columns", "missing_columns")}
    )


# Column names c1..c7 as bits of a number: an independent way to compare column sets.
@query("match_model", with_views("""WITH b AS (SELECT run_id, CAST(sum(DISTINCT 1 << (CAST(lower(column_name)[2:] AS INTEGER) - 1)) AS BIGINT) AS bm FROM batch_columns GROUP BY run_id),
  m AS (SELECT model_id, CAST(sum(DISTINCT 1 << (CAST(lower(column_name)[2:] AS INTEGER) - 1)) AS BIGINT) AS cm FROM baseline_columns GROUP BY model_id),
  cs AS (SELECT cm, count(*) AS n, min(model_id) AS model_id FROM m GROUP BY cm),
  pairs AS (SELECT bm, cm, n, model_id, bit_count(bm & cm) AS o, bit_count(bm & cm) - 2.0 * (bit_count(cm) - bit_count(bm & cm)) - 0.25 * (bit_count(bm) - bit_count(bm & cm)) AS score
    FROM (SELECT DISTINCT bm FROM b), cs),
  top AS (SELECT bm, max(score) AS score FROM pairs GROUP BY bm),
  best AS (SELECT p.bm, p.score, sum(n) FILTER (o > 0) AS hit, sum(n) FILTER (o = 0) AS miss, min(model_id) FILTER (o > 0) AS model_id, max(o) AS o
    FROM pairs p JOIN top t ON p.bm = t.bm AND p.score = t.score GROUP BY p.bm, p.score)
  SELECT run_id, CASE WHEN coalesce(hit, 0) = 0 THEN 'no_match' WHEN hit + coalesce(miss, 0) > 1 THEN 'ambiguous' ELSE 'matched' END AS status,
    CASE WHEN hit = 1 AND miss IS NULL THEN best.model_id END AS model_id, CASE WHEN hit > 0 THEN score END AS score,
    CASE WHEN hit > 0 THEN CAST(o AS BIGINT) END AS matched_columns FROM b JOIN best ON b.bm = best.bm"""))
def match_model(spark, sf_dir):
    return schema.match_model(view(spark, sf_dir, "batch_columns"), view(spark, sf_dir, "baseline_columns"))


NEW_COLUMNS = ("order_no", "tax", "open_flag", "line_no", "returnflag", "supplier_id", "nothing")


def _candidate_sql() -> str:
    from batchwatch.plans.quality import _TYPES_SQL

    return _TYPES_SQL + """, d AS (SELECT column_name, count(DISTINCT cell0) AS unique_count,
      array_to_string(list_sort(list_distinct(list(cell0)))[:10], ',') AS sample_values FROM (""" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS cell0 FROM lineitem_text" for c in NEW_COLUMNS
    ) + f""") GROUP BY column_name),
  j AS (SELECT t.column_name, t.dtype, CASE t.dtype WHEN 'int' THEN 'numeric' WHEN 'float' THEN 'numeric' WHEN 'bool' THEN 'boolean' ELSE 'categorical' END AS inferred_type,
    (row_count - present_count) / row_count AS missing_ratio, unique_count, row_count, present_count, coalesce(sample_values, '') AS sample_values
    FROM typed t JOIN d ON t.column_name = d.column_name),
  k AS (SELECT *, CASE WHEN {identifier('column_name')} THEN 'identifier' WHEN inferred_type IN ('numeric', 'boolean') THEN 'numeric_feature'
    WHEN unique_count >= 200 OR (present_count >= 50 AND unique_count / present_count >= 0.2) THEN 'high_cardinality_text' ELSE 'categorical_feature' END AS semantic_type FROM j),
  cand AS (SELECT column_name, dtype, inferred_type, round(missing_ratio, 6) AS missing_ratio, unique_count, row_count, sample_values, semantic_type,
    CASE semantic_type WHEN 'numeric_feature' THEN 'approve_as_feature' WHEN 'categorical_feature' THEN 'approve_with_encoding' ELSE 'reject_as_feature' END AS recommended_decision,
    CASE semantic_type WHEN 'numeric_feature' THEN 'none' WHEN 'high_cardinality_text' THEN 'custom_required' WHEN 'categorical_feature' THEN 'one_hot' END AS encoding_strategy,
    semantic_type IN ('numeric_feature', 'categorical_feature') AS safe_as_feature FROM k)"""


@query("feature_candidates", with_views(_candidate_sql() + " SELECT * FROM cand"))
def feature_candidates(spark, sf_dir):
    found = schema.feature_candidates(view(spark, sf_dir, "lineitem_text"), NEW_COLUMNS)
    return found.drop("present_count").withColumn("sample_values", F.array_join("sample_values", ",")).withColumn(
        "missing_ratio", F.round("missing_ratio", 6)
    )


@query("candidate_profile", with_views(_candidate_sql() + """ SELECT column_name, dtype, CASE WHEN inferred_type = 'numeric' THEN 'numeric' WHEN inferred_type = 'boolean' THEN 'categorical'
    WHEN semantic_type = 'high_cardinality_text' THEN 'text' WHEN semantic_type = 'identifier' THEN 'identifier' ELSE 'categorical' END AS type,
  CASE WHEN inferred_type = 'numeric' THEN 'range' WHEN inferred_type = 'boolean' THEN 'enum' WHEN semantic_type = 'high_cardinality_text' THEN 'high_cardinality'
    WHEN semantic_type = 'identifier' THEN 'identifier' ELSE 'enum' END AS validation_mode,
  inferred_type IN ('numeric', 'boolean') OR semantic_type <> 'identifier' AS feature_candidate, encoding_strategy,
  CASE WHEN semantic_type = 'categorical_feature' THEN sample_values END AS unique_values FROM cand"""))
def candidate_profile(spark, sf_dir):
    found = schema.feature_candidates(view(spark, sf_dir, "lineitem_text"), NEW_COLUMNS)
    return schema.candidate_profile(found).withColumn("unique_values", F.array_join("unique_values", ","))


# Requests: every changed column of an event is asked for, some twice and padded; odd columns are safe.
_REQUESTS = """SELECT id, CAST(substring(column_name, 2, 1) AS INTEGER) AS position, concat(' ', column_name) AS column_name FROM schema_events
  UNION ALL SELECT id, 10 + CAST(substring(column_name, 2, 1) AS INTEGER) AS position, column_name FROM schema_events"""
_CANDIDATES = """SELECT id, column_name, column_name IN ('c1', 'c4', 'c6', 'c7') AS safe_as_feature FROM schema_events WHERE change_type = 'new_column'"""


@query("approved_features", with_views(f"""SELECT q.id, coalesce(string_agg(q.column_name, ',' ORDER BY position) FILTER (safe), '') AS approved_feature_columns,
    coalesce(string_agg(q.column_name, ',' ORDER BY q.column_name) FILTER (NOT safe), '') AS rejected_requested_columns
  FROM (SELECT r.id, trim(r.column_name) AS column_name, min(position) AS position, coalesce(bool_or(safe_as_feature), false) AS safe
    FROM ({_REQUESTS}) r LEFT JOIN ({_CANDIDATES}) c ON r.id = c.id AND trim(r.column_name) = c.column_name GROUP BY r.id, trim(r.column_name)) q GROUP BY q.id"""))
def approved_features(spark, sf_dir):
    view(spark, sf_dir, "schema_events").createOrReplaceTempView("schema_events")
    found = schema.approved_features(spark.sql(_REQUESTS), spark.sql(_CANDIDATES))
    return found.withColumns({c: F.array_join(c, ",") for c in ("approved_feature_columns", "rejected_requested_columns")})


@query("evolve_baseline", with_views("""WITH ok AS (SELECT DISTINCT model_id, column_name, 'float' AS dtype FROM schema_events WHERE status = 'approved' AND change_type = 'new_column'),
  v AS (SELECT model_id, max(version) AS last FROM baselines GROUP BY model_id),
  merged AS (SELECT model_id, column_name, dtype, false AS added FROM baseline_columns WHERE model_id IN (SELECT model_id FROM ok)
      AND (model_id, column_name) NOT IN (SELECT (model_id, column_name) FROM ok)
    UNION ALL SELECT model_id, column_name, dtype, true FROM ok)
  SELECT m.model_id, CAST(coalesce(last, 0) + 1 AS BIGINT) AS version, column_name, dtype, added FROM merged m LEFT JOIN v ON m.model_id = v.model_id"""))
def evolve_baseline(spark, sf_dir):
    approved = (
        view(spark, sf_dir, "schema_events")
        .filter("status = 'approved' AND change_type = 'new_column'")
        .select("model_id", "column_name", F.lit("float").alias("dtype")).distinct()
    )
    contracts = view(spark, sf_dir, "baseline_columns")
    return schema.evolve_contract(contracts, view(spark, sf_dir, "baselines"), approved)


@query("schema_change_events", with_views(f"""WITH {_DIFF_SQL}, opened AS (SELECT DISTINCT model_id FROM schema_events WHERE status = 'pending' AND run_id % 7 = 0),
  first AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY run_id) AS p FROM diff WHERE len(extra_columns) + len(missing_columns) > 0
    AND model_id NOT IN (SELECT model_id FROM opened))
  SELECT model_id, run_id, array_to_string(extra_columns, ',') AS new_columns, array_to_string(missing_columns, ',') AS missing_columns, 'pending' AS status FROM first WHERE p = 1"""))
def schema_change_events(spark, sf_dir):
    """Open events exist for some models only (runs divisible by 7), so that others need a new one."""
    events = view(spark, sf_dir, "schema_events").withColumn(
        "status", F.when(F.col("run_id") % 7 == 0, F.col("status")).otherwise("approved")
    )
    return schema.new_schema_events(_diffs(spark, sf_dir), events).withColumns(
        {c: F.array_join(c, ",") for c in ("new_columns", "missing_columns")}
    )


@query("schema_change_rows", with_views("SELECT id, column_name, change_type FROM schema_events"))
def schema_change_rows(spark, sf_dir):
    return schema.schema_change_rows(schema.events_as_lists(view(spark, sf_dir, "schema_events")))


# ---- versions --------------------------------------------------------------------------------------------------


@query("latest_run", with_views("""SELECT tenant_id, run_id, model_id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
  ORDER BY created_at DESC, run_id DESC) AS p FROM (SELECT r.*, m.tenant_id FROM pipeline_runs r JOIN ml_models m ON r.model_id = m.model_id)) WHERE p = 1"""))
def latest_run(spark, sf_dir):
    found = registry.latest_run(view(spark, sf_dir, "pipeline_runs"), view(spark, sf_dir, "ml_models"))
    return found.select("tenant_id", "run_id", "model_id", "status", "created_at")


@query("active_baseline", with_views("""SELECT model_id, id, version, is_active FROM (SELECT *, row_number() OVER (PARTITION BY model_id
  ORDER BY is_active DESC, version DESC) AS p FROM baselines WHERE status = 'approved') WHERE p = 1"""))
def active_baseline(spark, sf_dir):
    found = registry.active_baseline(view(spark, sf_dir, "baselines"))
    return found.select("model_id", "id", F.col("version").cast("bigint").alias("version"), "is_active")


@query("version_baselines", with_views("""WITH up AS (SELECT o_orderkey AS id, o_custkey AS model_id, o_orderkey % 5 = 0 AS approved,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'),
  known AS (SELECT model_id, max(version) AS last, bool_or(is_active AND status = 'approved') AS has_active FROM baselines WHERE model_id % 3 <> 0 GROUP BY model_id)
  SELECT id, up.model_id, CAST(coalesce(last, 0) + place AS BIGINT) AS version,
    CASE WHEN (place = 1 AND NOT coalesce(has_active, false)) OR approved THEN 'approved' ELSE 'draft' END AS status,
    place = 1 AND NOT coalesce(has_active, false) AS is_active FROM up LEFT JOIN known ON up.model_id = known.model_id"""))
def version_baselines(spark, sf_dir):
    """Uploads are the open orders; every third model has no baseline yet."""
    uploads = base(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("model_id"), (F.col("o_orderkey") % 5 == 0).alias("approved")
    )
    existing = view(spark, sf_dir, "baselines").filter("model_id % 3 <> 0")
    return registry.version_baselines(uploads, existing)


@query("activate_baseline", with_views("""WITH t AS (SELECT model_id, max(id) AS target FROM baselines WHERE status = 'draft' GROUP BY model_id)
  SELECT id, b.model_id, CASE WHEN id = target THEN 'approved' ELSE status END AS status, CASE WHEN target IS NULL THEN is_active ELSE id = target END AS is_active
  FROM baselines b LEFT JOIN t ON b.model_id = t.model_id"""))
def activate_baseline(spark, sf_dir):
    """Activate the newest draft of every model."""
    rows = view(spark, sf_dir, "baselines")
    drafts = rows.filter("status = 'draft'").groupBy("model_id").agg(F.max("id").alias("id"))
    return registry.activate_baselines(rows, drafts).select("id", "model_id", "status", "is_active")


def _reports(spark, sf_dir):
    return view(spark, sf_dir, "incidents").filter("failure_type = 'ai_root_cause'").select("id", "run_id", "severity")


@query("version_reports", with_views("""SELECT id, run_id, severity, row_number() OVER (PARTITION BY run_id ORDER BY id) AS version
  FROM incidents WHERE failure_type = 'ai_root_cause'"""))
def version_reports(spark, sf_dir):
    return registry.version_reports(_reports(spark, sf_dir))


@query("latest_report", with_views("""SELECT run_id, max(id) AS id, arg_max(severity, id) AS severity FROM incidents
  WHERE failure_type = 'ai_root_cause' GROUP BY run_id"""))
def latest_report(spark, sf_dir):
    return registry.latest_report(_reports(spark, sf_dir))


@query("latest_candidate", with_views("""SELECT remediation_run_id, max(id) AS id, arg_max(json_extract_string(payload, '$.candidate_model_uri'), id) AS candidate_model_uri,
  arg_max(payload, id) AS payload FROM action_log WHERE json_extract_string(payload, '$.candidate_model_uri') IS NOT NULL GROUP BY 1"""))
def latest_candidate(spark, sf_dir):
    return registry.latest_candidate(view(spark, sf_dir, "action_log"))


@query("latest_staged", with_views("""SELECT remediation_run_id, max(id) AS id, arg_max(json_extract_string(payload, '$.staged_model_version'), id) AS staged_model_version,
  arg_max(payload, id) AS payload FROM action_log WHERE json_extract_string(payload, '$.staged_model_version') IS NOT NULL GROUP BY 1"""))
def latest_staged(spark, sf_dir):
    return registry.latest_staged(view(spark, sf_dir, "action_log"))


_ALIASES = """SELECT id, remediation_run_id AS model_id, CASE WHEN status = 'staged' THEN 'staging' ELSE 'champion' END AS alias, id % 9 + 1 AS version
  FROM action_log WHERE status IN ('staged', 'running')"""


@query("current_alias", with_views(f"""SELECT model_id, alias, arg_max(version, id) AS version, max(id) AS changed_by, count(*) AS changes FROM ({_ALIASES}) GROUP BY model_id, alias"""))
def current_alias(spark, sf_dir):
    view(spark, sf_dir, "action_log").createOrReplaceTempView("action_log")
    return registry.current_alias(spark.sql(_ALIASES))


@query("baseline_listing", with_views("""SELECT id, b.model_id, CAST(b.version AS BIGINT) AS version, b.status, coalesce(m.name, 'Unknown Model') AS model_name
  FROM baselines b LEFT JOIN (SELECT * FROM ml_models WHERE version IS NOT NULL) m ON b.model_id = m.model_id"""))
def baseline_listing(spark, sf_dir):
    """Only registered models (with a version) have a name here."""
    models = view(spark, sf_dir, "ml_models").filter("version IS NOT NULL")
    found = lookups.baseline_listing(view(spark, sf_dir, "baselines"), models)
    return found.select("id", "model_id", F.col("version").cast("bigint").alias("version"), "status", "model_name")
