"""Derived input views as SQL text that Spark and the check engine both run, over the whole base tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # Reference side before 1998, current side from 1998 on.
    "lineitem_split": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
          l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AS is_reference
        FROM lineitem""",
    # Clean form of the corrupted batch: what its baseline is learned from.
    "lineitem_clean": """
        SELECT l_quantity AS quantity, l_discount AS discount, l_returnflag AS returnflag,
          l_linestatus = 'O' AS is_open
        FROM lineitem""",
    # Corrupted text batch: some orders hit four bad cells, some three, some one value out of range.
    "lineitem_raw": """
        SELECT l_orderkey, l_linenumber, l_suppkey,
          CASE WHEN l_orderkey % 11 = 0 THEN ' n/a ' WHEN l_orderkey % 13 = 0 THEN 'abc'
            WHEN l_orderkey % 17 = 0 THEN '9999' ELSE CAST(l_quantity AS STRING) END AS quantity,
          CASE WHEN l_orderkey % 11 = 0 THEN '' WHEN l_orderkey % 13 = 0 THEN '1d'
            ELSE CAST(l_discount AS STRING) END AS discount,
          CASE WHEN l_orderkey % 11 = 0 THEN 'null' WHEN l_orderkey % 13 = 0 THEN 'zz'
            ELSE lower(l_returnflag) END AS returnflag,
          CASE WHEN l_orderkey % 11 = 0 THEN 'maybe' WHEN l_linestatus = 'O' THEN 'Yes' ELSE '0' END AS is_open
        FROM lineitem""",
    # Text columns of every inferable type.
    "lineitem_text": """
        SELECT CAST(l_orderkey AS STRING) AS order_no, CAST(l_tax AS STRING) AS tax,
          CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END AS open_flag,
          CASE WHEN l_linenumber = 7 THEN 'N/A' ELSE CAST(l_linenumber AS STRING) END AS line_no,
          l_returnflag AS returnflag, CAST(l_suppkey AS STRING) AS supplier_id,
          CASE WHEN l_orderkey < 0 THEN 'x' END AS nothing
        FROM lineitem""",
    "ml_models": """
        SELECT c_custkey AS model_id, concat('tenant_', CAST(CAST(floor(c_custkey / 10) AS BIGINT) AS STRING)) AS tenant_id,
          CASE WHEN c_custkey % 7 = 0 THEN concat(c_name, ' KMeans') WHEN c_custkey % 11 = 0 THEN concat(c_name, '-clustering')
            ELSE c_name END AS name,
          CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 3 + 1 AS STRING) END AS version,
          CASE WHEN c_custkey % 5 = 0 THEN 'xgboost' ELSE 'sklearn' END AS framework
        FROM customer""",
    "pipeline_runs": """
        SELECT o_orderkey AS run_id, o_custkey AS model_id, o_orderkey % 4 + 1 AS baseline_version,
          CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'running' END AS status,
          o_orderpriority = '1-URGENT' AS schema_changed, o_orderdate AS created_at
        FROM orders""",
    "drift_metrics": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS run_id,
          CASE l_linenumber WHEN 1 THEN 'prediction_output' WHEN 2 THEN 'price' WHEN 3 THEN 'quantity'
            ELSE concat('f', CAST(l_linenumber AS STRING)) END AS feature_name,
          max(l_discount * 6) AS psi_score, max(l_tax * 4) AS ks_score, max(l_discount) AS ks_pvalue,
          max(l_shipdate) AS created_at
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "drift_findings": """
        SELECT m.*, greatest(psi_score, ks_score) AS drift_score, greatest(psi_score, ks_score) > 0.2 AS drift_detected,
          CASE WHEN greatest(psi_score, ks_score) >= 0.5 THEN 'critical' WHEN greatest(psi_score, ks_score) >= 0.3 THEN 'high'
            WHEN greatest(psi_score, ks_score) >= 0.2 THEN 'medium' ELSE 'low' END AS severity
        FROM drift_metrics m""",
    "dq_findings": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS run_id,
          CASE WHEN l_linenumber IN (6, 7) THEN NULL ELSE concat('c', CAST(l_linenumber AS STRING)) END AS column_name,
          CASE l_linenumber WHEN 1 THEN 'null_ratio' WHEN 2 THEN 'range' WHEN 3 THEN 'categorical'
            WHEN 4 THEN 'schema_type_mismatch' WHEN 6 THEN 'extra_columns' WHEN 7 THEN 'missing_columns'
            ELSE 'range' END AS check_type,
          CASE WHEN l_linenumber IN (4, 6, 7) THEN false ELSE min(l_quantity) < 25 END AS success,
          min(l_quantity) AS observed_min, max(l_quantity) AS observed_max, max(l_discount) AS ratio,
          min(l_returnflag) AS unseen, max(l_shipdate) AS created_at
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "incidents": """
        SELECT event_id AS id, user_id AS run_id,
          CASE event_type WHEN 'error' THEN 'ai_root_cause' WHEN 'click' THEN 'data_drift' WHEN 'view' THEN 'concept_drift'
            ELSE 'data_quality' END AS failure_type,
          CASE WHEN value >= 60 THEN 'critical' WHEN value >= 30 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS severity,
          CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' ELSE 'resolved' END AS status,
          CASE WHEN event_type = 'error' THEN 'AI Root Cause Analysis' ELSE concat('Signal ', event_type) END AS title,
          CASE event_type
            WHEN 'error' THEN concat('{"summary": "Run ', CAST(user_id AS STRING), '   cause", "failure_types": ["DATA_DRIFT", "NULL_SPIKE"], "severity": "high"}')
            WHEN 'view' THEN NULL
            ELSE concat('Drift  on   feature f', CAST(event_id % 7 AS STRING)) END AS description,
          CASE WHEN event_type = 'click' THEN 'drift' WHEN event_type = 'error' THEN 'root_cause' ELSE 'data_quality' END AS finding_type,
          CASE WHEN event_type = 'click' THEN user_id * 10 + event_id % 7 + 1 END AS finding_id, ts AS created_at
        FROM events""",
    # Version numbers grow with the id; at most one active baseline per model.
    "baselines": """
        SELECT o.o_orderkey AS id, o.o_custkey AS model_id, o.o_orderkey + 1 AS version,
          CASE WHEN o.o_orderstatus = 'F' THEN 'draft' ELSE 'approved' END AS status,
          coalesce(o.o_orderkey = a.active_id, false) AS is_active, o.o_orderdate AS created_at
        FROM orders o LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS active_id FROM orders
          WHERE o_orderstatus <> 'F' AND o_orderkey % 3 = 0 GROUP BY o_custkey) a ON o.o_custkey = a.o_custkey""",
    "action_log": """
        SELECT event_id AS id, user_id AS remediation_run_id, ts AS created_at,
          CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending_promotion'
            WHEN 'purchase' THEN 'staged' ELSE 'failed' END AS status,
          CASE WHEN event_type = 'click' THEN concat('{"candidate_model_uri":"runs:/', CAST(event_id AS STRING), '/m"}')
            WHEN event_type = 'purchase' THEN concat('{"staged_model_version":"', CAST(event_id % 9 AS STRING), '"}')
            ELSE props END AS payload
        FROM events""",
    "agent_steps": """
        SELECT conv_id AS run_id, turn % 4 AS step_index, turn AS seq,
          CASE WHEN role = 'user' THEN 'running' ELSE 'done' END AS status, text AS message
        FROM conversations""",
    "training_rows": """
        SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "prediction_pairs": """
        SELECT vec_id, label AS y_true, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y_pred
        FROM embeddings""",
    # Columns that each incoming batch (one order) carries; case varies between batches.
    "batch_columns": """
        SELECT DISTINCT l_orderkey AS run_id,
          CASE WHEN l_orderkey % 3 = 0 THEN concat('C', CAST(l_linenumber AS STRING)) ELSE concat('c', CAST(l_linenumber AS STRING)) END AS column_name
        FROM lineitem""",
    # Active contract of each model (one per customer): which columns it expects.
    "baseline_columns": """
        SELECT DISTINCT o_custkey AS model_id, concat('c', CAST(l_linenumber AS STRING)) AS column_name,
          CASE WHEN l_linenumber % 3 = 0 THEN 'object' WHEN l_linenumber % 3 = 1 THEN 'float' ELSE 'int' END AS dtype
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderstatus = 'F' AND l_returnflag = 'A' AND l_linestatus = 'O'""",
    "users": """
        SELECT c_custkey AS user_id, concat('tenant_', CAST(CAST(floor(c_custkey / 10) AS BIGINT) AS STRING)) AS tenant_id,
          c_acctbal > 0 AS is_verified,
          CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat(lower(c_name), '@example.com') END AS email
        FROM customer""",
    # Changed columns of each schema-change event, one row per column.
    "schema_events": """
        SELECT DISTINCT l_orderkey AS id, o_custkey AS model_id, l_orderkey AS run_id,
          CASE l_linenumber % 2 WHEN 0 THEN 'new_column' ELSE 'missing_column' END AS change_type,
          concat('c', CAST(l_linenumber AS STRING)) AS column_name,
          CASE l_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    # Free text that analysis rules read: conversation turns, documents, and notes built from findings.
    "notes": """
        SELECT concat('conv-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS note_id, text FROM conversations
        UNION ALL
        SELECT concat('doc-', CAST(doc_id AS STRING)) AS note_id, text FROM documents
        UNION ALL
        SELECT concat('event-', CAST(event_id AS STRING)) AS note_id,
          CASE event_id % 6
            WHEN 0 THEN concat('High PSI on feature f', CAST(event_id % 7 AS STRING), '. Check the source.')
            WHEN 1 THEN 'Orange juice orders are fine. No critical issues'
            WHEN 2 THEN concat('Quality check: fail on column c', CAST(event_id % 5 AS STRING), '.  Then stop. Unseen values')
            WHEN 3 THEN concat('Summary first. ```json {"failure_types": ["data drift", "null-spike", "other"], "severity": "HIGH", "summary": "Event ', CAST(event_id AS STRING), '"} ``` done')
            WHEN 4 THEN 'Model output moved. {"severity": "critical", "recommendation": "Compare labels"}'
            ELSE 'Broken note {"failure_types": ["DATA_DRIFT"' END AS text
        FROM events""",
}


def names_in(sql: str, candidates) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [c for c in candidates if c in words]


def with_views(sql: str) -> str:
    """Put the views that a check query uses in front of it, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in names_in(text, VIEWS):
            if name not in needed and VIEWS[name] is not text:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


#: Shuffled, compressed bytes that a task takes where the session names no size of its own. Rows of these views are short, sorted by
#: nothing and full of equal texts, so that a task holds some thirty times as much; with Spark's 64 MB it held gigabytes.
TASK_BYTES = "8m"
TASK_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(TASK_SIZE, None) is None:
        spark.conf.set(TASK_SIZE, TASK_BYTES)
    text = with_views(f"SELECT * FROM {name}")
    for table in names_in(text, BASE_TABLES):
        base(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(text)
