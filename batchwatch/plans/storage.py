"""Queries for readers and writers. Files are written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchwatch.operators import clean, schema, validate
from batchwatch.plans.quality import CONTRACT, KEYS, _NULLS, _RANGES, flagged, rules
from batchwatch.plans.registry import query
from batchwatch.plans.sqltext import FLAGGED
from batchwatch.plans.views import base, view, with_views
from batchwatch.sources import readers, sinks
from batchwatch.sources.storage import fresh_path

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


@query("scan_csv", _ORDERS)
def scan_csv(spark, sf_dir):
    """CSV text with inferred types gives the table back."""
    path = fresh_path(spark, "orders") + ".csv"
    base(spark, sf_dir, "orders").select(*ORDER_COLUMNS).write.option("header", True).csv(path)
    return readers.load_typed(spark, path)


@query("scan_json", _ORDERS)
def scan_json(spark, sf_dir):
    path = fresh_path(spark, "orders") + ".json"
    base(spark, sf_dir, "orders").select(*ORDER_COLUMNS).write.json(path)
    return readers.load_batch(spark, path).select(*ORDER_COLUMNS)


@query("scan_parquet", "SELECT l_returnflag, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY l_returnflag")
def scan_parquet(spark, sf_dir):
    df = readers.load_batch(spark, f"{sf_dir}/lineitem.parquet")
    late = df.filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return late.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _write_cleaned(spark, sf_dir):
    many = flagged(spark, sf_dir, (*KEYS, "l_suppkey"))
    cleaned = clean.clean_batch(many, rules(spark, sf_dir), keep=(*KEYS, "l_suppkey"))
    path = fresh_path(spark, "accepted")
    sinks.write_by_run(cleaned.withColumnRenamed("l_suppkey", "run_id"), path, shared=True)
    return path


_CLEAN_SQL = f"WITH {FLAGGED.strip()}"


@query("sink_cleaned", with_views(f"""{_CLEAN_SQL} SELECT l_suppkey AS run_id, count(*) AS rows, round(sum(quantity), 4) AS quantity, round(sum(discount), 4) AS discount,
  count(*) FILTER (is_open) AS open_rows FROM imputed GROUP BY l_suppkey"""))
def sink_cleaned(spark, sf_dir):
    stored = spark.read.parquet(_write_cleaned(spark, sf_dir))
    return stored.groupBy(F.col("run_id").cast("bigint").alias("run_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("quantity"), 4).alias("quantity"),
        F.round(F.sum("discount"), 4).alias("discount"), F.count_if("is_open").alias("open_rows"),
    )


@query("read_cleaned_run", with_views(f"""{_CLEAN_SQL} SELECT l_orderkey, l_linenumber, quantity, discount, upper(trim(returnflag)) AS returnflag, is_open FROM imputed WHERE l_suppkey = 7"""))
def read_cleaned_run(spark, sf_dir):
    """The reader's own feature: one run, found by its folder."""
    path = _write_cleaned(spark, sf_dir)
    return sinks.read_run(spark, path, 7).select(*KEYS, *CONTRACT)


@query("dq_findings", with_views(f"""{_CLEAN_SQL}, checks AS (SELECT column_name, check_type, success FROM ({_NULLS}) UNION ALL SELECT column_name, check_type, success FROM ({_RANGES})
    UNION ALL SELECT 'returnflag', 'categorical', bool_and(r_known) FROM parsed WHERE NOT r_mark UNION ALL SELECT 'is_open', 'categorical', false FROM parsed WHERE NOT o_mark HAVING count(*) > 0)
  SELECT * FROM checks UNION ALL SELECT 'quantity', 'schema_type_mismatch', false FROM parsed HAVING count(*) FILTER (NOT q_mark AND q_num IS NULL) > 0
  UNION ALL SELECT 'discount', 'schema_type_mismatch', false FROM parsed HAVING count(*) FILTER (NOT d_mark AND d_num IS NULL) > 0
  UNION ALL SELECT 'is_open', 'schema_type_mismatch', false"""))
def dq_findings(spark, sf_dir):
    """Stored findings of the corrupted batch."""
    raw, contract = view(spark, sf_dir, "lineitem_raw"), rules(spark, sf_dir)
    found = sinks.dq_finding_rows(validate.all_checks(raw, contract), validate.check_schema_types(raw, contract))
    path = fresh_path(spark, "findings")
    sinks.append(found, path)
    return spark.read.parquet(path).select("column_name", "check_type", "success")


@query("dq_findings_by_run", with_views("""WITH b AS (SELECT run_id, list(column_name) AS cols FROM batch_columns GROUP BY run_id),
    m AS (SELECT model_id, list(DISTINCT column_name) AS cols FROM baseline_columns GROUP BY model_id),
    d AS (SELECT r.run_id, array_to_string(list_sort(list_filter(b.cols, lambda c: NOT list_contains(m.cols, c))), ', ') AS e, array_to_string(list_sort(list_filter(m.cols, lambda c: NOT list_contains(b.cols, c))), ', ') AS x
      FROM pipeline_runs r JOIN b ON r.run_id = b.run_id JOIN m ON r.model_id = m.model_id)
  SELECT run_id, 'extra_columns' AS check_type, e AS info FROM d WHERE e <> '' UNION ALL SELECT run_id, 'missing_columns', x FROM d WHERE x <> ''"""))
def dq_findings_by_run(spark, sf_dir):
    """Findings of many runs at once: extra and missing columns of each."""
    diffs = schema.schema_diff(*(view(spark, sf_dir, v) for v in ("batch_columns", "pipeline_runs", "baseline_columns")))
    empty = diffs.limit(0)
    checks = empty.select("run_id", F.lit("").alias("column_name"), F.lit("").alias("check_type"), F.lit(True).alias("success"),
                          F.lit("").alias("info"), F.lit("").alias("details"))
    types = empty.select("run_id", F.lit("").alias("column_name"), F.lit("").alias("expected_type"),
                         F.lit("").alias("actual_type"), F.lit(True).alias("compatible"))
    return sinks.dq_finding_rows(checks, types, diffs, ["run_id"]).select("run_id", "check_type", "info")


@query("prediction_log", """SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS STRING) IS NULL AS feature_missing, round(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 2 END, 6) AS value,
  2 AS feature_count FROM events""")
def prediction_log(spark, sf_dir):
    events = base(spark, sf_dir, "events")
    scored = events.select(
        "event_id", F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("value")).alias("f1"),
        F.col("user_id").alias("f2"), F.when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value") * 2).alias("p"),
    )
    log = sinks.prediction_log(scored, ["f1", "f2"], "p", ["event_id"])
    return log.select(
        "event_id", F.get("features", F.lit(0)).isNull().alias("feature_missing"), F.round("value", 6).alias("value"),
        F.size("features").cast("bigint").alias("feature_count"),
    )
