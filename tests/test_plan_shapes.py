"""Plans keep their shape: pushed filters, pruned columns, shared shuffles."""

import re

from pyspark.sql import functions as F

from batchwatch.operators import profile
from batchwatch.plans import load_all, views

QUERIES = load_all().QUERIES


def plan(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    text = plan(QUERIES["scan_parquet"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in text


def test_drift_reads_and_shuffles_values_once(spark, sf_dir):
    final = plan(QUERIES["data_drift"](spark, sf_dir), run=True).split("== Initial Plan ==")[0]
    assert len(re.findall("FileScan", final)) == 1


def test_profile_reads_once(spark, sf_dir):
    final = plan(QUERIES["profile_numeric"](spark, sf_dir), run=True).split("== Initial Plan ==")[0]
    assert len(re.findall("FileScan", final)) == 1


def test_cell_rules_are_one_projection_chain(spark, sf_dir):
    text = plan(QUERIES["row_issue_counts"](spark, sf_dir))
    assert "Exchange" not in text
    assert text.count("RLIKE") == 2  # one number test per numeric column


def test_types_of_wide_tables_take_one_short_aggregate(spark):
    wide = spark.range(3).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(60)], "id", F.lit(None).cast("boolean").alias("none"))
    found = {r["column_name"]: tuple(r)[1:] for r in profile.extract_schema(wide).collect()}
    assert found["c7"] == ("int", 3, 3, 3, 3) and found["id"] == ("int", 3, 3, 3, 3) and found["none"] == ("bool", 3, 0, 0, 0)
    assert plan(profile.extract_schema(wide)).count("partial_count(") <= 8
    assert {tuple(r)[1:] for r in profile.extract_schema(wide.limit(0).select("c1")).collect()} == {("object", 0, 0, 0, 0)}


def test_shuffles_of_the_views_are_read_in_small_pieces(spark, sf_dir):
    spark.conf.unset(views.TASK_SIZE)
    QUERIES["approved_features"](spark, sf_dir)
    assert spark.conf.get(views.TASK_SIZE) == views.TASK_BYTES
    spark.conf.set(views.TASK_SIZE, "16m")
    QUERIES["run_rca"](spark, sf_dir)
    assert spark.conf.get(views.TASK_SIZE) == "16m"  # a size that the session names stays
    spark.conf.unset(views.TASK_SIZE)
