"""Rules as data: many models in one job give what each gives alone, with a hot model and rows that no rule fits."""

import pytest
from pyspark.sql import functions as F

from batchwatch.operators import clean, many, profile

COLUMNS = ("qty", "state", "ok", "note", "order_id")


@pytest.fixture(scope="module")
def trusted(spark):
    rows = spark.range(600).select(
        F.when(F.col("id") < 540, "hot").otherwise(F.concat(F.lit("m"), (F.col("id") % 3).cast("string"))).alias("model_id"),
        (F.col("id") % 40).cast("bigint").alias("qty"), F.when(F.col("id") % 2 == 0, "A").otherwise("b").alias("state"), (F.col("id") % 3 == 0).alias("ok"),
        F.concat(F.lit("n"), "id").alias("note"), F.col("id").cast("string").alias("order_id"),
    )
    return rows.cache()


@pytest.fixture(scope="module")
def batch(spark, trusted):
    bad = F.col("order_id").cast("int")
    return trusted.select(
        "model_id", (bad % 2).alias("run"), bad.alias("row_id"),
        F.when(bad % 10 == 0, " n/a ").when(bad % 7 == 0, "x").when(bad % 11 == 0, "9999").otherwise(F.col("qty").cast("string")).alias("qty"),
        F.when(bad % 10 == 0, "").when(bad % 13 == 0, "zz").otherwise(F.col("state")).alias("state"),
        F.when(bad % 10 == 0, "perhaps").otherwise(F.when(F.col("ok"), "Yes").otherwise("0")).alias("ok"),
        F.when(bad % 10 == 0, "NULL").when(bad % 9 != 0, F.col("note")).alias("note"), F.col("order_id"),
    )


def cells(spark, batch, trusted, runs=()):
    rules = many.rule_table(profile.create_baseline(trusted, ["model_id"]))
    flagged = many.flag_rows(many.as_cells(batch, COLUMNS, ["model_id", "run", "row_id"]), rules)
    return flagged, rules


def test_each_model_as_alone(spark, batch, trusted):
    flagged, rules = cells(spark, batch, trusted)
    got = {r["row_id"]: r["cells"] for r in many.clean_by_model(flagged, rules, keep=["row_id"]).collect()}
    counts = {r["row_id"]: (r["issue_count"], r["is_quarantined"]) for r in flagged.collect()}
    for model in ("hot", "m0", "m2"):
        own = profile.load_rules(profile.create_baseline(trusted.filter(F.col("model_id") == model).drop("model_id")), COLUMNS)
        alone = clean.flag_rows(batch.filter(F.col("model_id") == model), own, ["row_id"])
        for r in alone.collect():
            assert counts[r["row_id"]] == (r["issue_count"], r["is_quarantined"])
        for r in clean.clean_batch(alone, own, keep=["row_id"]).collect():
            mine = got.pop(r["row_id"])
            assert int(mine["qty"]) == r["qty"] and (mine["state"], mine["ok"] == "true", mine["note"], mine["order_id"]) == (r["state"], r["ok"], r["note"], r["order_id"])
    assert {b for b in got if counts[b][1]} == set()


def test_rows_without_rules_and_odd_columns(spark, trusted):
    rules = many.rule_table(profile.create_baseline(trusted, ["model_id"]))
    rows = spark.createDataFrame([("hot", 1, "5", "A"), (None, 2, "5", "A"), ("new", 3, "5", "A"), ("hot", 4, None, " a ")], "model_id string, row_id int, qty string, state string")
    flagged = many.flag_rows(many.as_cells(rows.withColumn("extra", F.lit("?")), ["qty", "state", "extra"], ["model_id", "row_id"]), rules)
    assert {r["row_id"]: (r["issue_count"], r["is_quarantined"]) for r in flagged.collect()} == {1: (0, False), 2: (0, True), 3: (0, True), 4: (0, False)}
    final = {r["row_id"]: r["cells"] for r in many.clean_by_model(flagged, rules, keep=["row_id"]).collect()}
    assert set(final) == {1, 4} and final[4]["qty"] == "5" and final[4]["state"] == "A" and "extra" not in final[1] and final[1]["note"] == "UNKNOWN"
    assert {(r["column_name"], r["check_type"]) for r in many.checks_by_model(flagged).filter("model_id = 'hot'").collect()} == {
        ("qty", "null_ratio"), ("qty", "range"), ("state", "null_ratio"), ("state", "categorical")}


def test_runs_are_filled_apart(spark, trusted):
    rules = many.rule_table(profile.create_baseline(trusted, ["model_id"]))
    rows = [("hot", run, 10 * k + i, v) for k, (run, v) in enumerate([("r1", "1"), ("r1", "3"), ("r2", "30"), (None, "20")]) for i in range(2)]
    rows += [("hot", run, 100 + i, None) for i, run in enumerate(("r1", "r2", None))]
    batch = spark.createDataFrame(rows, "model_id string, run string, row_id int, qty string")
    flagged = many.flag_rows(many.as_cells(batch, ["qty"], ["model_id", "run", "row_id"]), rules)
    got = {r["row_id"]: r["cells"]["qty"] for r in many.clean_by_model(flagged, rules, runs=["run"], keep=["row_id"]).collect()}
    assert len(got) == 11 and [got[100 + i] for i in range(3)] == ["2", "30", "20"]


def test_a_hot_model_is_not_shuffled(spark, batch, trusted):
    """Rows of the hot model stay where they are: only rows of small models pass the exchange of the join."""
    flagged, _ = cells(spark, batch, trusted)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cells_are_parsed_once_and_checks_need_no_sort(spark, batch, trusted):
    flagged, _ = cells(spark, batch, trusted)
    text = F.col("cells")["qty"]
    judged = flagged.select(many.judged(text, F.col("rules")["qty"]).alias("j"))
    assert judged._jdf.queryExecution().optimizedPlan().toString().split("Project")[1].count("RLIKE") == 1
    plan = many.checks_by_model(flagged)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan.split("observed_min")[0] and "any_value(rule#" not in plan
