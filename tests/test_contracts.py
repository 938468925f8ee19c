"""Gate, type checks, schema matching, candidates, versions and policy."""

import random

import pytest
from pyspark.sql import functions as F

from batchwatch.operators import profile, registry, remediation, retrain, schema, validate
from batchwatch.operators.profile import ColumnRule

GATE = "cleaned_rows bigint, total_rows bigint, missing_columns int, schema_errors int, failed_checks int"


@pytest.mark.parametrize("row,status,reasons", [
    ((49, 53, 0, 0, 0), "success", 0), ((49, 53, 1, 0, 0), "failed", 1), ((0, 53, 0, 0, 0), "failed", 3),
    ((49, 53, 0, 0, 2), "failed", 1), ((4999, 10000, 0, 0, 0), "failed", 1), ((5000, 10000, 0, 0, 0), "success", 0),
    ((9, 9, 0, 0, 0), "failed", 1), ((10, 10, 0, 0, 0), "success", 0), ((49, 53, 0, 1, 0), "failed", 1)])
def test_gate(spark, row, status, reasons):
    out = validate.quality_gate(spark.createDataFrame([row], GATE)).first()
    assert (out["status"], len(out["blocking_reasons"])) == (status, reasons)


def test_gate_texts(spark):
    out = validate.quality_gate(spark.createDataFrame([(4, 53, 0, 0, 2)], GATE)).first()["blocking_reasons"]
    assert out[0].endswith("(4 < 10).") and out[1].endswith("(7.55% < 50%).") and "failed 2 validation checks" in out[2]


def test_types(spark):
    df = spark.createDataFrame([("1", "1.0", "a", "1.5", None), ("2", "3", "b", "2", None)], "i string, f string, t string, h string, n string")
    want = {"i": "float", "f": "int", "t": "float", "h": "int", "n": "bool"}
    rows = validate.check_schema_types(df, [ColumnRule(c, t) for c, t in want.items()]).collect()
    assert {r["column_name"]: r["compatible"] for r in rows} == {"i": True, "f": True, "t": False, "h": False, "n": False}


def test_empty_batch_null_ratio(spark):
    row = validate.check_null_ratio(spark.createDataFrame([], "a string"), [ColumnRule("a", "float")]).first()
    assert (row["ratio"], row["success"]) == (1.0, False)


def match(spark, columns, contracts):
    batch = spark.createDataFrame([(1, c) for c in columns], "run_id int, column_name string")
    known = spark.createDataFrame([(m, c) for m, cs in contracts.items() for c in cs], "model_id int, column_name string")
    row = schema.match_model(batch, known).first()
    return row["status"], row["model_id"], row["score"]


CONTRACTS = {10: ["order_id", "price", "qty", "flag"], 20: ["a", "b"], 30: ["a", "b"]}


@pytest.mark.parametrize("columns,want", [
    (["order_id", "Price", "qty", "flag"], ("matched", 10, 4.0)), (["order_id", "price", "qty", "flag", "mood"], ("matched", 10, 3.75)),
    (["order_id", "price", "qty"], ("matched", 10, 1.0)), (["a", "b"], ("ambiguous", None, 2.0)),
    (["x", "y"], ("no_match", None, None)), (["qty"], ("no_match", None, None))])
def test_match_model(spark, columns, want):
    """The last case: the contract that shares a column misses three others, so a small stranger scores higher."""
    assert match(spark, columns, CONTRACTS) == want


@pytest.mark.parametrize("common", [0, 2, 64])
def test_match_model_against_all_pairs(spark, common):
    """Random sets over a few common and many rare columns, whatever counts as common."""
    rng = random.Random(11)
    names = [f"c{i}" for i in range(6)] + [f"r{i}" for i in range(60)]
    draw = lambda: frozenset(rng.sample(names[:6], rng.randrange(0, 5)) + rng.sample(names[6:], rng.randrange(0, 3))) or frozenset(["c0"])
    contracts, batches = {i: draw() for i in range(120)}, {i: draw() for i in range(150)}
    rows = lambda sets, key: spark.createDataFrame([(k, c) for k, s in sets.items() for c in s], f"{key} int, column_name string")
    found = {r["run_id"]: tuple(r)[1:] for r in schema.match_model(rows(batches, "run_id"), rows(contracts, "model_id"), common).collect()}
    for run, have in batches.items():
        scores = {m: len(have & want) - 2.0 * len(want - have) - 0.25 * len(have - want) for m, want in contracts.items()}
        best = max((s for m, s in scores.items() if have & contracts[m]), default=None)
        top = [m for m, s in scores.items() if s == best] if best is not None else []
        if best is None or max(scores.values()) > best:
            assert found[run] == ("no_match", None, None, None)
        else:
            n = max(len(have & contracts[m]) for m in top if have & contracts[m])
            assert found[run] == ("matched" if len(top) == 1 else "ambiguous", top[0] if len(top) == 1 else None, best, n)


def test_a_column_of_all_contracts_makes_no_pairs(spark):
    """Every set holds ``id``: candidates grow with the sets, not with their product."""
    sets = lambda n, tag: spark.range(n).select(F.array(F.lit("id"), F.concat(F.lit(tag), (F.col("id") / 2).cast("int").cast("string"))).alias("column_set"), F.col("id").alias("model_id"), F.lit(1).alias("model_count"))
    for n in (200, 400):
        contracts = sets(n, "x").dropDuplicates(["column_set"])
        index = schema.contract_index(contracts, schema.common_columns(contracts, 64))
        batches = sets(n, "x").select(F.array_append("column_set", F.lit("more")).alias("column_set")).distinct().withColumn("pattern", F.array(F.lit("id")))
        assert schema.rare_pairs(batches, index).count() == n / 2 and schema.pattern_pairs(batches, index).count() == 1



@pytest.mark.parametrize("rows,distinct,want", [
    (49, 49, "categorical_feature"), (50, 50, "high_cardinality_text"), (1000, 199, "categorical_feature"),
    (1000, 200, "high_cardinality_text"), (50, 9, "categorical_feature"), (50, 10, "high_cardinality_text")])
def test_candidate_edges(spark, rows, distinct, want):
    df = spark.range(rows).select(F.concat(F.lit("v"), (F.col("id") % distinct).cast("string")).alias("c"))
    assert schema.feature_candidates(df, ["c"]).first()["semantic_type"] == want


def test_baseline_of_identifiers_and_text(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("row_id"), F.col("id").cast("string").alias("free"), (F.col("id") % 2).cast("string").alias("g"))
    rows = {r["column_name"]: r for r in profile.create_baseline(df).collect()}
    assert rows["row_id"]["validation_mode"] == "identifier" and rows["row_id"]["unique_values"] is None
    assert rows["free"]["validation_mode"] == "high_cardinality" and len(rows["free"]["sample_values"]) == 20
    assert rows["g"]["unique_values"] == ["0", "1"]


def test_profile_paths_agree(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 1009).cast("double").alias("x"))
    exact, close = profile.profile_numeric(df, ["x"]).first(), profile.profile_numeric(df, ["x"], approximate=True).first()
    for name in ("min", "max", "mean", "median", "p01", "p99"):
        assert close[name] == pytest.approx(exact[name], abs=2.0)


def test_version_baselines_on_a_hot_model(spark):
    ups = spark.range(2000).select("id", F.when(F.col("id") % 4 > 0, 1).otherwise(2).alias("model_id"), F.lit(False).alias("approved"))
    old = spark.createDataFrame([(2, 5, True, "approved")], "model_id int, version int, is_active boolean, status string")
    out = registry.version_baselines(ups, old, buckets=8)
    one = out.filter("model_id = 1").agg(F.min("version"), F.max("version"), F.count_distinct("version"), F.count_if("is_active")).first()
    assert tuple(one) == (1, 1500, 1500, 1)
    assert out.filter("model_id = 2 AND (is_active OR version < 6)").count() == 0


@pytest.mark.parametrize("severity,kinds,want", [
    ("critical", ["DATA_DRIFT"], "manual_investigation"), ("high", ["DATA_DRIFT"], "retrain_model"), ("low", ["concept_drift"], "retrain_model"),
    ("high", ["DATA_DRIFT", "NULL_SPIKE"], "manual_data_correction"), ("high", ["OTHER"], "manual_review"),
    ("medium", [], "review_and_refresh_baseline"), ("low", [], "observe"), (None, [], "review_and_refresh_baseline")])
def test_policy(spark, severity, kinds, want):
    df = spark.createDataFrame([(severity, kinds)], "severity string, failure_types array<string>")
    assert remediation.remediation_policy(df).first()["action_type"] == want


def test_report_fields_cover_all_states(spark):
    df = spark.createDataFrame([(s,) for s in remediation.REPORT_STATUS], "status string")
    out = remediation.report_fields(df)
    assert out.filter("report_status IS NULL OR action_taken IS NULL").count() == 0 and out.count() == 12


@pytest.mark.parametrize("values,task,problem", [
    ([i % 20 for i in range(100)], "classification", False), ([i % 21 for i in range(100)], "regression", False),
    ([f"t{i % 21}" for i in range(100)], None, True), ([f"t{i % 18}" for i in range(50)], None, True), ([1] * 9, None, True),
    ([True, False] * 5, "classification", False)])
def test_task_type(spark, values, task, problem):
    df = spark.createDataFrame([(v,) for v in values], ["y"])
    row = retrain.infer_task_type(retrain.target_profile(df, ["y"])).first()
    assert row["task_type"] == task and (row["problem"] is not None) == problem


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").otherwise("b").alias("y"))
    first, second = (retrain.stratified_split(df.repartition(n), "y", "id") for n in (1, 7))
    assert first.exceptAll(second).count() == 0
    assert {(r["y"], r["n"]) for r in first.filter("split = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()} == {("a", 140), ("b", 60)}


def test_small_training_frame_trains(spark):
    df = spark.range(30).select(F.col("id").cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 2).cast("double").alias("label"))
    model = retrain.fit_supervised(df, ["a", "b"], [], "label", trees=3)
    row = retrain.classification_metrics(retrain.score_batch(model, df, ["a", "b"], []), "label", "prediction").first()
    assert 0.0 <= row["accuracy"] <= 1.0 and row["row_count"] == 30
