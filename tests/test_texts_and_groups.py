"""Text rules, group status, primary incidents, sources and explanations on small literal rows."""

import pytest
from pyspark.sql import functions as F

from batchwatch.operators import incidents, lookups, signals
from batchwatch.sources import readers


def parse(spark, text):
    return signals.parse_notes(spark.createDataFrame([(text,)], "text string")).first()


def test_json_keys_are_not_words(spark):
    row = parse(spark, 'Fine. ```json\n{"failure_types": [], "severity": "low"}\n``` ')
    assert (row["failure_types"], row["severity"]) == ([], "low")


@pytest.mark.parametrize("text,kinds", [
    ("orange juice", ["RANGE_VIOLATION"]), ("no issues", []), ("it did fail", ["DATA_QUALITY"]),
    ("data drift and null spike", ["DATA_DRIFT", "NULL_SPIKE"]), ('{"failure_types": "concept-drift"}', ["CONCEPT_DRIFT"]),
    ('{"failure_types": ["data drift", "DATA_DRIFT", "x"]', ["DATA_DRIFT"]), ("", [])])
def test_failure_types(spark, text, kinds):
    assert parse(spark, text)["failure_types"] == kinds


def test_note_fields(spark):
    row = parse(spark, "First  part. Second. HIGH and critical")
    assert row["summary"] == "First part" and row["severity"] == "critical"
    assert parse(spark, "")["summary"] == signals.NO_TEXT
    assert len(parse(spark, "x" * 900)["summary"]) == 240


def group(spark, *rows):
    df = spark.createDataFrame(
        [(i, 1, *r) for i, r in enumerate(rows)],
        "id int, run_id int, failure_type string, severity string, status string, title string, description string",
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    return incidents.incident_groups(df).first()


@pytest.mark.parametrize("states,want", [(["open", "resolved"], "open"), (["investigating", "resolved"], "investigating"), (["resolved"], "resolved")])
def test_group_status(spark, states, want):
    assert group(spark, *[("data_drift", "low", s, "t", "d") for s in states])["status"] == want


def test_primary(spark):
    both = group(spark, ("ai_root_cause", "low", "open", "one", "{}"), ("ai_root_cause", "low", "open", "two", '{"summary": "S"}'),
                 ("data_drift", "critical", "open", "t", "d"))
    assert (both["primary_incident_id"], both["title"], both["summary"], both["severity"]) == (1, "two", "S", "critical")
    plain = group(spark, ("data_drift", "high", "open", "t", "a"), ("other", "high", "open", "t", " b  c "))
    assert (plain["primary_incident_id"], plain["summary"]) == (1, "b c Signals: data_drift, other.")


def test_delta(spark):
    s = "id int, run_id int, severity string, status string"
    before = spark.createDataFrame([(1, 1, "low", "open"), (2, 1, "low", "resolved"), (3, 2, "low", "open"), (4, 2, "low", "open")], s)
    after = spark.createDataFrame([(1, 1, "low", "resolved"), (2, 1, "critical", "open"), (3, 2, "low", "open"), (5, 3, "critical", "open"), (6, 4, "low", "resolved")], s)
    rows = {r["run_id"]: tuple(r)[1:] for r in lookups.incident_delta(before, after).collect()}
    assert rows == {1: (1, 1, 1), 3: (1, 1, 0)}


def test_alert_text(spark):
    df = spark.createDataFrame([('{"recommendation": " do  it "}',), ("a " * 400,), (None,), ("{broken",)], "d string")
    out = [r["t"] for r in df.select(incidents.alert_text(F.col("d")).alias("t")).collect()]
    assert out[0] == "do it" and len(out[1]) == 500 and out[1].endswith("...") and out[2:] == ["", "{broken"]


def test_drift_signal_text(spark):
    q = spark.createDataFrame([], "run_id int, success boolean, check_type string, column_name string")
    d = spark.createDataFrame([(1, True, "price", "high", 0.5, 0.25, 0.125)], "run_id int, drift_detected boolean, feature_name string, severity string, drift_score double, psi_score double, ks_score double")
    row = signals.describe(signals.build_signals(q, d)).first()
    assert (row["title"], row["explanation"]) == ("price distribution drifted", "Current distribution differs from baseline; PSI=0.25, KS=0.125.")


def test_unknown_file_kind(spark):
    assert readers.file_kind("/a/B.CSV") == ".csv"
    with pytest.raises(ValueError):
        readers.load_batch(spark, "/tmp/x.xlsx")


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert readers.load_json_array(spark, str(tmp_path / "a.json")).count() == 2


def test_csv_inference_ignores_partitioning(spark, tmp_path):
    path = str(tmp_path / "b.csv")
    spark.range(100).select(F.when(F.col("id") == 99, "x").otherwise(F.col("id").cast("string")).alias("a"), F.lit("true").alias("f")).repartition(7).write.option("header", True).csv(path)
    assert dict(readers.load_typed(spark, path).dtypes) == {"a": "string", "f": "boolean"}


def test_all_stored_unseen_values_reach_the_signal(spark):
    """A finding keeps 20 values; those stored as rows of their own are joined back, and make no signals themselves."""
    rows = [(1, "state", "categorical", False, "unseen", '{"unseen_sample": ["v00"]}'), (1, "other", "categorical", False, "unseen", '{"unseen_sample": ["w"]}')]
    rows += [(1, "state", "unseen_value", None, f"v{i:02d}", "{}") for i in range(50)]
    quality = spark.createDataFrame(rows, "run_id long, column_name string, check_type string, success boolean, info string, details string")
    drift = spark.createDataFrame([], "run_id long, feature_name string, drift_detected boolean, severity string, drift_score double")
    found = {r["column_name"]: r["unseen_values"] for r in signals.build_signals(quality, drift).collect()}
    assert found == {"state": [f"v{i:02d}" for i in range(50)], "other": ["w"]}
