"""The composed batch run and runs that arrive in pieces."""

import json

import pytest
from pyspark.sql import functions as F

from batchwatch.operators import run
from batchwatch.operators.profile import ColumnRule
from batchwatch.streaming import assemble

RULES = [ColumnRule(f"f{i}", "float", "numeric", min=0.0, max=100.0, p01=0.0, p99=100.0, median=50.0) for i in range(4)]
NAMES = ["f0", "f1", "f2", "f3"]
SCENARIO = [tuple(str(i + j) for j in range(4)) for i in range(49)] + [("x", "NA", "999", "1")] * 4


def present(spark, *pairs):
    return spark.createDataFrame([(r, c) for r, names in pairs for c in names], "run_id string, column_name string")


def by_run(result):
    return {r["run_id"]: r for r in result.collect()}


def test_documented_scenario_through_the_pipeline(spark):
    """53 rows in, 49 accepted, 4 quarantined, gate passed; next to it runs that are blocked for each other reason."""
    rows = [("good", *r) for r in SCENARIO] + [("lacks", *r[:3], None) for r in SCENARIO] + [("few", *r) for r in SCENARIO[:5]]
    rows += [("broken", "x", "NA", "999", "-1")] * 12 + [("half", *r) for r in SCENARIO[:10]] + [("half", "x", "NA", "999", "1")] * 11
    df = spark.createDataFrame(rows, "run_id string, f0 string, f1 string, f2 string, f3 string")
    runs = spark.createDataFrame([(r,) for r in ("good", "lacks", "few", "broken", "half", "empty")], "run_id string")
    have = present(spark, ("good", [*NAMES, "more"]), ("lacks", NAMES[:3]), *[(r, NAMES) for r in ("few", "broken", "half", "empty")])
    result = run.run_batches(runs, df, have, RULES)
    found = by_run(result.runs)
    good = found["good"]
    assert (good["total_rows"], good["cleaned_rows"], good["rows_removed"], good["status"]) == (53, 49, 4, "success")
    assert good["extra_columns"] == ["more"] and found["lacks"]["missing_columns"] == ["f3"] and not good["blocking_reasons"]
    reasons = {r: len(found[r]["blocking_reasons"]) for r in found}
    assert reasons == {"good": 0, "lacks": 1, "few": 1, "broken": 3, "half": 1, "empty": 2}
    assert "retained too few rows" in found["half"]["blocking_reasons"][0] and all(found[r]["status"] == "failed" for r in reasons if r != "good")
    assert {r["run_id"] for r in run.usable(result).select("run_id").distinct().collect()} == {"good"}
    kinds = {(r["run_id"], r["check_type"]) for r in result.findings.filter("NOT success").collect()}
    assert ("good", "extra_columns") in kinds and ("lacks", "missing_columns") in kinds and ("good", "range") in kinds
    assert result.quarantined.filter("run_id = 'good'").count() == 4


def test_gate_sees_what_cleaning_cannot_mend(spark):
    """A date column that arrives as text stays a type mismatch; one with many gaps fails the null check after cleaning."""
    rules = [RULES[0], ColumnRule("day", "datetime")]
    texts = spark.createDataFrame([("r", str(i), "2024-01-01") for i in range(20)], "run_id string, f0 string, day string")
    runs = texts.select("run_id").distinct()
    row = run.run_batches(runs, texts, present(spark, ("r", ["f0", "day"])), rules).runs.first()
    assert row["schema_errors"] == 1 and row["blocking_reasons"] == ["The cleaned dataset still has schema/type mismatches after coercion."]
    gaps = texts.withColumn("day", F.when(F.col("f0").cast("int") < 10, F.lit("2024-01-01").cast("timestamp_ntz")))
    row = run.run_batches(runs, gaps, present(spark, ("r", ["f0", "day"])), rules).runs.first()
    assert row["failed_checks"] == 1 and row["status"] == "failed" and row["schema_errors"] == 0


@pytest.fixture
def folder(tmp_path):
    def put(run_id, name, rows, names=NAMES):
        path = tmp_path / "in" / run_id
        path.mkdir(parents=True, exist_ok=True)
        order = [NAMES.index(c) for c in names if c in NAMES]
        text = "\n".join([",".join(names), *[",".join(r[i] for i in order) for r in rows]]) if rows is not None else ""
        (path / name).write_text(text)

    def manifest(run_id, *names):
        (tmp_path / "in" / run_id).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / run_id / "manifest.json").write_text(json.dumps({"files": names}))

    return put, manifest, str(tmp_path / "in"), str(tmp_path / "work")


def test_a_run_in_two_triggers_equals_the_batch(spark, folder):
    put, manifest, path, work = folder
    put("a", "1.csv", SCENARIO[:30])
    put("b", "1.csv", SCENARIO[:12])
    manifest("a", "1.csv", "2.csv")
    manifest("b", "1.csv")
    first = by_run(assemble.ingest_runs(spark, path, RULES, work))
    assert first["b"]["status"] == "success" and (first["a"]["status"], first["a"]["blocking_reasons"]) == ("waiting", ["File is missing or empty: 2.csv"])
    put("a", "2.csv", SCENARIO[30:], NAMES[::-1])  # columns in another order
    second = by_run(assemble.ingest_runs(spark, path, RULES, work))
    assert set(second) == {"a", "b"}
    whole = spark.createDataFrame([("a", *r) for r in SCENARIO], "run_id string, f0 string, f1 string, f2 string, f3 string")
    want = run.run_batches(whole.select("run_id").distinct(), whole, present(spark, ("a", NAMES)), RULES)
    assert second["a"] == want.runs.first() and second["a"]["cleaned_rows"] == 49
    stored = spark.read.parquet(f"{work}/accepted").filter("run_id = 'a'").select("run_id", *NAMES)
    assert stored.exceptAll(want.accepted.select("run_id", *NAMES)).count() == 0 and stored.count() == 49
    assert by_run(assemble.ingest_runs(spark, path, RULES, work)) == second  # nothing new, nothing again


def test_files_that_cannot_be_read_get_a_ledger_row(spark, folder):
    put, manifest, path, work = folder
    for name in ("empty", "blank", "odd", "twice", "bare", "fine"):
        manifest(name, "1.csv" if name != "odd" else "1.xls")
    put("empty", "1.csv", None)
    put("blank", "1.csv", [], [" "])
    put("odd", "1.xls", SCENARIO[:20])
    put("twice", "1.csv", SCENARIO[:20], ["f0", "f0", "f1"])
    put("bare", "1.csv", [])
    put("fine", "1.csv", SCENARIO[:20], ["f2", "f0", "f3", "f1"])
    put("late", "1.csv", SCENARIO[:20])  # no manifest: held back
    found = by_run(assemble.ingest_runs(spark, path, RULES, work))
    assert set(found) == {"empty", "blank", "odd", "twice", "bare", "fine"}
    assert {r: found[r]["status"] for r in found} == {"empty": "waiting", "blank": "unreadable", "odd": "unreadable", "twice": "unreadable", "bare": "failed", "fine": "success"}
    assert found["empty"]["blocking_reasons"] == ["File is missing or empty: 1.csv"] and found["blank"]["blocking_reasons"] == ["File is empty: 1.csv"] and found["odd"]["blocking_reasons"] == ["Unsupported file type: 1.xls"]
    assert found["bare"]["total_rows"] == 0 and found["fine"]["cleaned_rows"] == 20


def test_rows_behind_a_run_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(value):
        seen.add(1)
        return value

    df = spark.createDataFrame([("good", *r) for r in SCENARIO], "run_id string, f0 string, f1 string, f2 string, f3 string")
    result = run.run_batches(df.select("run_id").distinct(), df.withColumn("f0", costly("f0")), present(spark, ("good", NAMES)), RULES)
    assert (by_run(result.runs)["good"]["cleaned_rows"], result.quarantined.count()) == (49, 4)
    assert seen.value == len(SCENARIO)
