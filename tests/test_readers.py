"""Files as people write them: quotes, line breaks, header order, big integers, arrays of records."""

import pytest

from batchwatch.operators import clean, profile, retrain, signals, validate
from batchwatch.sources import readers, sinks, storage
from batchwatch.streaming import ingest


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_quotes_and_line_breaks_in_cells(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b\n1,"say ""hi"", twice"\n2,"two\nlines"\n')
    assert [tuple(r) for r in readers.load_batch(spark, path).collect()] == [("1", 'say "hi", twice'), ("2", "two\nlines")]


def test_records_that_do_not_fit_are_returned(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b\n1,2\n3,4,5\n6\n")
    assert [tuple(r) for r in readers.load_batch(spark, path).collect()] == [("1", "2"), ("3", "4"), ("6", None)]
    assert sorted(r[readers.CORRUPT_COLUMN] for r in readers.unfitting_records(spark, path).collect()) == ["3,4,5", "6"]


def test_header_in_another_order_fails(spark, tmp_path):
    path = write(tmp_path, "a.csv", "b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.load_batch(spark, path, columns=["a", "b"]).collect()


def test_integers_beyond_64_bits_stay(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b\n12345678901234567890,1\n1,2\n")
    df = readers.load_typed(spark, path)
    assert dict(df.dtypes) == {"a": "string", "b": "bigint"} and [r["a"] for r in df.collect()] == ["12345678901234567890", "1"]


@pytest.mark.parametrize("text", ['[\n {"a": 1,\n  "b": "x"},\n {"a": 2, "b": "y"}\n]', '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]', '{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n'])
def test_json_as_array_or_lines(spark, tmp_path, text):
    path = write(tmp_path, "a.json", text)
    assert [tuple(r) for r in readers.load_batch(spark, path).collect()] == [(1, "x"), (2, "y")]


class Session:
    """A session as :func:`storage.shared_root` sees it."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.master, self.conf = self, master, {} if folder is None else {"spark.checkpoint.dir": folder}

    def getConf(self):
        return self.conf


def test_a_cluster_needs_a_shared_folder():
    assert storage.shared_root(Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_root(Session("spark://host:7077"))


def test_text_labels_and_numbers_can_be_learned(spark):
    rows = [(i, float(i % 5), "red" if i % 2 else "blue", "yes" if i % 2 else "no", i * 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, c string, label string, y double")
    model = retrain.fit_supervised(df, ["x"], ["c"], "label")
    unknown = df.drop("label").union(spark.createDataFrame([(99, 1.0, "green", 0.0)], "id long, x double, c string, y double"))
    scored = retrain.score_batch(model, unknown, ["x"], ["c"]).collect()
    assert all(r["predicted_label"] == ("yes" if r["id"] % 2 else "no") for r in scored if r["id"] < 60) and len(scored) == 61
    fitted = retrain.score_batch(retrain.fit_supervised(df, ["id"], [], "y", "regression"), df, ["id"], [])
    assert retrain.regression_metrics(fitted, "y", "prediction").first()["r2"] > 0.9


@pytest.fixture(scope="module")
def contract(spark):
    trusted = spark.createDataFrame([(float(i), "AB"[i % 2]) for i in range(60)], "x double, c string")
    return profile.load_rules(profile.create_baseline(trusted), trusted.columns)


def test_stored_findings_feed_the_signals(spark, contract, tmp_path):
    batch = spark.createDataFrame([(900.0, f"V{i:02d}") for i in range(30)], "x double, c string")
    checks, types = validate.all_checks(batch, contract), validate.check_schema_types(batch, contract)
    sinks.append(sinks.dq_finding_rows(checks, types, unseen=validate.unseen_values(batch, contract)), str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    assert stored.filter("check_type = 'unseen_value'").count() == 30
    drift = spark.createDataFrame([], "run_id long, feature_name string, drift_detected boolean, severity string, drift_score double, psi_score double, ks_score double")
    changes = spark.createDataFrame([(1, "new_column", "a"), (1, "new_column", "b"), (1, "removed_column", "d")], "run_id long, change_type string, column_name string")
    found = signals.describe(signals.build_signals(stored.selectExpr("1L AS run_id", "*"), drift, changes))
    said = {(r["type"], r["column_name"]): r for r in found.collect()}
    assert said["range", "x"]["explanation"].startswith("Observed range 900.0-900.0 versus baseline ")
    assert said["categorical", "c"]["explanation"].startswith("Unseen values: ['V00', 'V01', ")
    assert said["extra_columns", None]["columns"] == ["a", "b"] and said["missing_columns", None]["columns"] == ["d"]
    assert len(said) == found.count() and all(r["likely_cause"] and r["recommended_action"] for r in said.values())


def test_preview_and_empty_ledger(spark, contract, tmp_path):
    flagged = clean.flag_rows(spark.createDataFrame([("bad", "A", i) for i in range(30)], "x string, c string, k int"), contract, keep=["k"])
    assert clean.quarantine_preview(flagged, contract, ["k"]).count() <= clean.PREVIEW_ROWS
    (tmp_path / "in").mkdir()
    stream = ingest.incoming(spark, str(tmp_path / "in"), ["x", "c"])
    assert ingest.ingest(stream, contract, str(tmp_path / "work")).count() == 0


def test_folder_of_json_arrays_and_lines(spark, tmp_path):
    """Each file says for itself whether it is an array; no record is lost."""
    (tmp_path / "in").mkdir()
    write(tmp_path, "in/1.json", '[{"a": 1, "b": "x"},\n {"a": 2}]')
    write(tmp_path, "in/2.json", '{"a": 3}\n{"a": 4, "c": true}')
    write(tmp_path, "in/3.json", '\n  [{"a": 5}]')
    found = readers.load_json(spark, str(tmp_path / "in"))
    assert sorted(r["a"] for r in found.collect()) == [1, 2, 3, 4, 5] and found.columns == ["a", "b", "c"]
