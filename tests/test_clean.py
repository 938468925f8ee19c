"""Cleaning edges and invariants."""

import pytest
from pyspark.sql import functions as F

from batchwatch.operators import clean, profile, validate
from batchwatch.operators.profile import ColumnRule

TEN = [ColumnRule(f"c{i}", "float") for i in range(10)]


def ten(spark, bad, null=0):
    row = ["x"] * bad + [None] * null + ["1"] * (10 - bad - null)
    return spark.createDataFrame([tuple(row)], ", ".join(f"c{i} string" for i in range(10)))


@pytest.mark.parametrize("bad,null,gone", [(7, 0, True), (6, 0, False), (6, 4, False), (0, 10, False)])
def test_quarantine_edge(spark, bad, null, gone):
    row = clean.flag_rows(ten(spark, bad, null), TEN).first()
    assert (row["issue_count"], row["is_quarantined"]) == (bad, gone)


@pytest.mark.parametrize("known,want", [
    ({"median": 4.0, "mean": 9.0, "min": 0.0, "max": 2.0}, 4.0), ({"mean": 9.0, "min": 0.0, "max": 2.0}, 9.0),
    ({"min": 0.0, "max": 3.0}, 1.5), ({}, 0.0)])
def test_imputation_chain(spark, known, want):
    rule = ColumnRule("a", "float", **known)
    df = spark.createDataFrame([(None, 1), (None, 2)], "a string, i int")
    out = clean.clean_batch(clean.flag_rows(df, [rule], ["i"]), [rule], keep=["i"]).collect()
    assert [r["a"] for r in out] == [want, want]


def test_text_fills(spark):
    rules = [
        ColumnRule("user_id", "object"), ColumnRule("note", "object"),
        ColumnRule("grade", "object", "categorical", "enum", unique_values=("A", "B")), ColumnRule("ok", "bool"),
    ]
    df = spark.createDataFrame(
        [(None, "NA", " b ", None), ("7", " hi ", "zz", "maybe"), ("8", "yo", None, None)],
        "user_id string, note string, grade string, ok string",
    )
    out = clean.clean_batch(clean.flag_rows(df, rules), rules).collect()
    assert [tuple(r) for r in out] == [("UNKNOWN_ID", "UNKNOWN", "B", False), ("7", "hi", "B", False), ("8", "yo", "B", False)]


def test_mode_tie_takes_the_smallest(spark):
    rule = ColumnRule("g", "object", "categorical", "enum", unique_values=("A", "B"))
    df = spark.createDataFrame([("B",), ("A",), (None,)], "g string")
    out = clean.clean_batch(clean.flag_rows(df, [rule]), [rule]).collect()
    assert sorted(r["g"] for r in out) == ["A", "A", "B"]


@pytest.fixture(scope="module")
def batch(spark):
    clean_rows = spark.range(300).select(
        (F.col("id") % 30).cast("double").alias("x"), F.element_at(F.array(F.lit("u"), F.lit("v")), (F.col("id") % 2 + 1).cast("int")).alias("g"))
    rules = profile.load_rules(profile.create_baseline(clean_rows), ["x", "g"])
    dirty = clean_rows.select(
        F.when(F.col("x") == 3, "bad").when(F.col("x") == 4, "9e9").otherwise(F.col("x").cast("string")).alias("x"),
        F.when(F.col("x").isin(3, 9), "w").otherwise(F.col("g")).alias("g"))
    return clean_rows, rules, dirty


def test_rows_are_kept_or_quarantined(spark, batch):
    _, rules, dirty = batch
    flagged = clean.flag_rows(dirty, rules)
    audit = clean.cleaning_audit(flagged).first()
    kept, gone = clean.clean_batch(flagged, rules), clean.quarantined(flagged, rules)
    assert audit["rows_in"] == 300 == kept.count() + gone.count()
    assert audit["rows_out"] == kept.count() and gone.count() == 10
    assert kept.filter("x IS NULL OR g IS NULL").count() == 0


def test_clean_data_passes_and_cleaning_is_stable(spark, batch):
    _, rules, dirty = batch
    once = clean.clean_batch(clean.flag_rows(dirty, rules), rules)
    twice = clean.clean_batch(clean.flag_rows(once, rules), rules)
    assert once.exceptAll(twice).count() == 0 and twice.count() == once.count()
    checks = validate.all_checks(once, rules)
    assert checks.filter("NOT success").count() == 0 and checks.count() == 4


def test_documented_scenario(spark):
    """A small batch where only heavily broken rows leave: 53 in, 49 accepted, 4 quarantined."""
    rules = [ColumnRule(f"f{i}", "float", "numeric", min=0.0, max=100.0, p01=0.0, p99=100.0, median=50.0) for i in range(4)]
    rows = [tuple(str(i + j) for j in range(4)) for i in range(49)] + [("x", "NA", "999", "1")] * 4
    df = spark.createDataFrame(rows, "f0 string, f1 string, f2 string, f3 string")
    flagged = clean.flag_rows(df, rules)
    audit = clean.cleaning_audit(flagged).first()
    assert (audit["rows_in"], audit["rows_out"], audit["rows_removed"]) == (53, 49, 4)


def test_scoring_projection(spark):
    df = spark.createDataFrame([(1, "a", None, 2.5)], "Id int, t string, B double, c double")
    assert clean.scoring_features(df, ["b", "ID", "zz"]).columns == ["B", "Id"]
    assert tuple(clean.scoring_features(df).first()) == (1.0, 0.0, 2.5)
