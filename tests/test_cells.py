"""Cell rules on the edge values."""

import pytest
from pyspark.sql import functions as F

from batchwatch.functions import cells, severity
from batchwatch.operators import clean
from batchwatch.operators.profile import ColumnRule


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")


def column(df, expr):
    return [r["o"] for r in df.select("i", expr.alias("o")).orderBy("i").collect()]


def test_missing_markers(spark):
    df = texts(spark, "", " ", "NA", "n/a", "Null", "none", "NaN", "nil", None)
    assert column(df, cells.is_missing_marker(F.col("c"))) == [True] * 7 + [False, False]


def test_numbers(spark):
    good = {" 12 ": 12.0, "1e3": 1000.0, "-.5": -0.5, "+3": 3.0, "inf": float("inf"), "5.": 5.0}
    bad = ["1_000", "0x10", "1d", "1.5f", "True", "1L", "", "nan", "1e", "."]
    assert column(texts(spark, *good), cells.to_number(F.col("c"))) == list(good.values())
    assert column(texts(spark, *bad), cells.to_number(F.col("c"))) == [None] * len(bad)


def test_booleans(spark):
    df = texts(spark, "TRUE", "1", "y", "T", "No", "0", "f", "maybe", None)
    assert column(df, cells.to_boolean(F.col("c"))) == [True] * 4 + [False] * 3 + [None, None]
    rule = clean.sanitize_boolean(F.col("c"), df.schema["c"].dataType)
    assert column(df, rule.issue) == [False] * 7 + [True, False]


def test_identifiers(spark):
    names = {"id": True, "user_id": True, "UUID": True, "key": True, "paid": True, "custkey": False, " Key ": True}
    assert column(texts(spark, *names), cells.is_identifier_col(F.col("c"))) == list(names.values())
    assert [cells.is_identifier(n) for n in names] == list(names.values())


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 2.5), (3, -0.5)], "i int, c double")
    assert column(df, clean.coerced(ColumnRule("c", "int"), F.col("c"))) == [0, 2, 2, 0]


def test_finite(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, float("inf")), (2, -float("inf")), (3, 1.5)], "i int, c double")
    assert column(df, cells.finite(F.col("c"))) == [None, None, None, 1.5]


@pytest.mark.parametrize("score,level", [(0.1999, "low"), (0.2, "medium"), (0.3, "high"), (0.5, "critical"), (0.0, "low")])
def test_severity_edges(spark, score, level):
    assert column(spark.createDataFrame([(0, score)], "i int, c double"), severity.of_drift_score(F.col("c"))) == [level]


def test_severity_scale(spark):
    df = texts(spark, "Critical", "HIGH", "medium", "low", "odd", None)
    assert column(df, severity.rank(F.col("c"))) == [3, 2, 1, 0, 0, 0]
    assert df.agg(severity.worst(F.col("c")).alias("w")).first()["w"] == "critical"
