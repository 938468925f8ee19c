"""Bracketed histograms give the quantiles, PSI and KS of all values, and hold few of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_drift import CASES, numpy_ks, numpy_psi

from batchwatch.functions import brackets, quantiles
from batchwatch.operators import drift, profile
from batchwatch.plans.views import base, view

GRID = (0.0, 0.01, 0.37, 0.5, 0.99, 1.0)


def side(spark, values):
    return spark.createDataFrame([(float(x),) for x in values], "x double")


@pytest.mark.parametrize("cells", [3, 1024])
@pytest.mark.parametrize("name", ["normal", "hot value", "interpolated"])
def test_quantiles(spark, name, cells):
    values = CASES[name][0]
    long = quantiles.numeric_long(side(spark, values), ["x"])
    hist = brackets.bracketed_histogram(long, ["feature"], {"n": F.lit(1)}, {"n": GRID}, cells=cells)
    row = quantiles.exact_quantiles(hist, ["feature"], GRID, bounded=True).first()
    assert row["n"] == len(values) and row["q"] == pytest.approx(list(np.quantile(values, GRID)), rel=1e-12)


@pytest.mark.parametrize("name", ["normal", "constant", "outside", "hot value", "interpolated"])
def test_drift(spark, name):
    ref, cur = CASES[name]
    hist = drift.side_histogram(side(spark, ref), side(spark, cur), ["x"], bins=10, bracketed=True)
    row = drift.data_drift(hist).first()
    assert row["psi_score"] == pytest.approx(numpy_psi(ref, cur), abs=1e-12)
    assert row["ks_score"] == pytest.approx(numpy_ks(ref, cur), abs=1e-12)


def test_one_empty_side(spark):
    assert drift.data_drift(drift.side_histogram(side(spark, [1.0, 2.0]), side(spark, []), ["x"], bins=10, bracketed=True)).count() == 0


def test_few_values_are_kept(spark):
    """Of 200,000 near-unique values few are shuffled, and all rows are counted. Two samples that hardly differ need most for KS."""
    df = spark.range(200_000).select(F.hash("id").cast("double").alias("x"), (F.col("id") % 2 == 0).alias("ref"))
    for options, share in ((dict(gap=False), 0.03), (dict(), 0.6)):
        hist = drift.labelled_histogram(df, ["x"], F.col("ref"), bins=10, bracketed=True, **options)
        rows, counted = hist.count(), hist.agg(F.sum("ref_n") + F.sum("cur_n")).first()[0]
        assert counted == 200_000 and rows < share * 200_000
    moved = df.withColumn("x", F.when(F.col("ref"), F.col("x")).otherwise(F.col("x") * 0.9))
    assert drift.labelled_histogram(moved, ["x"], F.col("ref"), bins=10, bracketed=True).count() < 0.08 * 200_000


def test_choice_by_size(spark, sf_dir):
    rows = base(spark, sf_dir, "lineitem")
    assert not brackets.worthwhile(rows) and brackets.worthwhile(rows, True) and brackets.worthwhile(spark.range(1 << 40))


def test_no_shuffle_of_all_values(spark, sf_dir):
    """No exchange of the profile moves more rows than cells, tasks and features account for."""
    found = profile.profile_numeric(view(spark, sf_dir, "lineitem_split"), ["l_quantity", "l_extendedprice"], bracketed=True)
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "hashpartitioning(feature" in plan and "BroadcastNestedLoopJoin" not in plan
