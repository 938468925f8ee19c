"""Queries for distribution drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchwatch.operators import drift, profile
from batchwatch.plans.registry import query
from batchwatch.plans.sqltext import severity_of
from batchwatch.plans.views import view, with_views

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
# Bounds of the published asymptotic series, as in the operator.
_PVALUE = """CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * list_sum(list_transform(range(1, 101),
  lambda k: power(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam))))) END"""


def psi_sql(side_rows: str, feature: str) -> str:
    """PSI of one feature; ``side_rows`` selects (v, is_ref)."""
    return f"""SELECT '{feature}' AS feature, psi_score FROM (
      WITH d AS ({side_rows}),
      bp AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS b FROM d WHERE is_ref),
      tot AS (SELECT count(*) FILTER (is_ref) AS nr, count(*) FILTER (NOT is_ref) AS nc FROM d),
      bins AS (SELECT unnest(range(1, len(b))) AS i, b FROM bp),
      counts AS (SELECT i, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM bins JOIN d
        ON v >= b[i] AND (v < b[i + 1] OR (i = len(b) - 1 AND v = b[i + 1])) GROUP BY i),
      shares AS (SELECT CASE WHEN coalesce(r, 0) = 0 THEN 0.0001 ELSE r / nr END AS r, CASE WHEN coalesce(c, 0) = 0 THEN 0.0001 ELSE c / nc END AS c
        FROM bins LEFT JOIN counts USING (i), tot)
      SELECT coalesce(sum((c - r) * ln(c / r)), 0.0) AS psi_score FROM shares)"""


def ks_sql(side_rows: str, feature: str) -> str:
    """KS statistic, p-value and side counts of one feature."""
    return f"""SELECT '{feature}' AS feature, nr AS ref_n, nc AS cur_n, ks_score, {_PVALUE} AS ks_pvalue FROM (
      WITH d AS ({side_rows}),
      h AS (SELECT v, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM d GROUP BY v),
      run AS (SELECT sum(r) OVER w AS ur, sum(c) OVER w AS uc, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM h WINDOW w AS (ORDER BY v))
      SELECT CAST(max(nr) AS BIGINT) AS nr, CAST(max(nc) AS BIGINT) AS nc, max(abs(ur / nr - uc / nc)) AS ks_score,
        max(abs(ur / nr - uc / nc)) * sqrt(max(nr) * max(nc) / (max(nr) + max(nc))) AS lam FROM run)"""


def lineitem_side(c: str) -> str:
    return f"SELECT {c} AS v, is_reference AS is_ref FROM lineitem_split WHERE {c} IS NOT NULL"


_KS = " UNION ALL ".join(ks_sql(lineitem_side(c), c) for c in FEATURES)
_PSI = " UNION ALL ".join(psi_sql(lineitem_side(c), c) for c in FEATURES)


def scored_sql(rows: str, kind: str) -> str:
    """Finding columns from (feature, psi_score, ks_score, ks_pvalue)."""
    return f"""SELECT feature AS feature_name, round(psi_score, 6) AS psi_score, round(ks_score, 6) AS ks_score,
      round(ks_pvalue, 6) AS ks_pvalue, round(greatest(psi_score, ks_score), 6) AS drift_score,
      {severity_of('greatest(psi_score, ks_score)')} AS severity, greatest(psi_score, ks_score) > 0.2 AS drift_detected, '{kind}' AS type
      FROM ({rows})"""


def rounded(df):
    wanted = [c for c in ("psi_score", "ks_score", "ks_pvalue", "drift_score") if c in df.columns]
    return df.withColumns({c: F.round(c, 6) for c in wanted})


def _hist(spark, sf_dir, features=FEATURES, bins=10, gap=True, bracketed=None):
    rows = view(spark, sf_dir, "lineitem_split")
    return drift.labelled_histogram(rows, features, F.col("is_reference"), bins=bins, gap=gap, bracketed=bracketed)


@query("drift_columns", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) FILTER (is_reference) AS ref_n, count({c}) FILTER (NOT is_reference) AS cur_n FROM lineitem_split"
    for c in (*FEATURES, "l_orderkey"))))
def drift_columns(spark, sf_dir):
    return drift.comparable_columns(_hist(spark, sf_dir, (*FEATURES, "l_orderkey", "l_returnflag")))


@query("psi", with_views(f"SELECT feature, round(psi_score, 6) AS psi_score FROM ({_PSI})"))
def psi(spark, sf_dir):
    return rounded(drift.psi(_hist(spark, sf_dir, gap=False)).select("feature", "psi_score"))


@query("psi_bracketed", with_views(f"SELECT feature, ref_n, cur_n, round(psi_score, 6) AS psi_score FROM ({_PSI}) JOIN (SELECT feature, ref_n, cur_n FROM ({_KS})) USING (feature)"))
def psi_bracketed(spark, sf_dir):
    """PSI as for a large input: only the values around the reference's cut points are shuffled."""
    return rounded(drift.psi(_hist(spark, sf_dir, gap=False, bracketed=True)).select("feature", "ref_n", "cur_n", "psi_score"))


@query("ks_statistic", with_views(f"SELECT feature, ref_n, cur_n, round(ks_score, 6) AS ks_score FROM ({_KS})"))
def ks_statistic(spark, sf_dir):
    return rounded(drift.ks(_hist(spark, sf_dir)).select("feature", "ref_n", "cur_n", "ks_score"))


@query("ks_pvalue", with_views(f"SELECT feature, round(ks_pvalue, 6) AS ks_pvalue FROM ({_KS})"))
def ks_pvalue(spark, sf_dir):
    return rounded(drift.ks(_hist(spark, sf_dir)).select("feature", "ks_pvalue"))


_DATA = f"SELECT k.feature, psi_score, ks_score, ks_pvalue FROM ({_KS}) k JOIN ({_PSI}) p ON k.feature = p.feature"


@query("data_drift", with_views(scored_sql(_DATA, "data_drift")))
def data_drift(spark, sf_dir):
    return rounded(drift.data_drift(_hist(spark, sf_dir)).select(*drift.finding_columns()))


@query("data_drift_bracketed", with_views(scored_sql(_DATA, "data_drift")))
def data_drift_bracketed(spark, sf_dir):
    """PSI and KS as for a large input."""
    return rounded(drift.data_drift(_hist(spark, sf_dir, bracketed=True)).select(*drift.finding_columns()))


@query("data_drift_by_run", with_views("""WITH h AS (SELECT l_linenumber, l_quantity AS v, count(*) FILTER (is_reference) AS r, count(*) FILTER (NOT is_reference) AS c
    FROM lineitem_split GROUP BY ALL),
  run AS (SELECT l_linenumber, sum(r) OVER w AS ur, sum(c) OVER w AS uc, sum(r) OVER t AS nr, sum(c) OVER t AS nc FROM h
    WINDOW w AS (PARTITION BY l_linenumber ORDER BY v), t AS (PARTITION BY l_linenumber))
  SELECT l_linenumber, 'l_quantity' AS feature, CAST(max(nr) AS BIGINT) AS ref_n, CAST(max(nc) AS BIGINT) AS cur_n, round(max(abs(ur / nr - uc / nc)), 6) AS ks_score
  FROM run GROUP BY l_linenumber"""))
def data_drift_by_run(spark, sf_dir):
    """KS of many batches at once (one per line number)."""
    hist = drift.labelled_histogram(
        view(spark, sf_dir, "lineitem_split"), ["l_quantity"], F.col("is_reference"), ["l_linenumber"]
    )
    return rounded(drift.ks(hist, ["l_linenumber"]).drop("ks_pvalue"))


def _stored_rules(spark, sf_dir):
    reference = view(spark, sf_dir, "lineitem_split").filter("is_reference")
    columns = [*FEATURES, "l_returnflag", "l_linestatus"]
    return profile.load_rules(profile.create_baseline(reference.select(*columns)), columns)


def _current(spark, sf_dir):
    """Current side with a changed unit in one column and a new category in another."""
    return view(spark, sf_dir, "lineitem_split").filter("NOT is_reference").select(
        "l_quantity", (F.col("l_extendedprice") * 1.5).alias("l_extendedprice"), "l_discount", "l_tax",
        F.when(F.col("l_linenumber") == 7, "X").otherwise(F.lower("l_returnflag")).alias("l_returnflag"), "l_linestatus",
    )


def _profile_sql(c: str, value: str) -> str:
    return f"""SELECT '{c}' AS feature, 'numeric' AS profile_type, count(*) AS value_count, greatest(count(*) FILTER (v < lo OR v > hi) / count(*),
      greatest(0.0, max(lo) - min(v), max(v) - max(hi)) / max(w), abs(avg(v) - max(m)) / max(w)) AS score FROM
      (SELECT {value} AS v FROM lineitem_split WHERE NOT is_reference),
      (SELECT min({c}) AS lo, max({c}) AS hi, avg({c}) AS m, greatest(max({c}) - min({c}), 1.0) AS w FROM lineitem_split WHERE is_reference)"""


_PROFILE_NUMERIC = " UNION ALL ".join(
    _profile_sql(c, f"{c} * 1.5" if c == "l_extendedprice" else c) for c in FEATURES
)
_PROFILE_TEXT = """SELECT 'l_returnflag' AS feature, 'categorical' AS profile_type, count(*) AS value_count,
    count(*) FILTER (l_linenumber = 7 OR l_returnflag NOT IN (SELECT l_returnflag FROM lineitem_split WHERE is_reference)) / count(*) AS score FROM lineitem_split WHERE NOT is_reference
  UNION ALL SELECT 'l_linestatus', 'categorical', count(*),
    count(*) FILTER (l_linestatus NOT IN (SELECT l_linestatus FROM lineitem_split WHERE is_reference)) / count(*) FROM lineitem_split WHERE NOT is_reference"""
_PROFILE_OUT = """SELECT feature AS feature_name, profile_type, value_count, round(score, 6) AS drift_score, """ + severity_of("score") + " AS severity FROM "


def _profile_rows(spark, sf_dir, kind):
    found = drift.profile_drift(_current(spark, sf_dir), _stored_rules(spark, sf_dir))
    return rounded(found.filter(F.col("profile_type") == kind)).select(
        "feature_name", "profile_type", "value_count", "drift_score", "severity"
    )


@query("profile_drift_numeric", with_views(f"{_PROFILE_OUT} ({_PROFILE_NUMERIC})"))
def profile_drift_numeric(spark, sf_dir):
    return _profile_rows(spark, sf_dir, "numeric")


@query("profile_drift_categorical", with_views(f"{_PROFILE_OUT} ({_PROFILE_TEXT})"))
def profile_drift_categorical(spark, sf_dir):
    return _profile_rows(spark, sf_dir, "categorical")


_CONCEPT_ROWS = "SELECT CAST(y_true AS DOUBLE) AS v, true AS is_ref FROM prediction_pairs UNION ALL SELECT CAST(y_pred AS DOUBLE), false FROM prediction_pairs"
_CONCEPT = f"""SELECT k.feature, psi_score, ks_score, ks_pvalue FROM ({ks_sql(_CONCEPT_ROWS, 'prediction_output')}) k
  JOIN ({psi_sql(_CONCEPT_ROWS, 'prediction_output')}) p ON k.feature = p.feature"""


def _concept(spark, sf_dir):
    pairs = view(spark, sf_dir, "prediction_pairs")
    reference = pairs.withColumnRenamed("y_true", "target")
    target = drift.target_column(reference.columns, ["vec_id"])
    return drift.concept_drift(reference, pairs, target, "y_pred")


@query("concept_drift", with_views(scored_sql(_CONCEPT, "concept_drift")))
def concept_drift(spark, sf_dir):
    return rounded(_concept(spark, sf_dir).select(*drift.finding_columns()))


@query("drift_run", with_views(scored_sql(_DATA, "data_drift") + " UNION ALL " + scored_sql(_CONCEPT, "concept_drift")))
def drift_run(spark, sf_dir):
    return rounded(drift.drift_run(drift.data_drift(_hist(spark, sf_dir)), _concept(spark, sf_dir)))


@query("drift_backfill", with_views("""SELECT run_id, model_id, status FROM pipeline_runs
  WHERE run_id NOT IN (SELECT run_id FROM drift_findings WHERE run_id IS NOT NULL)"""))
def drift_backfill(spark, sf_dir):
    runs = view(spark, sf_dir, "pipeline_runs").select("run_id", "model_id", "status")
    return drift.runs_to_backfill(runs, view(spark, sf_dir, "drift_findings"))


@query("drift_findings", with_views(f"""SELECT id, run_id, feature_name, round(psi_score, 6) AS psi_score, round(ks_score, 6) AS ks_score,
  round(greatest(psi_score, ks_score), 6) AS drift_score, greatest(psi_score, ks_score) > 0.2 AS drift_detected,
  {severity_of('greatest(psi_score, ks_score)')} AS severity FROM drift_metrics"""))
def drift_findings(spark, sf_dir):
    found = drift.scored(view(spark, sf_dir, "drift_metrics")).drop("ks_pvalue", "created_at")
    return rounded(found)


@query("drift_interpretation", with_views("""SELECT id, CASE WHEN drift_detected THEN concat(feature_name, ' shows ',
    CASE WHEN psi_score >= 0.3 THEN 'strong' WHEN psi_score >= 0.2 THEN 'moderate' ELSE 'minor' END, ' population drift')
    ELSE concat(feature_name, ' is stable') END AS title,
  CASE WHEN drift_detected THEN concat(feature_name, ' no longer matches the baseline distribution. PSI=', printf('%.4f', psi_score), ', KS=', printf('%.4f', ks_score),
    ', drift score=', printf('%.4f', drift_score), '. ', CASE WHEN ks_pvalue < 0.05 THEN 'The KS p-value supports a statistically significant distribution shift.'
    ELSE 'The KS p-value is not significant, so treat this as monitoring evidence and confirm with source context.' END)
    ELSE 'Current values are close to the active baseline distribution.' END AS cause,
  CASE WHEN drift_detected THEN concat('Check whether ', feature_name, '''s source, business mix, or time window changed. Fix upstream data if unexpected; refresh the baseline or retrain only if the shift is valid.')
    ELSE 'Keep monitoring future runs.' END AS action FROM drift_findings"""))
def drift_interpretation(spark, sf_dir):
    return drift.interpretation(view(spark, sf_dir, "drift_findings")).select("id", "title", "cause", "action")
