"""Queries for retraining data work and model fitting."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from batchwatch.operators import retrain
from batchwatch.plans.registry import query
from batchwatch.plans.views import base, view, with_views

NUMERIC, TEXT = ["n_chars"], ["lang", "source"]

# Feature sources per model: every third model has a configured list (padded, one name twice); the profile marks
# some columns as target, identifier or text.
_RENAMED = """CASE column_name WHEN 'c1' THEN 'label' WHEN 'c2' THEN 'user_id' WHEN 'c7' THEN '_meta' ELSE column_name END"""
_CONFIGURED = """SELECT model_id, CAST(substring(column_name, 2, 1) AS INTEGER) AS position, concat(' ', column_name) AS feature FROM baseline_columns WHERE model_id % 3 = 0
  UNION ALL SELECT model_id, 10 + CAST(substring(column_name, 2, 1) AS INTEGER), column_name FROM baseline_columns WHERE model_id % 3 = 0"""
_PROFILES = f"""SELECT model_id, CAST(substring(column_name, 2, 1) AS INTEGER) AS position, {_RENAMED} AS column_name,
  CASE column_name WHEN 'c2' THEN 'identifier' WHEN 'c3' THEN 'text' ELSE 'numeric' END AS type, CASE WHEN column_name = 'c3' THEN 'high_cardinality' END AS validation_mode FROM baseline_columns"""
_CONTRACT = f"""SELECT model_id, CAST(substring(column_name, 2, 1) AS INTEGER) AS position, {_RENAMED} AS column_name FROM baseline_columns"""
_FEATURES_SQL = f"""conf AS (SELECT model_id, list(name ORDER BY position) AS f FROM (SELECT model_id, trim(feature) AS name, min(position) AS position FROM ({_CONFIGURED}) GROUP BY 1, 2) GROUP BY model_id),
  prof AS (SELECT model_id, list(column_name ORDER BY position) AS f FROM ({_PROFILES}) WHERE column_name NOT IN ('label', '_meta', 'user_id') AND type <> 'text' GROUP BY model_id),
  cont AS (SELECT model_id, list(column_name ORDER BY position) AS f FROM ({_CONTRACT}) WHERE column_name NOT IN ('label', 'user_id') GROUP BY model_id),
  feats AS (SELECT m.model_id, m.name, coalesce(conf.f, prof.f, cont.f, []) AS features, CASE WHEN conf.f IS NOT NULL THEN 'model' WHEN prof.f IS NOT NULL OR cont.f IS NOT NULL THEN 'baseline' ELSE 'unavailable' END AS feature_source
    FROM ml_models m LEFT JOIN conf ON m.model_id = conf.model_id LEFT JOIN prof ON m.model_id = prof.model_id LEFT JOIN cont ON m.model_id = cont.model_id)"""


def _features(spark, sf_dir):
    view(spark, sf_dir, "baseline_columns").createOrReplaceTempView("baseline_columns")
    return retrain.resolve_features(view(spark, sf_dir, "ml_models"), *[spark.sql(s) for s in (_CONFIGURED, _PROFILES, _CONTRACT)])


@query("resolve_features", with_views(f"WITH {_FEATURES_SQL} SELECT model_id, array_to_string(features, ',') AS features, feature_source FROM feats"))
def resolve_features(spark, sf_dir):
    return _features(spark, sf_dir).withColumn("features", F.array_join("features", ","))


_DATASET = """SELECT run_id, CAST(substring(column_name, 2, 1) AS INTEGER) AS position, CASE lower(column_name) WHEN 'c1' THEN 'Label' WHEN 'c2' THEN 'user_id' ELSE lower(column_name) END AS column_name FROM batch_columns"""


@query("retraining_readiness", with_views(f"""WITH {_FEATURES_SQL}, have AS (SELECT run_id, list(column_name ORDER BY position) FILTER (column_name <> 'user_id') AS usable, count(*) AS n FROM ({_DATASET}) GROUP BY run_id),
  j AS (SELECT r.run_id, r.model_id, n, feature_source, features, CASE WHEN regexp_matches(lower(name), 'kmeans|cluster|clustering') THEN 'unsupervised_clustering' ELSE 'supervised' END AS training_mode,
    coalesce(usable, []) AS usable FROM pipeline_runs r LEFT JOIN have h ON r.run_id = h.run_id LEFT JOIN feats f ON r.model_id = f.model_id),
  c AS (SELECT *, CASE WHEN training_mode = 'supervised' THEN list_filter(usable, lambda x: NOT list_contains(features, x)) ELSE [] END AS cand FROM j)
  SELECT run_id, model_id, training_mode, n IS NOT NULL AS cleaned_data_available, array_to_string(cand, ',') AS target_candidates, CASE WHEN list_contains(cand, 'Label') THEN 'Label' ELSE cand[1] END AS suggested_target,
    CAST((n IS NULL) AS BIGINT) + CAST(len(features) = 0 OR feature_source = 'baseline' AS BIGINT) + CAST(n IS NOT NULL AND training_mode = 'supervised' AND len(cand) = 0 AS BIGINT) AS warning_count FROM c"""))
def retraining_readiness(spark, sf_dir):
    view(spark, sf_dir, "batch_columns").createOrReplaceTempView("batch_columns")
    found = retrain.readiness(
        view(spark, sf_dir, "pipeline_runs"), spark.sql(_DATASET), _features(spark, sf_dir), view(spark, sf_dir, "ml_models")
    )
    return found.select(
        "run_id", "model_id", "training_mode", "cleaned_data_available", F.array_join("target_candidates", ",").alias("target_candidates"),
        "suggested_target", F.size("warnings").cast("bigint").alias("warning_count"),
    )


@query("training_mode", with_views("SELECT model_id, name, CASE WHEN regexp_matches(lower(name), 'kmeans|cluster|clustering') THEN 'unsupervised_clustering' ELSE 'supervised' END AS training_mode FROM ml_models"))
def training_mode(spark, sf_dir):
    return view(spark, sf_dir, "ml_models").select("model_id", "name", retrain.training_mode(F.col("name")).alias("training_mode"))


_TARGETS = """SELECT label, n_chars, lang, CASE WHEN label >= 0 THEN 'same' END AS constant, CAST(doc_id AS STRING) AS doc_no FROM training_rows"""
_TARGET_COLUMNS = ("label", "n_chars", "lang", "constant", "doc_no")


@query("infer_task_type", with_views(f"WITH t AS ({_TARGETS}), p AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, count({c}) AS present_count, {c in ('label', 'n_chars')} AS num FROM t" for c in _TARGET_COLUMNS) + """)
  SELECT column_name, distinct_count, present_count, CASE WHEN distinct_count < 2 THEN NULL WHEN num AND distinct_count > 20 THEN 'regression' WHEN num THEN 'classification'
    WHEN distinct_count > 20 OR distinct_count / present_count > 0.35 THEN NULL ELSE 'classification' END AS task_type FROM p"""))
def infer_task_type(spark, sf_dir):
    view(spark, sf_dir, "training_rows").createOrReplaceTempView("training_rows")
    found = retrain.infer_task_type(retrain.target_profile(spark.sql(_TARGETS), _TARGET_COLUMNS))
    return found.select("column_name", "distinct_count", "present_count", "task_type")


@query("target_checks", """WITH d AS (SELECT d.doc_id, l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), a AS (SELECT count(*) AS n, count(label) AS p FROM d),
  c AS (SELECT count(*) AS k, min(r) AS s FROM (SELECT label, count(*) AS r FROM d WHERE label IS NOT NULL GROUP BY label))
  SELECT 'null_ratio' AS check_name, round(1 - p / n, 6) AS value, 1 - p / n <= 0.10 AS passed FROM a UNION ALL SELECT 'row_count', p, p >= 25 FROM a
  UNION ALL SELECT 'class_count', k, k BETWEEN 2 AND 20 FROM c UNION ALL SELECT 'smallest_class', s, s >= 3 FROM c""")
def target_checks(spark, sf_dir):
    docs = base(spark, sf_dir, "documents").select("doc_id")
    labelled = docs.join(base(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    return retrain.target_checks(labelled, "label").withColumn("value", F.round("value", 6))


@query("class_distribution", with_views("SELECT CAST(label AS STRING) AS label, count(*) AS rows FROM training_rows GROUP BY 1"))
def class_distribution(spark, sf_dir):
    return retrain.class_distribution(view(spark, sf_dir, "training_rows"), "label")


@query("stratified_split", """SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS STRING)), o_orderkey)
  <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM orders""")
def stratified_split(spark, sf_dir):
    orders = base(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return retrain.stratified_split(orders, "o_orderstatus", "o_orderkey")


@query("feature_pipeline", with_views("""WITH s AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS sd FROM training_rows),
  lv AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) AS p FROM training_rows GROUP BY lang), nl AS (SELECT count(*) AS n FROM lv)
  SELECT doc_id, round((n_chars - m) / sd, 6) AS scaled, lv.p AS lang_slot, nl.n AS lang_slots FROM training_rows t JOIN lv ON t.lang = lv.lang, s, nl"""))
def feature_pipeline(spark, sf_dir):
    """Standardised length and one-hot language of every training row."""
    rows = view(spark, sf_dir, "training_rows")
    model = retrain.fit_features(rows, NUMERIC, ["lang"])
    values = vector_to_array("features")
    out = model.transform(retrain.prepared(rows, NUMERIC, ["lang"])).select("doc_id", values.alias("v"))
    return out.select(
        "doc_id", F.round(F.get("v", F.lit(0)), 6).alias("scaled"),
        (F.array_position("v", F.lit(1.0).cast("double")) - 1).cast("bigint").alias("lang_slot"),
        (F.size("v") - 1).cast("bigint").alias("lang_slots"),
    )


@query("kmeans_retrain")
def kmeans_retrain(spark, sf_dir):
    rows = base(spark, sf_dir, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return retrain.fit_clusters(rows, k=5)[1]


def _forest(spark, sf_dir):
    rows = view(spark, sf_dir, "training_rows").withColumn("label", F.col("label").cast("double"))
    parts = retrain.stratified_split(rows, "label", "doc_id")
    return retrain.fit_supervised(parts.filter("split = 'train'"), NUMERIC, TEXT, "label"), parts


@query("classifier_retrain")
def classifier_retrain(spark, sf_dir):
    """Accuracy on the held-out fifth of the labelled documents."""
    model, parts = _forest(spark, sf_dir)
    scored = retrain.score_batch(model, parts.filter("split = 'test'"), NUMERIC, TEXT)
    return retrain.classification_metrics(scored, "label", "prediction")


@query("batch_score")
def batch_score(spark, sf_dir):
    """Every document scored with the retrained model."""
    model, _ = _forest(spark, sf_dir)
    docs = base(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return retrain.score_batch(model, docs, NUMERIC, TEXT).select("doc_id", "prediction")


@query("regression_metrics", with_views("""SELECT count(*) AS row_count, round(avg(CAST(y_true = y_pred AS INTEGER)), 6) AS accuracy, round(sqrt(sum((y_true - y_pred) * (y_true - y_pred)) / count(*)), 6) AS rmse,
  round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)), 6) AS r2 FROM prediction_pairs"""))
def regression_metrics(spark, sf_dir):
    found = retrain.regression_metrics(view(spark, sf_dir, "prediction_pairs"), "y_true", "y_pred")
    return found.withColumns({c: F.round(c, 6) for c in ("accuracy", "rmse", "r2")})
