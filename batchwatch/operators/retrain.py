"""Retraining: features, readiness, target checks, splits, model fitting, metrics and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwatch.config import DEFAULTS
from batchwatch.functions import ordering
from batchwatch.functions.cells import is_identifier_col, is_target_col, strip, to_number
from batchwatch.operators import profile

# Preferred target names, words that mark a clustering model, seed.
PREFERRED_TARGETS = ("target", "label", "class", "outcome", "prediction_label", "cluster_label")
CLUSTER_WORDS = "kmeans|cluster|clustering"
SEED = 42
UNKNOWN = "UNKNOWN"


def _names(kept: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["name"])


def resolve_features(models: DataFrame, configured: DataFrame, profiles: DataFrame, contract: DataFrame) -> DataFrame:
    """Features of each model and where they come from.

    The configured list (trimmed, once each, in order) wins; else the profile columns that are no target,
    identifier or text; else the contract columns that are no target or identifier. Inputs carry model_id,
    position and the name (``feature`` / ``column_name``).
    """
    tidy = (
        configured.withColumn("name", F.trim("feature")).filter(F.col("name") != "")
        .groupBy("model_id", "name").agg(F.min("position").alias("position"))
    )
    item = F.struct("position", "name")
    listed = tidy.groupBy("model_id").agg(_names(item).alias("_configured"))
    name = F.col("column_name")
    closed = F.col("type").isin("identifier", "text") | F.coalesce(
        F.col("validation_mode").isin("identifier", "high_cardinality"), F.lit(False)
    )
    usable = F.struct("position", name.alias("name"))
    profiled = (
        profiles.filter(~name.startswith("_") & ~is_target_col(name) & ~closed)
        .groupBy("model_id").agg(_names(usable).alias("_profiled"))
    )
    contracted = (
        contract.filter(~is_target_col(name) & ~is_identifier_col(name))
        .groupBy("model_id").agg(_names(usable).alias("_contract"))
    )
    joined = (
        models.select("model_id").join(listed, "model_id", "left").join(profiled, "model_id", "left")
        .join(contracted, "model_id", "left")
    )
    source = (
        F.when(F.col("_configured").isNotNull(), "model")
        .when(F.col("_profiled").isNotNull() | F.col("_contract").isNotNull(), "baseline")
        .otherwise("unavailable")
    )
    return joined.select(
        "model_id",
        F.coalesce("_configured", "_profiled", "_contract", F.array().cast("array<string>")).alias("features"),
        source.alias("feature_source"),
    )


def training_mode(name: Column) -> Column:
    return F.when(F.lower(name).rlike(CLUSTER_WORDS), "unsupervised_clustering").otherwise("supervised")


def readiness(runs: DataFrame, columns: DataFrame, features: DataFrame, models: DataFrame) -> DataFrame:
    """Can a run be used for retraining? Target candidates, suggested target, warnings.

    ``columns``: run_id, position, column_name of the run's cleaned data (absent when there is none).
    """
    usable = F.when(~is_identifier_col(F.col("column_name")), F.struct("position", F.col("column_name").alias("name")))
    have = columns.groupBy("run_id").agg(_names(usable).alias("_usable"), F.count(F.lit(1)).alias("column_count"))
    joined = (
        runs.select("run_id", "model_id").join(have, "run_id", "left").join(features, "model_id", "left")
        .join(models.select("model_id", training_mode(F.col("name")).alias("training_mode")), "model_id", "left")
    )
    available = F.col("column_count").isNotNull()
    supervised = F.col("training_mode") != "unsupervised_clustering"
    none = F.array().cast("array<string>")
    known = F.coalesce("features", none)
    candidates = F.when(
        supervised, F.filter(F.coalesce("_usable", none), lambda c: ~F.array_contains(known, c))
    ).otherwise(none)
    named = lambda wanted: F.get(F.filter("target_candidates", lambda c: F.lower(c) == F.lit(wanted)), F.lit(0))
    preferred = F.coalesce(*[named(n) for n in PREFERRED_TARGETS])
    # Warning texts.
    warnings = F.array_compact(
        F.array(
            F.when(~available, "Cleaned data is not available for this run, so retraining cannot start."),
            F.when(F.size(known) == 0, "No feature list is configured for this model and no usable fallback could be derived from the active baseline.")
            .when(F.col("feature_source") == "baseline", "Expected features were inferred from the active baseline because the model record does not have an explicit feature list."),
            F.when(available & supervised & (F.size("target_candidates") == 0), "No target column candidates were found outside the resolved feature set."),
        )
    )
    return (
        joined.withColumn("target_candidates", candidates)
        .withColumn("suggested_target", F.coalesce(preferred, F.get("target_candidates", F.lit(0))))
        .withColumn("warnings", warnings)
        .withColumn("cleaned_data_available", available)
        .drop("_usable")
    )


def target_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """present / distinct counts and contract type of possible targets."""
    types = {f.name: profile.contract_type(f.dataType) for f in df.schema.fields}
    kind = F.lit("object")
    for name in columns:
        kind = F.when(F.col("column_name") == name, types[name]).otherwise(kind)
    return profile.cardinality(profile.text_histogram(df, columns)).drop("high_cardinality").withColumn("dtype", kind)


def infer_task_type(targets: DataFrame) -> DataFrame:
    """classification or regression, or the reason why the column cannot be a target."""
    n, distinct = F.col("present_count"), F.col("distinct_count")
    numeric = F.col("dtype").isin("int", "float")
    # Reasons.
    problem = (
        F.when(n == 0, "Target column contains no usable values for retraining.")
        .when(F.col("dtype") == "bool", None)
        .when(distinct < 2, "Target column must contain at least two distinct values for retraining.")
        .when(~numeric & (distinct > DEFAULTS.max_class_count),
              F.format_string(f"Target column has %d distinct values, which exceeds the remediation classification limit of {DEFAULTS.max_class_count}.", distinct))
        .when(~numeric & (distinct / n > DEFAULTS.max_class_unique_ratio),
              F.format_string("Target column has uniqueness ratio %.2f, which looks more like an identifier than a supervised label.", distinct / n))
    )
    task = F.when(numeric & (distinct > DEFAULTS.max_class_count), "regression").otherwise("classification")
    return targets.withColumn("problem", problem).withColumn("task_type", F.when(F.col("problem").isNull(), task))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(strip(F.col(target).cast("string")).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def target_checks(df: DataFrame, target: str, task: str = "classification") -> DataFrame:
    """Named pass/fail checks of a target column."""
    present = F.col(target).isNotNull()
    base = df.agg(F.count(F.lit(1)).alias("n"), F.count(target).alias("p"),
                  F.count(to_number(F.col(target).cast("string"))).alias("num"))
    classes = class_distribution(df.filter(present), target).agg(
        F.count(F.lit(1)).alias("classes"), F.min("rows").alias("smallest")
    )
    both = base.withColumn("_c", classes.select(F.struct("classes", "smallest")).scalar())
    ratio = F.coalesce(1 - F.col("p") / F.nullif(F.col("n"), F.lit(0)), F.lit(1.0))
    row = lambda name, value, ok: F.struct(
        F.lit(name).alias("check_name"), value.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("passed")
    )
    rows = [
        row("null_ratio", ratio, ratio <= DEFAULTS.max_target_null_ratio),
        row("row_count", F.col("p"), F.col("p") >= DEFAULTS.min_training_rows),
    ]
    if task == "classification":
        rows += [
            row("class_count", F.col("_c.classes"), F.col("_c.classes").between(2, DEFAULTS.max_class_count)),
            row("smallest_class", F.col("_c.smallest"), F.col("_c.smallest") >= DEFAULTS.min_class_count),
        ]
    else:
        rows.append(row("invalid_numbers", F.col("p") - F.col("num"), F.col("p") == F.col("num")))
    return both.select(F.inline(F.array(*rows)))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = DEFAULTS.test_size) -> DataFrame:
    """Exact, repeatable split per class: the rows with the smallest hash of the key are the test set.

    The hash orders the rows evenly, so its first two digits cut every class, however large, into 256 ranges.
    """
    digest = F.md5(F.col(key).cast("string"))
    hashed = df.withColumn("_digest", digest)
    placed = ordering.row_numbers(
        hashed, [label], ["_digest", key], "_place", bucket=F.conv(F.left("_digest", F.lit(2)), 16, 10).cast("int")
    )
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    is_test = F.col("_place") <= F.floor(F.col("_size") * test_size + 0.5)
    return placed.join(sizes, label).withColumn("split", F.when(is_test, "test").otherwise("train")).drop(
        "_digest", "_place", "_size"
    )


# ---- fitting ---------------------------------------------------------------------------------------------------


def feature_stages(numeric: Sequence[str], text: Sequence[str]) -> list:
    """Median-imputed, standardised numbers and one-hot text (unknown categories are ignored: all their slots are zero)."""
    stages = []
    parts = []
    if numeric:
        stages += [
            Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}__filled" for c in numeric]),
            VectorAssembler(inputCols=[f"{c}__filled" for c in numeric], outputCol="__numbers"),
            StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True),
        ]
        parts.append("__scaled")
    for c in text:
        stages += [
            StringIndexer(inputCol=c, outputCol=f"{c}__index", handleInvalid="keep", stringOrderType="frequencyDesc"),
            OneHotEncoder(inputCol=f"{c}__index", outputCol=f"{c}__hot", dropLast=True),
        ]
        parts.append(f"{c}__hot")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def prepared(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {**{c: to_number(F.col(c), df.schema[c].dataType) for c in numeric}, **{c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in text}}
    )


def fit_features(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> PipelineModel:
    return Pipeline(stages=feature_stages(numeric, text)).fit(prepared(df, numeric, text))


def fit_clusters(df: DataFrame, features: str = "features", k: int = 5) -> tuple[object, DataFrame]:
    """K-means model and its metrics: inertia, clusters used, silhouette (squared Euclidean)."""
    model = KMeans(k=k, seed=SEED, featuresCol=features).fit(df)
    predicted = model.transform(df)
    used = predicted.agg(F.count_distinct("prediction").alias("n")).first()["n"]  # one number
    score = ClusteringEvaluator(featuresCol=features).evaluate(predicted) if 1 < used else None
    rows = [("inertia", float(model.summary.trainingCost)), ("cluster_count", float(used)), ("silhouette_score", score)]
    return model, df.sparkSession.createDataFrame(rows, "metric string, value double")


def fit_supervised(
    train: DataFrame, numeric: Sequence[str], text: Sequence[str], label: str, task: str = "classification", trees: int = 20
) -> PipelineModel:
    """Random forest on prepared features. Classes given as text are indexed, and :func:`score_batch` adds their names
    as ``predicted_label``; :func:`target_checks` bounds their number."""
    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    ready, named = prepared(train, numeric, text), isinstance(train.schema[label].dataType, T.StringType)
    target, before, after = label, [], []
    if named and task == "classification":
        index = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(ready)
        target, before = "__label", [index]
        after = [IndexToString(inputCol="prediction", outputCol="predicted_label", labels=index.labels)]
    forest = kind(labelCol=target, featuresCol="features", numTrees=trees, seed=SEED)
    stages = Pipeline(stages=[*feature_stages(numeric, text), *before, forest, *after]).fit(ready).stages
    return PipelineModel([s for s in stages if s not in before])  # rows to score carry no label


def score_batch(model: PipelineModel, df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    return model.transform(prepared(df, numeric, text))


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    hit = F.avg((F.col(truth).cast("double") == F.col(predicted).cast("double")).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("row_count"), hit.alias("accuracy"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, RMSE and R2 as plain aggregates."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    sse = F.sum((y - p) * (y - p))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.avg((y == p).cast("double")).alias("accuracy"),
        F.sqrt(sse / F.count(F.lit(1))).alias("rmse"),
        (1 - F.try_divide(sse, F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
    )
