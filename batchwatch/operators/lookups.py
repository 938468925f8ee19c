"""Joins, scoping, paging, search and snapshot comparison over runs, findings and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwatch.operators.registry import latest_run

# States that end an incident, agent states that count as analysed, name of an unknown model.
RESOLVED = ("resolved", "closed")
ANALYSED = ("running", "completed")
UNKNOWN_MODEL = "Unknown Model"


def is_resolved(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin(*RESOLVED), F.lit(False))


def findings_by_model(findings: DataFrame, runs: DataFrame, models: DataFrame) -> DataFrame:
    """Findings with the model and tenant of their run."""
    named = runs.select("run_id", "model_id").join(
        models.select("model_id", "tenant_id", F.col("name").alias("model_name")), "model_id"
    )
    return findings.join(named, "run_id")


def runs_for_tenant(runs: DataFrame, models: DataFrame, tenant: str) -> DataFrame:
    return runs.join(models.filter(F.col("tenant_id") == tenant), "model_id", "left_semi")


def tenant_scope(runs: DataFrame, models: DataFrame) -> DataFrame:
    """Runs with the tenant that owns them."""
    return runs.join(models.select("model_id", "tenant_id"), "model_id")


def runs_to_analyze(runs: DataFrame, models: DataFrame, analyses: DataFrame) -> DataFrame:
    """Latest run of each tenant, unless an analysis of it is running or complete."""
    done = analyses.filter(F.col("status").isin(*ANALYSED)).select("run_id").distinct()
    return latest_run(runs, models).join(done, "run_id", "left_anti")


def incident_details(incidents: DataFrame, drift: DataFrame) -> DataFrame:
    """Incidents with the drift finding they came from, where they came from one."""
    metrics = drift.select(
        F.col("id").alias("finding_id"), "feature_name", "psi_score", "ks_score", "drift_score"
    )
    from_drift = F.when(F.col("finding_type") == "drift", F.col("finding_id"))
    return incidents.withColumn("_fid", from_drift).join(
        metrics.withColumnRenamed("finding_id", "_fid"), "_fid", "left"
    ).drop("_fid")


def baseline_listing(baselines: DataFrame, models: DataFrame) -> DataFrame:
    named = models.select("model_id", F.col("name").alias("model_name"))
    return baselines.join(named, "model_id", "left").withColumn(
        "model_name", F.coalesce("model_name", F.lit(UNKNOWN_MODEL))
    )


def incident_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per run: incidents newly open (new or re-opened), newly critical, and newly resolved between snapshots."""
    was = before.select("id", is_resolved(F.col("status")).alias("_was"))
    joined = after.join(was, "id", "left")
    now = is_resolved(F.col("status"))
    opened = ~now & F.coalesce(F.col("_was"), F.lit(True))
    closed = now & F.coalesce(~F.col("_was"), F.lit(False))
    critical = F.lower(F.coalesce("severity", F.lit(""))) == "critical"
    return (
        joined.groupBy("run_id")
        .agg(F.count_if(opened).alias("new_open"), F.count_if(opened & critical).alias("new_critical"),
             F.count_if(closed).alias("newly_resolved"))
        .filter((F.col("new_open") > 0) | (F.col("newly_resolved") > 0))
    )


def run_context(runs: DataFrame, drift: DataFrame, quality: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per run with the size of each kind of evidence."""
    per_run = lambda df, name, *more: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name), *more)
    out = (
        runs.select("run_id", "model_id", "status")
        .join(per_run(drift, "drift_count", F.max("drift_score").alias("max_drift_score")), "run_id", "left")
        .join(per_run(quality, "quality_count", F.count_if(~F.col("success")).alias("failed_count")), "run_id", "left")
        .join(per_run(changes, "schema_change_count"), "run_id", "left")
    )
    counts = ("drift_count", "quality_count", "failed_count", "schema_change_count")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts})


def page_of_runs(findings: DataFrame, offset: int, limit: int) -> DataFrame:
    """All findings of one page of runs (newest run id first)."""
    page = findings.select("run_id").distinct().orderBy(F.desc("run_id")).offset(offset).limit(limit)
    return findings.join(F.broadcast(page), "run_id", "left_semi")  # at most ``limit`` run ids


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def filter_findings(findings: DataFrame, **equals) -> DataFrame:
    """Keep rows that match every given column value; None means "any"."""
    for column, value in equals.items():
        if value is not None:
            findings = findings.filter(F.col(column) == value)
    return findings


def search(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows whose joined text contains the needle, ignoring case; an empty needle keeps everything."""
    needle = needle.strip().lower()
    if not needle:
        return df
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return df.filter(text.contains(needle))


def step_timeline(steps: DataFrame) -> DataFrame:
    """Newest state of every step of an agent run; read it ordered by (run_id, step_index)."""
    last = steps.groupBy("run_id", "step_index").agg(
        F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("updates")
    )
    return last.orderBy("run_id", "step_index")
