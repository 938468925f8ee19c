"""Dashboard roll-ups: counts and worst/latest values per run, model, tenant or severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchwatch.functions import severity
from batchwatch.operators.lookups import is_resolved

# Severity shown for a failed check of each type.
CHECK_SEVERITY = {
    "schema_type_mismatch": "high", "range": "medium", "categorical": "medium", "null_ratio": "medium",
    "extra_columns": "medium", "missing_columns": "high",
}
MATRIX_SIZE = 8


def check_severity(check_type: Column) -> Column:
    out = F.lit("medium")
    for name, level in CHECK_SEVERITY.items():
        out = F.when(check_type == name, level).otherwise(out)
    return out


def dq_stats(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    aggregates = [
        F.count_if("success").alias("passed"), F.count_if(~F.col("success")).alias("failed"),
        F.count_distinct("run_id").alias("runs"),
    ]
    return findings.groupBy(*keys).agg(*aggregates) if keys else findings.agg(*aggregates)


def drift_stats(findings: DataFrame) -> DataFrame:
    at = lambda level: F.count_if(F.col("severity") == level).alias(level)
    return findings.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("drift_detected").alias("detected"),
        F.avg("drift_score").alias("average_score"), *[at(s) for s in severity.LEVELS],
    )


def incident_stats(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "resolved").alias("open"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
    )


def workspace_stats(models: DataFrame, runs: DataFrame, incidents: DataFrame) -> DataFrame:
    """Model, run and open-incident counts per tenant."""
    owner = models.select("model_id", "tenant_id")
    by_tenant = lambda df, name: df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(name))
    owned_runs = runs.select("run_id", "model_id").join(owner, "model_id")
    # Per-run counts first, so that one busy run is a single row in the join.
    busy = incidents.filter(F.col("status") == "open").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    open_incidents = busy.join(owned_runs, "run_id").groupBy("tenant_id").agg(F.sum("n").alias("open_incidents"))
    out = (
        by_tenant(models, "models")
        .join(by_tenant(owned_runs, "runs"), "tenant_id", "left")
        .join(open_incidents, "tenant_id", "left")
    )
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("runs", "open_incidents")})


def model_stats(models: DataFrame) -> DataFrame:
    return models.agg(
        F.count(F.lit(1)).alias("models"), F.count("version").alias("registered_versions"),
        F.count_distinct("framework").alias("frameworks"),
    )


def tenant_table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per (tenant, table); every input carries tenant_id."""
    parts = [
        df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dq_by_run(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id").agg(
        F.count_if("success").alias("passed"), F.count_if(~F.col("success")).alias("failed"),
        F.max("created_at").alias("latest_at"),
    )


def drift_by_run(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("drift_detected").alias("drifted"),
        F.greatest(F.lit(0.0), F.max("drift_score")).alias("max_score"),
        severity.worst(F.col("severity")).alias("severity"), F.max("created_at").alias("latest_at"),
    )


def incidents_by_run(incidents: DataFrame) -> DataFrame:
    done = is_resolved(F.col("status"))
    return incidents.groupBy("run_id").agg(
        F.count_if(~done).alias("open"), F.count_if(done).alias("resolved"),
        severity.worst(F.col("severity")).alias("severity"), F.max("created_at").alias("latest_at"),
    )


def dq_issue_groups(findings: DataFrame) -> DataFrame:
    """Failed checks per (run, check type) with severity and the columns concerned."""
    kind = F.coalesce("check_type", F.lit("data_quality"))
    return (
        findings.filter(~F.col("success"))
        .groupBy("run_id", kind.alias("check_type"))
        .agg(F.count(F.lit(1)).alias("findings"), F.array_sort(F.collect_set("column_name")).alias("columns"))
        .withColumn("severity", check_severity(F.col("check_type")))
    )


def drift_run_summary(findings: DataFrame) -> DataFrame:
    """Drifted and stable features of each run and its strongest drifted feature."""
    order = F.when(F.col("drift_detected"), F.struct("drift_score", "feature_name"))
    return findings.groupBy("run_id").agg(
        F.count_if("drift_detected").alias("drifted"), F.count_if(~F.col("drift_detected")).alias("stable"),
        F.max(order)["feature_name"].alias("strongest_feature"), F.max(order)["drift_score"].alias("strongest_score"),
    )


def top_drift_features(findings: DataFrame, limit: int = 3) -> DataFrame:
    """Strongest drifted features of each run. The rank filter is applied before and after the shuffle."""
    place = F.row_number().over(
        Window.partitionBy("run_id").orderBy(F.desc("drift_score"), F.asc("feature_name"))
    )
    return findings.filter("drift_detected").withColumn("place", place).filter(F.col("place") <= limit)


def drift_matrix(findings: DataFrame, features: Sequence[str], runs: int = MATRIX_SIZE) -> DataFrame:
    """Run x feature drift scores for the newest runs (a report of fixed size)."""
    newest = findings.select("run_id").distinct().orderBy(F.desc("run_id")).limit(runs)
    kept = findings.join(F.broadcast(newest), "run_id", "left_semi")  # at most ``runs`` ids
    return kept.groupBy("run_id").pivot("feature_name", list(features)).agg(F.max("drift_score"))


def matrix_features(findings: DataFrame, limit: int = MATRIX_SIZE) -> list[str]:
    """First feature names in name order (at most ``limit`` of them reach the driver)."""
    rows = findings.select("feature_name").distinct().orderBy("feature_name").limit(limit).collect()
    return [r["feature_name"] for r in rows]


def severity_distribution(findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
    # Window over at most four rows.
    return counts.withColumn("share", F.col("findings") / F.sum("findings").over(Window.partitionBy()))


def failure_types_by_run(incidents: DataFrame, shown: int = 3) -> DataFrame:
    """Distinct failure types of a run: the first few in name order and how many more there are."""
    kinds = incidents.groupBy("run_id").agg(
        F.array_sort(F.collect_set(F.coalesce("failure_type", F.lit("unknown")))).alias("_kinds")
    )
    return kinds.select(
        "run_id", F.slice("_kinds", 1, shown).alias("failure_types"),
        F.greatest(F.size("_kinds") - shown, F.lit(0)).cast("bigint").alias("more"),
    )
