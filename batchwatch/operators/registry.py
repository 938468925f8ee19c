"""Versioned things: baselines, reports, candidates and aliases; latest runs.

"Latest of a group" is an aggregate (``max_by``), combined before the shuffle, never a window over the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwatch.functions import ordering


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key group."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def latest_run(runs: DataFrame, models: DataFrame) -> DataFrame:
    """Newest run of every tenant."""
    scoped = runs.join(models.select("model_id", "tenant_id"), "model_id")
    return latest(scoped, ["tenant_id"], ["created_at", "run_id"])


def active_baseline(baselines: DataFrame) -> DataFrame:
    """Per model: the active approved baseline, else the approved one with the highest version."""
    return latest(baselines.filter(F.col("status") == "approved"), ["model_id"], ["is_active", "version"])


def version_baselines(uploads: DataFrame, existing: DataFrame, buckets: int | None = None) -> DataFrame:
    """Version, status and active flag of new uploads (id, model_id, approved), in id order per model.

    The first upload of a model without an active approved baseline becomes approved and active; later ones are
    approved when asked, else drafts.
    """
    known = existing.groupBy("model_id").agg(
        F.max("version").alias("_last"),
        F.bool_or(F.col("is_active") & (F.col("status") == "approved")).alias("_has_active"),
    )
    numbered = ordering.row_numbers(uploads, ["model_id"], ["id"], "_place", value="id", buckets=buckets)
    joined = numbered.join(known, "model_id", "left")
    first = (F.col("_place") == 1) & ~F.coalesce("_has_active", F.lit(False))
    return joined.select(
        "id", "model_id",
        (F.coalesce("_last", F.lit(0)) + F.col("_place")).cast("bigint").alias("version"),
        F.when(first | F.col("approved"), "approved").otherwise("draft").alias("status"),
        first.alias("is_active"),
    )


def activate_baselines(baselines: DataFrame, targets: DataFrame) -> DataFrame:
    """Make each target (model_id, id) the active, approved baseline of its model and switch the others off.

    One target per model; should several be asked, the highest id wins.
    """
    chosen = targets.groupBy("model_id").agg(F.max("id").alias("_target"))
    joined = baselines.join(chosen, "model_id", "left")
    hit = F.coalesce(F.col("id") == F.col("_target"), F.lit(False))
    return (
        joined.withColumn("status", F.when(hit, "approved").otherwise(F.col("status")))
        .withColumn("is_active", F.when(F.col("_target").isNotNull(), hit).otherwise(F.col("is_active")))
        .drop("_target")
    )


def version_reports(reports: DataFrame, key: str = "run_id", buckets: int | None = None) -> DataFrame:
    """Number the reports of every incident in id order."""
    return ordering.row_numbers(reports, [key], ["id"], "version", value="id", buckets=buckets)


def latest_report(reports: DataFrame, key: str = "run_id") -> DataFrame:
    return latest(reports, [key], ["id"])


def latest_with_key(log: DataFrame, json_keys: list[str], out: str) -> DataFrame:
    """Newest log payload per remediation run that holds one of the JSON keys with a value."""
    value = F.coalesce(*[F.nullif(F.get_json_object("payload", f"$.{k}"), F.lit("")) for k in json_keys])
    found = log.withColumn(out, value).filter(F.col(out).isNotNull())
    return found.groupBy("remediation_run_id").agg(
        F.max("id").alias("id"), F.max_by(out, "id").alias(out), F.max_by("payload", "id").alias("payload")
    )


def latest_candidate(log: DataFrame) -> DataFrame:
    return latest_with_key(log, ["candidate_model_uri"], "candidate_model_uri")


def latest_staged(log: DataFrame) -> DataFrame:
    return latest_with_key(log, ["staged_model_version", "promoted_model_version"], "staged_model_version")


def current_alias(history: DataFrame) -> DataFrame:
    """Current version per (model, alias) from alias events (id, model_id, alias, version)."""
    return history.groupBy("model_id", "alias").agg(
        F.max_by("version", "id").alias("version"), F.max("id").alias("changed_by"), F.count(F.lit(1)).alias("changes")
    )
