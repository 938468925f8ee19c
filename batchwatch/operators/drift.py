"""Distribution drift: PSI, two-sample KS, profile-based drift, concept drift and the drift run.

The metrics work on a *side histogram*: one row per (run keys, feature, distinct value) with the number of
reference and current occurrences. It is the only full shuffle; PSI, KS and the quantile cut points reuse it. With a number of
bins it holds only the values that they look at (``functions/brackets.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwatch.config import DEFAULTS
from batchwatch.functions import brackets, ordering, quantiles, severity
from batchwatch.functions.cells import is_identifier, strip, to_number

# Floor for an empty bin, column names tried first as the prediction target.
EMPTY_BIN_SHARE = 0.0001
TARGET_PREFERENCE = ("target", "prediction", "loan_risk", "value", "y", "score")
PREDICTION_FEATURE = "prediction_output"


def histogram_of(long: DataFrame, keys: Sequence[str], bins: int | None, gap: bool, bracketed: bool | None) -> DataFrame:
    counts = {"ref_n": F.col("_is_ref").cast("int"), "cur_n": (~F.col("_is_ref")).cast("int")}
    if bins is None or keys or not brackets.worthwhile(long, bracketed):
        return quantiles.value_histogram(long, [*keys, "feature"], counts)
    ranks = {"ref_n": quantiles.linspace(bins)}
    return brackets.bracketed_histogram(long, ["feature"], counts, ranks, ("ref_n", "cur_n") if gap else None)


def labelled_histogram(
    df: DataFrame, features: Sequence[str], is_reference: Column, keys: Sequence[str] = (), bins: int | None = None, gap: bool = True,
    bracketed: bool | None = None,
) -> DataFrame:
    """Side histogram of one DataFrame whose rows are marked as reference or current.

    Identifier columns are left out here, by name, before any row is read. Without ``bins`` every distinct value is a row. With
    ``bins`` (and no ``keys``) a large input's values that neither PSI with that many bins nor KS looks at are merged, which shuffles a few
    percent of them; ``gap=False`` leaves out those that only KS needs. ``bracketed`` overrules the estimate of the size.
    """
    features = [f for f in features if not is_identifier(f)]
    long = quantiles.numeric_long(df.withColumn("_is_ref", is_reference), features, [*keys, "_is_ref"])
    return histogram_of(long, keys, bins, gap, bracketed)


def side_histogram(
    reference: DataFrame, current: DataFrame, features: Sequence[str], keys: Sequence[str] = (), bins: int | None = None, gap: bool = True,
    bracketed: bool | None = None,
) -> DataFrame:
    """Side histogram of two DataFrames; the options as in :func:`labelled_histogram`."""
    features = [f for f in features if not is_identifier(f)]
    ref = quantiles.numeric_long(reference, features, keys).withColumn("_is_ref", F.lit(True))
    cur = quantiles.numeric_long(current, features, keys).withColumn("_is_ref", F.lit(False))
    return histogram_of(ref.unionByName(cur), keys, bins, gap, bracketed)


def comparable_columns(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Numeric features present on both sides, with the value count per side."""
    counts = hist.groupBy(*keys, "feature").agg(F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n"))
    return counts.filter((F.col("ref_n") > 0) & (F.col("cur_n") > 0))


def psi(hist: DataFrame, keys: Sequence[str] = (), bins: int = 10, buckets: int | None = None) -> DataFrame:
    """Population stability index per feature over the reference's quantile bins.

    Repeated cut points collapse; values outside the reference range belong to no bin but stay in the
    denominator; fewer than two cut points score 0.
    """
    both = psi_from_cuts(hist, ordered_pass(hist, keys, bins, buckets), keys, bins)
    return both.filter(F.col("ref_n") > 0).select(*keys, "feature", "ref_n", "cur_n", "psi_score")


def ordered_pass(hist: DataFrame, keys: Sequence[str], bins: int, buckets: int | None) -> DataFrame:
    """KS statistic and reference quantiles ``q`` per feature from one running total over the distinct values."""
    group = [*keys, "feature"]
    running = ordering.running_totals(hist, group, "value", ["ref_n", "cur_n"], buckets, bounded=not keys)
    steps = quantiles.linspace(bins)
    found = running.groupBy(*group, "_all_ref_n", "_all_cur_n").agg(
        F.coalesce(F.max(cdf_gap()), F.lit(0.0)).alias("ks_score"),
        *quantiles.rank_hits(steps, "_all_ref_n", "value", "ref_n", "upto_ref_n"),
    )
    return found.select(
        *group, F.col("_all_ref_n").alias("all_ref"), F.col("_all_cur_n").alias("all_cur"), "ks_score",
        quantiles.interpolate(steps, "_all_ref_n").alias("q"),
    )


def psi_from_cuts(hist: DataFrame, cuts: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """PSI once the reference quantiles ``q`` and both side totals are known per feature."""
    group = [*keys, "feature"]
    passed = [c for c in cuts.columns if c not in {*group, "q"}]
    # Bin 1 starts at the first cut point; the last bin includes its upper end; 0 is "no bin".
    points = cuts.withColumn("_bp", F.array_distinct("q")).drop("q")
    if keys:
        sizes = hist.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
        joined = ordering.join_groups(hist, points.join(sizes, group), group, "_rows")
    else:
        joined = hist.join(F.broadcast(points), group)
    placed = ordering.count_at_or_below(joined, "_bp", "value", bins + 1, "_pos")
    bin_of = F.when(F.col("value") > F.element_at("_bp", -1), 0).otherwise(F.least("_pos", F.size("_bp") - 1))
    # Bin counts first, so that the per-feature step sees at most bins + 1 rows per feature.
    counted = (
        placed.select(*group, *passed, F.size("_bp").alias("_points"), bin_of.alias("_bin"), "ref_n", "cur_n")
        .groupBy(*group, *passed, "_points", "_bin")
        .agg(F.sum("ref_n").alias("r"), F.sum("cur_n").alias("c"))
    )
    slots = lambda side: F.expr(
        f"array({', '.join(f'coalesce(sum(CASE WHEN _bin = {i} THEN {side} END), 0)' for i in range(1, bins + 1))})"
    )
    wide = counted.groupBy(*group, *passed, "_points").agg(slots("r").alias("_r"), slots("c").alias("_c"))
    share = lambda n, total: f"CASE WHEN {n} = 0 THEN {EMPTY_BIN_SHARE}D ELSE {n} / greatest({total}, 1) END"
    score = F.expr(
        f"""CASE WHEN _points < 2 THEN 0.0D ELSE aggregate(
          transform(slice(arrays_zip(_r, _c), 1, greatest(_points - 1, 1)),
            p -> named_struct('r', {share('p._r', 'all_ref')}, 'c', {share('p._c', 'all_cur')})),
          0.0D, (acc, s) -> acc + (s.c - s.r) * ln(s.c / s.r)) END"""
    )
    return wide.select(*group, *passed, score.alias("psi_score")).withColumnsRenamed(
        {"all_ref": "ref_n", "all_cur": "cur_n"}
    )


def cdf_gap() -> Column:
    return F.expr("abs(try_divide(upto_ref_n, _all_ref_n) - try_divide(upto_cur_n, _all_cur_n))")


def with_pvalue(df: DataFrame) -> DataFrame:
    return df.withColumn("ks_pvalue", quantiles.ks_pvalue("ks_score", "ref_n", "cur_n"))


def ks(hist: DataFrame, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value per feature."""
    group = [*keys, "feature"]
    running = ordering.running_totals(hist, group, "value", ["ref_n", "cur_n"], buckets, bounded=not keys)
    stat = running.groupBy(*group, "_all_ref_n", "_all_cur_n").agg(
        F.coalesce(F.max(cdf_gap()), F.lit(0.0)).alias("ks_score")
    )
    return with_pvalue(stat.withColumnsRenamed({"_all_ref_n": "ref_n", "_all_cur_n": "cur_n"}))


def scored(df: DataFrame) -> DataFrame:
    """Add drift_score, severity and drift_detected from the two metric columns."""
    return (
        df.withColumn("drift_score", F.greatest("psi_score", "ks_score"))
        .withColumn("severity", severity.of_drift_score(F.col("drift_score")))
        .withColumn("drift_detected", F.col("drift_score") > DEFAULTS.drift_detected)
    )


def data_drift(
    hist: DataFrame, keys: Sequence[str] = (), bins: int = 10, buckets: int | None = None
) -> DataFrame:
    """PSI and KS of every comparable feature, scored.

    The ordered pass is shared: one running total per distinct value yields the KS gap and the reference
    quantiles together; a second read of the same histogram fills the PSI bins.
    """
    comparable = (F.col("ref_n") > 0) & (F.col("cur_n") > 0)
    both = with_pvalue(psi_from_cuts(hist, ordered_pass(hist, keys, bins, buckets), keys, bins)).filter(comparable)
    return scored(both).withColumn("type", F.lit("data_drift")).withColumnRenamed("feature", "feature_name")


def finding_columns(keys: Sequence[str] = ()) -> list[str]:
    return [*keys, "feature_name", "psi_score", "ks_score", "ks_pvalue", "drift_score", "severity",
            "drift_detected", "type"]


def profile_drift(df: DataFrame, rules: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """Drift against a stored profile when no reference rows exist: one aggregate over the batch.

    Numeric: largest of share outside [min, max], range growth and mean shift, both relative to
    max(max - min, 1). Enumerated text: share of values that the profile does not list.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    usable = [r for r in rules if r.name in present and not is_identifier(r.name) and not r.name.startswith("_")]
    aggregates, records = [], []
    for position, rule in enumerate(usable):
        if rule.is_numeric:
            v = to_number(F.col(rule.name), present[rule.name])
            lo, hi = float(rule.min), float(rule.max)
            width = max(hi - lo, 1.0)
            n, mn, mx, mean, outside = (f"_{k}{position}" for k in ("n", "mn", "mx", "av", "out"))
            aggregates += [
                F.count(v).alias(n), F.min(v).alias(mn), F.max(v).alias(mx), F.avg(v).alias(mean),
                F.count_if((v < lo) | (v > hi)).alias(outside),
            ]
            growth = F.greatest(F.lit(0.0), F.lit(lo) - F.col(mn), F.col(mx) - F.lit(hi)) / width
            shift = (
                F.abs(F.col(mean) - float(rule.mean)) / width if rule.mean is not None else F.lit(0.0)
            )
            score = F.greatest(F.try_divide(outside, n), growth, shift)
            kind = "numeric"
        elif rule.unique_values:
            allowed = sorted({str(v).strip().upper() for v in rule.unique_values})
            text = F.upper(strip(F.col(rule.name).cast("string")))
            n, outside = f"_n{position}", f"_out{position}"
            aggregates += [F.count(text).alias(n), F.count_if(~text.isin(*allowed)).alias(outside)]
            score = F.try_divide(outside, n)
            kind = "categorical"
        else:
            continue
        records.append(
            F.struct(
                F.lit(rule.name).alias("feature_name"), F.lit(kind).alias("profile_type"),
                F.col(n).alias("value_count"), score.alias("psi_score"),
            )
        )
    wide = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    rows = wide.select(*keys, F.inline(F.array(*records))).filter(F.col("value_count") > 0)
    return scored(rows.withColumn("ks_score", F.lit(0.0)).withColumn("ks_pvalue", F.lit(1.0))).withColumn(
        "type", F.lit("data_drift")
    )


def target_column(columns: Sequence[str], features: Sequence[str]) -> str | None:
    """Column of the reference that predictions are compared with."""
    for name in TARGET_PREFERENCE:
        if name in columns:
            return name
    others = [c for c in columns if c not in features]
    return others[-1] if others else None


def concept_drift(
    reference: DataFrame, predictions: DataFrame, target: str, prediction: str = "value", keys: Sequence[str] = ()
) -> DataFrame:
    """PSI and KS of the predicted values against the reference target, stored as one pseudo feature."""
    number = lambda df, name: to_number(F.col(name), df.schema[name].dataType).alias(PREDICTION_FEATURE)
    ref = reference.select(*keys, number(reference, target))
    cur = predictions.select(*keys, number(predictions, prediction))
    hist = side_histogram(ref, cur, [PREDICTION_FEATURE], keys, bins=10)
    return data_drift(hist, keys).withColumn("type", F.lit("concept_drift"))


def drift_run(data: DataFrame, concept: DataFrame | None, keys: Sequence[str] = ()) -> DataFrame:
    """All drift findings of a run: data (or profile) drift plus concept drift."""
    cols = finding_columns(keys)
    out = data.select(*cols)
    return out.unionByName(concept.select(*cols)) if concept is not None else out


def runs_to_backfill(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Runs that have no drift finding yet."""
    return runs.join(findings.select("run_id").distinct(), "run_id", "left_anti")


def interpretation(findings: DataFrame) -> DataFrame:
    """Readable title, cause and action per drift finding."""
    # Wording of the explanation texts.
    feature = F.coalesce(F.col("feature_name"), F.lit("Feature"))
    strength = (
        F.when(F.col("psi_score") >= 0.3, "strong").when(F.col("psi_score") >= 0.2, "moderate").otherwise("minor")
    )
    note = F.when(
        F.col("ks_pvalue") < 0.05,
        "The KS p-value supports a statistically significant distribution shift.",
    ).otherwise(
        "The KS p-value is not significant, so treat this as monitoring evidence and confirm with source context."
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    detected = F.col("drift_detected")
    title = F.when(
        detected, F.concat(feature, F.lit(" shows "), strength, F.lit(" population drift"))
    ).otherwise(F.concat(feature, F.lit(" is stable")))
    cause = F.when(
        detected,
        F.format_string(
            "%s no longer matches the baseline distribution. PSI=%.4f, KS=%.4f, drift score=%.4f. %s",
            feature, zero("psi_score"), zero("ks_score"), zero("drift_score"), note,
        ),
    ).otherwise(F.lit("Current values are close to the active baseline distribution."))
    action = F.when(
        detected,
        F.concat(
            F.lit("Check whether "), feature, F.lit("'s source, business mix, or time window changed. "),
            F.lit("Fix upstream data if unexpected; refresh the baseline or retrain only if the shift is valid."),
        ),
    ).otherwise(F.lit("Keep monitoring future runs."))
    return findings.withColumns({"title": title, "cause": cause, "action": action})
