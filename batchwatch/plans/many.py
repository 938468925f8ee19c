"""Queries that check and clean the batches of many models in one job, each by its own baseline (a model for each supplier)."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchwatch.operators import many, profile
from batchwatch.plans.registry import query
from batchwatch.plans.sqltext import marker, number
from batchwatch.plans.views import base, view, with_views
from batchwatch.sources.storage import stored

COLUMNS = ("quantity", "discount", "returnflag", "is_open")
KEYS = ("l_orderkey", "l_linenumber")

# The corrupted batch of every supplier against the baseline of its clean one.
_FLAGGED = f"""bounds AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.01) AS q_lo, quantile_cont(l_quantity, 0.99) AS q_hi, quantile_cont(l_discount, 0.01) AS d_lo,
    quantile_cont(l_discount, 0.99) AS d_hi, quantile_cont(l_quantity, 0.5) AS q_mid, quantile_cont(l_discount, 0.5) AS d_mid, list(DISTINCT l_returnflag) AS flags,
    list(DISTINCT CASE WHEN l_linestatus = 'O' THEN 'TRUE' ELSE 'FALSE' END) AS opens FROM lineitem GROUP BY l_suppkey),
  parsed AS (SELECT r.*, b.* EXCLUDE (l_suppkey), {marker('quantity')} AS q_mark, {marker('discount')} AS d_mark, {marker('returnflag')} AS r_mark, {marker('is_open')} AS o_mark,
    {number('quantity')} AS q_num, {number('discount')} AS d_num, CASE WHEN lower(trim(is_open)) IN ('true', '1', 'yes', 'y', 't') THEN true
      WHEN lower(trim(is_open)) IN ('false', '0', 'no', 'n', 'f') THEN false END AS o_flag, list_contains(flags, upper(trim(returnflag))) AS r_known,
    list_contains(opens, upper(trim(is_open))) AS o_known FROM lineitem_raw r JOIN bounds b ON r.l_suppkey = b.l_suppkey),
  counted AS (SELECT *, CAST(q_mark OR q_num IS NULL OR q_num < q_lo OR q_num > q_hi AS INTEGER) + CAST(d_mark OR d_num IS NULL OR d_num < d_lo OR d_num > d_hi AS INTEGER)
    + CAST(r_mark OR NOT r_known AS INTEGER) + CAST(o_mark OR o_flag IS NULL AS INTEGER) AS issue_count,
    CASE WHEN q_num BETWEEN q_lo AND q_hi THEN q_num END AS q, CASE WHEN d_num BETWEEN d_lo AND d_hi THEN d_num END AS d, CASE WHEN r_known AND NOT r_mark THEN upper(trim(returnflag)) END AS r FROM parsed),
  kept AS (SELECT * FROM counted WHERE issue_count / 4.0 < 0.7)"""


def _baselines(spark, sf_dir):
    rows = base(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("model_id"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag"),
        (F.col("l_linestatus") == "O").alias("is_open"),
    )
    return profile.create_baseline(rows, ["model_id"])


def _rules(spark, sf_dir):
    """The stored baselines of all models."""
    return stored(many.rule_table(_baselines(spark, sf_dir)), "rules")


def flagged(spark, sf_dir, rules):
    raw = view(spark, sf_dir, "lineitem_raw").withColumnRenamed("l_suppkey", "model_id")
    return many.flag_rows(many.as_cells(raw, COLUMNS, [*KEYS, "model_id"]), rules)


@query("rules_by_model", with_views("""SELECT l_suppkey AS model_id, 'quantity' AS column_name, 'number' AS kind, round(quantile_cont(l_quantity, 0.01), 6) AS lo, round(quantile_cont(l_quantity, 0.99), 6) AS hi,
    '' AS allowed, round(quantile_cont(l_quantity, 0.5), 6)::VARCHAR AS fallback FROM lineitem GROUP BY 1
  UNION ALL SELECT l_suppkey, 'discount', 'number', round(quantile_cont(l_discount, 0.01), 6), round(quantile_cont(l_discount, 0.99), 6), '', round(quantile_cont(l_discount, 0.5), 6)::VARCHAR FROM lineitem GROUP BY 1
  UNION ALL SELECT l_suppkey, 'returnflag', 'listed', NULL, NULL, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), min(l_returnflag) FROM lineitem GROUP BY 1
  UNION ALL SELECT l_suppkey, 'is_open', 'flag', NULL, NULL, string_agg(DISTINCT CASE WHEN l_linestatus = 'O' THEN 'TRUE' ELSE 'FALSE' END, ',' ORDER BY CASE WHEN l_linestatus = 'O' THEN 'TRUE' ELSE 'FALSE' END), 'false' FROM lineitem GROUP BY 1"""))
def rules_by_model(spark, sf_dir):
    """The rule table itself, one row for each model and column."""
    rules = many.rule_table(_baselines(spark, sf_dir)).select("model_id", F.explode("rules").alias("column_name", "rule"))
    fallback = F.when(F.col("rule.kind") == many.NUMBER, F.round(F.col("rule.fallback").cast("double"), 6).cast("string")).otherwise(F.col("rule.fallback"))
    return rules.select(
        "model_id", "column_name", "rule.kind", F.round("rule.lo", 6).alias("lo"), F.round("rule.hi", 6).alias("hi"),
        F.coalesce(F.array_join(F.array_sort("rule.allowed"), ","), F.lit("")).alias("allowed"), fallback.alias("fallback"),
    )


@query("flags_by_model", with_views(f"WITH {_FLAGGED} SELECT l_suppkey AS model_id, l_orderkey, l_linenumber, CAST(issue_count AS BIGINT) AS issue_count, issue_count / 4.0 >= 0.7 AS is_quarantined FROM counted"))
def flags_by_model(spark, sf_dir):
    return flagged(spark, sf_dir, _rules(spark, sf_dir)).select("model_id", *KEYS, "issue_count", "is_quarantined")


@query("clean_by_model", with_views(f"""WITH {_FLAGGED},
  fills AS (SELECT l_suppkey, quantile_cont(q, 0.5) AS q_fill, quantile_cont(d, 0.5) AS d_fill FROM kept GROUP BY l_suppkey),
  r_fills AS (SELECT l_suppkey, r AS r_fill FROM kept WHERE r IS NOT NULL GROUP BY l_suppkey, r QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, lower(r)) = 1),
  o_fills AS (SELECT l_suppkey, o_flag AS o_fill FROM kept WHERE o_flag IS NOT NULL GROUP BY l_suppkey, o_flag QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, o_flag) = 1)
  SELECT k.l_suppkey AS model_id, l_orderkey, l_linenumber, round(coalesce(q, q_fill, q_mid), 6) AS quantity, round(coalesce(d, d_fill, d_mid), 6) AS discount,
    coalesce(r, r_fill, list_min(flags)) AS returnflag, coalesce(o_flag, o_fill, false) AS is_open
  FROM kept k LEFT JOIN fills f ON k.l_suppkey = f.l_suppkey LEFT JOIN r_fills r ON k.l_suppkey = r.l_suppkey LEFT JOIN o_fills o ON k.l_suppkey = o.l_suppkey"""))
def clean_by_model(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    cells = many.clean_by_model(flagged(spark, sf_dir, rules), rules, keep=KEYS)
    cell = lambda c, t: F.element_at("cells", F.lit(c)).cast(t)
    return cells.select(
        "model_id", *KEYS, F.round(cell("quantity", "double"), 6).alias("quantity"), F.round(cell("discount", "double"), 6).alias("discount"),
        cell("returnflag", "string").alias("returnflag"), cell("is_open", "boolean").alias("is_open"),
    )


def _checks_sql() -> str:
    none = "NULL::DOUBLE AS observed_min, NULL::DOUBLE AS observed_max, NULL::DOUBLE AS baseline_min, NULL::DOUBLE AS baseline_max"
    parts = [
        f"SELECT l_suppkey AS model_id, '{c}' AS column_name, 'null_ratio' AS check_type, avg(CAST({p}_mark AS INTEGER)) <= 0.3 AS success, count(*) FILTER ({p}_mark) AS bad_count, "
        f"round(avg(CAST({p}_mark AS INTEGER)), 6) AS ratio, {none} FROM parsed GROUP BY l_suppkey" for c, p in (("quantity", "q"), ("discount", "d"), ("returnflag", "r"), ("is_open", "o"))
    ] + [
        f"SELECT l_suppkey, '{c}', 'range', min({p}_num) >= min({p}_lo) AND max({p}_num) <= max({p}_hi), count(*) FILTER ({p}_num < {p}_lo OR {p}_num > {p}_hi), NULL, "
        f"min({p}_num), max({p}_num), round(min({p}_lo), 6), round(max({p}_hi), 6) FROM parsed GROUP BY l_suppkey HAVING count({p}_num) > 0" for c, p in (("quantity", "q"), ("discount", "d"))
    ] + [
        f"SELECT l_suppkey, '{c}', 'categorical', count(*) FILTER (NOT {p}_mark AND NOT {p}_known) = 0, count(*) FILTER (NOT {p}_mark AND NOT {p}_known), NULL, NULL, NULL, NULL, NULL FROM parsed GROUP BY l_suppkey"
        for c, p in (("returnflag", "r"), ("is_open", "o"))
    ]
    return f"WITH {_FLAGGED} " + " UNION ALL ".join(parts)


@query("checks_by_model", with_views(_checks_sql()))
def checks_by_model(spark, sf_dir):
    found = many.checks_by_model(flagged(spark, sf_dir, _rules(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 6) for c in ("ratio", "baseline_min", "baseline_max")})


@query("unseen_by_model", with_views(f"""WITH {_FLAGGED} SELECT l_suppkey AS model_id, 'returnflag' AS column_name, upper(trim(returnflag)) AS upper_value, count(*) AS row_count FROM parsed WHERE NOT r_mark AND NOT r_known GROUP BY ALL
  UNION ALL SELECT l_suppkey, 'is_open', upper(trim(is_open)), count(*) FROM parsed WHERE NOT o_mark AND NOT o_known GROUP BY ALL"""))
def unseen_by_model(spark, sf_dir):
    return many.unseen_by_model(flagged(spark, sf_dir, _rules(spark, sf_dir)))
