"""Queries for column rules, profiling, validation and cleaning."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from batchwatch.functions import cells
from batchwatch.functions.cells import finite, is_identifier_col, without_markers
from batchwatch.operators import clean, profile, run, validate
from batchwatch.plans.registry import query
from batchwatch.plans.sqltext import FLAGGED, identifier, marker, number
from batchwatch.plans.views import base, view, with_views

KEYS = ("l_orderkey", "l_linenumber")
CONTRACT = ("quantity", "discount", "returnflag", "is_open")
ALL_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@lru_cache(maxsize=8)
def _rules(app_id: str, spark, sf_dir: str):
    return tuple(profile.load_rules(profile.create_baseline(view(spark, sf_dir, "lineitem_clean")), CONTRACT))


def rules(spark, sf_dir):
    """Baseline of the clean batch (a stored contract in real use), learned once per session."""
    return list(_rules(spark.sparkContext.applicationId, spark, sf_dir))


def flagged(spark, sf_dir, keep=KEYS):
    return clean.flag_rows(view(spark, sf_dir, "lineitem_raw"), rules(spark, sf_dir), keep)


def checked(sql: str) -> str:
    return with_views(sql)


# ---- types and names -------------------------------------------------------------------------------------------

TEXT_COLUMNS = ("order_no", "tax", "open_flag", "line_no", "returnflag", "supplier_id", "nothing")
_TYPES_SQL = "WITH cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN NOT {marker(c)} THEN {c} END AS cell FROM lineitem_text"
    for c in TEXT_COLUMNS
) + f"""), counts AS (SELECT column_name, count(*) AS n, count(cell) AS p, count({number('cell')}) AS num,
  count(*) FILTER (regexp_full_match(trim(cell), '[+-]?[0-9]+')) AS w,
  count(*) FILTER (trim(cell) IN ('true', 'false', 'True', 'False', 'TRUE', 'FALSE')) AS b FROM cells GROUP BY column_name),
  typed AS (SELECT column_name, CASE WHEN p = 0 THEN 'object' WHEN w = p AND p = n THEN 'int'
    WHEN b = p AND p = n THEN 'bool' WHEN num = p THEN 'float' ELSE 'object' END AS dtype,
    n AS row_count, p AS present_count FROM counts)"""


@query("extract_schema", checked(_TYPES_SQL + " SELECT * FROM typed"))
def extract_schema(spark, sf_dir):
    found = profile.extract_schema(view(spark, sf_dir, "lineitem_text"))
    return found.select("column_name", "dtype", "row_count", "present_count")


@query("classify_columns", checked(_TYPES_SQL + """ SELECT column_name, dtype, CASE dtype WHEN 'int' THEN 'numeric'
  WHEN 'float' THEN 'numeric' WHEN 'bool' THEN 'boolean' WHEN 'datetime' THEN 'datetime' ELSE 'categorical' END AS column_class FROM typed"""))
def classify_columns(spark, sf_dir):
    found = profile.classify_columns(profile.extract_schema(view(spark, sf_dir, "lineitem_text")))
    return found.select("column_name", "dtype", "column_class")


_NAMES = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN concat(p_brand, '_ID')
  WHEN 2 THEN ' Key ' WHEN 3 THEN 'paid' WHEN 4 THEN 'custkey' ELSE 'u_u_i_d' END AS column_name FROM part"""


@query("identifier_columns", f"SELECT p_partkey, column_name, {identifier('column_name')} AS is_identifier FROM ({_NAMES})")
def identifier_columns(spark, sf_dir):
    base(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_NAMES).withColumn("is_identifier", is_identifier_col(F.col("column_name")))


# ---- cell rules ------------------------------------------------------------------------------------------------


@query("normalize_missing", checked(
    "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"CASE WHEN NOT {marker(c)} THEN {c} END AS {c}" for c in CONTRACT) + " FROM lineitem_raw"))
def normalize_missing(spark, sf_dir):
    raw = view(spark, sf_dir, "lineitem_raw")
    return raw.select(*KEYS, *[without_markers(F.col(c)).alias(c) for c in CONTRACT])


@query("coerce_numeric", checked(f"""SELECT l_orderkey, l_linenumber, {number('quantity')} AS quantity, {number('discount')} AS discount,
  NOT {marker('quantity')} AND ({number('quantity')}) IS NULL AS quantity_invalid,
  NOT {marker('discount')} AND ({number('discount')}) IS NULL AS discount_invalid FROM lineitem_raw"""))
def coerce_numeric(spark, sf_dir):
    raw = view(spark, sf_dir, "lineitem_raw")
    found = {c: clean.coerce_numeric(F.col(c), raw.schema[c].dataType) for c in ("quantity", "discount")}
    return raw.select(
        *KEYS, *[r.value.alias(c) for c, r in found.items()], *[r.issue.alias(f"{c}_invalid") for c, r in found.items()]
    )


@query("mask_out_of_range", checked(f"""WITH {FLAGGED.strip()} SELECT l_orderkey, l_linenumber,
  CASE WHEN q_num BETWEEN q_lo AND q_hi THEN q_num END AS quantity, coalesce(q_num < q_lo OR q_num > q_hi, false) AS out_of_range
  FROM parsed, bounds"""))
def mask_out_of_range(spark, sf_dir):
    raw = view(spark, sf_dir, "lineitem_raw")
    rule = rules(spark, sf_dir)[0]
    value = clean.coerce_numeric(F.col("quantity"), raw.schema["quantity"].dataType).value
    masked = clean.mask_out_of_range(value, rule.bounds())
    return raw.select(*KEYS, masked.value.alias("quantity"), masked.issue.alias("out_of_range"))


@query("sanitize_boolean", checked(f"""WITH {FLAGGED.strip()} SELECT l_orderkey, l_linenumber, o_flag AS is_open,
  NOT o_mark AND o_flag IS NULL AS invalid FROM parsed"""))
def sanitize_boolean(spark, sf_dir):
    raw = view(spark, sf_dir, "lineitem_raw")
    flag = clean.sanitize_boolean(F.col("is_open"), raw.schema["is_open"].dataType)
    return raw.select(*KEYS, flag.value.alias("is_open"), flag.issue.alias("invalid"))


@query("mask_unseen_enum", checked(f"""WITH {FLAGGED.strip()} SELECT l_orderkey, l_linenumber,
  CASE WHEN r_known AND NOT r_mark THEN trim(returnflag) END AS returnflag, NOT r_mark AND NOT r_known AS unseen FROM parsed"""))
def mask_unseen_enum(spark, sf_dir):
    raw = view(spark, sf_dir, "lineitem_raw")
    rule = rules(spark, sf_dir)[2]
    known = clean.mask_unseen_enum(cells.strip(without_markers(F.col("returnflag"))), rule.allowed())
    return raw.select(*KEYS, known.value.alias("returnflag"), known.issue.alias("unseen"))


@query("row_issue_counts", checked(
    f"WITH {FLAGGED.strip()} SELECT l_orderkey, l_linenumber, issue_count, is_quarantined FROM counted"))
def row_issue_counts(spark, sf_dir):
    return flagged(spark, sf_dir).select(*KEYS, "issue_count", "is_quarantined")


@query("column_issue_counts", checked(f"""WITH {FLAGGED.strip()} SELECT 'quantity' AS column_name, CAST(sum(q_bad) AS BIGINT) AS issue_count FROM counted
  UNION ALL SELECT 'discount', CAST(sum(d_bad) AS BIGINT) FROM counted UNION ALL SELECT 'returnflag', CAST(sum(r_bad) AS BIGINT) FROM counted
  UNION ALL SELECT 'is_open', CAST(sum(o_bad) AS BIGINT) FROM counted"""))
def column_issue_counts(spark, sf_dir):
    return clean.column_issue_counts(flagged(spark, sf_dir), rules(spark, sf_dir))


@query("quarantine_rows", checked(f"""WITH {FLAGGED.strip()} SELECT l_orderkey, l_linenumber, quantity, discount, returnflag, is_open, issue_count
  FROM counted WHERE is_quarantined"""))
def quarantine_rows(spark, sf_dir):
    return clean.quarantined(flagged(spark, sf_dir), rules(spark, sf_dir), KEYS)


def _imputed(spark, sf_dir, *columns):
    return clean.impute(flagged(spark, sf_dir), rules(spark, sf_dir), keep=KEYS).select(*KEYS, *columns)


@query("impute_numeric", checked(f"WITH {FLAGGED.strip()} SELECT l_orderkey, l_linenumber, quantity, discount FROM imputed"))
def impute_numeric(spark, sf_dir):
    return _imputed(spark, sf_dir, "quantity", "discount")


@query("impute_boolean", checked(f"WITH {FLAGGED.strip()} SELECT l_orderkey, l_linenumber, is_open FROM imputed"))
def impute_boolean(spark, sf_dir):
    return _imputed(spark, sf_dir, "is_open")


@query("impute_categorical", checked(f"WITH {FLAGGED.strip()} SELECT l_orderkey, l_linenumber, returnflag FROM imputed"))
def impute_categorical(spark, sf_dir):
    return _imputed(spark, sf_dir, "returnflag")


_HALVES = "SELECT l_orderkey, l_linenumber, l_quantity / 2 AS half, l_discount, l_linestatus = 'O' AS flag FROM lineitem"


@query("coerce_types", f"""SELECT l_orderkey, l_linenumber, CAST(round_even(half, 0) AS BIGINT) AS half, l_discount, flag FROM ({_HALVES})""")
def coerce_types(spark, sf_dir):
    base(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    df = spark.sql(_HALVES)
    contract = [profile.ColumnRule("half", "int"), profile.ColumnRule("l_discount", "float"), profile.ColumnRule("flag", "bool")]
    return df.select(*KEYS, *[clean.coerced(r, F.col(r.name)).alias(r.name) for r in contract])


@query("normalize_categorical", """SELECT p_partkey, upper(trim(concat(' ', p_type, ' '))) AS p_type, trim(concat('  ', p_name)) AS p_name FROM part""")
def normalize_categorical(spark, sf_dir):
    part = base(spark, sf_dir, "part")
    padded = part.select("p_partkey", F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("p_type"),
                         F.concat(F.lit("  "), "p_name").alias("p_name"))
    contract = [profile.ColumnRule("p_type", "object", unique_values=("a",)), profile.ColumnRule("p_name", "object")]
    return padded.select("p_partkey", *[clean.normalized(r, F.col(r.name)).alias(r.name) for r in contract])


@query("clean_batch", checked(f"""WITH {FLAGGED.strip()} SELECT l_orderkey, l_linenumber, quantity, discount,
  upper(trim(returnflag)) AS returnflag, is_open FROM imputed"""))
def clean_batch(spark, sf_dir):
    return clean.clean_batch(flagged(spark, sf_dir), rules(spark, sf_dir), keep=KEYS)


@query("clean_batch_by_run", checked(f"""WITH {FLAGGED.strip()},
  per_run AS (SELECT l_suppkey, quantile_cont(quantity, 0.5) AS q_fill, quantile_cont(discount, 0.5) AS d_fill FROM kept GROUP BY l_suppkey),
  r_run AS (SELECT l_suppkey, returnflag AS r_fill FROM (SELECT l_suppkey, returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, returnflag) AS p
    FROM kept WHERE returnflag IS NOT NULL GROUP BY l_suppkey, returnflag) WHERE p = 1),
  o_run AS (SELECT l_suppkey, is_open AS o_fill FROM (SELECT l_suppkey, is_open, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, is_open) AS p
    FROM kept WHERE is_open IS NOT NULL GROUP BY l_suppkey, is_open) WHERE p = 1)
  SELECT k.l_suppkey, l_orderkey, l_linenumber, coalesce(quantity, q_fill, q_mid) AS quantity, coalesce(discount, d_fill, d_mid) AS discount,
    upper(trim(coalesce(returnflag, r_fill, 'A'))) AS returnflag, coalesce(is_open, o_fill, false) AS is_open
  FROM kept k CROSS JOIN bounds LEFT JOIN per_run p ON k.l_suppkey = p.l_suppkey LEFT JOIN r_run r ON k.l_suppkey = r.l_suppkey
  LEFT JOIN o_run o ON k.l_suppkey = o.l_suppkey"""))
def clean_batch_by_run(spark, sf_dir):
    """Many batches at once: one batch per supplier, each imputed from its own rows."""
    many = flagged(spark, sf_dir, (*KEYS, "l_suppkey"))
    return clean.clean_batch(many, rules(spark, sf_dir), keys=["l_suppkey"], keep=KEYS)


@query("cleaning_audit", checked(f"""WITH {FLAGGED.strip()} SELECT count(*) AS rows_in, count(*) FILTER (NOT is_quarantined) AS rows_out,
  count(*) FILTER (is_quarantined) AS rows_removed, CAST(0.7 AS DOUBLE) AS row_issue_threshold FROM counted"""))
def cleaning_audit(spark, sf_dir):
    return clean.cleaning_audit(flagged(spark, sf_dir))


@query("scoring_features", """SELECT l_orderkey, l_linenumber, coalesce(l_tax, 0.0) AS l_tax, coalesce(l_quantity, 0.0) AS l_quantity FROM lineitem""")
def scoring_features(spark, sf_dir):
    df = base(spark, sf_dir, "lineitem")
    return clean.scoring_features(df, ["L_TAX", "absent", "L_Quantity"], keep=KEYS)


@query("finite_guard", """SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN NULL ELSE value END AS value FROM events""")
def finite_guard(spark, sf_dir):
    kind = F.col("event_id") % 5
    odd = (
        F.when(kind == 0, float("nan")).when(kind == 1, float("inf")).when(kind == 2, float("-inf"))
        .otherwise(F.col("value"))
    )
    return base(spark, sf_dir, "events").select("event_id", finite(odd).alias("value"))


# ---- profiles --------------------------------------------------------------------------------------------------

NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _numeric_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS value_count, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean,
      quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.99) AS p99 FROM lineitem"""


_ROUNDED = ("median", "p01", "p99")


_PROFILE_SQL = ("SELECT column_name, value_count, min, max, mean, round(median, 6) AS median, round(p01, 6) AS p01, round(p99, 6) AS p99 FROM ("
       + " UNION ALL ".join(_numeric_sql(c) for c in NUMERIC) + ")")


@query("profile_numeric", _PROFILE_SQL)
def profile_numeric(spark, sf_dir):
    found = profile.profile_numeric(base(spark, sf_dir, "lineitem"), NUMERIC)
    return found.withColumn("mean", F.round("mean", 4)).withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query("profile_numeric_bracketed", _PROFILE_SQL)
def profile_numeric_bracketed(spark, sf_dir):
    """The profile as for a large input: only the values at the wanted ranks are shuffled."""
    found = profile.profile_numeric(base(spark, sf_dir, "lineitem"), NUMERIC, bracketed=True)
    return found.withColumn("mean", F.round("mean", 4)).withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query("batch_medians", checked(f"""WITH {FLAGGED.strip()} SELECT 'quantity' AS column_name, quantile_cont(quantity, 0.5) AS median FROM kept
  UNION ALL SELECT 'discount', quantile_cont(discount, 0.5) FROM kept"""))
def batch_medians(spark, sf_dir):
    """Medians of the accepted cells, as for a large batch."""
    return clean.medians(clean.accepted(flagged(spark, sf_dir)), rules(spark, sf_dir), bracketed=True)


@query("profile_numeric_by_run", """SELECT l_suppkey, 'l_quantity' AS column_name, count(l_quantity) AS value_count, min(l_quantity) AS min,
  max(l_quantity) AS max, round(avg(l_quantity), 4) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS median,
  round(quantile_cont(l_quantity, 0.01), 6) AS p01, round(quantile_cont(l_quantity, 0.99), 6) AS p99 FROM lineitem GROUP BY l_suppkey""")
def profile_numeric_by_run(spark, sf_dir):
    found = profile.profile_numeric(base(spark, sf_dir, "lineitem"), ["l_quantity"], ["l_suppkey"])
    return found.withColumn("mean", F.round("mean", 4)).withColumns({c: F.round(c, 6) for c in _ROUNDED})


MIXED = ("l_returnflag", "l_linestatus", "l_comment_id", "l_ship")
_MIXED_SQL = """SELECT l_returnflag, l_linestatus, CAST(l_orderkey AS STRING) AS l_comment_id, CAST(CAST(l_shipdate AS DATE) AS STRING) AS l_ship FROM lineitem"""
_CARDINALITY = "WITH mixed AS (" + _MIXED_SQL + "), card AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, count({c}) AS present_count FROM mixed" for c in MIXED
) + "), flagged_card AS (SELECT *, distinct_count >= 200 OR distinct_count / present_count >= 0.20 AS high_cardinality FROM card)"


def _mixed(spark, sf_dir):
    base(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_MIXED_SQL)


@query("cardinality_profile", _CARDINALITY + " SELECT * FROM flagged_card")
def cardinality_profile(spark, sf_dir):
    return profile.cardinality(profile.text_histogram(_mixed(spark, sf_dir), MIXED))


@query("profile_categorical", _CARDINALITY + ", vals AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, array_to_string(list_sort(list(v))[:50], ',') AS v50, array_to_string(list_sort(list(v))[:20], ',') AS v20 "
    f"FROM (SELECT DISTINCT {c} AS v FROM mixed WHERE {c} IS NOT NULL)" for c in MIXED) + f""")
  SELECT c.column_name, CASE WHEN {identifier('c.column_name')} THEN 'identifier' WHEN high_cardinality THEN 'text' ELSE 'categorical' END AS type,
    CASE WHEN {identifier('c.column_name')} THEN 'identifier' WHEN high_cardinality THEN 'high_cardinality' ELSE 'enum' END AS validation_mode,
    distinct_count, CASE WHEN NOT {identifier('c.column_name')} AND NOT high_cardinality THEN v50 END AS unique_values,
    CASE WHEN NOT {identifier('c.column_name')} AND high_cardinality THEN v20 END AS sample_values
  FROM flagged_card c JOIN vals v ON c.column_name = v.column_name""")
def profile_categorical(spark, sf_dir):
    found = profile.profile_categorical(_mixed(spark, sf_dir), MIXED)
    return found.withColumns({c: F.array_join(c, ",") for c in ("unique_values", "sample_values")})


@query("create_baseline", "SELECT column_name, dtype, type, validation_mode, min, max, round(mean, 4) AS mean, median, p01, p99, unique_values FROM ("
       + " UNION ALL ".join(
           f"""SELECT '{c}' AS column_name, 'float' AS dtype, 'numeric' AS type, CAST(NULL AS STRING) AS validation_mode, min({c}) AS min, max({c}) AS max,
           avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.99) AS p99,
           CAST(NULL AS STRING) AS unique_values FROM lineitem""" for c in NUMERIC)
       + " UNION ALL " + " UNION ALL ".join(
           f"""SELECT '{c}', 'object', 'categorical', 'enum', NULL, NULL, NULL, NULL, NULL, NULL, string_agg(v, ',' ORDER BY v)
           FROM (SELECT DISTINCT {c} AS v FROM lineitem)""" for c in ("l_returnflag", "l_linestatus")) + ")")
def create_baseline(spark, sf_dir):
    df = base(spark, sf_dir, "lineitem").select(*ALL_COLUMNS)
    found = profile.create_baseline(df).withColumn("mean", F.round("mean", 4))
    return found.withColumn("unique_values", F.array_join("unique_values", ",")).drop("sample_values")


# ---- validation ------------------------------------------------------------------------------------------------


def _null_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, 'null_ratio' AS check_type, avg(CAST({marker(c)} AS INTEGER)) <= 0.30 AS success,
      round(avg(CAST({marker(c)} AS INTEGER)), 6) AS ratio, CAST(0.3 AS DOUBLE) AS threshold, count(*) FILTER ({marker(c)}) AS missing_count,
      count(*) AS row_count FROM lineitem_raw"""


_NULLS = " UNION ALL ".join(_null_sql(c) for c in CONTRACT)


@query("check_null_ratio", checked(_NULLS))
def check_null_ratio(spark, sf_dir):
    found = validate.check_null_ratio(view(spark, sf_dir, "lineitem_raw"), rules(spark, sf_dir))
    return found.withColumn("ratio", F.round("ratio", 6))


def _range_sql(c: str, p: str) -> str:
    return f"""SELECT '{c}' AS column_name, 'range' AS check_type, min({p}_num) >= min({p}_lo) AND max({p}_num) <= max({p}_hi) AS success,
      min({p}_num) AS observed_min, max({p}_num) AS observed_max, round(min({p}_lo), 6) AS baseline_min, round(max({p}_hi), 6) AS baseline_max,
      count(*) FILTER ({p}_num < {p}_lo) AS below_min_count, count(*) FILTER ({p}_num > {p}_hi) AS above_max_count FROM parsed, bounds"""


_RANGES = f"{_range_sql('quantity', 'q')} UNION ALL {_range_sql('discount', 'd')}"


@query("check_range", checked(f"WITH {FLAGGED.strip()} {_RANGES}"))
def check_range(spark, sf_dir):
    found = validate.check_range(view(spark, sf_dir, "lineitem_raw"), rules(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("baseline_min", "baseline_max")})


@query("check_categorical", checked(f"""WITH {FLAGGED.strip()}, seen AS (SELECT upper(trim(returnflag)) AS v, count(*) AS n FROM parsed WHERE NOT r_mark GROUP BY 1)
  SELECT 'returnflag' AS column_name, 'categorical' AS check_type, count(*) FILTER (v NOT IN ('A', 'N', 'R')) = 0 AS success,
    count(*) FILTER (v NOT IN ('A', 'N', 'R')) AS unseen_distinct, CAST(coalesce(sum(n) FILTER (v NOT IN ('A', 'N', 'R')), 0) AS BIGINT) AS unseen_count,
    coalesce(string_agg(v, ',' ORDER BY v) FILTER (v NOT IN ('A', 'N', 'R')), '') AS unseen_sample, 'A,N,R' AS allowed_sample FROM seen
  UNION ALL SELECT 'is_open', 'categorical', false, count(DISTINCT upper(trim(is_open))), count(*), string_agg(DISTINCT upper(trim(is_open)), ',' ORDER BY upper(trim(is_open))), 'FALSE,TRUE'
  FROM parsed WHERE NOT o_mark"""))
def check_categorical(spark, sf_dir):
    found = validate.check_categorical(view(spark, sf_dir, "lineitem_raw"), rules(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, ",") for c in ("unseen_sample", "allowed_sample")})


@query("unseen_values", checked(f"""WITH {FLAGGED.strip()} SELECT 'returnflag' AS column_name, upper(trim(returnflag)) AS upper_value, count(*) AS row_count
  FROM parsed WHERE NOT r_mark AND NOT r_known GROUP BY 2
  UNION ALL SELECT 'is_open', upper(trim(is_open)), count(*) FROM parsed WHERE NOT o_mark GROUP BY 2"""))
def unseen_values(spark, sf_dir):
    return validate.unseen_values(view(spark, sf_dir, "lineitem_raw"), rules(spark, sf_dir))


_WIDE = """SELECT l_returnflag AS flag, CAST(l_partkey AS STRING) AS part_code, CAST(l_linenumber AS STRING) AS line FROM lineitem"""


@query("check_categorical_eligibility", f"""WITH wide AS ({_WIDE}), card AS (
  SELECT 'flag' AS column_name, count(DISTINCT flag) AS distinct_count, count(flag) AS present_count, CAST(3 AS BIGINT) AS allowed_count FROM wide
  UNION ALL SELECT 'part_code', count(DISTINCT part_code), count(part_code), 50 FROM wide
  UNION ALL SELECT 'line', count(DISTINCT line), count(line), 50 FROM wide)
  SELECT *, distinct_count >= 200 OR distinct_count / present_count >= 0.2 AS high_cardinality,
    NOT (allowed_count >= 50 AND (distinct_count >= 200 OR distinct_count / present_count >= 0.2)) AS should_validate FROM card""")
def check_categorical_eligibility(spark, sf_dir):
    base(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    capped = tuple(str(i) for i in range(50))
    contract = [
        profile.ColumnRule("flag", "object", "categorical", "enum", unique_values=("A", "N", "R")),
        profile.ColumnRule("part_code", "object", "categorical", "enum", unique_values=capped),
        profile.ColumnRule("line", "object", "categorical", "enum", unique_values=capped),
    ]
    return validate.categorical_eligibility(spark.sql(_WIDE), contract)


_EXPECTED = {"order_no": "int", "tax": "int", "open_flag": "bool", "line_no": "int", "returnflag": "float",
             "supplier_id": "float", "nothing": "object"}
_TYPE_CHECK = _TYPES_SQL + ", whole AS (SELECT column_name, count(*) FILTER ((" + number("cell") + """) % 1 = 0) AS i FROM cells GROUP BY column_name),
  expected AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', '{t}')" for c, t in _EXPECTED.items()) + """) AS e(column_name, expected_type)),
  types_checked AS (SELECT t.column_name, e.expected_type, t.dtype AS actual_type,
    t.dtype = e.expected_type OR (e.expected_type = 'int' AND t.dtype IN ('float', 'object') AND w.i = t.present_count)
    OR (e.expected_type = 'float' AND t.dtype = 'int') OR (e.expected_type = 'float' AND t.dtype = 'object' AND c.num = t.present_count) AS compatible
  FROM typed t JOIN expected e ON t.column_name = e.column_name JOIN whole w ON w.column_name = t.column_name JOIN counts c ON c.column_name = t.column_name)"""


def _type_checks(spark, sf_dir):
    contract = [profile.ColumnRule(c, t) for c, t in _EXPECTED.items()]
    return validate.check_schema_types(view(spark, sf_dir, "lineitem_text"), contract)


@query("check_schema_types", checked(_TYPE_CHECK + " SELECT * FROM types_checked"))
def check_schema_types(spark, sf_dir):
    return _type_checks(spark, sf_dir)


@query("validation_summary", checked(f"""WITH {FLAGGED.strip()}, checks AS (SELECT success FROM ({_NULLS}) UNION ALL SELECT success FROM ({_RANGES})
    UNION ALL SELECT bool_and(r_known) FROM parsed WHERE NOT r_mark UNION ALL SELECT false),
  bad_types AS (SELECT count(*) AS schema_errors FROM (SELECT 1 FROM parsed HAVING count(*) FILTER (NOT q_mark AND q_num IS NULL) > 0
    UNION ALL SELECT 1 FROM parsed HAVING count(*) FILTER (NOT d_mark AND d_num IS NULL) > 0 UNION ALL SELECT 1))
  SELECT count(*) AS total_checks, count(*) FILTER (NOT success) AS failed_checks, round(count(*) FILTER (NOT success) / count(*), 6) AS failed_check_ratio,
    max(schema_errors) AS schema_errors, 'FAIL' AS status FROM checks, bad_types"""))
def validation_summary(spark, sf_dir):
    raw, contract = view(spark, sf_dir, "lineitem_raw"), rules(spark, sf_dir)
    found = validate.validation_summary(
        validate.all_checks(raw, contract), validate.check_schema_types(raw, contract)
    )
    return found.withColumn("failed_check_ratio", F.round("failed_check_ratio", 6))


@query("quality_gate", checked(f"""WITH {FLAGGED.strip()}, runs AS (SELECT l_orderkey AS run_id, count(*) FILTER (NOT is_quarantined) AS cleaned_rows, count(*) AS total_rows,
    count(*) FILTER (NOT is_quarantined AND quantity IS NULL) > 0.3 * count(*) FILTER (NOT is_quarantined) AS too_empty FROM counted GROUP BY l_orderkey),
  reasons AS (SELECT run_id, cleaned_rows, total_rows, cleaned_rows / total_rows AS r, CAST(too_empty AS BIGINT) AS failed_checks FROM runs)
  SELECT run_id, cleaned_rows, total_rows, round(r, 6) AS clean_row_ratio, concat_ws('|',
    CASE WHEN cleaned_rows = 0 THEN 'No usable rows remained after cleaning.' END,
    CASE WHEN cleaned_rows < 10 THEN concat('The cleaned dataset is below the minimum accepted row count (', cleaned_rows, ' < 10).') END,
    CASE WHEN r < 0.5 THEN concat('The cleaned dataset retained too few rows after quarantine (', printf('%.2f', r * 100), '% < 50%).') END,
    CASE WHEN failed_checks > 0 THEN concat('The cleaned dataset still failed ', failed_checks, ' validation checks.') END) AS blocking_reasons,
    CASE WHEN cleaned_rows >= 10 AND r >= 0.5 AND failed_checks = 0 THEN 'success' ELSE 'failed' END AS status FROM reasons"""))
def quality_gate(spark, sf_dir):
    """One gate decision per run (order): cleaned rows and the null-ratio check of the accepted rows."""
    rows = flagged(spark, sf_dir)
    kept = ~F.col("is_quarantined")
    missing = F.count_if(kept & F.col("quantity").isNull())
    runs = rows.groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count_if(kept).alias("cleaned_rows"), F.count(F.lit(1)).alias("total_rows"),
        (missing > 0.3 * F.count_if(kept)).cast("bigint").alias("failed_checks"),
    )
    gated = validate.quality_gate(runs.withColumns({"missing_columns": F.lit(0), "schema_errors": F.lit(0)}))
    return gated.select(
        "run_id", "cleaned_rows", "total_rows", F.round("clean_row_ratio", 6).alias("clean_row_ratio"),
        F.array_join("blocking_reasons", "|").alias("blocking_reasons"), "status",
    )


# ---- the composed run ------------------------------------------------------------------------------------------

# A run for each supplier: every fifth lacks a column, every seventh has one more, every third has many rows without a date.
_RUN_ROWS = """SELECT concat('run-', CAST(r.l_suppkey AS STRING)) AS run_id, r.l_suppkey AS supp, r.l_orderkey, r.l_linenumber, quantity,
    CASE WHEN r.l_suppkey % 5 = 0 THEN NULL ELSE discount END AS discount, returnflag, is_open,
    CASE WHEN r.l_suppkey % 3 = 0 AND r.l_orderkey % 2 = 0 THEN NULL ELSE i.l_shipdate END AS shipped
  FROM lineitem_raw r JOIN (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY l_orderkey, l_linenumber) i
    ON r.l_orderkey = i.l_orderkey AND r.l_linenumber = i.l_linenumber"""


def _composed(spark, sf_dir):
    base(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    view(spark, sf_dir, "lineitem_raw").createOrReplaceTempView("lineitem_raw")
    rows = spark.sql(_RUN_ROWS)
    runs = rows.select("run_id", "supp").distinct()
    always = [c for c in (*CONTRACT, "shipped") if c != "discount"]
    present = runs.select("run_id", F.explode(F.concat(
        F.array(*[F.lit(c) for c in always]), F.when(F.col("supp") % 5 != 0, F.array(F.lit("discount"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("supp") % 7 == 0, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>")),
    )).alias("column_name"))
    contract = [*rules(spark, sf_dir), profile.ColumnRule("shipped", "datetime")]
    return run.run_batches(runs.select("run_id"), rows.drop("supp"), present, contract, KEYS)


_COMPOSED_SQL = f"""WITH bounds AS (SELECT quantile_cont(l_quantity, 0.01) AS q_lo, quantile_cont(l_quantity, 0.99) AS q_hi, quantile_cont(l_discount, 0.01) AS d_lo, quantile_cont(l_discount, 0.99) AS d_hi FROM lineitem),
  run_rows AS ({_RUN_ROWS}),
  marked AS (SELECT *, {marker('quantity')} AS q_mark, {marker('discount')} AS d_mark, {marker('returnflag')} AS r_mark, {marker('is_open')} AS o_mark, {number('quantity')} AS q_num, {number('discount')} AS d_num FROM run_rows),
  judged AS (SELECT *, CAST(q_mark OR q_num IS NULL OR q_num < q_lo OR q_num > q_hi AS INTEGER) + CAST(discount IS NOT NULL AND (d_mark OR d_num IS NULL OR d_num < d_lo OR d_num > d_hi) AS INTEGER)
    + CAST(r_mark OR upper(trim(returnflag)) NOT IN ('A', 'N', 'R') AS INTEGER) + CAST(o_mark OR lower(trim(is_open)) NOT IN ('true', '1', 'yes', 'y', 't', 'false', '0', 'no', 'n', 'f') AS INTEGER) AS issues FROM marked, bounds),
  r AS (SELECT run_id, any_value(supp) AS supp, count(*) AS total_rows, count(*) FILTER (issues < 3.5) AS cleaned_rows, count(*) FILTER (issues < 3.5 AND shipped IS NULL) AS undated FROM judged GROUP BY run_id),
  g AS (SELECT *, cleaned_rows / total_rows AS ratio, CASE WHEN cleaned_rows > 0 AND undated / cleaned_rows > 0.3 THEN 1 ELSE 0 END AS failed_checks FROM r)
  SELECT run_id, total_rows, cleaned_rows, total_rows - cleaned_rows AS rows_removed, CASE WHEN supp % 7 = 0 THEN 'note' ELSE '' END AS extra_columns, CASE WHEN supp % 5 = 0 THEN 'discount' ELSE '' END AS missing_columns,
    CAST(failed_checks AS BIGINT) AS failed_checks, CAST(0 AS BIGINT) AS schema_errors, round(ratio, 6) AS clean_row_ratio, concat_ws('|',
    CASE WHEN supp % 5 = 0 THEN 'The incoming dataset is missing baseline-required columns and cannot be treated as production-safe input.' END,
    CASE WHEN cleaned_rows = 0 THEN 'No usable rows remained after cleaning.' END,
    CASE WHEN cleaned_rows < 10 THEN concat('The cleaned dataset is below the minimum accepted row count (', cleaned_rows, ' < 10).') END,
    CASE WHEN ratio < 0.5 THEN concat('The cleaned dataset retained too few rows after quarantine (', printf('%.2f', ratio * 100), '% < 50%).') END,
    CASE WHEN failed_checks > 0 THEN concat('The cleaned dataset still failed ', failed_checks, ' validation checks.') END) AS blocking_reasons,
    CASE WHEN supp % 5 <> 0 AND cleaned_rows >= 10 AND ratio >= 0.5 AND failed_checks = 0 THEN 'success' ELSE 'failed' END AS status FROM g"""


@query("pipeline_run", checked(_COMPOSED_SQL))
def pipeline_run(spark, sf_dir):
    """Every supplier's batch through the whole pipeline; the gate judges the checks of the cleaned rows."""
    found = _composed(spark, sf_dir).runs
    return found.drop("raw_failures").withColumns({
        "clean_row_ratio": F.round("clean_row_ratio", 6), "blocking_reasons": F.array_join("blocking_reasons", "|"),
        "extra_columns": F.array_join("extra_columns", ","), "missing_columns": F.array_join("missing_columns", ","),
    })
