"""SQL fragments of the check queries (written for the check engine, independent of the operators)."""

from __future__ import annotations

MARKERS = "('', 'NA', 'N/A', 'NULL', 'NONE', 'NAN')"
NUMBER = r"[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)"


def marker(c: str) -> str:
    return f"coalesce(upper(trim({c})) IN {MARKERS}, false)"


def number(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '{NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def identifier(c: str) -> str:
    bare = f"replace(lower(trim({c})), '_', '')"
    return f"({bare} IN ('id', 'uuid', 'key') OR {bare} LIKE '%id')"


def rank(c: str) -> str:
    return f"CASE lower({c}) WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


def level(c: str) -> str:
    return f"CASE {c} WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"


def severity_of(c: str) -> str:
    return (
        f"CASE WHEN {c} >= 0.5 THEN 'critical' WHEN {c} >= 0.3 THEN 'high' "
        f"WHEN {c} >= 0.2 THEN 'medium' ELSE 'low' END"
    )


# Bounds of the clean batch, then cell flags and masked cells of the corrupted one.
FLAGGED = f"""
  bounds AS (SELECT quantile_cont(quantity, 0.01) AS q_lo, quantile_cont(quantity, 0.99) AS q_hi,
    quantile_cont(discount, 0.01) AS d_lo, quantile_cont(discount, 0.99) AS d_hi,
    quantile_cont(quantity, 0.5) AS q_mid, quantile_cont(discount, 0.5) AS d_mid FROM lineitem_clean),
  parsed AS (SELECT *, {marker('quantity')} AS q_mark, {marker('discount')} AS d_mark, {marker('returnflag')} AS r_mark,
    {marker('is_open')} AS o_mark, {number('quantity')} AS q_num, {number('discount')} AS d_num,
    CASE WHEN lower(trim(is_open)) IN ('true', '1', 'yes', 'y', 't') THEN true
      WHEN lower(trim(is_open)) IN ('false', '0', 'no', 'n', 'f') THEN false END AS o_flag,
    upper(trim(returnflag)) IN ('A', 'N', 'R') AS r_known FROM lineitem_raw),
  flagged AS (SELECT l_orderkey, l_linenumber, l_suppkey,
    CASE WHEN q_num BETWEEN q_lo AND q_hi THEN q_num END AS quantity,
    CASE WHEN d_num BETWEEN d_lo AND d_hi THEN d_num END AS discount,
    CASE WHEN r_known THEN trim(returnflag) END AS returnflag, o_flag AS is_open,
    CAST(q_mark OR q_num IS NULL OR q_num < q_lo OR q_num > q_hi AS INTEGER) AS q_bad,
    CAST(d_mark OR d_num IS NULL OR d_num < d_lo OR d_num > d_hi AS INTEGER) AS d_bad,
    CAST(r_mark OR NOT r_known AS INTEGER) AS r_bad, CAST(o_mark OR o_flag IS NULL AS INTEGER) AS o_bad
    FROM parsed, bounds),
  counted AS (SELECT *, CAST(q_bad + d_bad + r_bad + o_bad AS BIGINT) AS issue_count,
    (q_bad + d_bad + r_bad + o_bad) / 4.0 >= 0.70 AS is_quarantined FROM flagged),
  kept AS (SELECT * FROM counted WHERE NOT is_quarantined),
  fills AS (SELECT quantile_cont(quantity, 0.5) AS q_fill, quantile_cont(discount, 0.5) AS d_fill FROM kept),
  r_mode AS (SELECT returnflag AS r_fill FROM kept WHERE returnflag IS NOT NULL GROUP BY returnflag
    ORDER BY count(*) DESC, returnflag LIMIT 1),
  o_mode AS (SELECT is_open AS o_fill FROM kept WHERE is_open IS NOT NULL GROUP BY is_open
    ORDER BY count(*) DESC, is_open LIMIT 1),
  imputed AS (SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(quantity, q_fill) AS quantity, coalesce(discount, d_fill) AS discount,
    coalesce(returnflag, r_fill) AS returnflag, coalesce(is_open, o_fill) AS is_open FROM kept, fills, r_mode, o_mode)"""
