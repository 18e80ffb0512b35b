"""Profiling plans (D1-D9) on customer, part and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.exprs import binarise
from driftline.operators import profile as P
from driftline.plans.registry import register
from driftline.plans.views import present, t

PROFILE_TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
}
STRING_COLS = {"c_name", "c_mktsegment", "p_name", "p_brand", "p_type"}


def _profile_sql() -> str:
    parts = []
    for tab, cols in PROFILE_TABLES.items():
        for c in cols:
            sent = f"count(*) FILTER (WHERE {c} = '?')" if c in STRING_COLS else "0"
            parts.append(
                f"SELECT '{tab}' AS tbl, '{c}' AS column_name, count(*) AS n_rows, CAST({sent} AS BIGINT) AS n_sentinel, "
                f"count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
                f"CAST(coalesce(count({c}) = count(*) AND min({c}) = max({c}), false) AS INTEGER) AS constant, "
                    f"(SELECT max(k) FROM (SELECT count(*) AS k FROM {tab} GROUP BY {c})) AS top_count FROM {tab}")
    return (
        "WITH _p AS (" + " UNION ALL ".join(parts) + ")\n"
        "SELECT tbl, column_name, n_rows, n_sentinel, round(100.0 * n_sentinel / n_rows, 6) AS pct_sentinel, n_null, "
        "round(100.0 * n_null / n_rows, 6) AS pct_null, constant, "
        "round(top_count::DOUBLE / n_rows, 6) AS top_share, "
        "CAST(top_count::DOUBLE / n_rows >= 0.995 AND top_count::DOUBLE / n_rows < 1.0 AS INTEGER) "
        "AS near_zero_variance FROM _p")


@register("profile_columns", _profile_sql())
def profile_columns(spark, sf):
    """Sentinel / null counts, constancy and top-value share for every
    column of customer and part (one aggregate pass + one value-count shuffle each)."""
    outs = []
    for tab, cols in PROFILE_TABLES.items():
        df = t(spark, sf, tab).select(*cols)
        m = P.missing_profile(df)
        c = P.constant_columns(df)
        s = P.top_value_share(df)
        outs.append(m.join(c, "column_name").join(s, "column_name").select(
            F.lit(tab).alias("tbl"), "column_name", "n_rows", "n_sentinel", "pct_sentinel", "n_null",
            "pct_null", "constant", "top_share", "near_zero_variance"))
    return present(outs[0].unionByName(outs[1]))


@register("class_balance",
          "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_positive, "
          "count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'F') AS n_negative, "
          "round(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*), 6) AS positive_rate, "
          "round(count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'F')::DOUBLE / count(*) FILTER (WHERE o_orderstatus = 'F'), 6) AS imbalance_ratio, "
          "round(greatest(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*), "
          "count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'F')::DOUBLE / count(*)), 6) AS majority_accuracy FROM orders")
def class_balance(spark, sf):
    """Class balance of ``o_orderstatus = 'F'`` on orders."""
    o = t(spark, sf, "orders").select(binarise("o_orderstatus", "F").alias("label"))
    return present(P.class_balance(o, "label"))


@register("subgroup_population",
          "WITH _o AS (SELECT coalesce(o_orderpriority, '<null>') AS o_orderpriority, coalesce(o_orderstatus, '<null>') AS o_orderstatus, "
          "CAST(coalesce(o_orderstatus = 'F', false) AS INTEGER) AS y FROM orders)\n"
          "SELECT 'o_orderpriority' AS dimension, o_orderpriority AS grp, count(*) AS n, "
          "round(100.0 * count(*) / (SELECT count(*) FROM orders), 6) AS pct, round(avg(y), 6) AS positive_rate, "
          "CAST(count(*) >= 500 AS INTEGER) AS sufficient FROM _o GROUP BY o_orderpriority UNION ALL "
          "SELECT 'o_orderstatus', o_orderstatus, count(*), round(100.0 * count(*) / (SELECT count(*) FROM orders), 6), "
          "round(avg(y), 6), CAST(count(*) >= 500 AS INTEGER) FROM _o GROUP BY o_orderstatus")
def subgroup_population(spark, sf):
    """Population, share, positive rate per priority and per status (GROUPING SETS)."""
    o = t(spark, sf, "orders").withColumn("label", binarise("o_orderstatus", "F"))
    return present(P.subgroup_population(o, ["o_orderpriority", "o_orderstatus"], "label"))


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_FP_CATS = ["o_orderpriority", "o_orderstatus"]
_FP_HEAD = '{"columns":["' + '","'.join(sorted(_ORDER_COLS)) + '"],"levels":{'


def fingerprint_sql(src: str) -> str:
    """``h``: the fingerprint of the orders contract over the rows of ``src``."""
    levels = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {src}" for c in _FP_CATS)
    return ("SELECT substr(sha256('" + _FP_HEAD + "' || array_to_string(list_sort(list(item)), ',') || '}}'), 1, 16) AS h FROM ("
            "SELECT '\"' || col || '\":[\"' || array_to_string(list_sort(list(v)), '\",\"') || '\"]' AS item FROM ("
            f"SELECT DISTINCT col, v FROM ({levels}) WHERE v IS NOT NULL) GROUP BY col)")


@register("contract_fingerprint",
          "WITH _lv AS (SELECT DISTINCT col, v FROM (" + " UNION ALL ".join(
              f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM orders" for c in _FP_CATS)
          + ") WHERE v IS NOT NULL),\n"
          "_per AS (SELECT '\"' || col || '\":[\"' || array_to_string(list_sort(list(v)), '\",\"') || '\"]' AS item FROM _lv GROUP BY col),\n"
          f"_c AS (SELECT '{_FP_HEAD}' || array_to_string(list_sort(list(item)), ',') || '}}}}' AS canonical FROM _per)\n"
          "SELECT canonical, substr(sha256(canonical), 1, 16) AS fingerprint FROM _c")
def contract_fingerprint(spark, sf):
    """Fingerprint of the orders contract (column names + category levels)."""
    return present(P.contract_fingerprint(t(spark, sf, "orders").select(*_ORDER_COLS), _FP_CATS))
