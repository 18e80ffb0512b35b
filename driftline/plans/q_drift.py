"""Drift plans on lineitem (flagship ``drift_report``; H1-H4, H9, H18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import drift as D
from driftline.plans import sqlgen as S
from driftline.plans.registry import register
from driftline.plans.views import present, t

CUT = "1998-01-01"
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linestatus"]
#: per-feature thresholds of the flagship; l_linestatus has none on purpose
THRESHOLDS = [("l_quantity", 0.10), ("l_extendedprice", 0.10), ("l_discount", 0.10),
              ("l_tax", 0.10), ("l_returnflag", 0.10)]


def _sides(spark, sf):
    li = t(spark, sf, "lineitem").select("l_shipdate", *NUM, *CAT)
    ref = li.where(F.col("l_shipdate") < F.lit(CUT).cast("timestamp"))
    cur = li.where(F.col("l_shipdate") >= F.lit(CUT).cast("timestamp"))
    return ref, cur


def _thresholds(spark):
    return spark.createDataFrame(THRESHOLDS, "feature string, threshold double")


_SIDES_SQL = (f"_ref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'),\n"
              f"_cur AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}'),\n")
_THR_SQL = "_thr(feature, threshold) AS (VALUES " + ", ".join(
    f"('{f}', {S.dbl(v)})" for f, v in THRESHOLDS) + "),\n"

DRIFT_REPORT_SQL = (
    "WITH " + _SIDES_SQL + _THR_SQL + S.psi_sql("_ref", "_cur", NUM, CAT) + "\n"
    "SELECT p.feature, p.kind, round(p.psi, 6) AS psi, round(t.threshold, 6) AS threshold, "
    "CASE WHEN t.threshold IS NULL THEN 'skipped_no_threshold' ELSE 'checked' END AS status, "
    "CAST(coalesce(p.psi > t.threshold, false) AS INTEGER) AS breaching, "
    "p.degenerate, p.reference_n, p.current_n, p.n_cells "
    "FROM _psi p LEFT JOIN _thr t ON p.feature = t.feature")


@register("drift_report", DRIFT_REPORT_SQL)
def drift_report(spark, sf):
    """Flagship (A2, H1-H4, H9): PSI of 4 numeric + 2 categorical lineitem
    features, reference = ship dates before 1998, current = from 1998, each
    against its own threshold."""
    ref, cur = _sides(spark, sf)
    p = D.psi(ref, cur, NUM, CAT)
    r = D.data_drift(p, _thresholds(spark))
    return present(r.select("feature", "kind", "psi", "threshold", "status", "breaching",
                            "degenerate", "reference_n", "current_n", "n_cells"))


JS_SQL = (
    "WITH " + _SIDES_SQL + S.psi_sql("_ref", "_cur", NUM, CAT) + "\n"
    "SELECT feature, round(js_divergence, 6) AS js_divergence, "
    "round(sqrt(greatest(js_divergence, 0)), 6) AS js_distance, round(psi, 6) AS psi FROM _psi")


@register("js_distance", JS_SQL)
def js_distance(spark, sf):
    """Jensen-Shannon divergence / distance from the same cell counts as PSI."""
    ref, cur = _sides(spark, sf)
    p = D.psi(ref, cur, NUM, CAT)
    return present(p.select("feature", "js_divergence",
                            F.sqrt(F.greatest("js_divergence", F.lit(0.0))).alias("js_distance"),
                            "psi"))
