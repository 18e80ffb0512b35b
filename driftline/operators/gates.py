"""Promotion gates and retrain triggers (K1-K8).

Gates compare one incumbent and one challenger (rows bounded by models and
metrics); the metrics come from the grouped evaluation operators.  Output is
always ``(gate, passed, observed, limit_value)``; promotion needs every gate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.quantile import with_quantiles


def pivot_models(metrics: DataFrame, incumbent: str, challenger: str, cols: Sequence[str]) -> DataFrame:
    """One row with ``inc_<m>`` and ``ch_<m>`` from a per-model metrics table."""
    aggs = []
    for m in cols:
        aggs.append(F.max(F.when(F.col("model") == incumbent, F.col(m))).alias(f"inc_{m}"))
        aggs.append(F.max(F.when(F.col("model") == challenger, F.col(m))).alias(f"ch_{m}"))
    return metrics.agg(*aggs)


def gate_rows(wide: DataFrame, gates: Mapping[str, tuple[Column, Column, Column]]) -> DataFrame:
    """``{gate: (observed, limit, passed)}`` over a one-row frame -> long table."""
    st = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), p.cast("int").alias("passed"),
                                      o.cast("double").alias("observed"), lim.cast("double").alias("limit_value"))
                             for g, (o, lim, p) in gates.items()]))
    return wide.select(st.alias("s")).select("s.*")


def promotion_gates(wide: DataFrame, pr_auc_margin: float = 0.005, brier_ratio: float = 1.02,
                    ece_max: float = 0.05, gap_widening: float = 0.20, slo_p99: float | None = None) -> DataFrame:
    """K1, K2, K3, K5 (and the F20 ECE gate) from a pivoted row with pr_auc, pr_auc_lower, brier, ece,
    worst_gap, contract hash, canary p99 and the prevalence baseline."""
    c = F.col
    gates = {
        "k1_pr_auc_non_inferior": (c("ch_pr_auc") - c("inc_pr_auc"), F.lit(-pr_auc_margin),
                                   c("ch_pr_auc") - c("inc_pr_auc") >= -pr_auc_margin),
        "k1_ci_above_baseline": (c("ch_pr_auc_lower"), c("baseline_pr_auc"),
                                 c("ch_pr_auc_lower") > c("baseline_pr_auc")),
        "k2_brier_ratio": (c("ch_brier") / c("inc_brier"), F.lit(brier_ratio),
                           c("ch_brier") / c("inc_brier") <= brier_ratio),
        "k2_ece": (c("ch_ece"), F.lit(ece_max), c("ch_ece") <= ece_max),
        "k3_recall_gap": (F.abs(c("ch_worst_gap")), F.abs(c("inc_worst_gap")) * (1 + gap_widening),
                          F.abs(c("ch_worst_gap")) <= F.abs(c("inc_worst_gap")) * (1 + gap_widening)),
        "k5_contract_hash": ((c("ch_hash") == c("inc_hash")).cast("double"), F.lit(1.0), c("ch_hash") == c("inc_hash")),
    }
    if slo_p99 is not None:
        gates["k5_canary_p99"] = (c("canary_p99"), F.lit(slo_p99), c("canary_p99") <= slo_p99)
    return gate_rows(wide, gates)


def missingness_gate(ref_profile: DataFrame, cur_profile: DataFrame, max_points: float = 10.0) -> DataFrame:
    """K6: missing share of any feature up by at most ``max_points`` percentage points."""
    r = ref_profile.select("column_name", F.col("pct_null").alias("pct_null_ref"))
    c = cur_profile.select("column_name", F.col("pct_null").alias("pct_null_cur"))
    j = r.join(c, "column_name")
    d = F.col("pct_null_cur") - F.col("pct_null_ref")
    return j.select("column_name", "pct_null_ref", "pct_null_cur", d.alias("delta_points"),
                    (d <= max_points).cast("int").alias("passed"))


def data_gate(missing: DataFrame, expectations: DataFrame) -> DataFrame:
    """K6: both halves as rows ``(gate, passed, observed, limit_value)``: the largest rise of a column's missing
    share, from ``missingness_gate``'s rows, and the table expectations that fail."""
    m = missing.agg(F.max("delta_points").alias("observed"), F.min("passed").alias("passed"), F.lit(10.0).alias("limit_value"))
    e = expectations.agg(F.count_if(F.col("passed") == 0).cast("double").alias("observed"), F.min("passed").alias("passed"),
                         F.lit(0.0).alias("limit_value"))
    cols = ["passed", "observed", "limit_value"]
    return m.select(F.lit("k6_missingness").alias("gate"), *cols).unionByName(e.select(F.lit("k6_table_expectations").alias("gate"), *cols))


def canary_checks(canary: DataFrame, value: str, error_flag: str, baseline_error: Column,
                  ci_lower: Column, ci_upper: Column, slo_p99: float, min_n: int = 1000) -> DataFrame:
    """K8: canary verdict once it has ``min_n`` rows: p99 within SLO, error ratio
    at most 1.5x the baseline's, mean inside the baseline's bootstrap CI."""
    c = with_quantiles(canary.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(error_flag).cast("double")).alias("error_ratio"),
                                  F.avg(value).alias("mean_score")), canary, value, {"p99": 0.99})
    ok = ((F.col("n") >= min_n) & (F.col("p99") <= slo_p99) & (F.col("error_ratio") <= baseline_error * 1.5) &
          (F.col("mean_score") >= ci_lower) & (F.col("mean_score") <= ci_upper))
    return c.select("n", "p99", "error_ratio", baseline_error.alias("baseline_error_ratio"), "mean_score",
                    ci_lower.alias("ci_lower"), ci_upper.alias("ci_upper"),
                    (F.col("n") >= min_n).cast("int").alias("enough"), ok.cast("int").alias("passed"))


def triggers(rows: Mapping[str, tuple[Column, str]], frame: DataFrame) -> DataFrame:
    """K7: boolean trigger table ``(trigger_name, fired, reason)`` from a one-row frame."""
    st = F.explode(F.array(*[F.struct(F.lit(k).alias("trigger_name"), v.cast("int").alias("fired"),
                                      F.lit(reason).alias("reason")) for k, (v, reason) in rows.items()]))
    return frame.select(st.alias("s")).select("s.*")
