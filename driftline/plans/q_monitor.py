"""Monitoring plans: null calibration, prediction / label drift, window alerts,
perturbations (E11, E14, E15, H5-H8, H10, H11, H13-H17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.exprs import poisson1_cdf  # noqa: F401
from driftline.operators import drift as D
from driftline.operators import metrics as M
from driftline.operators.order import global_rank
from driftline.plans import sqlgen as S
from driftline.plans import views as V
from driftline.plans.q_drift import CAT, NUM
from driftline.plans.q_eval import SCORED_SQL, boot_sql, curve_sql, rank_sql, scored_once
from driftline.plans.registry import register
from driftline.plans.views import present, t

LI_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "l_extendedprice", "l_quantity"]
K_NULL = 20

# ---------------------------------------------------------------- H5, H6, H17


def _null_long(spark, sf):
    li = t(spark, sf, "lineitem")
    # pairs x features, read by the thresholds and by what is judged with them: computed once
    return D.null_psi(li, LI_ORDER, NUM, CAT, n_windows=K_NULL).checkpoint()


NULL_SQL = (
    "_li AS (SELECT *, row_number() OVER (ORDER BY " + ", ".join(LI_ORDER) + ") AS rn FROM lineitem),\n"
    f"_wr AS (SELECT count(*) // {K_NULL} AS wr FROM lineitem),\n"
    f"_lw AS (SELECT _li.*, (rn - 1) // wr AS w FROM _li, _wr WHERE (rn - 1) // wr < {K_NULL}),\n"
    f"_refw AS (SELECT *, w AS pair FROM _lw WHERE w < {K_NULL - 1}),\n"
    "_curw AS (SELECT *, w - 1 AS pair FROM _lw WHERE w >= 1),\n"
    + S.psi_sql("_refw", "_curw", NUM, CAT, keys=["pair"]) + ",\n"
    "_cal AS (SELECT feature, count(*) AS n_comparisons, quantile_cont(psi, 0.5::DOUBLE) AS median, "
    "quantile_cont(psi, 0.9::DOUBLE) AS p90, quantile_cont(psi, 0.99::DOUBLE) AS p99, max(psi) AS maximum FROM _psi GROUP BY feature),\n"
    "_calt AS (SELECT *, greatest(least(p99, 0.25::DOUBLE), 0.10::DOUBLE) AS threshold, "
    "CASE WHEN p99 < 0.10::DOUBLE THEN 'floor' WHEN p99 > 0.25::DOUBLE THEN 'ceiling' ELSE 'none' END AS clamped FROM _cal)")


@register("null_calibration", "WITH " + NULL_SQL + "\nSELECT feature, n_comparisons, round(median, 6) AS median, "
          "round(p90, 6) AS p90, round(p99, 6) AS p99, round(maximum, 6) AS maximum, round(threshold, 6) AS threshold, "
          "clamped FROM _calt")
def null_calibration(spark, sf):
    """H5 + E11 + E15: lineitem in ship-date order (full tiebreak), 20 equal
    windows, PSI of each adjacent pair with edges from the earlier window;
    threshold = clip(p99, 0.10, 0.25) per feature."""
    cal = D.calibrate_thresholds(_null_long(spark, sf))
    return present(cal.select("feature", "n_comparisons", "median", "p90", "p99", "maximum",
                              "threshold", "clamped"))


@register("null_summary", "WITH " + NULL_SQL + "\nSELECT clamped, count(*) AS n_features, "
          "string_agg(feature, ',' ORDER BY feature) AS features FROM _calt GROUP BY clamped")
def null_summary(spark, sf):
    """H6: features per clamp class."""
    return present(D.calibration_summary(D.calibrate_thresholds(_null_long(spark, sf))))


@register("false_alarms", "WITH " + NULL_SQL + "\nSELECT count(*) AS n_checks, "
          "count(*) FILTER (WHERE p.psi > 0.10::DOUBLE) AS uniform_alarms, "
          "count(*) FILTER (WHERE p.psi > c.threshold) AS calibrated_alarms, "
          "round(count(*) FILTER (WHERE p.psi > 0.10::DOUBLE)::DOUBLE / count(*), 6) AS uniform_rate, "
          "round(count(*) FILTER (WHERE p.psi > c.threshold)::DOUBLE / count(*), 6) AS calibrated_rate "
          "FROM _psi p JOIN _calt c USING (feature)")
def false_alarms(spark, sf):
    """Alarms over the null pairs with a uniform 0.10 vs the calibrated thresholds."""
    nl = _null_long(spark, sf)
    return present(D.false_alarms(nl, D.calibrate_thresholds(nl)))


# ---------------------------------------------------------------- H7

PD_CUT = "1998-01-01"
PD_B = 500
PD_THR = 0.35


@register("prediction_drift",
          "WITH " + SCORED_SQL.split(",\n_outc")[0] + ",\n"
          f"_r AS (SELECT * FROM _pred WHERE pred_ts < TIMESTAMP '{PD_CUT}'),\n"
          f"_c AS (SELECT * FROM _pred WHERE pred_ts >= TIMESTAMP '{PD_CUT}'),\n"
          f"_rep AS ({S.replicate_sql('_r', 'prediction_id', PD_B)}),\n"
          "_m AS (SELECT b, sum(w * score) / sum(w) AS m FROM _rep GROUP BY b),\n"
          f"_ci AS (SELECT quantile_cont(m, {S.dbl((1 - 0.99) / 2)}) AS lo, quantile_cont(m, {S.dbl(1 - (1 - 0.99) / 2)}) AS hi FROM _m),\n"
          f"_rs AS (SELECT avg(score) AS rm, avg(CAST(score >= {PD_THR} AS INTEGER)::DOUBLE) AS ra FROM _r),\n"
          f"_cs AS (SELECT avg(score) AS cm, avg(CAST(score >= {PD_THR} AS INTEGER)::DOUBLE) AS ca FROM _c),\n"
          "_o AS (SELECT rm AS reference_mean, cm AS current_mean, CASE WHEN rm <> 0 THEN (cm - rm) / rm ELSE 0.0 END AS mean_relative_change, "
          "lo AS reference_ci_lower, hi AS reference_ci_upper, ra AS reference_alert_rate, ca AS current_alert_rate, "
          "CASE WHEN ra <> 0 THEN (ca - ra) / ra ELSE 0.0 END AS alert_rate_relative_change FROM _rs, _cs, _ci)\n"
          "SELECT round(reference_mean, 6) AS reference_mean, round(current_mean, 6) AS current_mean, "
          "round(mean_relative_change, 6) AS mean_relative_change, round(reference_ci_lower, 6) AS reference_ci_lower, "
          "round(reference_ci_upper, 6) AS reference_ci_upper, round(reference_alert_rate, 6) AS reference_alert_rate, "
          "round(current_alert_rate, 6) AS current_alert_rate, round(alert_rate_relative_change, 6) AS alert_rate_relative_change, "
          "CAST(NOT (reference_ci_lower <= current_mean AND current_mean <= reference_ci_upper) AS INTEGER) AS mean_outside_reference_ci, "
          "CAST(abs(alert_rate_relative_change) > 0.25 OR NOT (reference_ci_lower <= current_mean AND current_mean <= reference_ci_upper) AS INTEGER) AS breaching "
          "FROM _o")
def prediction_drift(spark, sf):
    """H7: scores of orders before 1998 (reference) vs from 1998; decision
    threshold 0.35 travels with the model; 99% bootstrap CI of the reference mean."""
    p = V.pred(spark, sf)
    cut = F.lit(PD_CUT).cast("timestamp")
    return present(D.prediction_drift(p.where(F.col("pred_ts") < cut), p.where(F.col("pred_ts") >= cut),
                                      "score", ["prediction_id"], PD_THR, B=PD_B))


# ---------------------------------------------------------------- H8 / E14

LD_CUT = "1997-01-01"
LD_B = 1000
LD_FRACTION = 0.6


def matured_earliest(df, order_cols, fraction):
    """Earliest ``fraction`` of a window by the order = the matured labels."""
    from driftline.operators.split import earliest_fraction
    return earliest_fraction(df, order_cols, fraction)


@register("label_drift",
          "WITH " + SCORED_SQL + ",\n"
          f"_win AS (SELECT *, row_number() OVER (ORDER BY pred_ts, prediction_id) AS rn, count(*) OVER () AS nw "
          f"FROM _scored WHERE pred_ts >= TIMESTAMP '{LD_CUT}'),\n"
          f"_mat AS (SELECT * EXCLUDE (rn, nw) FROM _win WHERE rn <= floor(nw * {S.dbl(LD_FRACTION)})),\n"
          f"_base AS (SELECT * FROM _scored WHERE pred_ts < TIMESTAMP '{LD_CUT}'),\n"
          + curve_sql("_base", [], name="_bl") + ",\n"
          "_blr AS (" + rank_sql("_bl", []) + "),\n"
          + boot_sql("_mat", [], LD_B) + ",\n"
          "_st AS (SELECT count(*) AS n_matured, sum(label) AS npos FROM _mat),\n"
          "_x AS (SELECT n_matured, CAST(n_matured >= 500 AND npos > 0 AND npos < n_matured AS INTEGER) AS ok, "
          "(SELECT average_precision FROM _blr) AS bl, point AS obs, se FROM _st, _bci WHERE metric = 'pr_auc')\n"
          "SELECT n_matured, ok AS sufficient_labels, round(bl, 6) AS baseline_pr_auc, "
          "round(CASE WHEN ok = 1 THEN obs END, 6) AS observed_pr_auc, round(CASE WHEN ok = 1 THEN bl - obs END, 6) AS drop, "
          "round(CASE WHEN ok = 1 THEN se END, 6) AS bootstrap_se, "
          "round(CASE WHEN ok = 1 THEN CASE WHEN se > 0 THEN (bl - obs) / se ELSE 0.0 END END, 6) AS drop_in_standard_errors, "
          "CAST(coalesce(ok = 1 AND CASE WHEN se > 0 THEN (bl - obs) / se ELSE 0.0 END > 2.0, false) AS INTEGER) AS breaching FROM _x")
def label_drift(spark, sf):
    """H8 + E14: orders from 1997 form the window; its earliest 60% by time are
    matured; PR-AUC drop vs the pre-1997 baseline in bootstrap SEs (B = 1000)."""
    s = scored_once(spark, sf).select("prediction_id", "pred_ts", "label", "score")
    cut = F.lit(LD_CUT).cast("timestamp")
    win = s.where(F.col("pred_ts") >= cut)
    # read by the counts and by the bootstrap: ranked once
    mat = matured_earliest(win, ["pred_ts", "prediction_id"], LD_FRACTION).checkpoint()
    base = M.rank_metrics(M.score_curve(s.where(F.col("pred_ts") < cut))).select("average_precision")
    return present(D.label_drift(mat, base.scalar(), ["prediction_id"], B=LD_B))


# ---------------------------------------------------------------- H10, H11, H16

AL_REF_CUT = "1996-01-01"
AL_INDUCED_FROM = 1999
AL_THR = 0.10
AL_MIN_FEATURES = 3
AL_CONSECUTIVE = 2
AL_MANIPULATION = "shift:l_quantity+10<=50;collapse:l_discount=0.0;collapse:l_returnflag=R"


def _alert_windows(spark, sf):
    li = t(spark, sf, "lineitem").select("l_shipdate", *NUM, *CAT)
    cut = F.lit(AL_REF_CUT).cast("timestamp")
    ref = li.where(F.col("l_shipdate") < cut)
    cur = li.where(F.col("l_shipdate") >= cut).withColumn("win", F.year("l_shipdate"))
    induced = F.col("win") >= AL_INDUCED_FROM
    cur = cur.withColumn("l_quantity", F.when(induced, F.least(F.col("l_quantity") + 10, F.lit(50.0)))
                         .otherwise(F.col("l_quantity")))
    cur = cur.withColumn("l_discount", F.when(induced, F.lit(0.0)).otherwise(F.col("l_discount")))
    cur = cur.withColumn("l_returnflag", F.when(induced, F.lit("R")).otherwise(F.col("l_returnflag")))
    p = D.psi_vs_reference(ref, cur, "win", NUM, CAT)
    per = p.groupBy("win").agg(
        F.count_if(F.col("psi") > AL_THR).alias("n_breaching"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("psi") > AL_THR, F.col("feature")))))
        .alias("breaching_features"))
    st = D.alert_state(per, "win", "n_breaching", AL_MIN_FEATURES, AL_CONSECUTIVE)
    first = st.where(F.col("confirmed") == 1).agg(F.min("win")).scalar()
    st = D.label_origin(st, F.col("win") >= AL_INDUCED_FROM, AL_MANIPULATION)
    return st.select(
        "win", "drift_origin", "manipulation",
        "n_breaching", "breaching_features", "confirmed",
        F.coalesce(F.col("win") == first, F.lit(False)).cast("int").alias("first_confirmed"))


_IND = f"year(l_shipdate) >= {AL_INDUCED_FROM}"
ALERT_SQL = (
    "WITH " f"_ref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{AL_REF_CUT}'),\n"
    "_cur AS (SELECT l_shipdate, CAST(year(l_shipdate) AS INTEGER) AS win, "
    f"CASE WHEN {_IND} THEN least(l_quantity + 10, 50.0::DOUBLE) ELSE l_quantity END AS l_quantity, "
    f"l_extendedprice, CASE WHEN {_IND} THEN 0.0::DOUBLE ELSE l_discount END AS l_discount, l_tax, "
    f"CASE WHEN {_IND} THEN 'R' ELSE l_returnflag END AS l_returnflag, l_linestatus "
    f"FROM lineitem WHERE l_shipdate >= TIMESTAMP '{AL_REF_CUT}'),\n"
    "_refw AS (SELECT r.*, w.win FROM _ref r CROSS JOIN (SELECT DISTINCT win FROM _cur) w),\n"
    + S.psi_sql("_refw", "_cur", NUM, CAT, keys=["win"]) + ",\n"
    "_per AS (SELECT win, count(*) FILTER (WHERE psi > 0.10::DOUBLE) AS n_breaching, "
    "coalesce(string_agg(CASE WHEN psi > 0.10::DOUBLE THEN feature END, ',' ORDER BY feature), '') AS breaching_features "
    "FROM _psi GROUP BY win),\n"
    f"_st AS (SELECT *, CAST(count(*) OVER w >= {AL_CONSECUTIVE} AND sum(CAST(n_breaching >= {AL_MIN_FEATURES} AS INTEGER)) OVER w = {AL_CONSECUTIVE} AS INTEGER) AS confirmed "
    f"FROM _per WINDOW w AS (ORDER BY win ROWS BETWEEN {AL_CONSECUTIVE - 1} PRECEDING AND CURRENT ROW))\n"
    f"SELECT win, CASE WHEN win >= {AL_INDUCED_FROM} THEN 'induced' ELSE 'real' END AS drift_origin, "
    f"CASE WHEN win >= {AL_INDUCED_FROM} THEN '{AL_MANIPULATION}' ELSE 'none' END AS manipulation, "
    "n_breaching, breaching_features, confirmed, "
    "CAST(coalesce(win = (SELECT min(win) FROM _st WHERE confirmed = 1), false) AS INTEGER) AS first_confirmed FROM _st")


@register("drift_alerts", ALERT_SQL)
def drift_alerts(spark, sf):
    """H9 + H10 + H11 + H16: yearly windows of lineitem vs the 1995 reference;
    windows from 1999 get an induced shift (quantity +10 capped at 50, discount
    collapsed to 0, return flag collapsed to R); confirmed = 3+ features over 0.10 in 2 consecutive windows."""
    return present(_alert_windows(spark, sf))


# ---------------------------------------------------------------- H9

RP_CUT, RP_CHANGED, RP_THR, RP_LIMIT = "1996-01-01", 1998, 0.35, 0.02
RP_NUM, RP_CAT = ["o_totalprice"], ["o_orderpriority", "o_orderstatus"]
RP_COLS = ["o_totalprice", "o_orderpriority", "o_orderstatus", "score", "label", "prediction_id"]


def _rp_sql() -> str:
    out = "(coalesce(mean_score < lo OR mean_score > hi, false) OR abs(change) > 0.25)"
    same = f"(win <> {RP_CHANGED})"
    return (
        "WITH " + SCORED_SQL + ",\n"
        "_sc AS (SELECT s.prediction_id, s.pred_ts, s.score, s.label, o.o_totalprice, o.o_orderpriority, o.o_orderstatus, "
        "CAST(year(s.pred_ts) AS INTEGER) AS win FROM _scored s JOIN orders o ON o.o_orderkey = s.prediction_id),\n"
        f"_rp_ref AS (SELECT * FROM _sc WHERE pred_ts < TIMESTAMP '{RP_CUT}'),\n_cur AS (SELECT * FROM _sc WHERE pred_ts >= TIMESTAMP '{RP_CUT}'),\n"
        "_refw AS (SELECT r.* REPLACE (w.win AS win) FROM _rp_ref r CROSS JOIN (SELECT DISTINCT win FROM _cur) w),\n"
        + S.psi_sql("_refw", "_cur", RP_NUM, RP_CAT, keys=["win"]) + ",\n"
        f"_dd AS (SELECT win, count(*) FILTER (WHERE psi > {RP_LIMIT}) AS n_breaching, "
        f"coalesce(string_agg(CASE WHEN psi > {RP_LIMIT} THEN feature END, ',' ORDER BY feature), '') AS breaching_features FROM _psi GROUP BY win),\n"
        + curve_sql("_rp_ref", [], name="_bl") + ",\n_blr AS (" + rank_sql("_bl", []) + "),\n"
        + boot_sql("_cur", ["win"], LD_B) + ",\n"
        f"_mrep AS ({S.replicate_sql('_rp_ref', 'prediction_id', PD_B)}),\n_mm AS (SELECT b, sum(w * score) / sum(w) AS m FROM _mrep GROUP BY b),\n"
        f"_mci AS (SELECT quantile_cont(m, {S.dbl((1 - 0.99) / 2)}) AS lo, quantile_cont(m, {S.dbl(1 - (1 - 0.99) / 2)}) AS hi FROM _mm),\n"
        f"_rs AS (SELECT avg(CAST(score >= {RP_THR} AS INTEGER)::DOUBLE) AS ra FROM _rp_ref),\n"
        f"_ws AS (SELECT win, count(*) AS n_rows, avg(score) AS mean_score, avg(CAST(score >= {RP_THR} AS INTEGER)::DOUBLE) AS alert_rate, "
        "count(label) AS n_matured, CAST(sum(label) AS BIGINT) AS npos FROM _cur GROUP BY win),\n"
        "_a AS (SELECT w.*, d.n_breaching, d.breaching_features, lo, hi, CASE WHEN ra <> 0 THEN (alert_rate - ra) / ra ELSE 0.0 END AS change, "
        "CASE WHEN n_matured >= 500 AND npos > 0 AND npos < n_matured THEN (SELECT average_precision FROM _blr) - b.point END AS drp, b.se "
        "FROM _ws w JOIN _dd d USING (win) LEFT JOIN (SELECT * FROM _bci WHERE metric = 'pr_auc') b USING (win), _mci, _rs),\n"
        "_z AS (SELECT *, CASE WHEN se > 0 THEN drp / se WHEN drp IS NOT NULL THEN 0.0 END AS dse FROM _a)\n"
        f"SELECT 'replay-1' AS run_id, win, n_rows, CAST({same} AS INTEGER) AS comparable, "
        f"CASE WHEN NOT {same} THEN 'other contract: not comparable' WHEN n_rows < 1000 THEN 'window below 1000 rows: indicative only' ELSE '' END AS note, "
        f"n_breaching, breaching_features, CAST({same} AND n_breaching > 0 AS INTEGER) AS data_drift, round(mean_score, 6) AS mean_score, "
        f"round(alert_rate, 6) AS alert_rate, round(change, 6) AS alert_rate_change, CAST({same} AND {out} AS INTEGER) AS prediction_drift, n_matured, "
        f"round(drp, 6) AS pr_auc_drop, round(dse, 6) AS drop_in_standard_errors, CAST({same} AND coalesce(dse > 2.0, false) AS INTEGER) AS label_drift FROM _z")


@register("window_replay", _rp_sql())
def window_replay(spark, sf):
    """H9 (+ H4, H7, H8): scored orders replayed in yearly windows from 1996 against the years before; the windows'
    contract hash is the reference's, except in 1998, whose window is therefore not comparable."""
    s = scored_once(spark, sf).select("prediction_id", "pred_ts", "score", "label", "o_totalprice", "o_orderpriority", "o_orderstatus")
    cut = F.lit(RP_CUT).cast("timestamp")
    ref, cur = s.where(F.col("pred_ts") < cut), s.where(F.col("pred_ts") >= cut).withColumn("win", F.year("pred_ts"))
    own = F.lit("orders-contract-1")
    cur = cur.withColumn("contract", F.when(F.col("win") == RP_CHANGED, F.lit("orders-contract-2")).otherwise(own))
    thr = spark.createDataFrame([(f, RP_LIMIT) for f in RP_NUM + RP_CAT], "feature string, threshold double")
    base = M.rank_metrics(M.score_curve(ref)).select("average_precision").scalar()
    return present(D.window_analysis(ref, cur, "win", "replay-1", thr, numeric=RP_NUM, categorical=RP_CAT, score="score",
                                     decision_threshold=RP_THR, row_key=["prediction_id"], reference_hash=own, hash_col="contract",
                                     label="label", baseline_pr_auc=base, mean_draws=PD_B, label_draws=LD_B))
