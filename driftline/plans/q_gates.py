"""Promotion gates, retrain triggers and canary verdict plans (K1-K8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import exprs as S_
from driftline.operators import gates as G
from driftline.operators import metrics as M
from driftline.operators import profile as P
from driftline.operators.bootstrap import bootstrap_mean
from driftline.operators.quantile import grouped_quantiles
from driftline.plans import q_eval as E
from driftline.plans.q_monitor import AL_REF_CUT  # also registers drift_alerts, reused below
from driftline.plans import sqlgen as S
from driftline.plans import views as V
from driftline.plans.q_profile import _FP_CATS, _ORDER_COLS, fingerprint_sql
from driftline.plans.registry import ORACLES, register
from driftline.plans.views import REQ_SQL, present, t

INCUMBENT, CHALLENGER = "price_linear", "price_priority"
CANARY_INSTANCE = 3
SLO_P99 = 0.485
#: The incumbent was trained on the orders before, the challenger on all.
TRAINED_TO = "1997-01-01"
_TRAINED_SQL = f"(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{TRAINED_TO}')"
_INNER10 = E._INNER10


def _model_frames(s):
    return {m: s.withColumn("score", F.expr(e).cast("double")) for m, e, _ in E.CANDIDATES}


def _wide(spark, sf):
    s = E.scored_once(spark, sf)
    # a row a model, read by a gate each
    rep = E._report(spark, sf, s).select("model", "pr_auc", "pr_auc_lower", "brier").checkpoint()
    frames = _model_frames(s)
    o, cut = t(spark, sf, "orders").select(*_ORDER_COLS), F.lit(TRAINED_TO).cast("timestamp")
    # each model's contract is that of the orders it was trained on
    trained = {INCUMBENT: o.where(F.col("o_orderdate") < cut), CHALLENGER: o}
    rows = []
    for m, df in frames.items():   # bounded loop over candidate models; two numbers each
        ece = M.ece(M.calibration_bins(df)).select("ece").first()[0]
        gap = M.worst_gap(M.subgroup_metrics(df, E.DIMS, E.THR)).select("worst_recall_gap").first()[0]
        own = P.contract_fingerprint(trained[m], _FP_CATS).select("fingerprint").first()[0]
        rows.append((m, float(ece), float(gap), own))
    extra = spark.createDataFrame(rows, "model string, ece double, worst_gap double, hash string")
    per = rep.join(extra, "model")
    w = G.pivot_models(per, INCUMBENT, CHALLENGER, ["pr_auc", "pr_auc_lower", "brier", "ece", "worst_gap", "hash"])
    base = s.agg(F.avg(F.col("label").cast("double"))).scalar()
    req = V.req(spark, sf).where(F.col("instance") == CANARY_INSTANCE)
    p99 = grouped_quantiles(req, F.col("duration_ms") / 1000.0, [0.99]).select(F.get("q", F.lit(0))).scalar()
    return w.select("*", base.alias("baseline_pr_auc"), p99.alias("canary_p99"))


def _gate_sql() -> str:
    b_expr = [e for m, e, _ in E.CANDIDATES if m == CHALLENGER][0].replace("1.0)", "1.0::DOUBLE)")
    sub_a = E.sub_sql("_scored", "_a")
    sub_b = E.sub_sql("_scored_b", "_b")
    wg = ("(SELECT coalesce(min(recall_gap), 0.0) FROM _sub{s} WHERE sufficient = 1)")
    return (
        E.REPORT_SQL + ",\n"
        f"_scored_b AS (SELECT * REPLACE (CAST({b_expr} AS DOUBLE) AS score) FROM _scored),\n"
        + sub_a + ",\n" + sub_b + ",\n"
        "_bn AS (SELECT model, least(greatest(len(list_filter(" + _INNER10 + ", lambda e: e < score)), 0), 9) AS bin, label, score FROM _cand),\n"
        "_bg AS (SELECT model, bin, count(*) AS cnt, avg(score) AS conf, avg(label::DOUBLE) AS acc FROM _bn GROUP BY model, bin),\n"
        "_ece AS (SELECT model, sum(cnt * abs(conf - acc)) / sum(cnt) AS ece FROM _bg GROUP BY model),\n"
        + REQ_SQL + ",\n"
        "_gw AS (SELECT "
        f"max(pr_auc) FILTER (WHERE model = '{INCUMBENT}') AS inc_pr_auc, max(pr_auc) FILTER (WHERE model = '{CHALLENGER}') AS ch_pr_auc, "
        f"max(pr_auc_lower) FILTER (WHERE model = '{CHALLENGER}') AS ch_pr_auc_lower, "
        f"max(brier) FILTER (WHERE model = '{INCUMBENT}') AS inc_brier, max(brier) FILTER (WHERE model = '{CHALLENGER}') AS ch_brier, "
        f"(SELECT ece FROM _ece WHERE model = '{CHALLENGER}') AS ch_ece, "
        f"{wg.format(s='_a')} AS inc_worst_gap, {wg.format(s='_b')} AS ch_worst_gap, "
        "(SELECT avg(label::DOUBLE) FROM _scored) AS baseline_pr_auc, "
        f"(SELECT quantile_cont(duration_ms / 1000.0, 0.99::DOUBLE) FROM _req WHERE instance = {CANARY_INSTANCE}) AS canary_p99 "
        "FROM _rep_all)\n"
        "SELECT gate, CAST(passed AS INTEGER) AS passed, round(observed, 6) AS observed, round(lim, 6) AS limit_value FROM ("
        "SELECT 'k1_pr_auc_non_inferior' AS gate, ch_pr_auc - inc_pr_auc >= -0.005 AS passed, ch_pr_auc - inc_pr_auc AS observed, -0.005 AS lim FROM _gw UNION ALL "
        "SELECT 'k1_ci_above_baseline', ch_pr_auc_lower > baseline_pr_auc, ch_pr_auc_lower, baseline_pr_auc FROM _gw UNION ALL "
        "SELECT 'k2_brier_ratio', ch_brier / inc_brier <= 1.02, ch_brier / inc_brier, 1.02 FROM _gw UNION ALL "
        "SELECT 'k2_ece', ch_ece <= 0.05, ch_ece, 0.05 FROM _gw UNION ALL "
        "SELECT 'k3_recall_gap', abs(ch_worst_gap) <= abs(inc_worst_gap) * (1 + 0.2), abs(ch_worst_gap), abs(inc_worst_gap) * (1 + 0.2) FROM _gw UNION ALL "
        "SELECT 'k5_contract_hash', a.h = b.h, (a.h = b.h)::INTEGER::DOUBLE, 1.0 FROM "
        + f"({fingerprint_sql(_TRAINED_SQL)}) a, ({fingerprint_sql('orders')}) b UNION ALL "
        f"SELECT 'k5_canary_p99', canary_p99 <= {SLO_P99!r}, canary_p99, {SLO_P99!r} FROM _gw)")


@register("promotion_gates", _gate_sql())
def promotion_gates(spark, sf):
    """K1 + K2 + K3 + K5: challenger (price_priority) vs incumbent (price_linear):
    PR-AUC non-inferiority and CI above the prevalence baseline, Brier ratio,
    ECE, worst subgroup recall gap, contract hash, canary p99."""
    return present(G.promotion_gates(_wide(spark, sf), slo_p99=SLO_P99))


MISS_CUT = "1997-01-01"


@register("missingness_gate",
          "WITH _r AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '" + MISS_CUT + "'), "
          "_c AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '" + MISS_CUT + "'),\n"
          "_m AS (" + " UNION ALL ".join(
              f"SELECT '{c}' AS column_name, 100.0 * count(*) FILTER (WHERE r.{c} IS NULL) / count(*) AS pct_null_ref, "
              f"(SELECT 100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) FROM _c) AS pct_null_cur FROM _r r"
              for c in _ORDER_COLS) + ")\n"
          "SELECT column_name, round(pct_null_ref, 6) AS pct_null_ref, round(pct_null_cur, 6) AS pct_null_cur, "
          "round(pct_null_cur - pct_null_ref, 6) AS delta_points, CAST(pct_null_cur - pct_null_ref <= 10.0 AS INTEGER) AS passed FROM _m")
def missingness_gate(spark, sf):
    """K6: null share of every orders column in the window from 1997 vs before,
    at most 10 points higher."""
    o = t(spark, sf, "orders").select(*_ORDER_COLS)
    cut = F.lit(MISS_CUT).cast("timestamp")
    ref = P.missing_profile(o.where(F.col("o_orderdate") < cut))
    cur = P.missing_profile(o.where(F.col("o_orderdate") >= cut))
    return present(G.missingness_gate(ref, cur))


@register("data_gate",
          "WITH _m AS (" + ORACLES["missingness_gate"] + "), _e AS (" + ORACLES["table_expectations"] + ")\n"
          "SELECT 'k6_missingness' AS gate, min(passed) AS passed, round(max(delta_points), 6) AS observed, 10.0 AS limit_value FROM _m UNION ALL "
          "SELECT 'k6_table_expectations', min(passed), count(*) FILTER (WHERE passed = 0), 0.0 FROM _e")
def data_gate(spark, sf):
    """K6: missing shares and the table expectations, both halves of the gate."""
    from driftline.plans.q_clean import table_expectations
    return present(G.data_gate(missingness_gate(spark, sf), table_expectations(spark, sf)))


@register("contract_gate",
          f"SELECT a.h AS incumbent, b.h AS challenger, c.h AS filtered, (a.h = b.h)::INTEGER AS equal_contract, (a.h = c.h)::INTEGER AS equal_filtered "
          f"FROM ({fingerprint_sql(_TRAINED_SQL)}) a, ({fingerprint_sql('orders')}) b, "
          f"({fingerprint_sql(chr(40) + 'SELECT * FROM orders WHERE o_orderstatus <> ' + chr(39) + 'P' + chr(39) + chr(41))}) c")
def contract_gate(spark, sf):
    """K5: fingerprints of the contracts of two models, and of one trained without the orders in progress, whose level is then
    missing: its fingerprint differs and the gate fails."""
    o, cut = t(spark, sf, "orders").select(*_ORDER_COLS), F.lit(TRAINED_TO).cast("timestamp")
    a, b, c = (P.contract_fingerprint(x, _FP_CATS).select("fingerprint").scalar() for x in (
        o.where(F.col("o_orderdate") < cut), o, o.where(F.col("o_orderstatus") != "P")))
    return spark.range(1).select(a.alias("incumbent"), b.alias("challenger"), c.alias("filtered"), (a == b).cast("int").alias("equal_contract"),
                                 (a == c).cast("int").alias("equal_filtered"))


SCHEDULE_DAYS = 90


@register("retrain_triggers",
          ORACLES["drift_alerts"].rsplit("\nSELECT win,", 1)[0] + ",\n"
          "_asof AS (SELECT max(l_shipdate) AS as_of_ts, max(l_shipdate) FILTER (WHERE l_shipdate < TIMESTAMP '" + AL_REF_CUT + "') AS trained FROM lineitem)\n"
          f"SELECT 'schedule' AS trigger_name, CAST((SELECT date_diff('day', trained, as_of_ts) FROM _asof) >= {SCHEDULE_DAYS} AS INTEGER) AS fired, "
          f"'model older than {SCHEDULE_DAYS} days' AS reason UNION ALL "
          "SELECT 'data_drift', CAST(coalesce(max(confirmed), 0) AS INTEGER), 'confirmed drift alert (2 consecutive windows)' FROM _st UNION ALL "
          "SELECT 'label_drift', (SELECT max(breaching) FROM (" + ORACLES["label_drift"] + ")), 'PR-AUC drop of matured labels' UNION ALL "
          "SELECT 'manual', 0, 'operator request' UNION ALL "
          "SELECT 'single_window_breach', 0, 'not a trigger: one breaching window is noise'")
def retrain_triggers(spark, sf):
    """K7: retrain triggers (schedule: the model is trained on lineitem before
    the alert reference cut; confirmed data drift; label drift; manual) and the
    explicit non-trigger (a single breaching window), from the alert tables."""
    from driftline.plans.q_monitor import _alert_windows, label_drift
    li = t(spark, sf, "lineitem")
    a = li.agg(F.max("l_shipdate").alias("asof"),
               F.max(F.when(F.col("l_shipdate") < F.lit(AL_REF_CUT).cast("timestamp"), F.col("l_shipdate"))).alias("trained"))
    age = a.select(F.datediff(F.to_date("asof"), F.to_date("trained")).alias("d")).first()["d"]  # one number
    conf = _alert_windows(spark, sf).agg(F.coalesce(F.max("confirmed"), F.lit(0))).scalar()
    label = label_drift(spark, sf).agg(F.coalesce(F.max("breaching"), F.lit(0))).scalar()
    frame = spark.range(1)
    return G.triggers({"schedule": (F.lit(age is not None and age >= SCHEDULE_DAYS), f"model older than {SCHEDULE_DAYS} days"),
                       "data_drift": (conf == 1, "confirmed drift alert (2 consecutive windows)"),
                       "label_drift": (label == 1, "PR-AUC drop of matured labels"),
                       "manual": (F.lit(False), "operator request"),
                       "single_window_breach": (F.lit(False), "not a trigger: one breaching window is noise")}, frame)


CANARY_MIN = 1000
CANARY_B = 500


@register("canary_verdict",
          "WITH " + REQ_SQL + ",\n"
          f"_base AS (SELECT * FROM _req WHERE instance <> {CANARY_INSTANCE}),\n"
          f"_can AS (SELECT * FROM _req WHERE instance = {CANARY_INSTANCE}),\n"
          f"_rep AS ({S.replicate_sql('(SELECT event_id, duration_ms / 1000.0 AS v FROM _base)', 'event_id', CANARY_B)}),\n"
          "_m AS (SELECT b, sum(w * v) / sum(w) AS m FROM _rep GROUP BY b),\n"
          f"_ci AS (SELECT quantile_cont(m, {S.dbl((1 - 0.99) / 2)}) AS lo, quantile_cont(m, {S.dbl(1 - (1 - 0.99) / 2)}) AS hi FROM _m),\n"
          "_b AS (SELECT avg(is_5xx::DOUBLE) AS base_err FROM _base),\n"
          "_c AS (SELECT count(*) AS n, quantile_cont(duration_ms / 1000.0, 0.99::DOUBLE) AS p99, avg(is_5xx::DOUBLE) AS err, "
          "avg(duration_ms / 1000.0) AS mean_score FROM _can)\n"
          "SELECT n, round(p99, 6) AS p99, round(err, 6) AS error_ratio, round(base_err, 6) AS baseline_error_ratio, "
          "round(mean_score, 6) AS mean_score, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, "
          f"CAST(n >= {CANARY_MIN} AS INTEGER) AS enough, CAST(n >= {CANARY_MIN} AND p99 <= {SLO_P99!r} AND err <= base_err * 1.5 "
          "AND mean_score >= lo AND mean_score <= hi AS INTEGER) AS passed FROM _c, _b, _ci")
def canary_verdict(spark, sf):
    """K8: the canary instance after >= 1000 requests: p99 within SLO, 5xx ratio
    at most 1.5x the baseline instances', mean latency score inside the 99%
    bootstrap CI (B = 500) of the baseline mean."""
    r = V.req(spark, sf).withColumn("v", F.col("duration_ms") / 1000.0)
    base = r.where(F.col("instance") != CANARY_INSTANCE)
    can = r.where(F.col("instance") == CANARY_INSTANCE)
    ci = bootstrap_mean(base, "v", ["event_id"], B=CANARY_B, level=0.99)
    be = base.agg(F.avg(F.col("is_5xx").cast("double"))).scalar()
    cs = S_.scalars(ci, "lower", "upper")
    lo, hi = cs["lower"], cs["upper"]
    return present(G.canary_checks(can, "v", "is_5xx", be, lo, hi, SLO_P99, CANARY_MIN))
