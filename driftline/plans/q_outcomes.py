"""Prediction log x outcomes (I2-I7, J15) and perturbation plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.exprs import scalars
from driftline.operators import drift as D
from driftline.operators import outcomes as O
from driftline.operators import profile as P
from driftline.operators.quantile import with_quantiles
from driftline.plans import sqlgen as S
from driftline.plans import views as V
from driftline.plans.q_eval import LWW_SQL, OUTC_SQL, PRED_SQL
from driftline.plans.registry import register
from driftline.plans.views import present, t

_BASE = "WITH " + PRED_SQL + ",\n" + OUTC_SQL + ",\n" + LWW_SQL


def _joined(spark, sf):
    lww = O.last_write_wins(V.outc(spark, sf), "prediction_id", "outcome_ts", V.OUTC_TIEBREAK)
    return O.join_outcomes(V.pred(spark, sf), lww.select("prediction_id", "outcome_label", "outcome_ts",
                                                           "n_writes"), "prediction_id")


@register("join_outcomes", _BASE + "\nSELECT p.prediction_id, p.pred_ts, round(p.score, 6) AS score, "
          "CAST(l.outcome_label AS DOUBLE) AS outcome_label, l.outcome_ts, coalesce(l.n_writes, 0) AS n_writes "
          "FROM _pred p LEFT JOIN _lww l ON p.prediction_id = l.prediction_id")
def join_outcomes(spark, sf):
    """I2 + I3: last write per prediction id (latest outcome time, then a full
    tiebreak) left-joined to every prediction."""
    j = _joined(spark, sf)
    return present(j.select("prediction_id", "pred_ts", "score", F.col("outcome_label").cast("double"),
                            "outcome_ts", F.coalesce("n_writes", F.lit(0)).alias("n_writes")))


@register("maturity_counts", _BASE + "\nSELECT count(*) AS n_predictions, count(l.outcome_label) AS n_matured, "
          "count(*) - count(l.outcome_label) AS n_unmatured, count(*) FILTER (WHERE l.n_writes > 1) AS n_corrected "
          "FROM _pred p LEFT JOIN _lww l ON p.prediction_id = l.prediction_id")
def maturity_counts(spark, sf):
    """I4: matured / unmatured predictions and ids whose outcome was corrected."""
    j = _joined(spark, sf)
    return O.maturity_counts(j, "outcome_label").join(
        j.agg(F.count_if(F.col("n_writes") > 1).alias("n_corrected")))


@register("unmatched_outcomes", "WITH " + PRED_SQL + ",\n" + OUTC_SQL + "\n"
          "SELECT o.prediction_id, count(*) AS n_outcomes FROM _outc o ANTI JOIN _pred p ON o.prediction_id = p.prediction_id "
          "GROUP BY o.prediction_id")
def unmatched_outcomes(spark, sf):
    """Outcomes whose prediction id is unknown (anti join), counted per id."""
    u = O.unmatched_outcomes(V.outc(spark, sf), V.pred(spark, sf), "prediction_id")
    return u.groupBy("prediction_id").agg(F.count(F.lit(1)).alias("n_outcomes"))


MATURE_DAYS = 30


@register("maturation_lag", _BASE + ",\n"
          "_j AS (SELECT (epoch(l.outcome_ts) - epoch(p.pred_ts)) / 86400.0 AS lag_days, "
          f"CAST(coalesce(l.outcome_ts >= p.pred_ts + INTERVAL {MATURE_DAYS} DAYS, false) AS INTEGER) AS matured "
          "FROM _pred p LEFT JOIN _lww l ON p.prediction_id = l.prediction_id)\n"
          "SELECT count(lag_days) AS n_labelled, CAST(sum(matured) AS BIGINT) AS n_matured, "
          "round(quantile_cont(lag_days, 0.5::DOUBLE), 6) AS lag_p50, round(quantile_cont(lag_days, 0.9::DOUBLE), 6) AS lag_p90, "
          "round(quantile_cont(lag_days, 0.99::DOUBLE), 6) AS lag_p99, round(avg(matured::DOUBLE), 6) AS matured_share FROM _j")
def maturation_lag(spark, sf):
    """A label counts only 30 days after its prediction; delay quantiles."""
    m = O.maturation(_joined(spark, sf), "pred_ts", "outcome_ts", MATURE_DAYS)
    g = m.agg(F.count("lag_days").alias("n_labelled"), F.sum("matured").cast("long").alias("n_matured"),
              F.avg(F.col("matured").cast("double")).alias("matured_share"))
    return present(with_quantiles(g, m, "lag_days", {"lag_p50": 0.5, "lag_p90": 0.9, "lag_p99": 0.99}))


@register("label_watchdog", "WITH " + PRED_SQL + ",\n" + OUTC_SQL + ",\n"
          "_asof AS (SELECT max(pred_ts) AS t FROM _pred),\n"
          "_o AS (SELECT o.* FROM _outc o, _asof a WHERE o.outcome_ts <= a.t)\n"
          "SELECT max(outcome_ts) AS last_outcome_ts, count(*) AS n_outcomes, "
          "round((epoch((SELECT t FROM _asof)) - epoch(max(outcome_ts))) / 3600.0, 6) AS hours_since_last, "
          "CAST(coalesce((epoch((SELECT t FROM _asof)) - epoch(max(outcome_ts))) / 3600.0 > 888.0, true) AS INTEGER) AS breaching, "
          "count(*) FILTER (WHERE outcome_ts > (SELECT t FROM _asof) - INTERVAL 5 DAYS) AS outcomes_last_5d, "
          "CAST(count(*) FILTER (WHERE outcome_ts > (SELECT t FROM _asof) - INTERVAL 5 DAYS) = 0 AS INTEGER) AS no_outcomes_alert FROM _o")
def label_watchdog(spark, sf):
    """I7 + J15: as of the last prediction time, hours since the last outcome
    (limit 888 h) and the absence alert (no outcome in 5 days)."""
    asof = V.pred(spark, sf).agg(F.max("pred_ts")).scalar()
    o = V.outc(spark, sf).where(F.col("outcome_ts") <= asof)
    w = O.label_watchdog(o, "outcome_ts", asof)
    recent = o.agg(F.count_if(F.col("outcome_ts") > asof - F.expr("INTERVAL 5 DAYS")).alias("outcomes_last_5d"))
    return present(w.join(recent).withColumn("no_outcomes_alert", (F.col("outcomes_last_5d") == 0).cast("int")))


# ---------------------------------------------------------------- H13-H15

RW_LEVELS = ["AUTOMOBILE"]
RW_WEIGHT = 4.0


@register("reweighted_sample",
          "WITH _c AS (SELECT *, CASE WHEN c_mktsegment IN ('AUTOMOBILE') THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM customer),\n"
          "_t AS (SELECT count(*) AS n, sum(w) AS sw FROM _c),\n"
          f"_l AS (SELECT _c.*, w * n / sw AS lam, {S.hash_uniform_sql('c_custkey')} AS u FROM _c, _t),\n"
          f"_k AS (SELECT c_mktsegment, {S.poisson_inverse_sql('lam', 'u')} AS copies FROM _l),\n"
          "_b AS (SELECT c_mktsegment AS value, count(*) AS n_before FROM customer GROUP BY 1),\n"
          "_a AS (SELECT c_mktsegment AS value, CAST(sum(copies) AS BIGINT) AS n_after FROM _k GROUP BY 1)\n"
          "SELECT value, n_before, round(n_before::DOUBLE / sum(n_before) OVER (), 6) AS share_before, coalesce(n_after, 0) AS n_after, "
          "round(coalesce(n_after, 0)::DOUBLE / sum(n_after) OVER (), 6) AS share_after FROM _b LEFT JOIN _a USING (value)")
def reweighted_sample(spark, sf):
    """H13 + D7: customers resampled with replacement, AUTOMOBILE weighted 4
    (hash-seeded Poisson copies); segment shares before and after."""
    c = t(spark, sf, "customer")
    r = D.reweight_sample(c, "c_mktsegment", RW_LEVELS, RW_WEIGHT, ["c_custkey"])
    b = c.groupBy(F.col("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("n_before"))
    # a row a segment, read by the shares and by their total: the sample is drawn once
    a = r.groupBy(F.col("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("n_after")).checkpoint()
    nb, na = c.select(F.count(F.lit(1))).scalar(), a.agg(F.coalesce(F.sum("n_after"), F.lit(0))).scalar()
    j = b.join(a, "value", "left").fillna(0, ["n_after"])
    return present(j.select("value", "n_before", (F.col("n_before") / nb).alias("share_before"), "n_after",
                            (F.col("n_after") / na).alias("share_after")))


@register("additive_shift",
          "WITH _ref AS (SELECT l_quantity FROM lineitem), _cur AS (SELECT least(l_quantity + 10, 50.0::DOUBLE) AS l_quantity FROM lineitem),\n"
          + S.psi_sql("_ref", "_cur", ["l_quantity"], []) + "\n"
          "SELECT 'l_quantity' AS feature, round((SELECT avg(l_quantity) FROM _ref), 6) AS mean_before, "
          "round((SELECT avg(l_quantity) FROM _cur), 6) AS mean_after, "
          "round((SELECT quantile_cont(l_quantity, 0.9::DOUBLE) FROM _ref), 6) AS p90_before, "
          "round((SELECT quantile_cont(l_quantity, 0.9::DOUBLE) FROM _cur), 6) AS p90_after, round(psi, 6) AS psi FROM _psi")
def additive_shift(spark, sf):
    """H14 + D10: l_quantity + 10 capped at 50; mean / p90 before and after and
    the PSI it causes."""
    li = t(spark, sf, "lineitem").select("l_quantity")
    sh = D.additive_shift(li, "l_quantity", 10.0, 50.0)
    mb, ma = P.moments(li, "l_quantity"), P.moments(sh, "l_quantity")
    p = D.psi(li, sh, ["l_quantity"], [])
    b, a = scalars(mb, "mean", "p90"), scalars(ma, "mean", "p90")
    return present(p.select("feature", b["mean"].alias("mean_before"), a["mean"].alias("mean_after"),
                            b["p90"].alias("p90_before"), a["p90"].alias("p90_after"), "psi"))


@register("collapse",
          "WITH _b AS (SELECT p_brand AS value, count(*)::DOUBLE / (SELECT count(*) FROM part) AS share FROM part GROUP BY 1),\n"
          "_tb AS (SELECT 'before' AS stage, value, share FROM _b ORDER BY share DESC, value LIMIT 5),\n"
          "_ta AS (SELECT 'after' AS stage, 'Brand#11' AS value, 1.0::DOUBLE AS share FROM part LIMIT 1),\n"
          "_ref AS (SELECT p_brand FROM part), _cur AS (SELECT 'Brand#11' AS p_brand FROM part),\n"
          + S.psi_sql("_ref", "_cur", [], ["p_brand"]) + "\n"
          "SELECT stage, value, round(share, 6) AS share, round((SELECT psi FROM _psi), 6) AS psi FROM (SELECT * FROM _tb UNION ALL SELECT * FROM _ta)")
def collapse(spark, sf):
    """H15 + D7: p_brand collapsed to one value; top-5 shares before / after and
    the PSI of the collapse."""
    p = t(spark, sf, "part").select("p_brand")
    c = D.collapse(p, "p_brand", "Brand#11")
    ps = D.psi(p, c, [], ["p_brand"]).select("psi").scalar()
    tb = P.top_shares(p, "p_brand").select(F.lit("before").alias("stage"), "value", "share")
    ta = P.top_shares(c, "p_brand").select(F.lit("after").alias("stage"), "value", "share")
    return present(tb.unionByName(ta).withColumn("psi", ps))
