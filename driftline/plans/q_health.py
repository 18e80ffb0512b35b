"""Model-health and data-quality rules and the one alert table.

Stand-ins in the request log: an ``error`` request reports that the instance has no usable model, a ``signup``
that it serves its local fallback, any other that its model is loaded; the record of a request of instance 2
with ``k`` = 7 could not be written to the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import slo as L
from driftline.plans import q_slo as Q
from driftline.plans import views as V
from driftline.plans.q_slo import DAY, HOUR, REQ2_SQL, STEP, VALIDATION_K_MAX, grid_sql, hold_sql, trail_sql
from driftline.plans.registry import ORACLES, register
from driftline.plans.views import REQ_SQL, present

STATUS = {"error": "not_loaded", "signup": "local_fallback"}
STATUS_HOLD = {"model_not_loaded": ("not_loaded", 2 * HOUR), "serving_fallback": ("local_fallback", 3 * HOUR)}
LOG_RANGE = LOG_HOLD = 15 * HOUR
OUTCOME_DAYS = 5


def _tail(name: str) -> str:
    """The CTEs of a registered oracle behind the request view, without its last SELECT."""
    return ORACLES[name].split(REQ2_SQL + ",\n", 1)[1].rsplit("\nSELECT ", 1)[0]


# ---------------------------------------------------------------- J11 with its hold

def _status_rules(spark, sf):
    r = Q._req(spark, sf)
    status = F.lit("loaded")
    for endpoint, name in STATUS.items():
        status = F.when(F.col("endpoint") == endpoint, name).otherwise(status)
    s = L.status_series(r.withColumn("status", status), "instance", "ts", "status", STEP, ["event_id"])
    out = None
    for rule, (name, hold_s) in STATUS_HOLD.items():
        g = s.withColumn("rule", F.lit(rule)).withColumn("cond", F.coalesce(F.col("status") == name, F.lit(False)))
        one = L.hold(g, "cond", STEP, hold_s, ["rule", "instance"])
        out = one if out is None else out.unionByName(one)
    return out


STATUS_SQL = (
    "_ms AS (SELECT instance, b, arg_max(CASE endpoint " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in STATUS.items())
    + " ELSE 'loaded' END, (ts, event_id)) AS st FROM _rq GROUP BY ALL),\n"
    "_mg AS (SELECT k.instance, s.b, make_timestamp((s.b + 1) * " + str(STEP * 1_000_000) + ") AS t, "
    "last_value(m.st IGNORE NULLS) OVER (PARTITION BY k.instance ORDER BY s.b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS status "
    "FROM (SELECT DISTINCT instance FROM _rq) k CROSS JOIN (SELECT unnest(range(min(b), max(b) + 1)) AS b FROM _rq) s "
    "LEFT JOIN _ms m ON m.instance = k.instance AND m.b = s.b),\n"
    + ",\n".join(f"_mc{i} AS (SELECT '{rule}' AS rule, instance, b, t, status, coalesce(status = '{name}', false) AS cnd FROM _mg)"
                  for i, (rule, (name, _)) in enumerate(STATUS_HOLD.items())) + ",\n"
    "_status AS (" + " UNION ALL ".join(
        f"SELECT rule, instance, t, status, CAST(cnd AS INTEGER) AS condition, firing, starts_firing FROM "
        + hold_sql(f"_mc{i}", ["rule", "instance"], "cnd", h) for i, (_, h) in enumerate(STATUS_HOLD.values())) + ")")


@register("model_status_rules", "WITH " + REQ2_SQL + ",\n" + STATUS_SQL + "\nSELECT rule, instance, t, status, condition, firing, starts_firing FROM _status")
def model_status_rules(spark, sf):
    """J11 + J8: load status per instance at every hour, carried forward; no usable model held 2 h (page), the local
    fallback held 3 h (ticket)."""
    s = _status_rules(spark, sf)
    return present(s.select("rule", "instance", "t", "status", F.col("cond").cast("int").alias("condition"), "firing", "starts_firing"))


# ---------------------------------------------------------------- J14

def _writes(spark, sf):
    r = Q._req(spark, sf).withColumn("k", F.from_json("props", "k int")["k"])
    failed = F.coalesce((F.col("instance") == 2) & (F.col("k") == 7), F.lit(False))
    return r.withColumn("result", F.when(failed, "failed").otherwise("ok"))


def _log_rules(spark, sf):
    g = L.grid_series(_writes(spark, sf), "ts", STEP, {"failed": F.count_if(F.col("result") == "failed")})
    g = L.trailing(g, LOG_RANGE, STEP, ["failed"], [], "_range")
    g = g.withColumn("rule", F.lit("log_write_failures")).withColumn("cond", F.col("failed_range") > 0)
    return L.hold(g, "cond", STEP, LOG_HOLD, ["rule"])


K_SQL = "_rk AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM _rq)"
LOG_SQL = (
    K_SQL + ",\n_rw AS (SELECT *, CASE WHEN coalesce(instance = 2 AND k = 7, false) THEN 'failed' ELSE 'ok' END AS result FROM _rk),\n"
    + grid_sql("_lg", [], {"failed": "count(*) FILTER (WHERE result = 'failed')"}, "_rw") + ",\n"
    f"_lt AS (SELECT 'log_write_failures' AS rule, b, t, {trail_sql('failed', [], LOG_RANGE)} AS n FROM _lg),\n"
    "_lc AS (SELECT *, n > 0 AS cnd FROM _lt),\n"
    "_log AS (SELECT rule, t, CAST(n AS BIGINT) AS failed_15h, CAST(cnd AS INTEGER) AS condition, firing, starts_firing FROM "
    + hold_sql("_lc", ["rule"], "cnd", LOG_HOLD) + ")")


@register("log_write_failures", "WITH " + REQ2_SQL + ",\n" + LOG_SQL + "\nSELECT t, failed_15h, condition, firing, starts_firing FROM _log")
def log_write_failures(spark, sf):
    """J14 + J8: log writes that failed in a trailing window of 15 h, above zero for 15 h."""
    s = _log_rules(spark, sf)
    return present(s.select("t", F.col("failed_range").cast("long").alias("failed_15h"), F.col("cond").cast("int").alias("condition"),
                            "firing", "starts_firing"))


# ---------------------------------------------------------------- J15 on a grid

def _outcome_rules(spark, sf):
    # a day without outcomes is a row: the grid spans the predictions too
    span = V.pred(spark, sf).select(F.col("pred_ts").alias("outcome_ts")).unionByName(V.outc(spark, sf).select("outcome_ts"))
    g = L.grid_series(V.outc(spark, sf).where("outcome_label = 1"), "outcome_ts", DAY, {"n": F.count(F.lit(1))}, span=span)
    g = L.trailing(g, OUTCOME_DAYS * DAY, DAY, ["n"], [], "_range")
    g = g.withColumn("rule", F.lit("no_outcomes")).withColumn("cond", F.col("n_range") == 0)
    return L.hold(g, "cond", DAY, DAY, ["rule"])


def _day_hold_sql(src: str) -> str:
    return (f"(SELECT *, CAST(cnd AND b - min(b) OVER (PARTITION BY rule, cnd, i) >= 1 AS INTEGER) AS firing, "
            f"CAST(cnd AND b - min(b) OVER (PARTITION BY rule, cnd, i) = 1 AS INTEGER) AS starts_firing FROM ("
            f"SELECT *, b - row_number() OVER (PARTITION BY rule, cnd ORDER BY b) AS i FROM {src}))")


OUTCOME_SQL = (
    f"_oa AS (SELECT epoch_us(l_shipdate) // {DAY}000000 AS b, l_returnflag = 'R' AS hit FROM lineitem "
    f"UNION ALL SELECT epoch_us(o_orderdate) // {DAY}000000, false FROM orders),\n"
    "_og AS (SELECT s.b, coalesce(n, 0) AS n FROM (SELECT unnest(range(min(b), max(b) + 1)) AS b FROM _oa) s "
    "LEFT JOIN (SELECT b, count(*) AS n FROM _oa WHERE hit GROUP BY b) g USING (b)),\n"
    f"_oc AS (SELECT 'no_outcomes' AS rule, b, make_timestamp((b + 1) * {DAY}000000) AS t, n5, n5 = 0 AS cnd FROM ("
    f"SELECT b, CAST(sum(n) OVER (ORDER BY b RANGE BETWEEN {OUTCOME_DAYS - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS n5 FROM _og)),\n"
    "_out AS (SELECT rule, t, n5, CAST(cnd AS INTEGER) AS condition, firing, starts_firing FROM " + _day_hold_sql("_oc") + ")")


@register("no_outcomes_rule", "WITH " + OUTCOME_SQL + "\nSELECT t, n5 AS outcomes_5d, condition, firing, starts_firing FROM _out")
def no_outcomes_rule(spark, sf):
    """J15 + J8: positive outcomes recorded in a trailing window of five days, none for a day."""
    s = _outcome_rules(spark, sf)
    return present(s.select("t", F.col("n_range").cast("long").alias("outcomes_5d"), F.col("cond").cast("int").alias("condition"),
                            "firing", "starts_firing"))


# ---------------------------------------------------------------- J18 panels

@register("health_panels",
          "WITH " + REQ2_SQL + ",\n" + LOG_SQL.split(",\n_lg_g", 1)[0] + ",\n"
          "_p AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, 'log_writes' AS panel, result AS series FROM _rw UNION ALL "
          f"SELECT CAST(date_trunc('day', ts) AS DATE), 'validation_errors', 'k' FROM _rw WHERE k IS NULL OR k < 0 OR k > {VALIDATION_K_MAX} UNION ALL "
          "SELECT CAST(date_trunc('day', ts) AS DATE), 'status_class', status_class FROM _rw)\n"
          "SELECT panel, series, strftime(day, '%Y-%m-%d') AS day, count(*) AS n, round(count(*) / 86400.0, 6) AS rate_per_s FROM _p GROUP BY ALL")
def health_panels(spark, sf):
    """The panels by label: log writes by result, validation errors by field, requests by status class, per day."""
    from driftline.operators import validate as VL
    r = _writes(spark, sf)
    v = VL.validate(r, [VL.FieldRule("k", required=True, dtype="int", ge=0, le=VALIDATION_K_MAX)])
    errors = VL.flatten_errors(v.select("event_id", "ts", "errors"), ["event_id", "ts"])
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    rows = r.select(F.lit("log_writes").alias("panel"), F.col("result").alias("series"), day).unionByName(
        errors.select(F.lit("validation_errors").alias("panel"), F.col("field").alias("series"), day)).unionByName(
        r.select(F.lit("status_class").alias("panel"), F.col("status_class").alias("series"), day))
    g = rows.groupBy("panel", "series", "day").agg(F.count(F.lit(1)).alias("n"))
    return present(g.withColumn("rate_per_s", F.col("n") / 86400.0))


# ---------------------------------------------------------------- J21

#: Every rule: severity (page or ticket) and runbook.
RULES = {"fast_burn": ("page", "error-budget-burn"), "slow_burn": ("ticket", "error-budget-burn"), "latency_p99": ("page", "latency"),
         "latency_creep": ("ticket", "latency"), "saturation": ("ticket", "saturation"), "score_shift": ("ticket", "score-shift"),
         "no_traffic": ("ticket", "no-traffic"), "validation_spike": ("ticket", "validation"), "model_not_loaded": ("page", "model-status"),
         "serving_fallback": ("ticket", "model-status"), "log_write_failures": ("ticket", "prediction-log"),
         "no_outcomes": ("ticket", "label-pipeline"), "heartbeat_missing": ("page", "no-traffic")}


@register("alert_table",
          Q.BURN_SQL + ",\n" + Q.P99_SQL.split(REQ2_SQL + ",\n", 1)[1] + ",\n" + Q.SIMPLE_SQL.split(REQ2_SQL + ",\n", 1)[1] + ",\n"
          + _tail("validation_spike") + ",\n" + STATUS_SQL + ",\n" + LOG_SQL + ",\n" + OUTCOME_SQL + ",\n"
          "_hb AS (SELECT instance, ts AS gap_start, lead(ts) OVER (PARTITION BY instance ORDER BY ts, event_id) AS gap_end FROM _req),\n"
          "_rb(rule, severity, runbook) AS (VALUES " + ", ".join(f"('{r}', '{s}', 'runbooks/{b}.md')" for r, (s, b) in RULES.items()) + "),\n"
          "_fires AS (SELECT rule, t AS fired_at, ratio_long AS value FROM _burn WHERE starts_firing = 1 UNION ALL "
          "SELECT rule, t, p99 FROM _p99 WHERE starts_firing = 1 UNION ALL SELECT rule, t, value FROM _simple WHERE starts_firing = 1 UNION ALL "
          "SELECT rule, t, value FROM " + hold_sql("_vc", ["rule", "field"], "cnd", Q.SPIKE_HOLD) + " WHERE starts_firing = 1 UNION ALL "
          "SELECT rule, t, instance::DOUBLE FROM _status WHERE starts_firing = 1 UNION ALL "
          "SELECT rule, t, failed_15h::DOUBLE FROM _log WHERE starts_firing = 1 UNION ALL SELECT rule, t, n5::DOUBLE FROM _out WHERE starts_firing = 1 UNION ALL "
          f"SELECT 'heartbeat_missing', gap_start + INTERVAL {Q.HEARTBEAT_GAP_S} SECONDS, (epoch_us(gap_end) - epoch_us(gap_start)) / 6e7 FROM _hb "
          f"WHERE epoch_us(gap_end) - epoch_us(gap_start) > {Q.HEARTBEAT_GAP_S * 1_000_000})\n"
          "SELECT f.rule, r.severity, f.fired_at, round(f.value, 6) AS value, r.runbook FROM _fires f JOIN _rb r USING (rule)")
def alert_table(spark, sf):
    """J21 (+ J6-J17): every rule's firing onsets in one table (rule, severity, fired_at, value, runbook); exactly two
    severities, page and ticket. The value is the rule's measure, for the status rules the instance."""
    onset = F.col("starts_firing") == 1

    def rows(df, value, at="t"):
        return df.select("rule", F.col(at).alias("fired_at"), F.col(value).cast("double").alias("value"))
    gaps = L.consecutive_gaps(V.req(spark, sf).select("instance", "ts", "event_id"), "instance", "ts", Q.HEARTBEAT_GAP_S)
    gaps = gaps.select(F.lit("heartbeat_missing").alias("rule"), (F.col("gap_start") + F.expr(f"INTERVAL {Q.HEARTBEAT_GAP_S} SECONDS")).alias("t"),
                       "gap_minutes")
    parts = [rows(Q._burn(spark, sf).where(onset), "ratio_long"), rows(Q._p99_rules(spark, sf).where(onset), "p99"),
             rows(Q._simple_rules(spark, sf).where(onset), "value"), rows(Q._spike(spark, sf).where(onset), "value"),
             rows(_status_rules(spark, sf).where(onset), "instance"), rows(_log_rules(spark, sf).where(onset), "failed_range"),
             rows(_outcome_rules(spark, sf).where(onset), "n_range"), rows(gaps, "gap_minutes")]
    fires = parts[0]
    for p in parts[1:]:
        fires = fires.unionByName(p)
    meta = spark.createDataFrame([(r, s, f"runbooks/{b}.md") for r, (s, b) in RULES.items()], "rule string, severity string, runbook string")
    return present(fires.join(F.broadcast(meta), "rule").select("rule", "severity", "fired_at", "value", "runbook"))
