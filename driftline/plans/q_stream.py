"""Streaming plans (S1-S9): inputs replayed from the test tables as time-ordered
files, run with ``availableNow`` into Parquet sinks, returned as DataFrames.  Each has
a batch twin as its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.plans import views as V
from driftline.plans.q_eval import LWW_SQL, OUTC_SQL
from driftline.plans.registry import register
from driftline.plans.views import REQ_SQL, present
from driftline.session import scratch_dir
from driftline.streaming import stream as ST

PRED_SCHEMA = T.StructType([T.StructField("prediction_id", T.LongType()), T.StructField("pred_ts", T.TimestampType()),
                            T.StructField("score", T.DoubleType())])
OUTC_SCHEMA = T.StructType([T.StructField("prediction_id", T.LongType()), T.StructField("outcome_ts", T.TimestampType()),
                            T.StructField("outcome_label", T.IntegerType())] +
                           [T.StructField(c, t) for c, t in (("l_linenumber", T.IntegerType()), ("l_partkey", T.LongType()),
                                                             ("l_suppkey", T.LongType()), ("l_extendedprice", T.DoubleType()),
                                                             ("l_quantity", T.DoubleType()))])
WITHIN_DAYS = 37
DELAY = "40 days 1 hour"


def _pred_files(spark, sf, base):
    ST.write_ordered(spark, V.pred(spark, sf).select("prediction_id", "pred_ts", "score"), "pred_ts", base)


def _outc_files(spark, sf, base):
    ST.write_ordered(spark, V.outc(spark, sf), "outcome_ts", base)


@register("stream_join_outcomes",
          "WITH _p AS (SELECT o_orderkey AS prediction_id, o_orderdate AS pred_ts FROM orders),\n"
          "_o AS (SELECT l_orderkey AS prediction_id, l_shipdate AS outcome_ts, CAST(l_returnflag = 'R' AS INTEGER) AS outcome_label FROM lineitem),\n"
          f"_wm AS (SELECT least((SELECT max(pred_ts) FROM _p), (SELECT max(outcome_ts) FROM _o)) - INTERVAL '{DELAY}' AS wm),\n"
          "_m AS (SELECT p.prediction_id, p.pred_ts, o.outcome_ts, o.outcome_label FROM _p p JOIN _o o ON p.prediction_id = o.prediction_id "
          f"AND o.outcome_ts >= p.pred_ts AND o.outcome_ts <= p.pred_ts + INTERVAL {WITHIN_DAYS} DAYS)\n"
          "SELECT prediction_id, pred_ts, outcome_ts, CAST(outcome_label AS DOUBLE) AS outcome_label FROM _m "
          "UNION ALL SELECT p.prediction_id, p.pred_ts, NULL::TIMESTAMP, NULL::DOUBLE FROM _p p "
          "WHERE p.prediction_id NOT IN (SELECT prediction_id FROM _m) "
          f"AND p.pred_ts + INTERVAL {WITHIN_DAYS} DAYS < (SELECT wm FROM _wm)")
def stream_join_outcomes(spark, sf):
    """S1 + S2 + S3 + S9: prediction and outcome streams (files in time order),
    watermarked, de-duplicated on id, left-outer joined with outcomes inside
    [pred_ts, pred_ts + 37 d]; unmatched predictions appear once the watermark
    has passed them."""
    base = scratch_dir(spark, "stream_join")
    _pred_files(spark, sf, f"{base}/pred")
    _outc_files(spark, sf, f"{base}/outc")
    p = ST.dedupe(ST.with_event_time(ST.file_stream(spark, f"{base}/pred", PRED_SCHEMA), "pred_ts", DELAY), "prediction_id")
    o = ST.with_event_time(ST.file_stream(spark, f"{base}/outc", OUTC_SCHEMA), "outcome_ts", DELAY)
    j = ST.late_outcome_join(p, o.select("prediction_id", "outcome_ts", "outcome_label"), "prediction_id",
                             "pred_ts", "outcome_ts", f"{WITHIN_DAYS} days")
    out = ST.run_available_now(j.select("prediction_id", "pred_ts", "outcome_ts", "outcome_label"),
                               f"{base}/out", f"{base}/_ckpt")
    return present(out.withColumn("outcome_label", F.col("outcome_label").cast("double")))


BURN_DELAY = "1 hour"


@register("stream_burn",
          "WITH " + REQ_SQL + ",\n"
          "_w AS (SELECT make_timestamp((epoch_us(ts) // 3600000000 - k) * 3600000000) AS window_start, is_5xx FROM _req, range(6) r(k)),\n"
          f"_wm AS (SELECT max(ts) - INTERVAL '{BURN_DELAY}' AS wm FROM _req)\n"
          "SELECT window_start, window_start + INTERVAL 6 HOURS AS window_end, count(*) AS n, CAST(sum(is_5xx) AS BIGINT) AS n_5xx, "
          "round(sum(is_5xx)::DOUBLE / count(*), 6) AS error_ratio FROM _w GROUP BY window_start "
          "HAVING window_start + INTERVAL 6 HOURS <= (SELECT wm FROM _wm)")
def stream_burn(spark, sf):
    """S5 (+ S2): request stream (files in time order) counted in sliding 6 h
    windows every hour; append mode emits each window once the watermark
    (1 h delay) has passed its end."""
    base = scratch_dir(spark, "stream_burn")
    ST.write_ordered(spark, V.req(spark, sf).select("ts", "is_5xx"), "ts", f"{base}/req")
    sch = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("is_5xx", T.IntegerType())])
    s = ST.with_event_time(ST.file_stream(spark, f"{base}/req", sch), "ts", BURN_DELAY)
    w = ST.windowed_counts(s, "ts", "6 hours", "1 hour",
                           {"n": F.count(F.lit(1)), "n_5xx": F.sum("is_5xx").cast("long")})
    out = ST.run_available_now(w, f"{base}/out", f"{base}/_ckpt")
    return present(out.withColumn("error_ratio", F.col("n_5xx") / F.col("n")))


@register("stream_outcome_upsert", "WITH " + OUTC_SQL + ",\n" + LWW_SQL + "\n"
          "SELECT prediction_id, outcome_ts, outcome_label, l_linenumber, l_partkey, l_suppkey, "
          "round(l_extendedprice, 6) AS l_extendedprice, round(l_quantity, 6) AS l_quantity FROM _lww")
def stream_outcome_upsert(spark, sf):
    """Corrected outcomes supersede earlier ones: each micro-batch of the
    outcome stream is merged into a keyed snapshot table by last-write-wins."""
    base = scratch_dir(spark, "stream_upsert")
    _outc_files(spark, sf, f"{base}/outc")
    table = ST.OutcomeTable(f"{base}/table", "prediction_id", "outcome_ts", V.OUTC_TIEBREAK)
    s = ST.file_stream(spark, f"{base}/outc", OUTC_SCHEMA)
    ST.run_foreach_batch(s, table.upsert, f"{base}/_ckpt")
    return present(table.current(spark))


WIN_SIZE = 2000


@register("stream_count_windows",
          "WITH _r AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, "
          "count(*) OVER () AS n FROM orders)\n"
          f"SELECT (rn - 1) // {WIN_SIZE} AS window_id, count(*) AS n, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts "
          f"FROM _r WHERE (rn - 1) // {WIN_SIZE} < n // {WIN_SIZE} GROUP BY 1")
def stream_count_windows(spark, sf):
    """The prediction stream cut into consecutive windows of 2,000 records
    across micro-batches; completed windows are reported."""
    base = scratch_dir(spark, "stream_windows")
    _pred_files(spark, sf, f"{base}/pred")
    done = []
    cw = ST.CountWindows(f"{base}/log", ["pred_ts", "prediction_id"], WIN_SIZE,
                         on_window=lambda df, w: done.append(w))
    s = ST.file_stream(spark, f"{base}/pred", PRED_SCHEMA)
    ST.run_foreach_batch(s, cw.process, f"{base}/_ckpt")
    log = cw.log(spark)
    if log is None:
        log = spark.createDataFrame([], PRED_SCHEMA).withColumn("window_id", F.lit(0).cast("long"))
    log = log.where(F.col("window_id").isin(done))
    return present(log.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.min("pred_ts").alias("first_ts"),
                                                F.max("pred_ts").alias("last_ts")))


HB_GAP_S = 2 * 3600


@register("stream_heartbeat",
          "WITH " + REQ_SQL + ",\n"
          "_hb AS (SELECT instance, ts AS gap_start, lead(ts) OVER (PARTITION BY instance ORDER BY ts, event_id) AS gap_end FROM _req)\n"
          "SELECT instance, gap_start AS last_seen, gap_end AS next_seen, 'heartbeat_gap' AS alert FROM _hb "
          f"WHERE epoch_us(gap_end) - epoch_us(gap_start) > {HB_GAP_S * 1_000_000} "
          "UNION ALL SELECT instance, max(ts), NULL::TIMESTAMP, 'heartbeat_missing' FROM _req GROUP BY instance "
          f"HAVING max(ts) + INTERVAL {HB_GAP_S} SECONDS < (SELECT max(ts) FROM _req) - INTERVAL 10 MINUTES")
def stream_heartbeat(spark, sf):
    """S1 + S7: per-instance heartbeat watchdog (applyInPandasWithState) over an NDJSON stream: gaps over
    2 h between consecutive requests, found inside and across micro-batches
    with the last-seen state; event-time timeouts report trailing silence."""
    base = scratch_dir(spark, "stream_heartbeat")
    # the wire format has microseconds, which the JSON writer's own timestamps lack
    r = V.req(spark, sf).select("instance", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"))
    ST.write_ordered(spark, r, "ts", f"{base}/req", "json")
    sch = T.StructType([T.StructField("instance", T.LongType()), T.StructField("ts", T.TimestampType())])
    lines = ST.ndjson_stream(spark, f"{base}/req", sch).where("_malformed = 0").select("instance", "ts")
    out = ST.run_available_now(ST.heartbeat_watchdog(lines, "instance", "ts", "2 hours", "10 minutes"), f"{base}/out", f"{base}/_ckpt")
    return present(out)


HOLD_LIMIT = 0.2
#: (rule, step, hold, seconds of each): an hourly ratio held for two hours, and two daily windows in a row.
HOLDS = [("hold_2h", "1 hour", "2 hours", 3600, 7200), ("two_windows", "1 day", "1 day", 86400, 86400)]


def _hold_sql(rule: str, step_s: int, hold_s: int) -> str:
    return (
        f"SELECT '{rule}' AS rule, instance, make_timestamp(b * {step_s}000000) AS window_start, n, hits, c AS condition, "
        f"CASE WHEN c = 1 THEN make_timestamp(s * {step_s}000000) END AS active_since, "
        f"CAST(c = 1 AND (b - s) * {step_s} >= {hold_s} AS INTEGER) AS firing, "
        f"CAST(c = 1 AND (b - s) * {step_s} >= {hold_s} AND (b - s - 1) * {step_s} < {hold_s} AS INTEGER) AS starts_firing, 0 AS resolved "
        f"FROM (SELECT *, min(b) OVER (PARTITION BY instance, c, i) AS s FROM (SELECT *, b - row_number() OVER (PARTITION BY instance, c ORDER BY b) AS i FROM _g{step_s}))\n"
        f"UNION ALL SELECT '{rule}', instance, make_timestamp((b + 1) * {step_s}000000), 0, 0, 0, NULL, 0, 0, 1 "
        f"FROM (SELECT *, lead(b) OVER (PARTITION BY instance ORDER BY b) AS nb FROM _g{step_s}) "
        f"WHERE c = 1 AND (nb > b + 1 OR nb IS NULL AND make_timestamp((b + 2) * {step_s}000000) <= (SELECT wm FROM _wm))")


@register("stream_hold",
          "WITH " + REQ_SQL + ",\n"
          f"_wm AS (SELECT max(ts) - INTERVAL '{BURN_DELAY}' AS wm FROM _req),\n"
          + ",\n".join(
              f"_g{step_s} AS (SELECT instance, epoch_us(ts) // {step_s}000000 AS b, count(*) AS n, CAST(sum(is_5xx) AS BIGINT) AS hits, "
              f"CAST(sum(is_5xx)::DOUBLE / count(*) > {HOLD_LIMIT!r}::DOUBLE AS INTEGER) AS c FROM _req GROUP BY 1, 2 "
              f"HAVING make_timestamp((epoch_us(min(ts)) // {step_s}000000 + 1) * {step_s}000000) <= (SELECT wm FROM _wm))"
              for _, _, _, step_s, _ in HOLDS)
          + "\n" + " UNION ALL ".join(_hold_sql(r, step_s, hold_s) for r, _, _, step_s, hold_s in HOLDS))
def stream_hold(spark, sf):
    """S8 (+ S2, S5): per instance, the 5xx ratio above 0.2 held for two hours of hourly windows, and
    confirmed by two daily windows in a row; the island start lives in keyed state, and silence behind an
    open island resolves it by an event-time timer."""
    base = scratch_dir(spark, "stream_hold")
    ST.write_ordered(spark, V.req(spark, sf).select("ts", "instance", "is_5xx"), "ts", f"{base}/req")
    sch = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("instance", T.LongType()),
                        T.StructField("is_5xx", T.IntegerType())])
    out = None
    for rule, step, hold, _, _ in HOLDS:
        rows = ST.hold_stream(ST.file_stream(spark, f"{base}/req", sch), "instance", "ts", "is_5xx",
                              lambda n, hits: hits / n > HOLD_LIMIT, step, hold, BURN_DELAY)
        got = ST.run_available_now(rows, f"{base}/{rule}", f"{base}/_ckpt_{rule}").select(F.lit(rule).alias("rule"), "*")
        out = got if out is None else out.unionByName(got)
    return present(out)
