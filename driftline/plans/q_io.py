"""Source / sink plans (A1-A12, I1, H9, H12).  Tables written here go to fresh
sub-folders of the session's shared checkpoint folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.exprs import scalars
from driftline.operators import drift as D
from driftline.operators import split as SP
from driftline.operators.order import global_rank
from driftline.plans import sqlgen as S
from driftline.plans import views as V
from driftline.plans.q_eval import EVAL_RATES, REPORT_SQL, _report
from driftline.plans.q_monitor import NULL_SQL, _null_long
from driftline.plans.q_order import _OR_RANK_SQL, _SPLIT_SQL
from driftline.plans.q_profile import _ORDER_COLS, contract_fingerprint
from driftline.plans.registry import ORACLES, register
from driftline.plans.views import present, t
from driftline.session import scratch_dir
from driftline.sources import files as FS

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType())])


@register("csv_scan", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf):
    """A1: customer written once as CSV, read back with the contract schema and
    the default NA tokens mapped to null."""
    path = scratch_dir(spark, "csv_scan")
    FS.write_csv(t(spark, sf, "customer"), path)
    return present(FS.read_csv(spark, path, CUSTOMER_SCHEMA))


# ---------------------------------------------------------------- A5-A7, I1

THR = 0.35
FEATURES = ["o_totalprice", "o_orderpriority", "o_orderstatus"]
#: Log lines are mostly field names: the logs are compressed, in files of so many records that many tasks read them.
LOG_FILES = ("gzip", 500_000)


def _orders_hash(spark, sf) -> str:
    return contract_fingerprint(spark, sf).select("fingerprint").first()[0]


def write_prediction_log(spark, sf, path: str) -> None:
    """Two appends of I1 records (orders before / from 1997) and one truncated line."""
    p = V.pred(spark, sf)
    h = _orders_hash(spark, sf)
    cut = F.lit("1997-01-01").cast("timestamp")
    FS.append_ndjson(FS.prediction_records(p.where(F.col("pred_ts") < cut), ["prediction_id"], "pred_ts", "score",
                                           THR, "orders_price", "1", h, FEATURES), path, *LOG_FILES)
    FS.append_ndjson(FS.prediction_records(p.where(F.col("pred_ts") >= cut), ["prediction_id"], "pred_ts", "score",
                                           THR, "orders_price", "1", h, FEATURES), path, *LOG_FILES)
    spark.createDataFrame([('{"prediction_id": "trunc',)], "value string").write.mode("append").text(path)


_PRED_SQL = ("_p AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority, o_orderstatus, "
             "least(o_totalprice / 500000.0::DOUBLE, 1.0::DOUBLE) AS score FROM orders)")


@register("ndjson_log", "WITH " + _PRED_SQL + "\nSELECT CAST(score >= 0.35 AS INTEGER) AS predicted_label, count(*) AS n, "
          f"round(avg({S.r6('score')}), 6) AS mean_proba, CAST(1 AS BIGINT) AS n_malformed, 1 AS write_failure_alert, "
          "(SELECT count(*) FROM lineitem) AS n_outcomes_logged FROM _p GROUP BY 1")
def ndjson_log(spark, sf):
    """A5 + A6 + A7 + I1 + J14: prediction records appended twice as NDJSON
    plus a truncated line (a failed write); the tolerant reader keeps the valid
    records and counts the malformed one, which raises the write-failure alert;
    outcome records are appended to their own log (never to the predictions)."""
    path = scratch_dir(spark, "prediction_log")
    write_prediction_log(spark, sf, path)
    good, bad = FS.read_ndjson(spark, path, FS.PREDICTION_SCHEMA)
    opath = scratch_dir(spark, "outcome_log")
    o = V.outc(spark, sf)
    FS.append_ndjson(o.select(F.sha2(F.col("prediction_id").cast("string"), 256).alias("prediction_id"),
                              "outcome_label", F.date_format("outcome_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
                              .alias("outcome_timestamp"), F.lit("lineitem").alias("outcome_source"),
                              F.lit(1).alias("schema_version")), opath, *LOG_FILES)
    n_out = FS.read_ndjson(spark, opath, FS.OUTCOME_SCHEMA)[0].select(F.count(F.lit(1))).scalar()
    g = good.groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n"), F.avg("predicted_proba").alias("mean_proba"))
    nm = bad.select("n_malformed").scalar()
    return present(g.withColumn("n_malformed", nm)
                    .withColumn("write_failure_alert", (nm > 0).cast("int"))
                    .withColumn("n_outcomes_logged", n_out))


LIVE_W = 2000
LIVE_REF_CUT = "1997-01-01"


def _live(spark, sf):
    path = scratch_dir(spark, "live_log")
    write_prediction_log(spark, sf, path)
    good, _ = FS.read_ndjson(spark, path, FS.PREDICTION_SCHEMA)
    log = good.select("prediction_id", "timestamp_utc", "feature_schema_hash",
                      F.col("features_raw")["o_totalprice"].cast("double").alias("o_totalprice"),
                      F.col("features_raw")["o_orderpriority"].alias("o_orderpriority"),
                      F.col("features_raw")["o_orderstatus"].alias("o_orderstatus"))
    # counted, cut, bucketed and ranked below: the lines are parsed once
    log = log.withColumn("_ts", F.to_timestamp("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'")).checkpoint()
    n = log.count()
    r = global_rank(log, ["_ts", "prediction_id"], "_r")
    win = r.where(F.col("_r") > n - LIVE_W).checkpoint()          # the newest records; all of a shorter log
    ref = t(spark, sf, "orders").where(F.col("o_orderdate") < F.lit(LIVE_REF_CUT).cast("timestamp"))
    ref_hash = _orders_hash(spark, sf)
    thr = spark.createDataFrame([(f, 0.10) for f in FEATURES], "feature string, threshold double")
    p = D.data_drift(D.psi(ref, win, ["o_totalprice"], ["o_orderpriority", "o_orderstatus"]), thr)
    stored = win.agg(F.max("feature_schema_hash").alias("h"), F.count(F.lit(1)).alias("n"))
    st = scalars(stored, "h", "n")
    comparable = (st["h"] == F.lit(ref_hash)).cast("int")
    wn = st["n"]
    return p.select("feature", "psi", "threshold", "breaching", comparable.alias("comparable"),
                    wn.alias("window_rows"),
                    F.when(wn < 1000, F.lit("window below 1000 rows: indicative only")).otherwise(F.lit(""))
                    .alias("note"))


@register("live_check", "WITH " + _PRED_SQL + ",\n"
          "_lg AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, sha256(CAST(o_orderkey AS VARCHAR))) AS rn, "
          "count(*) OVER () AS n FROM _p),\n"
          f"_win AS (SELECT * FROM _lg WHERE rn > n - {LIVE_W}),\n"
          f"_ref AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{LIVE_REF_CUT}'),\n"
          + S.psi_sql("_ref", "_win", ["o_totalprice"], ["o_orderpriority", "o_orderstatus"]) + "\n"
          "SELECT feature, round(psi, 6) AS psi, 0.1 AS threshold, CAST(psi > 0.1 AS INTEGER) AS breaching, 1 AS comparable, "
          f"(SELECT count(*) FROM _win) AS window_rows, CASE WHEN (SELECT count(*) FROM _win) < 1000 THEN "
          "'window below 1000 rows: indicative only' ELSE '' END AS note FROM _psi")
def live_check(spark, sf):
    """A5 + H9 + H12: the NDJSON log is parsed, its features flattened, and its
    newest 2,000 records (log order; a shorter log whole) are checked against the
    pre-1997 reference; the stored contract hash is kept and compared."""
    return present(_live(spark, sf))


# ---------------------------------------------------------------- A2-A4

@register("frozen_reference", "WITH " + _OR_RANK_SQL + ",\n" + _SPLIT_SQL + "\n"
          "SELECT (SELECT count(*) FROM _s WHERE split = 'train') AS n_rows, "
          "(" + ORACLES["contract_fingerprint"].replace("SELECT canonical, substr", "SELECT substr").replace(
              "AS fingerprint FROM _c", "FROM _c") + ") AS feature_schema_hash, "
          "1 AS second_write_refused, 1 AS missing_split_refused")
def frozen_reference(spark, sf):
    """A2 + A3 + A4: orders split chronologically are written partitioned by
    split; the train split becomes the frozen reference (written once, with its
    contract hash column); a second write and a missing split are refused."""
    base = scratch_dir(spark, "splits")
    o = t(spark, sf, "orders").select(*_ORDER_COLS)
    r, n = global_rank(o, ["o_orderkey"], "_rank"), o.count()
    FS.write_splits(SP.chronological_split(r, n).drop("_rank"), base)
    train = FS.read_split(spark, base, "train").drop("split")
    try:
        FS.read_split(spark, base, "holdout")
        missing = 0
    except FileNotFoundError:
        missing = 1
    ref_path = scratch_dir(spark, "reference")
    h = _orders_hash(spark, sf)
    FS.write_reference(train, ref_path, h)
    try:
        FS.write_reference(train, ref_path, h)
        refused = 0
    except Exception:
        refused = 1
    ref = FS.read_reference(spark, ref_path)
    return ref.agg(F.count(F.lit(1)).alias("n_rows"), F.max("feature_schema_hash").alias("feature_schema_hash")) \
              .select("n_rows", "feature_schema_hash", F.lit(refused).alias("second_write_refused"),
                      F.lit(missing).alias("missing_split_refused"))


# ---------------------------------------------------------------- A10

@register("threshold_store", "WITH " + NULL_SQL + "\nSELECT feature, round(threshold, 6) AS threshold, "
          "'calibrated' AS provenance, 1 AS placeholder_refused FROM _calt")
def threshold_store(spark, sf):
    """A10: calibrated thresholds (H5 on lineitem) written with provenance and
    run id and read back; a store holding a PLACEHOLDER is refused."""
    # a row a feature, written to two stores
    cal = D.calibrate_thresholds(_null_long(spark, sf)).checkpoint()
    path = scratch_dir(spark, "thresholds")
    FS.write_thresholds(cal, path, "run-1")
    bad = scratch_dir(spark, "thresholds_placeholder")
    FS.write_thresholds(cal.limit(1).withColumn("threshold", F.lit(0.5)), bad, "run-0", provenance="PLACEHOLDER")
    try:
        FS.read_thresholds(spark, bad)
        refused = 0
    except ValueError:
        refused = 1
    got = FS.read_thresholds(spark, path, "run-1")
    return present(got.select("feature", "threshold", "provenance", F.lit(refused).alias("placeholder_refused")))


# ---------------------------------------------------------------- A8, A9, A12

_METRICS = ["pr_auc", "roc_auc", "brier"] + EVAL_RATES


@register("metric_rows", REPORT_SQL + ",\n_long AS (" + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, round({m}, 6) AS value FROM _rep_all" for m in _METRICS) + ")\n"
    "SELECT printf('driftline_model_metric{model=\"%s\",metric=\"%s\"} %.6f', model, metric, value) AS line FROM _long "
    "UNION ALL SELECT printf('driftline_baseline_pr_auc{model=\"%s\"} %.6f', 'price_linear', "
    "(SELECT value FROM _long WHERE model = 'price_linear' AND metric = 'pr_auc'))")
def metric_rows(spark, sf):
    """A8 + A9 + A12: candidate metrics as a long (run, model, metric, value)
    table, written as a JSON report, exported as exposition lines, and the
    champion's baseline PR-AUC looked up from the stored table."""
    r = present(_report(spark, sf))
    long = r.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                                for m in _METRICS])).alias("s")).select("model", "s.metric", "s.value")
    path = scratch_dir(spark, "metrics")
    FS.write_report(long, path, "run-1")
    stored = spark.read.json(path)
    lines = FS.metric_lines(stored, "driftline_model_metric", ["model", "metric"], "value")
    base = FS.baseline_metric(stored, "run-1", "price_linear", "pr_auc")
    bl = spark.range(1).select(F.format_string('driftline_baseline_pr_auc{model="%s"} %.6f',
                                               F.lit("price_linear"), base).alias("value"))
    return lines.unionByName(bl).withColumnRenamed("value", "line")


# ---------------------------------------------------------------- A11

@register("manifest_check")
def manifest_check(spark, sf):
    """Copies of region and nation are digested (binary source + sha256)
    and checked against a recorded manifest in which one digest is wrong."""
    base = scratch_dir(spark, "manifest")
    for name in ("region", "nation"):
        t(spark, sf, name).coalesce(1).write.parquet(f"{base}/{name}")
    d = FS.file_digests(spark, f"{base}/*/*.parquet", part=-2).drop("length")
    recorded = d.select("name", F.when(F.col("name") == "nation", F.sha2(F.lit("tampered"), 256))
                        .otherwise(F.col("actual")).alias("expected"))
    return FS.manifest_check(d, recorded)
