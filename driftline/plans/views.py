"""Stand-in views built from the test tables (schema only; no job work here).

* ``pred``  = orders as a prediction log (id, time, score, entity, two dimensions)
* ``outc``  = lineitem as an outcome log (several outcomes per prediction id)
* ``scored``= predictions with their last-written outcome label
* ``req``   = events as a request log
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.exprs import round_half_up
from driftline.sources.tables import load_table

#: outcome tiebreak after the outcome time (lineitem has no unique key)
OUTC_TIEBREAK = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return load_table(spark, sf, name)


def pred(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("prediction_id"),
        F.col("o_orderdate").alias("pred_ts"),
        F.least(F.col("o_totalprice") / F.lit(500000.0), F.lit(1.0)).alias("score"),
        F.col("o_custkey").alias("entity"),
        "o_orderpriority", "o_orderstatus", "o_totalprice",
    )


def outc(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("prediction_id"),
        F.col("l_shipdate").alias("outcome_ts"),
        (F.col("l_returnflag") == "R").cast("int").alias("outcome_label"),
        *OUTC_TIEBREAK,
    )


def req(spark: SparkSession, sf: str) -> DataFrame:
    """events as a request log: path, status code, latency, instance."""
    e = t(spark, sf, "events")
    return e.select(
        "event_id", "ts", "user_id",
        F.col("event_type").alias("endpoint"),
        F.concat(F.lit("/v1/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string")).alias("path"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 201)
         .otherwise(200).alias("status"),
        F.col("value").alias("duration_ms"),
        (F.col("event_type") == "error").cast("int").alias("is_5xx"),
        (F.col("user_id") % 4).alias("instance"),
        "props",
    )


REQ_SQL = ("_req AS (SELECT event_id, ts, user_id, event_type AS endpoint, "
           "'/v1/' || event_type || '/' || CAST(event_id AS VARCHAR) AS path, "
           "CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status, "
           "value AS duration_ms, CAST(event_type = 'error' AS INTEGER) AS is_5xx, user_id % 4 AS instance, props "
           "FROM events)")


def round_doubles(df: DataFrame, dp: int = 6) -> DataFrame:
    """Round every double column (result presentation; oracle does the same)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_up(F.col(f.name), dp).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def ntz(df: DataFrame) -> DataFrame:
    """Timestamps back to ``TIMESTAMP_NTZ`` (the oracle's column type)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def present(df: DataFrame) -> DataFrame:
    return ntz(round_doubles(df))
