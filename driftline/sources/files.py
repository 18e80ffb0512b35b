"""Scans and sinks (A1-A12): CSV, Parquet splits and frozen reference, tolerant
NDJSON logs, reports, metric text, threshold store, file manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.exprs import round_half_up

# The text tokens a CSV reader treats as missing by default
# (pandas' default NA list), in its documented order.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


# -- A1 CSV --------------------------------------------------------------------------

def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """A1: CSV with an explicit schema; every NA token becomes null.

    Spark's ``nullValue`` takes one token, so string columns are read as text
    and mapped with ``isin``; typed columns are parsed after the mapping
    (``try_cast``: an unparsable cell is null, as in a permissive reader)."""
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = spark.read.option("header", True).schema(as_text).csv(path)
    cols = []
    for f in schema.fields:
        c = F.when(F.col(f.name).isin(list(na_tokens)), F.lit(None)).otherwise(F.col(f.name))
        cols.append((c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name))
    return raw.select(*cols)


# -- A2 / A3 / A4 Parquet -------------------------------------------------------------------

def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """A4: one table partitioned by split (partition pruning on read)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    """A2: one split; a split that was never written is an error."""
    df = spark.read.parquet(path).where(F.col(split_col) == split)
    if df.limit(1).count() == 0:
        raise FileNotFoundError(f"split {split!r} missing under {path}")
    return df


def write_reference(df: DataFrame, path: str, contract_hash: str) -> None:
    """A4: the frozen reference is written once (``errorifexists``); the contract
    hash travels as a column, not as frame metadata."""
    df.withColumn("feature_schema_hash", F.lit(contract_hash)).write.mode("errorifexists").parquet(path)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """A3: frozen reference with its contract hash column."""
    return spark.read.parquet(path)


# -- A5 / A6 / A7 NDJSON logs --------------------------------------------------------------------

# The wire format of a prediction log's records, in the order of its fields.
PREDICTION_SCHEMA = T.StructType([
    T.StructField("prediction_id", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("timestamp_utc", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("model_stage", T.StringType()),
    T.StructField("model_source", T.StringType()),
    T.StructField("feature_schema_hash", T.StringType()),
    T.StructField("features_raw", T.MapType(T.StringType(), T.StringType())),
    T.StructField("predicted_proba", T.DoubleType()),
    T.StructField("predicted_label", T.IntegerType()),
    T.StructField("decision_threshold", T.DoubleType()),
    T.StructField("latency_ms_total", T.DoubleType()),
    T.StructField("latency_ms_inference", T.DoubleType()),
    T.StructField("api_version", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("batch_index", T.IntegerType()),
    T.StructField("outcome_label", T.IntegerType()),
    T.StructField("outcome_timestamp", T.StringType()),
    T.StructField("outcome_source", T.StringType()),
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])
OUTCOME_SCHEMA = T.StructType([
    T.StructField("prediction_id", T.StringType()), T.StructField("outcome_label", T.IntegerType()),
    T.StructField("outcome_timestamp", T.StringType()), T.StructField("outcome_source", T.StringType()),
    T.StructField("schema_version", T.IntegerType()),
])
CORRUPT = "_corrupt_record"


def parse_ndjson(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """A5 / S1 parse step on a ``value`` text column: blank lines dropped, each
    line parsed permissively; ``_malformed`` = 1 for lines that did not parse."""
    s = schema.add(CORRUPT, T.StringType()) if CORRUPT not in schema.fieldNames() else schema
    v = lines.where(F.trim("value") != "")
    p = v.select(F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    out = p.select("r.*")
    return out.withColumn("_malformed", F.col(CORRUPT).isNotNull().cast("int")).drop(CORRUPT)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType,
                limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A5: (good records, one-row malformed count).  A missing log is empty."""
    from pyspark.errors import AnalysisException
    try:
        lines = spark.read.text(path)
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    parsed = parse_ndjson(lines, schema)
    good = parsed.where(F.col("_malformed") == 0).drop("_malformed")
    if limit is not None:
        good = good.limit(limit)
    bad = parsed.agg(F.count_if(F.col("_malformed") == 1).alias("n_malformed"))
    return good, bad


def append_ndjson(df: DataFrame, path: str, compression: str = "none", file_records: int = 0) -> None:
    """Append records (one task file per partition; the commit of a
    task stands for one fsync per batch). A compressed file is read by one task: ``file_records`` bounds its records."""
    df.write.mode("append").option("compression", compression).option("maxRecordsPerFile", file_records).json(path)


# -- I1 prediction records -----------------------------------------------------------------------

def prediction_records(scored: DataFrame, key_cols: Sequence[str], ts_col: str, score_col: str,
                       threshold: float, model_name: str, model_version: str, schema_hash: str,
                       feature_cols: Sequence[str], latency_col: str | None = None,
                       batch_col: str | None = None, inference_col: str | None = None,
                       index_col: str | None = None) -> DataFrame:
    """Log records after scoring; the model's own latency and the place in a
    batch are null unless their columns are given.  Replayable ids (sha256 of the key), ISO
    UTC time, label from the **model's** threshold, scores rounded to 6 dp and
    latencies to 3 dp (half-up)."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    lat = F.col(latency_col) if latency_col else F.lit(0.0)
    inference = F.col(inference_col) if inference_col else F.lit(None).cast("double")
    return scored.select(
        F.sha2(key, 256).alias("prediction_id"),
        F.sha2(F.concat(F.lit("req|"), key), 256).substr(1, 32).alias("request_id"),
        F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"),
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
        F.lit("production").alias("model_stage"), F.lit("registry").alias("model_source"),
        F.lit(schema_hash).alias("feature_schema_hash"),
        F.create_map(*[x for c in feature_cols for x in (F.lit(c), F.col(c).cast("string"))]).alias("features_raw"),
        round_half_up(F.col(score_col), 6).alias("predicted_proba"),
        (F.col(score_col) >= F.lit(threshold)).cast("int").alias("predicted_label"),
        round_half_up(F.lit(threshold), 6).alias("decision_threshold"),
        round_half_up(lat, 3).alias("latency_ms_total"), round_half_up(inference, 3).alias("latency_ms_inference"),
        F.lit("v1").alias("api_version"), F.lit("batch").alias("client_id"),
        (F.col(batch_col).cast("string") if batch_col else F.lit(None).cast("string")).alias("batch_id"),
        (F.col(index_col) if index_col else F.lit(None)).cast("int").alias("batch_index"),
        F.lit(None).cast("int").alias("outcome_label"), F.lit(None).cast("string").alias("outcome_timestamp"),
        F.lit(None).cast("string").alias("outcome_source"), F.lit(1).alias("schema_version"),
        F.create_map().cast("map<string,string>").alias("extra"))


# -- A8 / A9 / A12 reports and metrics ----------------------------------------------------------

def write_report(df: DataFrame, path: str, run_id: str, fmt: str = "json") -> None:
    """Result DataFrames become tables keyed by ``run_id``."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").format(fmt).save(path)


def metric_lines(df: DataFrame, metric: str, label_cols: Sequence[str], value_col: str) -> DataFrame:
    """One exposition line per row: ``name{l1="v1",...} value``."""
    def escaped(c: str) -> Column:
        out = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            out = F.replace(out, F.lit(plain), F.lit(code))
        return out
    labels = F.concat_ws(",", *[F.format_string(f'{c}="%s"', escaped(c)) for c in label_cols])
    return df.select(F.format_string(f"{metric}{{%s}} %.6f", labels, F.col(value_col).cast("double")).alias("value"))


def baseline_metric(metrics: DataFrame, run_id: str, model: str, metric: str) -> Column:
    """The champion's baseline value from a metrics table (scalar)."""
    return metrics.where((F.col("run_id") == run_id) & (F.col("model") == model) &
                         (F.col("metric") == metric)).select(F.max("value")).scalar()


# -- A10 threshold store ----------------------------------------------------------------------------

def write_thresholds(df: DataFrame, path: str, run_id: str, provenance: str = "calibrated") -> None:
    df.select("feature", F.col("threshold").cast("double"), F.lit(provenance).alias("provenance"),
              F.lit(run_id).alias("run_id")).write.mode("append").parquet(path)


def read_thresholds(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """A10: per-feature thresholds; a PLACEHOLDER value is refused."""
    t = spark.read.parquet(path)
    if run_id is not None:
        t = t.where(F.col("run_id") == run_id)
    if t.where(F.col("provenance") == "PLACEHOLDER").limit(1).count():
        raise ValueError("threshold store holds PLACEHOLDER values: calibrate before monitoring")
    return t


# -- A11 manifests ----------------------------------------------------------------------------------

def file_digests(spark: SparkSession, path_glob: str, part: int = -1) -> DataFrame:
    """sha256 of every file (binary source, one task per file split), named by the ``part`` of its path
    counted from the end (-1: the file, -2: its folder)."""
    b = spark.read.format("binaryFile").load(path_glob)
    return b.select(F.element_at(F.split("path", "/"), part).alias("name"), F.sha2("content", 256).alias("actual"),
                    "length")


def manifest_check(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Recorded vs actual digests; missing files and mismatches are rows
    with ``ok = 0`` (full outer join on the file name)."""
    j = manifest.join(digests, "name", "full")
    return j.select("name", "expected", "actual",
                    F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).cast("int").alias("ok"))
