"""Parquet scans of the input tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_timestamps(df: DataFrame) -> DataFrame:
    """Cast ``TIMESTAMP_NTZ`` columns to session-time ``TIMESTAMP`` once, at the scan.

    Watermarks and numeric casts reject NTZ values; with the session zone at UTC
    the wall-clock values are unchanged.
    """
    cols = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            cols.append(F.col(f.name).cast("timestamp").alias(f.name))
            changed = True
        else:
            cols.append(F.col(f.name))
    return df.select(*cols) if changed else df


def load_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet``; optional early projection."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return normalise_timestamps(df)
