"""Shared-folder tables, files in any store, and text helpers of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One word of a text: anything between the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back: later readers
    neither recompute it nor depend on an executor that may be lost."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(rows: DataFrame, n: int, size: int, seed: int, *keys: str) -> DataFrame:
    """The ``size`` of ``n`` rows whose hash of ``keys`` comes first, whatever the order of the rows.
    Hashes that divide by a share spare the sort most rows and leave it twice ``size`` or more."""
    h = F.xxhash64(F.lit(seed), *keys)
    some = rows.where(F.pmod(h, F.lit(max(1, n // (2 * size)))) == 0)
    return some.orderBy(h, *keys).limit(size)


def file_system(uri: str):
    """``(pyarrow file system, path)`` of a folder or file that all executors share."""
    from pyarrow import fs
    if re.match(r"file:/+", uri):
        uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; a text of ASCII only takes the fast path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_of(df: DataFrame, column: str) -> Column:
    """The column as text, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
