"""Exact dedup with an extendible-hash index kept in shared files (JVM only).

1. Equal texts meet by ``(64-bit key, text)`` in one aggregate: Spark combines copies
   before the shuffle, so a group holding a third of all rows costs one entry per task,
   and two texts with one key stay apart because the grouping compares their bytes.
2. The directory doubles (one more leading key bit each time) until no bucket holds more
   than ``bucket_entries`` entries; a bucket keeps the smallest depth that suits it, so
   only overfull ones split. The whole doubling is one aggregate over entry counts per
   deepest prefix, a table of about 64 rows per bucket.
3. Owner tasks take contiguous key ranges, number each key's chain of colliding texts and
   write the index as Parquet in the shared checkpoint folder, sorted by key.
4. Every row is looked up by key and the SHA-256 of its text, which tells the members of
   a chain apart.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
texts the row with the largest id stays; null ids lose to any id. Rows repeated with the
same id and text cannot be told apart and share one verdict. An empty table gives an empty
result; other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import ascii_lower, shuffle_partitions, text_of, written

BUCKET_ENTRIES = 100_000


def prefix(key: Column, bits: int) -> Column:
    """The ``bits`` leading bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("bigint")


def text_key(text: Column, key_bits: int) -> Column:
    """64-bit hash; fewer ``key_bits`` clear the low ones (to force collisions in tests)."""
    h = F.xxhash64(text)
    return h if key_bits >= 64 else F.shiftleft(prefix(h, key_bits), 64 - key_bits)


def entries_of(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    """One row per distinct text: key, digest, bytes, the id that stays, number of rows."""
    rows = docs.select(docs[id_col].alias("doc_id"), ascii_lower(text_of(docs, text_col)).alias("norm"))
    return (rows.groupBy(text_key(F.col("norm"), key_bits).alias("key"), "norm")
            .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .select("key", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"),
                    "keep_id", "group_size"))


def directory(entries: DataFrame, bucket_entries: int) -> tuple[DataFrame, int]:
    """``(leaf, bucket, depth)`` and the deepest depth: bucket = the first ``depth`` bits of ``leaf``.

    Depth d of a leaf is the number of doublings after which its bucket holds at most
    ``bucket_entries``; a chain longer than that stops at the deepest level.
    """
    n = entries.count()
    deepest = min(40, max(1, math.ceil(math.log2(max(n, 1) / bucket_entries + 1)) + 6))
    leaves = entries.groupBy(prefix(F.col("key"), deepest).alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    levels = leaves.select("leaf", "n", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth")).select(
        "leaf", "n", "depth", F.expr(f"shiftrightunsigned(leaf, {deepest} - depth)").alias("bucket"))
    load = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("load"))
    fits = (levels.join(load, ["depth", "bucket"])
            .where((F.col("load") <= bucket_entries) | (F.col("depth") == deepest))
            .groupBy("leaf").agg(F.min("depth").alias("depth")))
    return fits.select("leaf", "depth", F.expr(f"shiftrightunsigned(leaf, {deepest} - depth)").alias("bucket")), deepest


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                bucket_entries: int = BUCKET_ENTRIES, key_bits: int = 64) -> DataFrame:
    """The index files: (depth, bucket, key, chain, text_sha256, n_bytes, keep_id, group_size)."""
    entries = written(entries_of(docs, id_col, text_col, key_bits), "dedup-entries")
    leaves, deepest = directory(entries, bucket_entries)
    leaves = written(leaves, "dedup-directory")
    placed = entries.withColumn("leaf", prefix(F.col("key"), deepest)).join(leaves, "leaf").drop("leaf")
    # with its sign bit flipped a key sorts in the directory's (unsigned) order
    placed = placed.withColumn("place", F.col("key").bitwiseXOR(F.lit(-2**63)))
    owned = placed.repartitionByRange(shuffle_partitions(docs.sparkSession), "place")
    chain = F.row_number().over(Window.partitionBy("place").orderBy("text_sha256")) - 1
    return written(owned.withColumn("chain", chain).drop("place"), "dedup-index")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                     bucket_entries: int = BUCKET_ENTRIES, key_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, depth, chain."""
    index = build_index(docs, id_col, text_col, bucket_entries=bucket_entries, key_bits=key_bits)
    norm = ascii_lower(text_of(docs, text_col))
    rows = docs.select(docs[id_col].alias("doc_id"), norm.alias("norm")).select(
        "doc_id", text_key(F.col("norm"), key_bits).alias("key"), F.sha2("norm", 256).alias("text_sha256"))
    found = rows.join(index, ["key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        "text_sha256", "bucket", "depth", "chain")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; rows repeated with one id stay once.

    Built from the same index: the one row per text that carries its ``keep_id``.
    """
    index = build_index(docs, id_col, text_col)
    stay = index.select(F.col("keep_id").alias("__dl_keep"), F.col("text_sha256").alias("__dl_same"))
    sha = F.sha2(ascii_lower(text_of(docs, text_col)), 256)
    left = docs.withColumn("__dl_sha", sha).join(
        stay, docs[id_col].eqNullSafe(stay["__dl_keep"]) & (F.col("__dl_sha") == F.col("__dl_same")), "left_semi")
    return left.dropDuplicates([id_col, "__dl_sha"]).drop("__dl_sha")
