"""Exact linear-interpolated quantiles of any number of groups, without a single-task merge.

Spark's exact ``percentile`` merges every distinct value of a group in one task. Here the values are
first collapsed to value counts per group (map-side, so a hot value is a row a task) and laid into
buckets of about equal numbers of distinct values, cut by one bounded sketch over all groups: whatever the
groups' sizes and ranges, a group's part of a bucket is no larger than the bucket. The buckets' counts per
group tell which bucket holds each wanted rank; only those buckets are put in order, each on its own, and
a running count gives the order statistics. The result is the linear interpolation
``(1 - f) * x[lo] + f * x[hi]`` at position ``(n - 1) q``. Nothing but the cut points passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.order import bucketize, cut_points, default_buckets, join_same


def _long(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    d = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return d.unpivot(list(keys), list(cols), "feature", "x")


def grouped_quantiles(df: DataFrame, value: str | Column, qs: Sequence[float], keys: Sequence[str] = (),
                      n_buckets: int | None = None) -> DataFrame:
    """``(keys..., q array<double> in the order of qs, n)`` of the non-null values of every group; without keys always
    one row. A group without a value has no row (without keys: null and 0). NaN counts as the greatest value."""
    keys, qs = list(keys), [float(q) for q in qs]
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    h = df.select(*keys, x.alias("_x")).where("_x is not null").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    cuts = cut_points(h, "_x", n_buckets or default_buckets(df))
    b, _ = bucketize(h, F.col("_x"), len(cuts) + 1, False, cuts=cuts)
    part = [*keys, "_dl_bucket"]
    # a key has as many rows here as there are buckets
    each = Window.partitionBy(*keys)
    totals = b.groupBy(*part).agg(F.sum("_c").alias("_t")).select(
        *part, "_t", (F.sum("_t").over(each.orderBy("_dl_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).alias("_before"),
        F.sum("_t").over(each).alias("_n"))
    position = [(F.col("_n") - 1) * F.lit(q) for q in qs]
    ranks = F.array_distinct(F.array(*[r.cast("long") for p in position for r in (F.floor(p) + 1, F.ceil(p) + 1)]))
    wanted = totals.withColumn("_ranks", F.filter(ranks, lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_t"))))
    wanted = wanted.where(F.size("_ranks") > 0).select(*part, "_before", "_n", "_ranks")
    w = Window.partitionBy(*part).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    hit = join_same(b, wanted, part).select(*keys, "_x", "_c", "_n", "_ranks", (F.col("_before") + F.sum("_c").over(w)).alias("_upto"))
    hit = hit.where(F.exists("_ranks", lambda r: (r <= F.col("_upto")) & (r > F.col("_upto") - F.col("_c"))))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_c")), F.col("_x")))
    aggs = [a for i, p in enumerate(position) for a in (at(F.floor(p) + 1).alias(f"_l{i}"), at(F.ceil(p) + 1).alias(f"_h{i}"))]
    found = (hit.groupBy(*keys) if keys else hit).agg(F.max("_n").alias("_n"), *aggs)
    values = [F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise(
        F.col(f"_l{i}") * (F.ceil(p) - p) + F.col(f"_h{i}") * (p - F.floor(p))) for i, p in enumerate(position)]
    q = F.when(F.col("_n").isNotNull(), F.array(*values))
    return found.select(*keys, q.alias("q"), F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def with_quantiles(table: DataFrame, df: DataFrame, value: str | Column, named: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """``table`` (one row per ``keys``, or one row) with the quantiles ``{column: q}`` of ``df``'s values beside it."""
    q = grouped_quantiles(df, value, list(named.values()), keys).drop("n")
    joined = join_same(table, q, list(keys), "left") if keys else table.join(q)
    return joined.select(*table.columns, *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(named)])


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], keys: Sequence[str] = (),
                    n_buckets: int | None = None) -> DataFrame:
    """``(keys..., feature, q array<double> (in qs order), mn, mx, n)`` per group and column. A group without any
    value keeps its row: null quantiles and ``n`` = 0."""
    keys = list(keys)
    long = _long(df, cols, keys)
    by = [*keys, "feature"]
    ends = long.groupBy(*by).agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    return join_same(ends, grouped_quantiles(long, "x", qs, by, n_buckets), by, "left").select(
        *by, "q", "mn", "mx", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
