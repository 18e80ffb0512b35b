"""Ordering primitives: global rank, prefix sums and rank-derived bins.

``Window.orderBy`` without ``partitionBy`` moves every row into one task, so
these operators never use it on row-level data. Instead:

1. cut points of the leading order column come from ``percentile_approx``
   (one pass, a bounded sketch; the cuts are literals, so every later pass
   assigns the same bucket to a row, even after a task is recomputed);
2. ``Bucketizer`` (binary search on the JVM) assigns a bucket per row;
3. a bucket that is overfull, whether by a hot leading value, by several or because the table is
   large, is split again at quantiles of its own rows, on the first order column (number, time or text)
   that is not the same in all of them, until no bucket is overfull;
4. per-bucket counts / sums give offsets (a table of at most a few thousand
   rows per key), and ``row_number`` / running sums run inside each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.exprs import col_of

_B = "_dl_bucket"
_S = "_dl_sub"
_K = "_dl_key"


def default_buckets(df: DataFrame) -> int:
    try:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always set in practice
        n = 200
    return max(8, min(n, 4096))


def _sortable(c: Column) -> Column:
    """Numeric image of an order key that preserves order (timestamps -> seconds)."""
    return c.cast("double")


def _placed(k: Column, descending: bool) -> Column:
    """The (negated, if descending) numeric key with nulls and NaN where the sort puts them:
    nulls first ascending and last descending, NaN last ascending and first descending."""
    first, last = F.lit(float("-inf")), F.lit(float("inf"))
    return F.when(k.isNull(), last if descending else first).when(F.isnan(k), first if descending else last).otherwise(k)


def cut_points(df: DataFrame, key: str | Column, n_buckets: int, descending: bool = False,
               relative_error: int = 10000) -> list[float]:
    """Approximate quantile cut points of an order key (metadata: ``n_buckets - 1``
    numbers reach the driver, never rows)."""
    k = _sortable(col_of(key))
    if descending:
        k = -k
    fracs = [i / n_buckets for i in range(1, n_buckets)]
    if not fracs:
        return []
    row = df.agg(F.percentile_approx(k, fracs, relative_error).alias("c")).first()
    raw = [float(c) for c in (row["c"] or []) if c is not None and c not in (float("inf"), float("-inf"))]
    cuts = set(raw)
    # a value returned for two or more quantiles holds at least 1/n_buckets of
    # the rows: give it a bucket of its own, [v, nextafter(v)), so that only
    # rows with that exact value share it (and it can be split on a tiebreak)
    for v in {v for v in raw if raw.count(v) > 1}:
        cuts.add(math.nextafter(v, math.inf))
    return sorted(cuts)


def bucketize(df: DataFrame, key: Column, n_buckets: int, descending: bool,
               relative_error: int = 10000, cuts: list[float] | None = None
               ) -> tuple[DataFrame, int]:
    """Add ``_dl_bucket`` from approximate quantile cut points of ``key``."""
    k = _sortable(key)
    if descending:
        k = -k
    if cuts is None:
        cuts = cut_points(df, key, n_buckets, descending, relative_error)
    df = df.withColumn(_K, _placed(k, descending))
    splits = [float("-inf")] + list(cuts) + [float("inf")]
    if len(splits) < 3:
        return df.withColumn(_B, F.lit(0)).drop(_K), 1
    if len(cuts) <= 64:
        # few cuts: a sum of literal comparisons stays inside whole-stage codegen
        from driftline.functions.exprs import count_le
        return df.withColumn(_B, count_le(list(cuts), F.col(_K)).cast("int")).drop(_K), len(splits) - 1
    # many cuts: binary search on the JVM
    out = Bucketizer(splits=splits, inputCol=_K, outputCol=_B,
                     handleInvalid="keep").transform(df)
    return out.withColumn(_B, F.col(_B).cast("int")).drop(_K), len(splits) - 1


def join_same(a: DataFrame, b: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on equal ``names``, nulls being equal (bucket columns hold none); the names of ``a`` stay."""
    renamed = b.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in b.columns])
    on = None
    for c in names:
        same = a[c] == renamed[f"_r_{c}"] if c.startswith((_B, _S)) else a[c].eqNullSafe(renamed[f"_r_{c}"])
        on = same if on is None else on & same
    return a.join(renamed, on, how).drop(*[f"_r_{c}" for c in names])


def _distance(df: DataFrame, column: str, least: Column, shared: Column) -> Column:
    """A number that never decreases along the values of a column inside a bucket: whole numbers and times by
    their distance from the bucket's least value, so that large ones keep their last digits, texts by the six
    bytes behind the bytes that all of the bucket's texts share."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), shared + 1, F.lit(6))), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.TimestampType):
        return (F.unix_micros(c) - F.unix_micros(least)).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return (F.unix_micros(c.cast("timestamp")) - F.unix_micros(least.cast("timestamp"))).cast("double")
    if isinstance(kind, T.IntegralType):
        return (c.cast("decimal(20,0)") - least.cast("decimal(20,0)")).cast("double")
    return _sortable(c)


#: Cuts of one overfull bucket in one pass, and hot buckets up to which their cuts are broadcast.
PASS_CUTS, BROADCAST_BUCKETS = 64, 10_000


def _split_overfull(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], target: int,
                    descending: bool) -> tuple[DataFrame, list[str]]:
    """Cut every bucket of more than ``4 * target`` rows, again and again, until none is left that the order
    columns can still split. Returns the frame and its bucket columns, in order.

    A bucket is cut on the first order column that is not the same in all its rows, at quantiles of its own rows. A cut
    is a value of the bucket and gets a part of its own, with the values between two cuts as further parts, so
    one pass sets apart hot values, several of them too, and any pass makes parts smaller than the bucket."""
    cols, before = [_B], None
    while True:
        group = [*keys, *cols]
        ends = [e for i, c in enumerate(order_cols) for e in (
            F.min(c).alias(f"_mn{i}"), F.max(c).alias(f"_mx{i}"), F.count(c).alias(f"_known{i}"))]
        counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *ends).where(F.col("_n") > 4 * target)
        at = F.lit(None).cast("int")
        for i in reversed(range(len(order_cols))):
            same = (F.col(f"_known{i}") == 0) | ((F.col(f"_known{i}") == F.col("_n")) & (F.col(f"_mn{i}") == F.col(f"_mx{i}")))
            at = F.when(~same, F.lit(i)).otherwise(at)
        over = counts.withColumn("_at", at).where("_at is not null")
        state = over.agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("rows"), F.max("_n").alias("most")).first()
        if not state["n"] or state == before:                 # none left, or values that no number tells apart
            return df, cols
        before = state
        keep = [f for i in range(len(order_cols)) for f in (f"_mn{i}", f"_mx{i}")]
        hot = over.select(*group, "_at", *keep)
        small = state["n"] <= BROADCAST_BUCKETS
        marked = join_same(df, F.broadcast(hot) if small else hot, group, "left")
        x = F.lit(None).cast("double")
        for i, c in enumerate(order_cols):
            shared = F.lit(0)
            if isinstance(df.schema[c].dataType, T.StringType):
                low, high = F.hex(F.encode(F.col(f"_mn{i}"), "utf-8")), F.hex(F.encode(F.col(f"_mx{i}"), "utf-8"))
                # leading bytes that the least and the greatest text share: all between share them
                shared = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(low), F.length(high)), F.lit(2)), F.lit(2)), F.lit(0), lambda n, j: F.when(
                    (n == F.floor(j / 2)) & (F.substring(low, j, F.lit(2)) == F.substring(high, j, F.lit(2))) & (F.length(low) > j) & (F.length(high) > j),
                    n + 1).otherwise(n))
            image = _distance(df, c, F.col(f"_mn{i}"), shared)
            x = F.when(F.col("_at") == i, _placed(-image if descending else image, descending)).otherwise(x)
        marked = marked.withColumn("_x", x)
        fracs = [k / PASS_CUTS for k in range(1, PASS_CUTS)]
        cuts = marked.where("_at is not null").groupBy(*group).agg(F.array_sort(F.array_distinct(
            F.percentile_approx("_x", fracs, 10_000))).alias("_cuts"))
        out = join_same(marked, F.broadcast(cuts) if small else cuts, group, "left")
        part = F.when(F.col("_at").isNull(), F.lit(0)).otherwise(
            F.size(F.filter("_cuts", lambda c: c < F.col("_x"))) + F.size(F.filter("_cuts", lambda c: c <= F.col("_x"))))
        name = f"{_S}{len(cols)}"
        df = out.withColumn(name, part).drop("_at", "_x", "_cuts", *keep)
        cols.append(name)


def _order_exprs(order_cols: Sequence[str], descending: bool) -> list[Column]:
    if descending:
        return [F.col(c).desc_nulls_last() for c in order_cols]
    return [F.col(c).asc_nulls_first() for c in order_cols]


def global_rank(df: DataFrame, order_cols: Sequence[str], rank_col: str = "rank",
                keys: Sequence[str] = (), n_buckets: int | None = None,
                rows_per_bucket: int = 2_000_000, descending: bool = False) -> DataFrame:
    """1-based position of every row in the order ``order_cols`` (within ``keys``).

    ``order_cols`` must give a total order (add tiebreak columns); the leading
    column must be numeric or a timestamp.  However many rows there are, a task orders a bucket of at most
    ``4 * rows_per_bucket`` rows, unless they agree in all order columns.
    """
    order_cols = list(order_cols)
    keys = list(keys)
    nb = n_buckets or default_buckets(df)
    b, _ = bucketize(df, F.col(order_cols[0]), nb, descending)
    b, cols = _split_overfull(b, keys, order_cols, rows_per_bucket, descending)
    counts = b.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("_dl_n"))
    wo = Window.partitionBy(*keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    # offsets table: one row per (key, bucket); AQE broadcasts it when small
    offsets = counts.select(*keys, *cols,
                            F.coalesce(F.sum("_dl_n").over(wo), F.lit(0)).alias("_dl_off"))
    w = Window.partitionBy(*keys, *cols).orderBy(*_order_exprs(order_cols, descending))
    # every bucket has its offset; an inner join would first filter the scan on "bucket is not null", a copy of the
    # order key's expression for each cut and row
    return (join_same(b, offsets, [*keys, *cols], "left")
             .withColumn(rank_col, (F.col("_dl_off") + F.row_number().over(w)).cast("long"))
             .drop(*cols, "_dl_off"))


def prefix_sum(df: DataFrame, order_col: str, value_cols: Sequence[str],
               keys: Sequence[str] = (), descending: bool = False,
               prefix: str = "cum_", n_buckets: int | None = None,
               cuts: list[float] | None = None) -> DataFrame:
    """Running sums of ``value_cols`` in the order of ``order_col`` within ``keys``.

    ``order_col`` must be unique within ``keys`` (collapse ties with ``groupBy``
    first, which also makes tie handling exact).  Sums are inclusive.
    """
    keys = list(keys)
    nb = n_buckets or default_buckets(df)
    b, _ = bucketize(df, F.col(order_col), nb, descending, cuts=cuts)
    tot = b.groupBy(*keys, _B).agg(*[F.sum(c).alias(f"_dl_t_{c}") for c in value_cols])
    wo = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select(*keys, _B, *[
        F.coalesce(F.sum(f"_dl_t_{c}").over(wo), F.lit(0)).alias(f"_dl_o_{c}")
        for c in value_cols])
    oc = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = (Window.partitionBy(*keys, _B).orderBy(oc)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = join_same(b, offsets, [*keys, _B], "left")    # as in global_rank
    for c in value_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_dl_o_{c}") + F.sum(c).over(w))
    return out.drop(_B, *[f"_dl_o_{c}" for c in value_cols])


def int_div(a: Column, b: Column) -> Column:
    """Exact floor division of non-negative longs (no double rounding)."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def equal_count_bin(rank: str | Column, n: str | Column, k: int) -> Column:
    """Bin of a 1-based rank in ``k`` equal-count bins (quantile cut of ranks).

    ``max(ceil((rank-1)*k/(n-1)) - 1, 0)`` in integer arithmetic; not ``ntile``.
    """
    r = col_of(rank).cast("long")
    nn = (F.lit(n) if isinstance(n, int) else col_of(n)).cast("long")
    num = (r - 1) * F.lit(k) + nn - 2
    v = F.when(nn <= 1, F.lit(0)).otherwise(
        F.greatest(int_div(num, nn - 1) - 1, F.lit(0)))
    return v.cast("int")


def window_id(rank: str | Column, window_rows: int) -> Column:
    """0-based id of consecutive fixed-size windows over a 1-based
    rank (the caller keeps complete windows, E12, or partial ones above a size,
    E13)."""
    return int_div(col_of(rank).cast("long") - 1, F.lit(window_rows).cast("long"))
