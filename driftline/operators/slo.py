"""Service-level time series on an events table.

A Prometheus ``rate(x[range])`` evaluated every ``step`` becomes: (1) one
partial aggregate of events into ``step`` buckets per key, (2) a full grid of
buckets per key (absences are rows with zeros), (3) trailing sums over the
grid with ``rangeBetween``.  Steps 2-3 touch grid points, never events, so
their size is bounded by time span / step x keys whatever the event volume.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.exprs import count_lt, lit_array, scalars
from driftline.operators.quantile import with_quantiles

# Latency histogram bucket upper bounds (seconds) of the service.
LATENCY_BUCKETS = (0.001, 0.0025, 0.005, 0.0075, 0.010, 0.015, 0.020, 0.030, 0.040, 0.050,
                   0.075, 0.100, 0.150, 0.200, 0.250, 0.500, 1.0, 5.0)


def bucket_of(ts: str, step_s: int) -> Column:
    """Index of the ``step_s``-second bucket holding ``ts`` (floor of epoch time)."""
    us = F.unix_micros(F.col(ts))
    st = F.lit(int(step_s) * 1_000_000)
    return ((us - F.pmod(us, st)) / st).cast("long")


def bucket_time(b: str | Column, step_s: int) -> Column:
    bc = F.col(b) if isinstance(b, str) else b
    return F.timestamp_micros(bc * F.lit(int(step_s) * 1_000_000))


def grid_series(df: DataFrame, ts: str, step_s: int, measures: Mapping[str, Column],
                keys: Sequence[str] = (), base: DataFrame | None = None,
                span: DataFrame | None = None) -> DataFrame:
    """Per-key series of ``step_s`` buckets
    from the first to the last bucket of
    ``span`` (default: the table itself); buckets without events carry zeros.
    ``base`` lists the keys (default: the keys seen in the data)."""
    keys = list(keys)
    b = df.withColumn("_b", bucket_of(ts, step_s))
    g = b.groupBy(*keys, "_b").agg(*[m.alias(n) for n, m in measures.items()]) if measures else b.select(*keys, "_b").distinct()
    sp = (span if span is not None else df).select(bucket_of(ts, step_s).alias("_b"))
    bounds = scalars(sp.agg(F.min("_b").alias("lo"), F.max("_b").alias("hi")), "lo", "hi")
    lo, hi = bounds["lo"], bounds["hi"]
    if base is None:
        base = b.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = base.select(*keys, F.explode(F.sequence(lo, hi)).alias("_b"))
    out = grid.join(g, [*keys, "_b"], "left").fillna(0, list(measures)) if measures else grid
    return out.withColumn("t", bucket_time(F.col("_b") + 1, step_s))


def trailing(grid: DataFrame, range_s: int, step_s: int, cols: Sequence[str],
             keys: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """Sums of ``cols`` over the trailing
    ``range_s`` seconds at every grid point (a Prometheus range)."""
    k = max(int(range_s // step_s), 1)
    w = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-(k - 1), 0)
    out = grid
    for c in cols:
        out = out.withColumn(f"{c}{suffix}", F.sum(c).over(w))
    return out


def hold(df: DataFrame, cond: str, step_s: int, hold_s: int, keys: Sequence[str] = ()) -> DataFrame:
    """J8 ``for:`` (used by J6, J7, J9-J17, J21): a condition fires once it has
    been true continuously for ``hold_s`` seconds (gaps and islands over grid
    points per key); ``starts_firing`` marks the onset rows of the alert table."""
    keys = list(keys)
    w = Window.partitionBy(*keys, cond).orderBy("_b")
    d = df.withColumn("_isl", F.col("_b") - F.row_number().over(w))
    wi = Window.partitionBy(*keys, cond, "_isl")
    d = d.withColumn("_start", F.min("_b").over(wi))
    age = (F.col("_b") - F.col("_start")) * step_s
    firing = F.col(cond) & (age >= hold_s)
    first = firing & (age - step_s < hold_s)
    return d.withColumn("firing", F.coalesce(firing, F.lit(False)).cast("int")) \
            .withColumn("starts_firing", F.coalesce(first, F.lit(False)).cast("int")) \
            .withColumn("active_since", F.when(F.col(cond), bucket_time(F.col("_start") + 1, step_s))) \
            .drop("_isl", "_start")


def burn_rate(grid: DataFrame, bad: str, total: str, long_s: int, short_s: int, step_s: int,
              factor: float, target: float, keys: Sequence[str] = ()) -> DataFrame:
    """Error ratio over a long and a short trailing window both above
    ``factor x (1 - target)``; ratio denominators floored at 0.001 per second."""
    g = trailing(grid, long_s, step_s, [bad, total], keys, "_long")
    g = trailing(g, short_s, step_s, [bad, total], keys, "_short")
    lim = factor * (1 - target)

    def ratio(sfx, secs):
        return (F.col(f"{bad}{sfx}") / secs) / F.greatest(F.col(f"{total}{sfx}") / secs, F.lit(0.001))
    g = g.withColumn("ratio_long", ratio("_long", long_s)).withColumn("ratio_short", ratio("_short", short_s))
    return g.withColumn("condition", (F.col("ratio_long") > lim) & (F.col("ratio_short") > lim)) \
            .withColumn("limit", F.lit(lim))


def histogram(df: DataFrame, value_s: str, keys: Sequence[str], bounds: Sequence[float] = LATENCY_BUCKETS
              ) -> DataFrame:
    """Cumulative histogram ``(keys, le_idx, le, count, cum)``; le = first bound
    >= value, the last bucket is +Inf; every bucket present (bounded rows)."""
    keys = list(keys)
    arr = lit_array(bounds)
    idx = count_lt(list(bounds), F.col(value_s))
    g = df.groupBy(*keys, idx.alias("le_idx")).agg(F.count(F.lit(1)).alias("count"))
    nb = len(bounds) + 1
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("le_idx"))
    h = grid.join(g, [*keys, "le_idx"], "left").fillna(0, ["count"])
    h = h.withColumn("le", F.coalesce(F.try_element_at(arr, F.col("le_idx") + 1), F.lit(float("inf"))))
    w = Window.partitionBy(*keys).orderBy("le_idx").rowsBetween(Window.unboundedPreceding, 0)
    return h.withColumn("cum", F.sum("count").over(w))


def histogram_quantiles(hist: DataFrame, qs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Quantile from a cumulative histogram with linear interpolation inside
    the bucket (lower edge of the first bucket is 0; a rank in the +Inf bucket
    returns the largest finite bound)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("le_idx")
    h = hist.withColumn("prev_cum", F.coalesce(F.lag("cum").over(w), F.lit(0))) \
            .withColumn("prev_le", F.coalesce(F.lag("le").over(w), F.lit(0.0))) \
            .withColumn("total", F.max("cum").over(Window.partitionBy(*keys)))
    aggs = []
    for q in qs:
        rank = F.lit(q) * F.col("total")
        pick = F.min_by(F.struct("le_idx", "le", "prev_le", "cum", "prev_cum"),
                        F.when(F.col("cum") >= rank, F.col("le_idx")))
        aggs.append(pick.alias(f"_q{int(round(q * 1000))}"))
    g = h.groupBy(*keys).agg(F.max("total").alias("total"), *aggs)
    out = g
    for q in qs:
        s = F.col(f"_q{int(round(q * 1000))}")
        rank = F.lit(q) * F.col("total")
        interp = s["prev_le"] + (s["le"] - s["prev_le"]) * (rank - s["prev_cum"]) / (s["cum"] - s["prev_cum"])
        val = F.when(F.col("total") == 0, F.lit(None)).when(s["le"] == float("inf"), s["prev_le"]).otherwise(interp)
        out = out.withColumn(f"p{int(round(q * 100))}", val)
    return out.drop(*[f"_q{int(round(q * 1000))}" for q in qs])


def consecutive_gaps(df: DataFrame, key: str, ts: str, min_gap_s: float) -> DataFrame:
    """Gaps longer than ``min_gap_s`` between consecutive events per key.

    Consecutive pairs come from a keyed ``global_rank`` and an equi-join of rank
    r with r + 1 (a hot key is split across buckets; no per-key sort task)."""
    from driftline.operators.order import global_rank
    r = global_rank(df.select(key, ts), [ts], "_r", keys=[key])
    nxt = r.select(key, (F.col("_r") - 1).alias("_r"), F.col(ts).alias("_next"))
    j = r.join(nxt, [key, "_r"], "inner")
    gap = F.unix_micros("_next") - F.unix_micros(ts)
    return j.where(gap > F.lit(min_gap_s * 1e6)).select(
        key, F.col(ts).alias("gap_start"), F.col("_next").alias("gap_end"), (gap / 6e7).alias("gap_minutes"))


def status_series(df: DataFrame, key: str, ts: str, status: str, step_s: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The status of every instance at every grid point, its last one at or before it (null before the
    first). A step's last status is found by a window-group limit (a row a task and step); the
    series itself is bounded by instances x grid points."""
    from driftline.operators.outcomes import top_row
    b = df.select(key, ts, F.col(status).alias("_status"), *tiebreak).withColumn("_b", bucket_of(ts, step_s))
    last = top_row(b, [key, "_b"], [F.col(ts).desc(), *[F.col(c).desc() for c in tiebreak]]).select(key, "_b", "_status")
    grid = grid_series(df, ts, step_s, {}, [key])
    w = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(last, [key, "_b"], "left").withColumn(status, F.last("_status", ignorenulls=True).over(w)).drop("_status")


def latency_profile(df: DataFrame, period: Column, value: str, seconds: float) -> DataFrame:
    """Exact percentiles, max and rate per period; the knee is the first
    period whose rate falls while p99 rises (periods are few rows)."""
    d = df.withColumn("period", period)
    g = with_quantiles(d.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max")), d, value,
                       {f"p{int(q * 100)}": q for q in (0.5, 0.75, 0.9, 0.95, 0.99)}, ["period"])
    g = g.withColumn("rps", F.col("n") / F.lit(float(seconds)))
    w = Window.orderBy("period")
    knee = (F.col("rps") < F.lag("rps").over(w)) & (F.col("p99") > F.lag("p99").over(w))
    return g.withColumn("knee_candidate", F.coalesce(knee, F.lit(False)).cast("int"))


def slo_derivation(p99: Column, target: float, days: Column) -> list[Column]:
    """SLO = 2 x p99, ticket = 1.5 x p99, error budget minutes."""
    return [(p99 * 2).alias("slo_p99"), (p99 * 1.5).alias("ticket_p99"),
            ((1 - target) * days * F.lit(1440)).alias("budget_minutes")]
