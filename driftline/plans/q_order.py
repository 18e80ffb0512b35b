"""Ordering, binning, splits and windows (E1-E17, I8) on events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.exprs import binarise, scalars
from driftline.operators import outcomes as O
from driftline.operators import split as SP
from driftline.operators.order import equal_count_bin, global_rank
from driftline.plans import sqlgen as S
from driftline.plans.registry import register
from driftline.plans.views import present, t

EV_TYPES = ["click", "error", "purchase", "signup", "view"]
OR_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
OR_STATUS = ["F", "O", "P"]


def t_test_sql(rho: str, k: int) -> str:
    """The p-value in closed form, for an even number of degrees of freedom."""
    import math
    dof = k - 2
    r = f"abs({rho})"
    tt = f"({r} * sqrt({float(dof)!r}::DOUBLE / (1.0::DOUBLE - {r} * {r})))"
    theta = f"atan({tt} / {math.sqrt(dof)!r}::DOUBLE)"
    c = f"power(cos({theta}), 2)"
    series, coef = "1.0::DOUBLE", 1.0
    for j in range(1, dof // 2):
        coef *= (2 * j - 1) / (2 * j)
        series = f"({series} + {coef!r}::DOUBLE * power({c}, {j}))"
    p = f"(1.0::DOUBLE - sin({theta}) * {series})"
    return f"(CASE WHEN {r} >= 1.0 THEN 0.0 ELSE greatest({p}, 0.0) END)"


def bin_sql(rn: str, n: str, k: int) -> str:
    return f"CAST(CASE WHEN {n} <= 1 THEN 0 ELSE greatest((({rn} - 1) * {k} + {n} - 2) // ({n} - 1) - 1, 0) END AS INTEGER)"


# ---------------------------------------------------------------- E1


@register("global_rank", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rank FROM events")
def q_global_rank(spark, sf):
    """Position of every event in (ts, event_id) order, computed per bucket
    of approximate-quantile cut points (no single-partition window)."""
    ev = t(spark, sf, "events").select("event_id", "ts")
    return global_rank(ev, ["ts", "event_id"], "rank").select("event_id", "rank")


# ---------------------------------------------------------------- E2, E3

def _ev_signals():
    return {f"type={x}": F.col("event_type") == x for x in EV_TYPES}


def _ev_rates(spark, sf, k):
    ev = t(spark, sf, "events").select("event_id", "ts", "event_type")
    return SP.bin_rates(SP.ranked_bins(ev, ["ts", "event_id"], k), _ev_signals())


def ev_rates_sql(k: int) -> str:
    sig = " UNION ALL ".join(
        f"SELECT 'type={x}' AS signal, bin, avg(CAST(event_type = '{x}' AS INTEGER)::DOUBLE) AS rate FROM _b GROUP BY bin"
        for x in EV_TYPES)
    return ("_r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events),\n"
            f"_b AS (SELECT *, {bin_sql('rn', 'n', k)} AS bin FROM _r),\n"
            f"_rates AS ({sig})")


@register("order_bins", "WITH " + ev_rates_sql(10) + "\nSELECT signal, bin, round(rate, 6) AS rate FROM _rates")
def order_bins(spark, sf):
    """E2 + E3: events in 10 equal-count bins of (ts, event_id) order; share of
    every event type per bin."""
    return present(_ev_rates(spark, sf, 10))


# ---------------------------------------------------------------- E4, E5

def _or_signals():
    s = {f"priority={x}": F.col("o_orderpriority") == x for x in OR_PRIOS}
    s.update({f"status={x}": F.col("o_orderstatus") == x for x in OR_STATUS})
    return s


def _proxy(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    rates = SP.bin_rates(SP.ranked_bins(o, ["o_orderkey"], 10), _or_signals())
    return SP.spearman_trend(rates, 10)


_OR_SIG_SQL = " UNION ALL ".join(
    [f"SELECT 'priority={x}' AS signal, bin, avg(CAST(o_orderpriority = '{x}' AS INTEGER)::DOUBLE) AS rate FROM _b GROUP BY bin"
     for x in OR_PRIOS]
    + [f"SELECT 'status={x}', bin, avg(CAST(o_orderstatus = '{x}' AS INTEGER)::DOUBLE) FROM _b GROUP BY bin"
       for x in OR_STATUS])


@register("proxy_verification",
          "WITH _r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders),\n"
          f"_b AS (SELECT *, {bin_sql('rn', 'n', 10)} AS bin FROM _r),\n"
          f"_rates AS ({_OR_SIG_SQL}),\n"
          "_mr AS (SELECT *, rank() OVER (PARTITION BY signal ORDER BY rate) + (count(*) OVER (PARTITION BY signal, rate) - 1) / 2.0 AS ry FROM _rates),\n"
          "_sp AS (SELECT signal, corr(bin::DOUBLE, ry) AS rho, arg_min(rate, bin) AS first_bin, arg_max(rate, bin) AS last_bin FROM _mr GROUP BY signal),\n"
          f"_pv AS (SELECT *, CASE WHEN rho IS NOT NULL THEN {t_test_sql('rho', 10)} END AS p FROM _sp),\n"
          "_tr AS (SELECT *, CAST(coalesce(abs(rho) > 0.8 AND p < 0.01, false) AS INTEGER) AS trends FROM _pv)\n"
          "SELECT signal, round(rho, 6) AS spearman_rho, round(p, 6) AS p_value, round(first_bin, 6) AS first_bin, "
          "round(last_bin, 6) AS last_bin, trends, CAST(sum(trends) OVER () AS BIGINT) AS n_trending, "
          "CAST(sum(trends) OVER () >= 3 AS INTEGER) AS passed FROM _tr")
def proxy_verification(spark, sf):
    """E4 + E5: does o_orderkey order time?  8 signals (share per priority and
    status) over 10 bins; Spearman rho, p (t, 8 df), verdict (>= 3 trend)."""
    tr = _proxy(spark, sf)
    v = SP.proxy_verdict(tr)
    vs = scalars(v, "n_trending", "passed")
    return present(tr.select("signal", "spearman_rho", "p_value", "first_bin", "last_bin", "trends",
                             vs["n_trending"].alias("n_trending"), vs["passed"].alias("passed")))


def t_test_integral_sql(rho: str, k: int, panels: int = 400) -> str:
    """The p-value for any number of points, by Simpson's rule over the angle whose sine is |rho|."""
    dof = k - 2
    theta = f"asin(abs({rho}))"
    weight = f"(CASE WHEN i = 0 OR i = {2 * panels} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    area = (f"list_sum(list_transform(range({2 * panels + 1}), lambda i: {weight} * power(cos({theta} * i / {2 * panels}.0::DOUBLE), {dof - 1}))) "
            f"* {theta} / {6 * panels}.0::DOUBLE")
    c = f"exp(lgamma({dof + 1} / 2.0::DOUBLE) - lgamma({dof} / 2.0::DOUBLE)) / sqrt(pi())"
    return f"(CASE WHEN abs({rho}) >= 1.0 THEN 0.0 ELSE greatest(1.0::DOUBLE - 2 * {c} * {area}, 0.0) END)"


def _bins_sql(k: int) -> str:
    return (f"SELECT {k} AS n_bins, signal, rho AS spearman_rho, CASE WHEN rho IS NOT NULL THEN {t_test_integral_sql('rho', k)} END AS p_value FROM ("
            f"SELECT signal, corr(bin::DOUBLE, ry) AS rho FROM (SELECT *, rank() OVER (PARTITION BY signal ORDER BY rate) "
            f"+ (count(*) OVER (PARTITION BY signal, rate) - 1) / 2.0 AS ry FROM ({_OR_SIG_SQL.replace('FROM _b', f'FROM _b{k}')})) GROUP BY signal)")


TREND_BINS = (9, 20)


@register("proxy_bins",
          "WITH _r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders),\n"
          + ",\n".join(f"_b{k} AS (SELECT *, {bin_sql('rn', 'n', k)} AS bin FROM _r)" for k in TREND_BINS)
          + "\nSELECT n_bins, signal, round(spearman_rho, 6) AS spearman_rho, round(p_value, 6) AS p_value FROM ("
          + " UNION ALL ".join(_bins_sql(k) for k in TREND_BINS) + ")")
def proxy_bins(spark, sf):
    """The trend test with 9 and with 20 bins (7 and 18 degrees of freedom)."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    out = None
    for k in TREND_BINS:
        rates = SP.bin_rates(SP.ranked_bins(o, ["o_orderkey"], k), _or_signals())
        one = SP.spearman_trend(rates, k).select(F.lit(k).alias("n_bins"), "signal", "spearman_rho", "p_value")
        out = one if out is None else out.unionByName(one)
    return present(out)


# ---------------------------------------------------------------- E6

@register("discontinuity",
          "WITH " + ev_rates_sql(20) + ",\n"
          "_d AS (SELECT signal, bin, rate - lag(rate) OVER (PARTITION BY signal ORDER BY bin) AS delta FROM _rates),\n"
          "_m AS (SELECT signal, arg_min(bin, (delta, bin)) AS mb, min(delta) AS md, sum(abs(delta)) AS sa, count(*) AS nd, "
          "max(bin) AS kb FROM _d WHERE delta IS NOT NULL GROUP BY signal),\n"
          "_t AS (SELECT *, CASE WHEN nd > 1 THEN (sa - abs(md)) / (nd - 1) END AS ty FROM _m)\n"
          "SELECT signal, CAST(mb - 1 AS INTEGER) AS largest_drop_at_bin, round(md * 100, 6) AS largest_drop_pct_points, "
          "round(mb / (kb + 1) * 100, 6) AS percentile_of_ordering, "
          "round(abs(md) / CASE WHEN coalesce(ty, 0.0) = 0 THEN 1e-9 ELSE ty END, 6) AS ratio_to_typical_change FROM _t")
def discontinuity(spark, sf):
    """Sharpest bin-to-bin drop of each event-type share over 20 bins."""
    return present(SP.discontinuity(_ev_rates(spark, sf, 20)))


# ---------------------------------------------------------------- E7-E10, E17, I8

def _orders_ranked(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey",
                                      binarise("o_orderstatus", "F").alias("label"))
    return global_rank(o, ["o_orderkey"], "_rank"), o.select(F.count(F.lit(1))).scalar()


_OR_RANK_SQL = ("_r AS (SELECT o_orderkey, o_custkey, CAST(coalesce(o_orderstatus = 'F', false) AS INTEGER) AS label, "
                "row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)")


@register("censoring_evidence",
          "WITH " + _OR_RANK_SQL + ",\n"
          f"_b AS (SELECT *, {bin_sql('rn', 'n', 20)} AS bin FROM _r),\n"
          "_rt AS (SELECT bin, avg(label::DOUBLE) AS rate FROM _b GROUP BY bin)\n"
          "SELECT round(avg(rate) FILTER (WHERE bin < 16), 6) AS stable_rate, "
          "round(max(rate) FILTER (WHERE bin = 19), 6) AS final_bin_rate, "
          "round(max(rate) FILTER (WHERE bin = 19) / avg(rate) FILTER (WHERE bin < 16) - 1, 6) AS final_bin_relative_drop FROM _rt")
def censoring_evidence(spark, sf):
    """Positive rate (status F) per 20 bins of o_orderkey order; stable mean of
    the first 80% of bins vs the last bin."""
    r, n = _orders_ranked(spark, sf)
    rates = SP.bin_rates(r.withColumn("bin", equal_count_bin("_rank", n, 20)), {"label": F.col("label") == 1})
    return present(SP.censoring_evidence(rates, 20))


_SPLIT_SQL = (
    "_s AS (SELECT *, CASE WHEN rn > floor(n * 0.95::DOUBLE) THEN 'buffer' "
    "WHEN rn <= floor(floor(n * 0.95::DOUBLE) * 0.6::DOUBLE) THEN 'train' "
    "WHEN rn <= floor(floor(n * 0.95::DOUBLE) * 0.6::DOUBLE) + floor(floor(n * 0.95::DOUBLE) * 0.2::DOUBLE) THEN 'val' "
    "ELSE 'test' END AS split FROM _r)")


def _split(spark, sf):
    r, n = _orders_ranked(spark, sf)
    return SP.chronological_split(r, n)


@register("chrono_split",
          "WITH " + _OR_RANK_SQL + ",\n" + _SPLIT_SQL + ",\n"
          "_sum AS (SELECT split, count(*) AS n, min(o_orderkey) AS order_min, max(o_orderkey) AS order_max, "
          "avg(label::DOUBLE) AS positive_rate FROM _s GROUP BY split)\n"
          "SELECT split, n, order_min, order_max, round(positive_rate, 6) AS positive_rate, "
          "(SELECT CAST(max(order_max) FILTER (WHERE split = 'train') < max(order_min) FILTER (WHERE split = 'val') "
          "AND max(order_max) FILTER (WHERE split = 'val') < max(order_min) FILTER (WHERE split = 'test') AS INTEGER) FROM _sum) "
          "AS ranges_disjoint FROM _sum")
def chrono_split(spark, sf):
    """E8 + E9 + E10 + E17: drop the last 5% of o_orderkey order (censoring
    buffer), then 60/20/20 by position; sizes, key bounds, positive rates, and
    the disjoint-range guard."""
    summ = SP.split_summary(_split(spark, sf), "o_orderkey", "label")
    g = SP.split_guards(summ).select("ranges_disjoint").scalar()
    return present(summ.select("*", g.alias("ranges_disjoint")))


@register("entity_overlap",
          "WITH " + _OR_RANK_SQL + ",\n" + _SPLIT_SQL + "\n"
          "SELECT o_custkey, count(DISTINCT split) AS n_splits, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits "
          "FROM _s WHERE split <> 'buffer' GROUP BY o_custkey HAVING count(DISTINCT split) > 1")
def entity_overlap(spark, sf):
    """I8 + E10: customers whose orders fall in more than one split (the guard
    the reference asserts; here reported as rows)."""
    s = _split(spark, sf).where(F.col("split") != "buffer")
    ov = O.entity_overlap(s, "o_custkey", "split")
    return present(ov.select("o_custkey", "n_splits", F.array_join("splits", ",").alias("splits")))


# ---------------------------------------------------------------- E11-E14, E16

K_EQ, SIZE = 20, 600


@register("fixed_windows",
          "WITH _r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events),\n"
          f"_eq AS (SELECT 'equal_k' AS scheme, (rn - 1) // (n // {K_EQ}) AS window_id, ts FROM _r WHERE (rn - 1) // (n // {K_EQ}) < {K_EQ}),\n"
          f"_fx AS (SELECT (rn - 1) // {SIZE} AS window_id, ts FROM _r),\n"
          "_all AS (SELECT * FROM _eq UNION ALL SELECT 'fixed', window_id, ts FROM _fx UNION ALL SELECT 'fixed_keep_half', window_id, ts FROM _fx),\n"
          "_g AS (SELECT scheme, window_id, count(*) AS n, min(ts) AS ts_min, max(ts) AS ts_max FROM _all GROUP BY scheme, window_id)\n"
          "SELECT scheme, window_id, n, ts_min, ts_max, CAST(floor(n * 0.6::DOUBLE) AS BIGINT) AS n_matured FROM _g "
          f"WHERE scheme = 'equal_k' OR (scheme = 'fixed' AND n = {SIZE}) OR (scheme = 'fixed_keep_half' AND n >= {SIZE // 2})")
def fixed_windows(spark, sf):
    """E11 (20 equal windows, remainder dropped), E12 (windows of 600, partial
    tail dropped), E13 (partial tail kept if >= 300 rows), E14 (matured = the
    earliest 60% of each window), E17 (time bounds) on events."""
    ev = t(spark, sf, "events").select("event_id", "ts")
    n = ev.select(F.count(F.lit(1))).scalar()
    r = global_rank(ev, ["ts", "event_id"], "_rank")
    rows = r.select("ts", "_rank", F.explode(F.array(
        F.struct(F.lit("equal_k").alias("scheme"), F.lit(0).alias("size")),
        F.struct(F.lit("fixed").alias("scheme"), F.lit(SIZE).alias("size")),
        F.struct(F.lit("fixed_keep_half").alias("scheme"), F.lit(SIZE).alias("size")))).alias("s"))
    wsize = F.when(F.col("s.scheme") == "equal_k", (F.lit(n) / F.lit(K_EQ)).cast("long")).otherwise(F.col("s.size"))
    rows = rows.select(F.col("s.scheme").alias("scheme"), "ts", "_rank", wsize.alias("_ws"))
    rows = rows.withColumn("window_id", ((F.col("_rank") - 1 - F.pmod(F.col("_rank") - 1, F.col("_ws")))
                                         / F.col("_ws")).cast("long"))
    rows = rows.where((F.col("scheme") != "equal_k") | (F.col("window_id") < K_EQ))
    g = SP.order_bounds(rows, "ts", ["scheme", "window_id"]).withColumnsRenamed({"order_min": "ts_min", "order_max": "ts_max"})
    keep = ((F.col("scheme") == "equal_k") | ((F.col("scheme") == "fixed") & (F.col("n") == SIZE)) |
            ((F.col("scheme") == "fixed_keep_half") & (F.col("n") >= SIZE // 2)))
    return present(g.where(keep).withColumn("n_matured", F.floor(F.col("n") * F.lit(0.6)).cast("long")))


@register("hash_sample",
          "SELECT event_id, ts, event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '|42') LIMIT 500")
def hash_sample(spark, sf):
    """Reproducible sample of 500 events (smallest md5 of id and seed)."""
    ev = t(spark, sf, "events").select("event_id", "ts", "event_type")
    return present(SP.hash_sample(ev, ["event_id"], 500))
