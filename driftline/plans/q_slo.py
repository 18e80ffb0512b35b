"""Service-level plans on ``req`` (events as a request log): J1-J21, B15, B16.

The reference evaluates minutes-long ranges on a live service; the request log
here spans 30 days with 1,000-100,000 events, so hours stand in for minutes
(grid step 1 h) and thresholds are scaled to the data; each constant is named.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.exprs import count_lt, status_class
from driftline.operators import clean as C
from driftline.operators import slo as L
from driftline.operators.quantile import grouped_quantiles, with_quantiles
from driftline.plans import sqlgen as S
from driftline.plans import views as V
from driftline.plans.registry import register
from driftline.plans.views import REQ_SQL, present

STEP = 3600
HOUR, DAY = 3600, 86400
PROBE_REGEX = "^/(health|ready|metrics)"
#: route table of the service (templates); error paths stay unmatched
ROUTES = [("click", "/v1/click/{id}"), ("purchase", "/v1/purchase/{id}"),
          ("signup", "/v1/signup/{id}"), ("view", "/v1/view/{id}")]
SLO_TARGET = 0.9855
FAST = dict(long_s=3 * DAY, short_s=6 * HOUR, factor=14.4, hold_s=2 * HOUR, severity="page")
SLOW = dict(long_s=7 * DAY, short_s=1 * DAY, factor=6.0, hold_s=15 * HOUR, severity="ticket")
P99_SLO_S, P99_TICKET_S = 0.485, 0.48
KNEE_PER_HOUR = 20.0
SCORE_SHIFT = 0.25
VALIDATION_K_MAX = 90
HEARTBEAT_GAP_S = 2 * HOUR


def _req(spark, sf):
    r = V.req(spark, sf).where(~F.col("path").rlike(PROBE_REGEX))
    routes = spark.createDataFrame(ROUTES, "route_key string, template string")
    r = C.normalise_routes(r, F.split("path", "/")[2], routes)
    return r.withColumn("status_class", status_class("status"))


_ROUTE_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in ROUTES)
REQ2_SQL = (REQ_SQL + ",\n"
            f"_rq AS (SELECT q.*, coalesce(rt.template, 'unmatched') AS route, "
            "CAST(floor(status / 100) AS BIGINT)::VARCHAR || 'xx' AS status_class, "
            f"epoch_us(ts) // {STEP * 1_000_000} AS b FROM _req q LEFT JOIN (VALUES {_ROUTE_VALUES}) rt(k, template) "
            f"ON string_split(q.path, '/')[3] = rt.k WHERE NOT regexp_matches(q.path, '{PROBE_REGEX}'))")


def grid_sql(name: str, keys: list[str], measures: dict[str, str], src: str = "_rq") -> str:
    """Full grid of 1-hour buckets per key with the measures (zeros when empty)."""
    ks = S.keysel(keys)
    kdist = f"(SELECT DISTINCT {', '.join(keys)} FROM {src}) k, " if keys else ""
    kcols = ", ".join(f"k.{c}" for c in keys) + (", " if keys else "")
    ms = ", ".join(f"{e} AS {n}" for n, e in measures.items())
    using = ", ".join(keys + ["b"])
    fill = ", ".join(f"coalesce(g.{n}, 0) AS {n}" for n in measures)
    return (f"{name}_g AS (SELECT {ks}b, {ms} FROM {src} GROUP BY {ks}b),\n"
            f"{name}_s AS (SELECT unnest(range(min(b), max(b) + 1)) AS b FROM {src}),\n"
            f"{name}_grid AS (SELECT {kcols}s.b FROM {kdist}{name}_s s),\n"
            f"{name} AS (SELECT {S.keysel(keys, 'grid.')}grid.b, {fill}, make_timestamp((grid.b + 1) * {STEP * 1_000_000}) AS t "
            f"FROM {name}_grid grid LEFT JOIN {name}_g g USING ({using}))")


def trail_sql(col: str, keys: list[str], range_s: int) -> str:
    k = max(range_s // STEP, 1)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"sum({col}) OVER ({part}ORDER BY b RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


# ---------------------------------------------------------------- J1, B15, B16

@register("request_rate", "WITH " + REQ2_SQL + ",\n" + grid_sql("_rg", ["route", "status_class"], {"n": "count(*)"}) + "\n"
          f"SELECT route, status_class, t, CAST({trail_sql('n', ['route', 'status_class'], 6 * HOUR)} AS BIGINT) AS n_6h, "
          f"round({trail_sql('n', ['route', 'status_class'], 6 * HOUR)} / {float(6 * HOUR)}, 6) AS rate_per_s FROM _rg")
def request_rate(spark, sf):
    """J1 + J3 + B15 + B16: requests (probes excluded) per normalised route and
    status class (the status mix) over a trailing 6 h window, evaluated hourly;
    empty hours are rows."""
    g = L.grid_series(_req(spark, sf), "ts", STEP, {"n": F.count(F.lit(1))}, ["route", "status_class"])
    g = L.trailing(g, 6 * HOUR, STEP, ["n"], ["route", "status_class"], "_6h")
    return present(g.select("route", "status_class", "t", F.col("n_6h").cast("long"),
                            (F.col("n_6h") / float(6 * HOUR)).alias("rate_per_s")))


# ---------------------------------------------------------------- J2

@register("error_ratio", "WITH " + REQ2_SQL + ",\n" + grid_sql("_eg", [], {"n": "count(*)", "n_5xx": "CAST(sum(is_5xx) AS BIGINT)"}) + ",\n"
          f"_t AS (SELECT t, {trail_sql('n', [], 6 * HOUR)} AS n6, {trail_sql('n_5xx', [], 6 * HOUR)} AS e6 FROM _eg)\n"
          f"SELECT t, CAST(n6 AS BIGINT) AS n_6h, CAST(e6 AS BIGINT) AS n_5xx_6h, "
          f"round((e6 / {float(6 * HOUR)}) / greatest(n6 / {float(6 * HOUR)}, 0.001), 6) AS error_ratio FROM _t")
def error_ratio(spark, sf):
    """5xx / all over a trailing 6 h window, denominator floored at 0.001/s."""
    g = L.grid_series(_req(spark, sf), "ts", STEP, {"n": F.count(F.lit(1)), "n_5xx": F.sum("is_5xx").cast("long")})
    g = L.trailing(g, 6 * HOUR, STEP, ["n", "n_5xx"], [], "_6h")
    secs = float(6 * HOUR)
    return present(g.select("t", F.col("n_6h").cast("long"), F.col("n_5xx_6h").cast("long"),
                            ((F.col("n_5xx_6h") / secs) / F.greatest(F.col("n_6h") / secs, F.lit(0.001)))
                            .alias("error_ratio")))


# ---------------------------------------------------------------- J4, J5

_BOUNDS = S.dlist(L.LATENCY_BUCKETS)
HIST_SQL = (
    REQ2_SQL + ",\n"
    f"_hv AS (SELECT endpoint, epoch_us(ts) // {6 * HOUR * 1_000_000} AS b6, "
    f"len(list_filter({_BOUNDS}, lambda x: x < duration_ms / 1000.0)) AS le_idx FROM _rq),\n"
    "_hc AS (SELECT endpoint, b6, le_idx, count(*) AS cnt FROM _hv GROUP BY ALL),\n"
    f"_hg AS (SELECT k.endpoint, k.b6, r.range AS le_idx FROM (SELECT DISTINCT endpoint, b6 FROM _hv) k, range({len(L.LATENCY_BUCKETS) + 1}) r),\n"
    f"_h AS (SELECT g.endpoint, g.b6, g.le_idx, coalesce(c.cnt, 0) AS count, coalesce({_BOUNDS}[g.le_idx + 1], 'inf'::DOUBLE) AS le "
    "FROM _hg g LEFT JOIN _hc c USING (endpoint, b6, le_idx)),\n"
    "_hcum AS (SELECT *, sum(count) OVER (PARTITION BY endpoint, b6 ORDER BY le_idx ROWS UNBOUNDED PRECEDING) AS cum FROM _h)")


def _hist(spark, sf):
    r = _req(spark, sf).withColumn("b6", L.bucket_of("ts", 6 * HOUR)) \
                       .withColumn("v", F.col("duration_ms") / 1000.0)
    return L.histogram(r, "v", ["endpoint", "b6"])


@register("latency_histogram", "WITH " + HIST_SQL + "\n"
          f"SELECT endpoint, make_timestamp(b6 * {6 * HOUR * 1_000_000}) AS window_start, CAST(le_idx AS INTEGER) AS le_idx, "
          "le, count, CAST(cum AS BIGINT) AS cum FROM _hcum")
def latency_histogram(spark, sf):
    """Cumulative latency histogram (service buckets, seconds) per endpoint
    and 6 h window."""
    h = _hist(spark, sf)
    return present(h.select("endpoint", L.bucket_time("b6", 6 * HOUR).alias("window_start"),
                            F.col("le_idx").cast("int"), "le", "count", F.col("cum").cast("long")))


def hq_sql(src: str, keys: list[str], qs=(0.5, 0.95, 0.99)) -> str:
    """SQL twin of ``histogram_quantiles`` (ends in ``_hq``)."""
    ks = S.keysel(keys)
    part = ", ".join(keys)
    sel = []
    for q in qs:
        tag = int(round(q * 100))
        r = f"{q!r}::DOUBLE * total"
        sel.append(
            f"(SELECT CASE WHEN x.total = 0 THEN NULL WHEN s.le = 'inf'::DOUBLE THEN s.prev_le "
            f"ELSE s.prev_le + (s.le - s.prev_le) * ({r.replace('total', 'x.total')} - s.prev_cum) / (s.cum - s.prev_cum) END "
            f"FROM {src}_x s WHERE " + " AND ".join([f"s.{k} = x.{k}" for k in keys] + [f"s.cum >= {r.replace('total', 'x.total')}"])
            + f" ORDER BY s.le_idx LIMIT 1) AS p{tag}")
    return (f"{src}_x AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY {part} ORDER BY le_idx), 0) AS prev_cum, "
            f"coalesce(lag(le) OVER (PARTITION BY {part} ORDER BY le_idx), 0.0) AS prev_le, "
            f"max(cum) OVER (PARTITION BY {part}) AS total FROM {src}),\n"
            f"_hq AS (SELECT {ks}total, " + ", ".join(sel) + f" FROM (SELECT DISTINCT {ks}total FROM {src}_x) x)")


@register("latency_quantiles", "WITH " + HIST_SQL + ",\n" + hq_sql("_hcum", ["endpoint", "b6"]) + ",\n"
          "_ex AS (SELECT endpoint, b6, quantile_cont(duration_ms / 1000.0, 0.99::DOUBLE) AS exact_p99 FROM "
          f"(SELECT endpoint, duration_ms, epoch_us(ts) // {6 * HOUR * 1_000_000} AS b6 FROM _rq) GROUP BY ALL)\n"
          f"SELECT endpoint, make_timestamp(b6 * {6 * HOUR * 1_000_000}) AS window_start, CAST(total AS BIGINT) AS n, "
          "round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(exact_p99, 6) AS exact_p99 "
          "FROM _hq JOIN _ex USING (endpoint, b6)")
def latency_quantiles(spark, sf):
    """p50 / p95 / p99 interpolated inside histogram buckets per endpoint and
    6 h window, with the exact p99 beside it."""
    h = _hist(spark, sf)
    q = L.histogram_quantiles(h, [0.5, 0.95, 0.99], ["endpoint", "b6"])
    r = _req(spark, sf).withColumn("b6", L.bucket_of("ts", 6 * HOUR))
    ex = grouped_quantiles(r, F.col("duration_ms") / 1000.0, [0.99], ["endpoint", "b6"]).select(
        "endpoint", "b6", F.get("q", F.lit(0)).alias("exact_p99"))
    return present(q.join(ex, ["endpoint", "b6"]).select(
        "endpoint", L.bucket_time("b6", 6 * HOUR).alias("window_start"), F.col("total").cast("long").alias("n"),
        "p50", "p95", "p99", "exact_p99"))


# ---------------------------------------------------------------- J6-J8

def _burn(spark, sf):
    g = L.grid_series(_req(spark, sf), "ts", STEP, {"n": F.count(F.lit(1)), "n_5xx": F.sum("is_5xx").cast("long")})
    outs = []
    for name, r in (("fast_burn", FAST), ("slow_burn", SLOW)):
        b = L.burn_rate(g, "n_5xx", "n", r["long_s"], r["short_s"], STEP, r["factor"], SLO_TARGET)
        b = L.hold(b.withColumn("rule", F.lit(name)), "condition", STEP, r["hold_s"], ["rule"])
        outs.append(b.select("rule", F.lit(r["severity"]).alias("severity"), "t", "_b", "ratio_long",
                             "ratio_short", F.col("condition").cast("int").alias("condition"),
                             "firing", "starts_firing"))
    return outs[0].unionByName(outs[1])


def hold_sql(src: str, keys: list[str], cond: str, hold_s: int) -> str:
    part = ", ".join(keys + [cond])
    return (f"(SELECT *, CAST(coalesce({cond} AND (b - st) * {STEP} >= {hold_s}, false) AS INTEGER) AS firing, "
            f"CAST(coalesce({cond} AND (b - st) * {STEP} >= {hold_s} AND (b - st) * {STEP} - {STEP} < {hold_s}, false) AS INTEGER) AS starts_firing "
            f"FROM (SELECT *, min(b) OVER (PARTITION BY {part}, isl) AS st FROM "
            f"(SELECT *, b - row_number() OVER (PARTITION BY {part} ORDER BY b) AS isl FROM {src})))")


def _burn_rule_sql(name: str, r: dict) -> str:
    lim = r["factor"] * (1 - SLO_TARGET)
    lg, sh = r["long_s"], r["short_s"]
    inner = (f"(SELECT '{name}' AS rule, b, t, "
             f"({trail_sql('n_5xx', [], lg)} / {float(lg)}) / greatest({trail_sql('n', [], lg)} / {float(lg)}, 0.001) AS ratio_long, "
             f"({trail_sql('n_5xx', [], sh)} / {float(sh)}) / greatest({trail_sql('n', [], sh)} / {float(sh)}, 0.001) AS ratio_short "
             "FROM _eg)")
    cond = f"(SELECT *, ratio_long > {lim!r} AND ratio_short > {lim!r} AS cnd FROM {inner})"
    return (f"SELECT rule, '{r['severity']}' AS severity, t, b, ratio_long, ratio_short, CAST(cnd AS INTEGER) AS condition, "
            f"firing, starts_firing FROM {hold_sql(cond, ['rule'], 'cnd', r['hold_s'])}")


BURN_SQL = ("WITH " + REQ2_SQL + ",\n" + grid_sql("_eg", [], {"n": "count(*)", "n_5xx": "CAST(sum(is_5xx) AS BIGINT)"}) + ",\n"
            "_burn AS (" + _burn_rule_sql("fast_burn", FAST) + " UNION ALL " + _burn_rule_sql("slow_burn", SLOW) + ")")


@register("burn_rate_alerts", BURN_SQL + "\nSELECT rule, severity, t, round(ratio_long, 6) AS ratio_long, "
          "round(ratio_short, 6) AS ratio_short, condition, firing, starts_firing FROM _burn")
def burn_rate_alerts(spark, sf):
    """J6 + J7 + J8: multi-window burn rates of the 5xx budget (fast: 3 d and
    6 h over 14.4x budget, held 2 h, page; slow: 7 d and 1 d over 6x, held
    15 h, ticket), evaluated hourly."""
    return present(_burn(spark, sf).drop("_b"))


# ---------------------------------------------------------------- J9

NB = len(L.LATENCY_BUCKETS) + 1


def _p99_rules(spark, sf):
    r = _req(spark, sf)
    arr = F.array(*[F.lit(x) for x in L.LATENCY_BUCKETS])
    r = r.withColumn("le_idx", count_lt(list(L.LATENCY_BUCKETS), F.col("duration_ms") / 1000.0))
    base = r.select("endpoint").distinct().select("endpoint", F.explode(F.sequence(F.lit(0), F.lit(NB - 1))).alias("le_idx"))
    g = L.grid_series(r, "ts", STEP, {"count": F.count(F.lit(1))}, ["endpoint", "le_idx"], base=base)
    g = g.withColumn("le", F.coalesce(F.try_element_at(arr, F.col("le_idx") + 1), F.lit(float("inf"))))
    outs = []
    for name, rng, lim, hold_s, sev in (("latency_p99", 6 * HOUR, P99_SLO_S, 5 * HOUR, "page"),
                                        ("latency_creep", 30 * HOUR, P99_TICKET_S, 30 * HOUR, "ticket")):
        tr = L.trailing(g, rng, STEP, ["count"], ["endpoint", "le_idx"], "_w")
        from pyspark.sql import Window
        w = Window.partitionBy("endpoint", "_b").orderBy("le_idx").rowsBetween(Window.unboundedPreceding, 0)
        h = tr.select("endpoint", "_b", "t", "le_idx", "le", F.col("count_w").alias("count")) \
              .withColumn("cum", F.sum("count").over(w))
        q = L.histogram_quantiles(h, [0.99], ["endpoint", "_b", "t"])
        q = q.withColumn("rule", F.lit(name)).withColumn("cond", F.coalesce(F.col("p99") > lim, F.lit(False)))
        q = L.hold(q, "cond", STEP, hold_s, ["rule", "endpoint"])
        outs.append(q.select("rule", F.lit(sev).alias("severity"), "endpoint", "t", "_b", "p99",
                             F.col("cond").cast("int").alias("condition"), "firing", "starts_firing"))
    return outs[0].unionByName(outs[1])


def _p99_sql() -> str:
    parts = []
    for name, rng, lim, hold_s, sev in (("latency_p99", 6 * HOUR, P99_SLO_S, 5 * HOUR, "page"),
                                        ("latency_creep", 30 * HOUR, P99_TICKET_S, 30 * HOUR, "ticket")):
        tag = name
        parts.append(
            f"_{tag}_h AS (SELECT endpoint, b, t, le_idx, le, {trail_sql('count', ['endpoint', 'le_idx'], rng)} AS cnt FROM _pg),\n"
            f"_{tag}_c AS (SELECT endpoint, b, t, le_idx, le, cnt, sum(cnt) OVER (PARTITION BY endpoint, b ORDER BY le_idx "
            f"ROWS UNBOUNDED PRECEDING) AS cum FROM _{tag}_h),\n"
            f"_{tag}_x AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY endpoint, b ORDER BY le_idx), 0) AS prev_cum, "
            f"coalesce(lag(le) OVER (PARTITION BY endpoint, b ORDER BY le_idx), 0.0) AS prev_le, "
            f"max(cum) OVER (PARTITION BY endpoint, b) AS total FROM _{tag}_c),\n"
            f"_{tag}_f AS (SELECT endpoint, b, any_value(t) AS t, any_value(total) AS total, "
            f"arg_min(CASE WHEN total = 0 THEN NULL WHEN le = 'inf'::DOUBLE THEN prev_le ELSE prev_le + (le - prev_le) * (0.99 * total - prev_cum) / (cum - prev_cum) END, le_idx) "
            f"FILTER (WHERE cum >= 0.99 * total) AS p99 FROM _{tag}_x GROUP BY endpoint, b),\n"
            f"_{tag}_r AS (SELECT '{name}' AS rule, '{sev}' AS severity, endpoint, t, b, CASE WHEN total = 0 THEN NULL ELSE p99 END AS p99, "
            f"coalesce(CASE WHEN total = 0 THEN NULL ELSE p99 END > {lim!r}, false) AS cnd FROM _{tag}_f),\n"
            f"_{tag} AS (SELECT rule, severity, endpoint, t, b, p99, CAST(cnd AS INTEGER) AS condition, firing, starts_firing "
            f"FROM {hold_sql(f'_{tag}_r', ['rule', 'endpoint'], 'cnd', hold_s)})")
    return ",\n".join(parts)


_ARR = S.dlist(L.LATENCY_BUCKETS)
P99_SQL = ("WITH " + REQ2_SQL + ",\n"
           f"_rl AS (SELECT *, len(list_filter({_ARR}, lambda x: x < duration_ms / 1000.0)) AS le_idx FROM _rq),\n"
           "_pg_g AS (SELECT endpoint, le_idx, b, count(*) AS count FROM _rl GROUP BY ALL),\n"
           "_pg_s AS (SELECT unnest(range(min(b), max(b) + 1)) AS b FROM _rl),\n"
           f"_pg_grid AS (SELECT e.endpoint, r.range AS le_idx, s.b FROM (SELECT DISTINCT endpoint FROM _rl) e, range({NB}) r, _pg_s s),\n"
           f"_pg AS (SELECT grid.endpoint, grid.le_idx, grid.b, coalesce(g.count, 0) AS count, make_timestamp((grid.b + 1) * {STEP * 1_000_000}) AS t, "
           f"coalesce({_ARR}[grid.le_idx + 1], 'inf'::DOUBLE) AS le FROM _pg_grid grid LEFT JOIN _pg_g g USING (endpoint, le_idx, b)),\n"
           + _p99_sql() + ",\n_p99 AS (SELECT * FROM _latency_p99 UNION ALL SELECT * FROM _latency_creep)")


@register("sustained_alerts", P99_SQL + "\nSELECT rule, severity, endpoint, t, round(p99, 6) AS p99, condition, firing, starts_firing FROM _p99")
def sustained_alerts(spark, sf):
    """J8 + J9: p99 latency per endpoint from trailing histograms (6 h over
    0.485 s held 5 h, page; 30 h over 0.48 s held 30 h, ticket)."""
    return present(_p99_rules(spark, sf).drop("_b"))


# ---------------------------------------------------------------- J10, J12, J13, J16, J17

SAT_HOLD = 2 * HOUR
SHIFT_HOLD = 1 * HOUR
SPIKE_FACTOR, SPIKE_MIN_PER_H, SPIKE_HOLD = 3.0, 2.0, 0


def _simple_rules(spark, sf):
    r = _req(spark, sf)
    g = L.grid_series(r, "ts", STEP, {"n": F.count(F.lit(1)), "s": F.sum(F.col("duration_ms") / 1000.0)})
    g = L.trailing(g, 1 * HOUR, STEP, ["n"], [], "_1h")
    g = L.trailing(g, 6 * HOUR, STEP, ["n", "s"], [], "_6h")
    g = L.trailing(g, 7 * DAY, STEP, ["n", "s"], [], "_7d")
    lim = 0.8 * KNEE_PER_HOUR
    sat = L.hold(g.withColumn("rule", F.lit("saturation"))
                  .withColumn("value", F.col("n_1h").cast("double"))
                  .withColumn("cond", F.col("n_1h") > lim), "cond", STEP, SAT_HOLD, ["rule"])
    m6 = F.col("s_6h") / F.col("n_6h")
    m7 = F.col("s_7d") / F.col("n_7d")
    rel = F.abs(m6 - m7) / m7
    sh = L.hold(g.withColumn("rule", F.lit("score_shift")).withColumn("value", rel)
                 .withColumn("cond", F.coalesce(rel > SCORE_SHIFT, F.lit(False))), "cond", STEP, SHIFT_HOLD, ["rule"])
    nt = L.hold(g.withColumn("rule", F.lit("no_traffic")).withColumn("value", F.col("n_1h").cast("double"))
                 .withColumn("cond", F.col("n_1h") == 0), "cond", STEP, 1 * HOUR, ["rule"])
    cols = ["rule", "t", "_b", "value", F.col("cond").cast("int").alias("condition"), "firing", "starts_firing"]
    return sat.select(*cols).unionByName(sh.select(*cols)).unionByName(nt.select(*cols))


SIMPLE_SQL = (
    "WITH " + REQ2_SQL + ",\n" + grid_sql("_sg", [], {"n": "count(*)", "s": "sum(duration_ms / 1000.0)"}) + ",\n"
    f"_st AS (SELECT b, t, {trail_sql('n', [], HOUR)} AS n_1h, {trail_sql('n', [], 6 * HOUR)} AS n_6h, "
    f"{trail_sql('s', [], 6 * HOUR)} AS s_6h, {trail_sql('n', [], 7 * DAY)} AS n_7d, {trail_sql('s', [], 7 * DAY)} AS s_7d FROM _sg),\n"
    f"_sat AS (SELECT 'saturation' AS rule, b, t, n_1h::DOUBLE AS value, n_1h > {0.8 * KNEE_PER_HOUR!r} AS cnd FROM _st),\n"
    f"_shf AS (SELECT 'score_shift' AS rule, b, t, abs(s_6h / n_6h - s_7d / n_7d) / (s_7d / n_7d) AS value, "
    f"coalesce(abs(s_6h / n_6h - s_7d / n_7d) / (s_7d / n_7d) > {SCORE_SHIFT!r}, false) AS cnd FROM _st),\n"
    "_ntr AS (SELECT 'no_traffic' AS rule, b, t, n_1h::DOUBLE AS value, n_1h = 0 AS cnd FROM _st),\n"
    "_simple AS (SELECT rule, t, b, value, CAST(cnd AS INTEGER) AS condition, firing, starts_firing FROM "
    + hold_sql("_sat", ["rule"], "cnd", SAT_HOLD) + " UNION ALL SELECT rule, t, b, value, CAST(cnd AS INTEGER), firing, starts_firing FROM "
    + hold_sql("_shf", ["rule"], "cnd", SHIFT_HOLD) + " UNION ALL SELECT rule, t, b, value, CAST(cnd AS INTEGER), firing, starts_firing FROM "
    + hold_sql("_ntr", ["rule"], "cnd", HOUR) + ")")


@register("saturation", SIMPLE_SQL + "\nSELECT t, round(value, 6) AS requests_1h, condition, firing FROM _simple WHERE rule = 'saturation'")
def saturation(spark, sf):
    """Requests in the trailing hour above 80% of the knee (20/h), held 2 h."""
    s = _simple_rules(spark, sf).where(F.col("rule") == "saturation")
    return present(s.select("t", F.col("value").alias("requests_1h"), "condition", "firing"))


@register("score_shift", SIMPLE_SQL + "\nSELECT rule, t, round(value, 6) AS value, condition, firing FROM _simple WHERE rule <> 'saturation'")
def score_shift(spark, sf):
    """J12 + J17: |mean 6 h - mean 7 d| / mean 7 d of the latency score over 0.25
    (held 1 h), and the no-traffic absence rule (zero requests in 1 h, held 1 h)."""
    s = _simple_rules(spark, sf).where(F.col("rule") != "saturation")
    return present(s.select("rule", "t", "value", "condition", "firing"))


def _spike(spark, sf):
    from driftline.operators import validate as VL
    r = _req(spark, sf).withColumn("k", F.from_json("props", "k int")["k"])
    v = VL.validate(r, [VL.FieldRule("k", required=True, dtype="int", ge=0, le=VALIDATION_K_MAX)])
    errs = VL.flatten_errors(v.select("event_id", "ts", "errors"), ["event_id", "ts"])
    g = L.grid_series(errs, "ts", STEP, {"n": F.count(F.lit(1))}, ["field"], span=r)
    g = L.trailing(g, HOUR, STEP, ["n"], ["field"], "_1h")
    g = L.trailing(g, 7 * DAY, STEP, ["n"], ["field"], "_7d")
    short = F.col("n_1h") / 1.0
    long_ = F.col("n_7d") / (7 * DAY / HOUR)
    g = g.withColumn("rule", F.lit("validation_spike")).withColumn("value", short) \
         .withColumn("cond", (short > SPIKE_FACTOR * long_) & (short > SPIKE_MIN_PER_H))
    return L.hold(g, "cond", STEP, SPIKE_HOLD, ["rule", "field"])


@register("validation_spike",
          "WITH " + REQ2_SQL + ",\n"
          f"_ve AS (SELECT 'k' AS field, b FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM _rq) "
          f"WHERE k IS NULL OR k < 0 OR k > {VALIDATION_K_MAX}),\n"
          "_vg_g AS (SELECT field, b, count(*) AS n FROM _ve GROUP BY ALL),\n"
          "_vg_s AS (SELECT unnest(range(min(b), max(b) + 1)) AS b FROM _rq),\n"
          f"_vg AS (SELECT k.field, s.b, coalesce(g.n, 0) AS n, make_timestamp((s.b + 1) * {STEP * 1_000_000}) AS t "
          "FROM (SELECT DISTINCT field FROM _ve) k CROSS JOIN _vg_s s LEFT JOIN _vg_g g ON g.field = k.field AND g.b = s.b),\n"
          f"_vt AS (SELECT field, b, t, {trail_sql('n', ['field'], HOUR)} AS n_1h, {trail_sql('n', ['field'], 7 * DAY)} AS n_7d FROM _vg),\n"
          f"_vc AS (SELECT 'validation_spike' AS rule, *, n_1h / 1.0 AS value, n_1h / 1.0 > {SPIKE_FACTOR!r} * (n_7d / {float(7 * DAY / HOUR)!r}) "
          f"AND n_1h / 1.0 > {SPIKE_MIN_PER_H!r} AS cnd FROM _vt)\n"
          "SELECT field, t, round(value, 6) AS errors_1h, CAST(cnd AS INTEGER) AS condition, firing FROM "
          + hold_sql("_vc", ["rule", "field"], "cnd", SPIKE_HOLD))
def validation_spike(spark, sf):
    """J13 + C1 + C4: validation errors of ``props.k`` (int in 0..90) per field;
    the last hour over 3x the 7-day hourly rate and over 2 per hour."""
    s = _spike(spark, sf)
    return present(s.select("field", "t", F.col("value").alias("errors_1h"),
                            F.col("cond").cast("int").alias("condition"), "firing"))


@register("heartbeat_gap",
          "WITH " + REQ_SQL + ",\n"
          "_hb AS (SELECT instance, ts AS gap_start, lead(ts) OVER (PARTITION BY instance ORDER BY ts, event_id) AS gap_end FROM _req)\n"
          "SELECT instance, gap_start, gap_end, round((epoch_us(gap_end) - epoch_us(gap_start)) / 6e7, 6) AS gap_minutes FROM _hb "
          f"WHERE epoch_us(gap_end) - epoch_us(gap_start) > {HEARTBEAT_GAP_S * 1_000_000}")
def heartbeat_gap(spark, sf):
    """Gaps over 2 h between consecutive requests of an instance (the
    heartbeat), via keyed rank and an equi-join of consecutive ranks."""
    r = V.req(spark, sf).select("instance", "ts", "event_id")
    return present(L.consecutive_gaps(r, "instance", "ts", HEARTBEAT_GAP_S))


# ---------------------------------------------------------------- J11

@register("model_status",
          "WITH " + REQ_SQL + "\nSELECT instance, arg_max(endpoint, (ts, event_id)) AS last_status, max(ts) AS last_ts, "
          "CAST(arg_max(endpoint, (ts, event_id)) = 'error' AS INTEGER) AS serving_fallback FROM _req GROUP BY instance")
def model_status(spark, sf):
    """Last status per instance (the last request's endpoint stands for the
    load status; 'error' = serving from the fallback)."""
    r = V.req(spark, sf)
    g = r.groupBy("instance").agg(F.max_by("endpoint", F.struct("ts", "event_id")).alias("last_status"),
                                  F.max("ts").alias("last_ts"))
    return present(g.withColumn("serving_fallback", (F.col("last_status") == "error").cast("int")))


# ---------------------------------------------------------------- J18-J20

@register("latency_profile",
          "WITH " + REQ2_SQL + ",\n"
          "_d AS (SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n, "
          + ", ".join(f"quantile_cont(duration_ms / 1000.0, {q!r}::DOUBLE) AS p{int(q * 100)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99))
          + ", max(duration_ms / 1000.0) AS max FROM _rq GROUP BY 1)\n"
          "SELECT period, n, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p90, 6) AS p90, round(p95, 6) AS p95, "
          "round(p99, 6) AS p99, round(max, 6) AS max, round(n / 86400.0, 6) AS rps, "
          "CAST(coalesce(n / 86400.0 < lag(n / 86400.0) OVER (ORDER BY period) AND p99 > lag(p99) OVER (ORDER BY period), false) AS INTEGER) "
          "AS knee_candidate FROM _d")
def latency_profile(spark, sf):
    """J18 + J19: per-day latency percentiles, max and request rate; a knee is a
    day whose rate falls while p99 rises."""
    r = _req(spark, sf).withColumn("v", F.col("duration_ms") / 1000.0)
    return present(L.latency_profile(r, F.date_format("ts", "yyyy-MM-dd"), "v", float(DAY)))


@register("slo_derivation",
          "WITH " + REQ2_SQL + ",\n_p AS (SELECT quantile_cont(duration_ms / 1000.0, 0.99::DOUBLE) AS p99, "
          "count(DISTINCT CAST(date_trunc('day', ts) AS DATE)) AS days FROM _rq)\n"
          f"SELECT round(p99, 6) AS p99, round(p99 * 2, 6) AS slo_p99, round(p99 * 1.5, 6) AS ticket_p99, days, "
          f"round((1 - {SLO_TARGET!r}) * days * 1440, 6) AS budget_minutes FROM _p")
def slo_derivation(spark, sf):
    """SLO = 2 x p99, ticket = 1.5 x p99, error budget minutes over the days observed."""
    r = _req(spark, sf)
    g = with_quantiles(r.agg(F.countDistinct(F.to_date("ts")).alias("days")), r, F.col("duration_ms") / 1000.0, {"p99": 0.99})
    return present(g.select("p99", "days", *L.slo_derivation(F.col("p99"), SLO_TARGET, F.col("days"))))


# ---------------------------------------------------------------- J18 model health

MH_THR = 0.35


def _model_health(spark, sf):
    p = V.pred(spark, sf)
    o = V.outc(spark, sf)
    g = L.grid_series(p, "pred_ts", DAY, {"n_pred": F.count(F.lit(1)),
                                          "n_flagged": F.count_if(F.col("score") >= MH_THR),
                                          "score_sum": F.sum("score")})
    g = L.trailing(g, 7 * DAY, DAY, ["n_pred", "score_sum"], [], "_7d")
    oc = L.grid_series(o, "outcome_ts", DAY, {"n_outcomes": F.count(F.lit(1))},
                       span=p.select(F.col("pred_ts").alias("outcome_ts"))).select("_b", "n_outcomes")
    j = g.join(oc, "_b", "left").fillna(0, ["n_outcomes"])
    return j.select("t", "n_pred", "n_flagged", (F.col("n_pred") - F.col("n_flagged")).alias("n_not_flagged"),
                    (F.col("n_flagged") / F.greatest(F.col("n_pred").cast("double"), F.lit(0.001))).alias("flagged_share"),
                    (F.col("score_sum_7d") / F.col("n_pred_7d")).alias("mean_score_7d"), "n_outcomes")


@register("model_health",
          "WITH _p AS (SELECT o_orderdate AS ts, least(o_totalprice / 500000.0::DOUBLE, 1.0::DOUBLE) AS score, "
          f"epoch_us(o_orderdate) // {DAY * 1_000_000} AS b FROM orders),\n"
          f"_o AS (SELECT epoch_us(l_shipdate) // {DAY * 1_000_000} AS b FROM lineitem),\n"
          f"_g AS (SELECT b, count(*) AS n_pred, count(*) FILTER (WHERE score >= {MH_THR}) AS n_flagged, sum(score) AS score_sum FROM _p GROUP BY b),\n"
          "_s AS (SELECT unnest(range(min(b), max(b) + 1)) AS b FROM _p),\n"
          "_oc AS (SELECT b, count(*) AS n_outcomes FROM _o GROUP BY b),\n"
          f"_f AS (SELECT s.b, coalesce(g.n_pred, 0) AS n_pred, coalesce(g.n_flagged, 0) AS n_flagged, coalesce(g.score_sum, 0) AS score_sum, "
          "coalesce(oc.n_outcomes, 0) AS n_outcomes FROM _s s LEFT JOIN _g g USING (b) LEFT JOIN _oc oc USING (b)),\n"
          f"_t AS (SELECT *, sum(n_pred) OVER w AS n7, sum(score_sum) OVER w AS s7 FROM _f WINDOW w AS (ORDER BY b RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))\n"
          f"SELECT make_timestamp((b + 1) * {DAY * 1_000_000}) AS t, n_pred, n_flagged, n_pred - n_flagged AS n_not_flagged, "
          "round(n_flagged / greatest(n_pred::DOUBLE, 0.001), 6) AS flagged_share, round(s7 / n7, 6) AS mean_score_7d, n_outcomes FROM _t")
def model_health(spark, sf):
    """Daily model-health panel on the prediction log: prediction rate,
    flagged share (denominator floored at 0.001), label mix, 7-day mean score
    and outcomes recorded per day (empty days are rows)."""
    return present(_model_health(spark, sf))
