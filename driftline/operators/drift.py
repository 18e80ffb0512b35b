"""Distribution drift (H1-H4, H18): quantile edges, PSI, Jensen-Shannon.

All features are handled by one unpivot and one ``groupBy(keys, feature, cell)``
with two conditional counts, so a whole table of features costs one shuffle of
(feature x bin) partial counts, independent of the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.exprs import EPSILON, NULL_TOKEN, count_le, linspace, lit_array

REF, CUR = "reference", "current"


def _num_long(df: DataFrame, numeric: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys..., feature, x double) for the numeric features, nulls kept."""
    if not numeric:
        return None
    d = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in numeric])
    return d.unpivot(list(keys), list(numeric), "feature", "x")


def _cat_long(df: DataFrame, categorical: Sequence[str], keys: Sequence[str]) -> DataFrame:
    if not categorical:
        return None
    d = df.select(*keys, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_TOKEN)).alias(c)
                           for c in categorical])
    return d.unpivot(list(keys), list(categorical), "feature", "cell")


def reference_edges(ref: DataFrame, numeric: Sequence[str], bins: int = 10,
                    keys: Sequence[str] = (), method: str = "exact",
                    accuracy: int = 100000) -> DataFrame:
    """H1: quantile edges of every numeric feature of the reference (per ``keys``).

    Returns ``(keys..., feature, inner array<double>, lo, hi, n_edges, degenerate)``.
    ``inner`` are the interior edges of half-open bins; the outer edges are
    -inf/+inf.  A reference with fewer than two distinct quantiles gets the one
    closed bin ``[min-1, max+1]`` (``lo``/``hi``) and rows outside it are not
    counted.  ``degenerate`` = 1 when at most one bin exists (PSI is then 0 or
    blind).  ``method="exact"`` uses the distributed exact quantiles of
    ``operators.quantile`` (no single-task merge); ``method="approx"`` a
    bounded ``percentile_approx`` sketch.
    """
    qs = linspace(bins)
    if method == "exact":
        from driftline.operators.quantile import exact_quantiles
        ex = exact_quantiles(ref, numeric, qs, keys)
        long = ex.select(*keys, F.struct("feature", "q", "mn", "mx").alias("s"))
    else:
        aggs = []
        for c in numeric:
            x = F.col(c).cast("double")
            q = F.percentile_approx(x, lit_array(qs), accuracy)
            aggs.append(F.struct(F.lit(c).alias("feature"), q.alias("q"),
                                 F.min(x).alias("mn"), F.max(x).alias("mx")).alias(c))
        g = ref.groupBy(*keys).agg(*aggs) if keys else ref.agg(*aggs)
        long = g.select(*keys, F.explode(F.array(*[F.col(c) for c in numeric])).alias("s"))
    e = F.array_sort(F.array_distinct(F.coalesce(F.col("s.q"), F.array().cast("array<double>"))))
    n_e = F.size(e)
    return long.select(
        *keys,
        F.col("s.feature").alias("feature"),
        F.when(n_e >= 2, F.slice(e, 2, F.greatest(n_e - 2, F.lit(0))))
         .otherwise(F.array().cast("array<double>")).alias("inner"),
        F.when(n_e >= 2, F.lit(float("-inf"))).otherwise(F.col("s.mn") - 1).alias("lo"),
        F.when(n_e >= 2, F.lit(float("inf"))).otherwise(F.col("s.mx") + 1).alias("hi"),
        n_e.alias("n_edges"),
        (n_e <= 2).cast("int").alias("degenerate"),
    )


def materialize(df: DataFrame) -> DataFrame:
    """Evaluate a table of keys x features (e.g. edges) once, in the shared checkpoint folder: every later
    use (binning join, flags) reads the rows instead of re-planning the aggregate, however many keys there are."""
    return df.checkpoint()


def cell_rows(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
              keys: Sequence[str], edges: DataFrame | None, edge_keys: Sequence[str] = (),
              max_len: int | None = None) -> DataFrame:
    """One ``(keys..., feature, cell)`` row per (row, feature) value that is counted.

    Numeric values become the index of their bin among ``edges`` (joined on
    ``edge_keys + feature``); categorical values their text (null included)."""
    keys, edge_keys = list(keys), list(edge_keys)
    parts = []
    if numeric:
        nl = _num_long(df, numeric, keys)
        e = F.broadcast(edges) if not edge_keys else edges
        j = nl.join(e, [*edge_keys, "feature"], "inner")
        x = F.col("x")
        inside = x.isNotNull() & (x >= F.col("lo")) & (x <= F.col("hi"))
        parts.append(j.where(inside).select(*keys, "feature",
                                            count_le(F.col("inner"), x, max_len).cast("string").alias("cell")))
    if categorical:
        parts.append(_cat_long(df, categorical, keys).select(*keys, "feature", "cell"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u


def psi_cells(reference: DataFrame, current: DataFrame, numeric: Sequence[str] = (),
              categorical: Sequence[str] = (), keys: Sequence[str] = (),
              edges: DataFrame | None = None, bins: int = 10,
              edge_method: str = "exact") -> DataFrame:
    """H2/H3 counts: ``(keys..., feature, cell, ref_n, cur_n)``.

    Numeric cells are bin indexes (as text) of the reference edges; categorical
    cells are the string values, null included, from both sides (the union of
    categories falls out of the grouping).  One shuffle for all features.
    """
    numeric, categorical, keys = list(numeric), list(categorical), list(keys)
    if numeric and edges is None:
        edges = materialize(reference_edges(reference, numeric, bins, keys, edge_method))
    ml = bins - 1
    u = (cell_rows(reference, numeric, categorical, keys, edges, keys, ml).withColumn("side", F.lit(REF))
         .unionByName(cell_rows(current, numeric, categorical, keys, edges, keys, ml)
                      .withColumn("side", F.lit(CUR))))
    return (u.groupBy(*keys, "feature", "cell")
             .agg(F.count_if(F.col("side") == REF).alias("ref_n"),
                  F.count_if(F.col("side") == CUR).alias("cur_n")))


def psi_vs_reference(reference: DataFrame, current: DataFrame, window_col: str,
                     numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                     bins: int = 10, edge_method: str = "exact") -> DataFrame:
    """PSI of every window of ``current`` against one fixed reference.

    The reference is binned and counted once; its (feature x cell) counts, a
    table bounded by features x bins/levels, are fanned out to the window ids,
    so reference rows are never replicated per window."""
    numeric, categorical = list(numeric), list(categorical)
    edges = materialize(reference_edges(reference, numeric, bins, (), edge_method)) if numeric else None
    ref_cells = (cell_rows(reference, numeric, categorical, (), edges, (), bins - 1)
                 .groupBy("feature", "cell").agg(F.count(F.lit(1)).alias("ref_n")))
    # windows x cells: both sides are counts by then, so the product is the size of the result
    ref_w = ref_cells.crossJoin(current.select(window_col).distinct())
    cur_cells = (cell_rows(current, numeric, categorical, [window_col], edges, (), bins - 1)
                 .groupBy(window_col, "feature", "cell").agg(F.count(F.lit(1)).alias("cur_n")))
    cells = (ref_w.select(window_col, "feature", "cell", "ref_n", F.lit(0).cast("long").alias("cur_n"))
             .unionByName(cur_cells.select(window_col, "feature", "cell",
                                           F.lit(0).cast("long").alias("ref_n"), "cur_n"))
             .groupBy(window_col, "feature", "cell")
             .agg(F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n")))
    res = psi_from_cells(cells, [window_col])
    kind = F.when(F.col("feature").isin(numeric), F.lit("numeric")).otherwise(F.lit("categorical"))
    if numeric:
        res = res.join(F.broadcast(edges.select("feature", "degenerate")), "feature", "left")
    else:
        res = res.withColumn("degenerate", F.lit(0))
    return res.withColumn("kind", kind).withColumn("degenerate", F.coalesce("degenerate", F.lit(0)))


def psi_from_cells(cells: DataFrame, keys: Sequence[str] = (), eps: float = EPSILON) -> DataFrame:
    """H2/H3 + H18: PSI and Jensen-Shannon per ``(keys, feature)`` from cell counts.

    Totals are floored at 1, proportions clipped at ``eps`` (PSI), and the
    Jensen-Shannon divergence (natural log) uses the unclipped proportions.
    """
    keys = list(keys)
    tot = cells.groupBy(*keys, "feature").agg(
        F.sum("ref_n").alias("reference_n"), F.sum("cur_n").alias("current_n"),
        F.count(F.lit(1)).alias("n_cells"))
    j = cells.join(tot, [*keys, "feature"], "inner")
    p = F.col("ref_n") / F.greatest(F.col("reference_n"), F.lit(1))
    q = F.col("cur_n") / F.greatest(F.col("current_n"), F.lit(1))
    pc, qc = F.greatest(p, F.lit(eps)), F.greatest(q, F.lit(eps))
    m = (p + q) / 2

    def kl_term(a: Column) -> Column:
        return F.when(a > 0, a * F.log(a / m)).otherwise(F.lit(0.0))

    j = j.select(*keys, "feature", "reference_n", "current_n", "n_cells",
                 ((qc - pc) * F.log(qc / pc)).alias("_psi"),
                 (0.5 * kl_term(p) + 0.5 * kl_term(q)).alias("_js"))
    return (j.groupBy(*keys, "feature")
             .agg(F.sum("_psi").alias("psi"), F.sum("_js").alias("js_divergence"),
                  F.first("reference_n").alias("reference_n"),
                  F.first("current_n").alias("current_n"),
                  F.first("n_cells").alias("n_cells")))


def psi(reference: DataFrame, current: DataFrame, numeric: Sequence[str] = (),
        categorical: Sequence[str] = (), keys: Sequence[str] = (),
        bins: int = 10, edge_method: str = "exact") -> DataFrame:
    """H2/H3: PSI per feature, with edge metadata (degenerate flag, kind)."""
    numeric, categorical, keys = list(numeric), list(categorical), list(keys)
    edges = materialize(reference_edges(reference, numeric, bins, keys, edge_method)) if numeric else None
    cells = psi_cells(reference, current, numeric, categorical, keys, edges, bins, edge_method)
    res = psi_from_cells(cells, keys)
    kind = F.when(F.col("feature").isin(numeric), F.lit("numeric")).otherwise(F.lit("categorical"))
    if numeric:
        # full: a feature without any value on either side has edges but no cell
        flags = edges.select(*keys, "feature", "degenerate")
        res = res.join(flags, [*keys, "feature"], "full").fillna(
            {"psi": 0.0, "js_divergence": 0.0, "reference_n": 0, "current_n": 0, "n_cells": 0})
    else:
        res = res.withColumn("degenerate", F.lit(None).cast("int"))
    return res.withColumn("kind", kind).withColumn(
        "degenerate", F.coalesce(F.col("degenerate"), F.lit(0)))


def data_drift(psi_df: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """H4: compare each feature's PSI with **its own** threshold (strict ``>``).

    A feature with no threshold is kept with ``status = 'skipped_no_threshold'``
    and ``breaching = 0`` rather than judged against a default.
    """
    t = thresholds.select("feature", F.col("threshold").cast("double").alias("threshold"))
    j = psi_df.join(t, "feature", "left")                      # Spark broadcasts the thresholds while they are small
    return j.select(
        "*",
        F.when(F.col("threshold").isNull(), F.lit("skipped_no_threshold"))
         .otherwise(F.lit("checked")).alias("status"),
        F.coalesce(F.col("psi") > F.col("threshold"), F.lit(False)).cast("int").alias("breaching"),
    )


# -- H5 / H6 / H17 null calibration over adjacent windows ------------------------

def adjacent_pairs(ranked: DataFrame, window_col: str, n_windows: int) -> tuple[DataFrame, DataFrame]:
    """Window i is the reference and window i+1 the current of pair i.

    Each row plays both roles through one generator (no self join): it is the
    current of pair ``w-1`` and the reference of pair ``w``."""
    w = F.col(window_col)
    roles = ranked.withColumn("_role", F.explode(F.array(
        F.struct((w - 1).alias("pair"), F.lit(CUR).alias("side")),
        F.struct(w.alias("pair"), F.lit(REF).alias("side")))))
    roles = roles.select("*", F.col("_role.pair").alias("pair"), F.col("_role.side").alias("_side")) \
                 .drop("_role").where((F.col("pair") >= 0) & (F.col("pair") < n_windows - 1))
    return (roles.where(F.col("_side") == REF).drop("_side"),
            roles.where(F.col("_side") == CUR).drop("_side"))


def null_psi(df: DataFrame, order_cols: Sequence[str], numeric: Sequence[str],
             categorical: Sequence[str], n_windows: int = 20, bins: int = 10,
             min_window_rows: int = 100, edge_method: str = "exact") -> DataFrame:
    """H5 (first half): PSI of every feature for each adjacent pair of ``n_windows``
    equal consecutive windows of the order (remainder dropped).

    Returns the long table ``(pair, feature, psi)``; edges are recomputed per
    reference window."""
    from driftline.operators.order import global_rank, window_id
    n = df.count()
    window_rows = n // n_windows
    if window_rows < min_window_rows:
        raise ValueError(f"{n_windows} windows over {n} rows gives {window_rows} rows each; "
                         f"at least {min_window_rows} are required")
    cols = list(dict.fromkeys([*order_cols, *numeric, *categorical]))
    ranked = global_rank(df.select(*cols), order_cols, "_rank")
    ranked = ranked.withColumn("_w", window_id("_rank", window_rows)).where(F.col("_w") < n_windows)
    # read by the quantile sketch, the slab passes and both binning sides: cut the
    # rank lineage once (reliable checkpoint in spark.checkpoint.dir)
    ranked = ranked.drop("_rank").checkpoint()
    ref, cur = adjacent_pairs(ranked, "_w", n_windows)
    return psi(ref, cur, numeric, categorical, keys=["pair"], bins=bins, edge_method=edge_method)


def calibrate_thresholds(null_long: DataFrame, percentile: float = 0.99,
                         floor: float = 0.10, ceiling: float = 0.25) -> DataFrame:
    """H5 (second half): ``threshold = clip(p99 of the null PSIs, floor, ceiling)``."""
    g = null_long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_comparisons"),
        F.percentile("psi", F.lit(0.5)).alias("median"),
        F.percentile("psi", F.lit(0.9)).alias("p90"),
        F.percentile("psi", F.lit(percentile)).alias("p99"),
        F.max("psi").alias("maximum"))
    p99 = F.col("p99")
    return g.select(
        "*",
        F.greatest(F.least(p99, F.lit(ceiling)), F.lit(floor)).alias("threshold"),
        F.when(p99 < floor, "floor").when(p99 > ceiling, "ceiling").otherwise("none").alias("clamped"))


def calibration_summary(cal: DataFrame) -> DataFrame:
    """H6: features per clamp class (bounded by the number of features)."""
    return cal.groupBy("clamped").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.concat_ws(",", F.array_sort(F.collect_list("feature"))).alias("features"))


def false_alarms(null_long: DataFrame, cal: DataFrame, uniform: float = 0.10) -> DataFrame:
    """Alarms over the null pairs, uniform threshold vs calibrated."""
    j = null_long.join(cal.select("feature", "threshold"), "feature")
    return j.agg(F.count(F.lit(1)).alias("n_checks"),
                 F.count_if(F.col("psi") > uniform).alias("uniform_alarms"),
                 F.count_if(F.col("psi") > F.col("threshold")).alias("calibrated_alarms")) \
            .select("*", (F.col("uniform_alarms") / F.col("n_checks")).alias("uniform_rate"),
                    (F.col("calibrated_alarms") / F.col("n_checks")).alias("calibrated_rate"))


# -- H7 / H8 --------------------------------------------------------------------

def prediction_drift(reference: DataFrame, current: DataFrame, score: str, row_key: Sequence[str],
                     decision_threshold: float, rate_limit: float = 0.25, B: int = 500,
                     level: float = 0.99, seed: int = 42) -> DataFrame:
    """H7: mean score and alert-rate shift; breach = |rate change| > limit or the
    current mean outside the bootstrap CI of the reference mean.

    ``decision_threshold`` must be the model's own threshold (it is required)."""
    from driftline.operators.bootstrap import bootstrap_mean
    if decision_threshold is None:
        raise ValueError("decision_threshold must come from the model")
    s = F.col(score)
    r = reference.agg(F.avg(s).alias("reference_mean"),
                      F.avg((s >= decision_threshold).cast("double")).alias("reference_alert_rate"))
    c = current.agg(F.avg(s).alias("current_mean"),
                    F.avg((s >= decision_threshold).cast("double")).alias("current_alert_rate"))
    ci = bootstrap_mean(reference, score, row_key, B=B, level=level, seed=seed)
    from driftline.functions.exprs import scalars
    rs, cs = scalars(r, "reference_mean", "reference_alert_rate"), scalars(ci, "lower", "upper")
    rm, ra, lo, hi = rs["reference_mean"], rs["reference_alert_rate"], cs["lower"], cs["upper"]
    out = c.select(
        rm.alias("reference_mean"), "current_mean",
        F.when(rm != 0, (F.col("current_mean") - rm) / rm).otherwise(F.lit(0.0)).alias("mean_relative_change"),
        lo.alias("reference_ci_lower"), hi.alias("reference_ci_upper"),
        ra.alias("reference_alert_rate"), "current_alert_rate",
        F.when(ra != 0, (F.col("current_alert_rate") - ra) / ra).otherwise(F.lit(0.0))
         .alias("alert_rate_relative_change"))
    outside = ~((F.col("reference_ci_lower") <= F.col("current_mean")) &
                (F.col("current_mean") <= F.col("reference_ci_upper")))
    return out.select("*", outside.cast("int").alias("mean_outside_reference_ci"),
                      ((F.abs(F.col("alert_rate_relative_change")) > rate_limit) | outside)
                      .cast("int").alias("breaching"))


def label_drift(matured: DataFrame, baseline_pr_auc: float | Column, row_key: Sequence[str],
                label: str = "label", score: str = "score", min_labels: int = 500,
                limit_se: float = 2.0, B: int = 1000, seed: int = 42) -> DataFrame:
    """H8: PR-AUC drop on matured labels, in bootstrap standard errors
    (population std of the replicate APs); needs ``min_labels`` and two classes."""
    from driftline.operators.bootstrap import bootstrap_metrics
    base = matured.select(*row_key, F.col(label).alias("label"), F.col(score).alias("score"))
    bm = bootstrap_metrics(base, row_key, [], B=B, seed=seed, metrics=("pr_auc",))
    stats = base.agg(F.count(F.lit(1)).alias("n_matured"),
                     F.sum("label").alias("n_positive"))
    from driftline.functions.exprs import scalars
    bs = scalars(bm, "point", "se")
    obs, se = bs["point"], bs["se"]
    bl = baseline_pr_auc if isinstance(baseline_pr_auc, Column) else F.lit(float(baseline_pr_auc))
    enough = (F.col("n_matured") >= min_labels) & (F.col("n_positive") > 0) & \
        (F.col("n_positive") < F.col("n_matured"))
    drop = bl - obs
    dse = F.when(se > 0, drop / se).otherwise(F.lit(0.0))
    return stats.select(
        "n_matured", enough.cast("int").alias("sufficient_labels"),
        bl.alias("baseline_pr_auc"),
        F.when(enough, obs).alias("observed_pr_auc"),
        F.when(enough, drop).alias("drop"),
        F.when(enough, se).alias("bootstrap_se"),
        F.when(enough, dse).alias("drop_in_standard_errors"),
        F.coalesce(enough & (dse > limit_se), F.lit(False)).cast("int").alias("breaching"))


# -- H9 window analysis --------------------------------------------------------------

def window_analysis(reference: DataFrame, current: DataFrame, window_col: str, run_id: str, thresholds: DataFrame, *,
                    numeric: Sequence[str], categorical: Sequence[str], score: str, decision_threshold: float,
                    row_key: Sequence[str], reference_hash: Column, hash_col: str, label: str | None = None,
                    baseline_pr_auc: float | Column | None = None, bins: int = 10, min_rows: int = 1000, min_labels: int = 500,
                    rate_limit: float = 0.25, limit_se: float = 2.0, mean_draws: int = 500, mean_level: float = 0.99,
                    label_draws: int = 1000, seed: int = 42) -> DataFrame:
    """H9: one row per ``(run, window)``: data drift against the features' thresholds (H4), prediction drift against the
    reference's bootstrap interval (H7), label drift of the matured rows (H8), whether the window was scored under the
    reference's contract, and a note on small windows.

    A window whose rows do not all carry the reference's contract hash is not comparable: it keeps its figures, and
    none of them counts as a breach. All windows are analysed together, each step grouped by the window."""
    from driftline.functions.exprs import scalars
    from driftline.operators.bootstrap import bootstrap_mean, bootstrap_metrics
    from driftline.operators.order import join_same
    w, s = [window_col], F.col(score)
    alert = (s >= decision_threshold).cast("double")
    known = F.col(label) if label else F.lit(None).cast("int")
    stats = current.groupBy(*w).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count_if(F.col(hash_col).eqNullSafe(reference_hash)) == F.count(F.lit(1))).alias("_same"),
        F.avg(s).alias("mean_score"), F.avg(alert).alias("alert_rate"), F.count(known).alias("n_matured"),
        F.coalesce(F.sum(known), F.lit(0)).alias("n_positive"))
    data = data_drift(psi_vs_reference(reference, current, window_col, numeric, categorical, bins), thresholds).groupBy(*w).agg(
        F.sum("breaching").alias("n_breaching"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("breaching") == 1, F.col("feature"))))).alias("breaching_features"))
    ref = scalars(reference.agg(F.avg(s).alias("m"), F.avg(alert).alias("a")), "m", "a")
    ci = scalars(bootstrap_mean(reference, score, row_key, B=mean_draws, level=mean_level, seed=seed), "lower", "upper")
    out = join_same(stats, data, w, "left")
    if label:
        boot = bootstrap_metrics(current.where(F.col(label).isNotNull()), row_key, w, label, score, label_draws, seed=seed,
                                 metrics=("pr_auc",)).select(*w, F.col("point").alias("_ap"), F.col("se").alias("_se"))
        out = join_same(out, boot, w, "left")
    else:
        out = out.withColumn("_ap", F.lit(None).cast("double")).withColumn("_se", F.lit(None).cast("double"))
    base = baseline_pr_auc if isinstance(baseline_pr_auc, Column) else F.lit(baseline_pr_auc).cast("double")
    enough = (F.col("n_matured") >= min_labels) & (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_matured"))
    drop = F.when(enough, base - F.col("_ap"))
    change = F.when(ref["a"] != 0, (F.col("alert_rate") - ref["a"]) / ref["a"]).otherwise(F.lit(0.0))
    outside = (F.col("mean_score") < ci["lower"]) | (F.col("mean_score") > ci["upper"])
    in_se = F.when(F.col("_se") > 0, drop / F.col("_se")).when(drop.isNotNull(), F.lit(0.0))

    def breach(c: Column) -> Column:
        return (F.col("_same") & F.coalesce(c, F.lit(False))).cast("int")
    note = F.when(~F.col("_same"), F.lit("other contract: not comparable")).when(
        F.col("n_rows") < min_rows, F.lit(f"window below {min_rows} rows: indicative only")).otherwise(F.lit(""))
    return out.select(
        F.lit(run_id).alias("run_id"), window_col, "n_rows", F.col("_same").cast("int").alias("comparable"), note.alias("note"),
        F.coalesce("n_breaching", F.lit(0)).alias("n_breaching"), F.coalesce("breaching_features", F.lit("")).alias("breaching_features"),
        breach(F.col("n_breaching") > 0).alias("data_drift"), "mean_score", "alert_rate", change.alias("alert_rate_change"),
        breach(outside | (F.abs(change) > rate_limit)).alias("prediction_drift"), "n_matured", drop.alias("pr_auc_drop"),
        in_se.alias("drop_in_standard_errors"), breach(in_se > limit_se).alias("label_drift"))


# -- H10 / H11 alert confirmation -------------------------------------------------

def alert_state(window_breaches: DataFrame, window_col: str, count_col: str,
                min_features: int = 3, consecutive: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """A window is confirmed when it and the previous ``consecutive - 1``
    windows each have at least ``min_features`` breaching features.  Rows are
    windows (few per key), so the window function is bounded."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(window_col).rowsBetween(-(consecutive - 1), 0)
    flag = (F.col(count_col) >= min_features).cast("int")
    d = window_breaches.withColumn("_f", flag)
    return d.select(
        "*",
        (F.count(F.lit(1)).over(w) >= consecutive).alias("_full"),
        F.sum("_f").over(w).alias("_nf")).select(
        *[c for c in d.columns if c != "_f"],
        (F.col("_full") & (F.col("_nf") == consecutive)).cast("int").alias("confirmed")).drop("_full", "_nf")


# -- H13-H15 perturbations ----------------------------------------------------------

def poisson_inverse(lam: Column, u: Column, kmax: int = 40) -> Column:
    """Smallest k with Poisson(lam) CDF(k) >= u, for lam up to 5 (beyond ``kmax`` = 40 the tail is below 1e-22)."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-lam).alias("term"), F.exp(-lam).alias("cdf"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * lam / i.cast("double")
        return F.struct((s["k"] + F.when(u > s["cdf"], 1).otherwise(0)).alias("k"), term.alias("term"), (s["cdf"] + term).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(kmax)), start, step, lambda s: s["k"])


def reweight_sample(df: DataFrame, col: str, levels: Sequence[str], weight: float,
                    row_key: Sequence[str], seed: int = 42) -> DataFrame:
    """Weighted resample with replacement, ``levels`` weighted ``weight``.

    Row r is copied Poisson(n * w_r / sum w) times (hash-seeded), which keeps the
    expected size n and the level shares of a weighted draw; no driver loop."""
    w = F.when(F.col(col).isin(list(levels)), F.lit(float(weight))).otherwise(F.lit(1.0))
    tot = df.agg(F.sum(w).alias("sw"), F.count(F.lit(1)).alias("n"))
    from driftline.functions.exprs import scalars
    ts = scalars(tot, "n", "sw")
    lam = w * ts["n"] / ts["sw"]
    d = df.withColumn("_lam", lam).withColumn("_u", hash_uniform_cols(row_key, seed))
    # a large mean is a sum of independent draws of means of at most 5
    parts = F.greatest(F.ceil(F.col("_lam") / 5), F.lit(1))
    rest = F.when(parts > 1, F.sequence(F.lit(1), (parts - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    more = F.aggregate(F.transform(rest, lambda i: hash_uniform_cols([*row_key, i], seed)), F.lit(0),
                       lambda s, u: s + poisson_inverse(F.col("_lam") / parts, u))
    k = poisson_inverse(F.col("_lam") / parts, F.col("_u")) + more
    # one use of the number of copies: a filter on it and a sequence up to it would each draw it anew
    return d.select(*df.columns, F.posexplode(F.array_repeat(F.lit(0), k)).alias("_at", "_0")) \
            .select(*df.columns, (F.col("_at") + 1).alias("copy"))


def hash_uniform_cols(row_key: Sequence[str], seed: int) -> Column:
    from driftline.functions.exprs import hash_uniform
    return hash_uniform(*row_key, seed=seed)


def additive_shift(df: DataFrame, col: str, amount: float, cap: float | None = None) -> DataFrame:
    """``col + amount``, capped."""
    v = F.col(col) + F.lit(amount)
    if cap is not None:
        v = F.least(v, F.lit(cap))
    return df.withColumn(col, v.cast(df.schema[col].dataType))


def collapse(df: DataFrame, col: str, value) -> DataFrame:
    """Every row gets one value."""
    return df.withColumn(col, F.lit(value).cast(df.schema[col].dataType))


#: pluggable perturbations for ``df.transform``
INDUCERS = {"reweight": reweight_sample, "shift": additive_shift, "collapse": collapse}


def label_origin(windows: DataFrame, induced: Column, manipulation: str) -> DataFrame:
    """Every window row says whether its drift is ``real`` or ``induced``
    and carries the manipulation record."""
    return windows.withColumn("drift_origin", F.when(induced, F.lit("induced")).otherwise(F.lit("real"))) \
                  .withColumn("manipulation", F.when(induced, F.lit(manipulation)).otherwise(F.lit("none")))
