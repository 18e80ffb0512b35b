"""Binary-classification metrics (F1-F7, F11-F18), grouped by arbitrary keys.

Every function takes ``(df, keys, label, score, weight)``: the overall,
per-subgroup, per-window and bootstrap-replicate variants are the same code
with different keys (``weight`` carries bootstrap multiplicities).  Curves
collapse to one row per distinct score first (ties exact by construction) and
then use the distributed ``prefix_sum`` -- there is no global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.exprs import (NULL_TOKEN, col_of, count_lt, linspace, lit_array,
                                      round_half_up, safe_div, scalars)
from driftline.operators.order import cut_points, prefix_sum


def _w(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1)


def _wsum(cond: Column, weight: str | None) -> Column:
    if weight:
        return F.sum(F.when(cond, F.col(weight)).otherwise(F.lit(0)))
    return F.count_if(cond)


# -- F1 / F2 ---------------------------------------------------------------

def confusion(df: DataFrame, threshold: float | str | Column, keys: Sequence[str] = (),
              label: str = "label", score: str = "score", weight: str | None = None) -> DataFrame:
    """F1 + F2 at ``score >= threshold`` (a number, or a per-row column such as
    the model's own threshold).  Zero divisions give 0; lift is rounded to 3 dp."""
    keys = list(keys)
    thr = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else col_of(threshold)
    y = F.col(label) == 1
    p = F.col(score) >= thr
    g = df.groupBy(*keys).agg(
        _wsum(F.lit(True), weight).alias("n"),
        _wsum(y, weight).alias("n_positive"),
        _wsum(y & p, weight).alias("tp"),
        _wsum(~y & p, weight).alias("fp"),
        _wsum(~y & ~p, weight).alias("tn"),
        _wsum(y & ~p, weight).alias("fn"),
    )
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    prec = safe_div(tp, tp + fp)
    prev = safe_div(F.col("n_positive"), n)
    return g.select(
        "*",
        prev.alias("prevalence"),
        prec.alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_div(tn, tn + fp).alias("specificity"),
        safe_div(tp + tn, n).alias("accuracy"),
        safe_div(tp + fp, n).alias("flagged_rate"),
        F.when(prev > 0, round_half_up(prec / prev, 3)).otherwise(F.lit(0.0)).alias("lift"),
    )


# -- F3 curve and the rank metrics built on it -------------------------------

def score_curve(df: DataFrame, keys: Sequence[str] = (), label: str = "label",
                score: str = "score", weight: str | None = None,
                cuts: list[float] | None = None, with_sq_error: bool = False,
                materialize: bool = False) -> DataFrame:
    """one row per ``(keys, distinct score)`` in descending score order.

    Columns: ``pos, neg`` at the score, cumulative ``cum_pos, cum_neg`` over
    scores >= it, group totals ``total_pos, total_neg`` and the curve point
    ``precision, recall`` (threshold = score).
    """
    keys = list(keys)
    w = _w(weight)
    y = F.col(label) == 1
    extra = ([(F.sum(w * F.pow(F.col(score) - F.col(label), 2))).alias("sq_err")]
             if with_sq_error else [])
    pts = df.groupBy(*keys, score).agg(
        F.sum(F.when(y, w).otherwise(F.lit(0))).alias("pos"),
        F.sum(F.when(~y, w).otherwise(F.lit(0))).alias("neg"), *extra)
    if materialize:
        # the per-score sums feed the bucket totals, the offsets and the running
        # sums: cut the lineage once instead of re-deriving them per branch
        pts = pts.checkpoint()
    if cuts is None:
        cuts = cut_points(df, score, _nb(df), descending=True)
    cum = prefix_sum(pts, score, ["pos", "neg"], keys, descending=True, cuts=cuts)
    tot = pts.groupBy(*keys).agg(F.sum("pos").alias("total_pos"), F.sum("neg").alias("total_neg"))
    if keys:
        j = cum.join(tot, keys, "inner")
    else:  # scalar subqueries: computed once, one value each
        ts = scalars(tot, "total_pos", "total_neg")
        j = cum.select("*", ts["total_pos"].alias("total_pos"), ts["total_neg"].alias("total_neg"))
    return j.select(
        "*",
        safe_div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.when(F.col("total_pos") > 0, F.col("cum_pos") / F.col("total_pos"))
         .otherwise(F.lit(1.0)).alias("recall"),
    )


def _nb(df: DataFrame) -> int:
    try:
        return max(8, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4096))
    except Exception:  # pragma: no cover
        return 200


def rank_metrics(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """F5 + F6 from a curve: average precision (step sum, ties grouped) and
    ROC-AUC (ties count one half).  Null when a class is absent.  A curve built
    ``with_sq_error`` also yields the (weighted) Brier score in the same pass."""
    keys = list(keys)
    P, N = F.first("total_pos"), F.first("total_neg")
    extra = [F.sum("sq_err").alias("_sq")] if "sq_err" in curve.columns else []
    g = curve.groupBy(*keys).agg(
        F.sum(F.col("pos") * F.col("precision")).alias("_ap_num"),
        F.sum(F.col("pos") * (F.col("total_neg") - F.col("cum_neg") + 0.5 * F.col("neg"))).alias("_auc_num"),
        P.alias("total_pos"), N.alias("total_neg"), *extra)
    pos_ok = F.col("total_pos") > 0
    both = pos_ok & (F.col("total_neg") > 0)
    out = [F.when(pos_ok, F.col("_ap_num") / F.col("total_pos")).alias("average_precision"),
           F.when(both, F.col("_auc_num") / (F.col("total_pos") * F.col("total_neg"))).alias("roc_auc")]
    if extra:
        out.append((F.col("_sq") / (F.col("total_pos") + F.col("total_neg"))).alias("brier"))
    return g.select(*keys, "total_pos", "total_neg", *out)


def brier(df: DataFrame, keys: Sequence[str] = (), label: str = "label",
          score: str = "score", weight: str | None = None) -> DataFrame:
    """mean squared difference of score and label."""
    keys = list(keys)
    w = _w(weight)
    e = F.pow(F.col(score) - F.col(label), 2)
    return df.groupBy(*keys).agg((F.sum(w * e) / F.sum(w)).alias("brier"))


def choose_threshold(curve: DataFrame, target_recall: float, keys: Sequence[str] = ()) -> DataFrame:
    """highest precision among thresholds with recall >= target; ties go to
    the lowest threshold.  Unreachable target: best F1 (``target_met = 0``)."""
    keys = list(keys)
    ok = F.col("recall") >= F.lit(target_recall)
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(
        F.col("precision") + F.col("recall"), F.lit(1e-12))
    c = curve.withColumn("_ok", ok).withColumn("_f1", f1)
    g = c.groupBy(*keys).agg(
        F.max_by(F.struct(F.col("score").alias("t"), "precision", "recall"),
                 F.when(F.col("_ok"), F.struct("precision", (-F.col("score")).alias("ns")))).alias("best"),
        F.max_by(F.struct(F.col("score").alias("t"), "precision", "recall"),
                 F.struct("_f1", (-F.col("score")).alias("ns"))).alias("f1best"),
        F.max(F.col("_ok").cast("int")).alias("target_met"))
    pick = F.when(F.col("target_met") == 1, F.col("best")).otherwise(F.col("f1best"))
    return g.select(*keys, pick["t"].alias("threshold"),
                    pick["recall"].alias("achieved_recall"),
                    pick["precision"].alias("achieved_precision"),
                    F.col("target_met").cast("int").alias("target_met"))


# -- F11 / F12 calibration ---------------------------------------------------

def calibration_bins(df: DataFrame, keys: Sequence[str] = (), label: str = "label",
                     score: str = "score", bins: int = 10, weight: str | None = None) -> DataFrame:
    """reliability table, one row per ``(keys, bin)`` including empty bins.

    Bins are right-closed ``(lo, hi]`` with the first closed at 0: the bin of p
    is the number of inner edges strictly below p (edges are the literal
    ``i * (1/bins)`` floats)."""
    keys = list(keys)
    edges = linspace(bins)
    b = F.least(F.greatest(count_lt(edges[1:-1], F.col(score)), F.lit(0)), F.lit(bins - 1))
    def mean(c: Column) -> Column:
        w = F.when(c.isNotNull(), _w(weight))
        return F.sum(w * c) / F.sum(w)

    g = df.groupBy(*keys, b.alias("bin")).agg(
        F.sum(F.col(weight) if weight else F.lit(1)).alias("count"), mean(F.col(score).cast("double")).alias("confidence"),
        mean(F.col(label).cast("double")).alias("accuracy"))
    grid = (df.select(*keys).distinct() if keys else df.sparkSession.range(1).select())
    grid = grid.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    e = lit_array(edges)
    out = grid.join(g, [*keys, "bin"], "left")
    return out.select(
        *keys, "bin",
        F.element_at(e, F.col("bin") + 1).alias("lo"),
        F.element_at(e, F.col("bin") + 2).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.col("accuracy"), F.lit(0.0)).alias("accuracy"),
    )


def ece(bins_df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """count-weighted ECE and worst-bin MCE from the reliability table."""
    keys = list(keys)
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    b = bins_df.withColumn("_gap", F.when(F.col("count") > 0, gap).otherwise(F.lit(0.0)))
    g = b.groupBy(*keys).agg(F.sum(F.col("count") * F.col("_gap")).alias("_num"),
                             F.sum("count").alias("n"), F.max("_gap").alias("mce"))
    return g.select(*keys, safe_div(F.col("_num"), F.col("n")).alias("ece"), "mce", "n")


# -- F13-F15 subgroups ---------------------------------------------------------

def stack_dimensions(df: DataFrame, dims: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows x dimensions: ``(dimension, grp, cols...)``; group values as text,
    null as its own group."""
    d = df.select(*cols, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_TOKEN)).alias(f"_dim_{c}")
                           for c in dims])
    return d.unpivot(list(cols), [f"_dim_{c}" for c in dims], "dimension", "grp") \
            .withColumn("dimension", F.regexp_replace("dimension", "^_dim_", ""))


def subgroup_metrics(df: DataFrame, dims: Sequence[str], threshold: float,
                     label: str = "label", score: str = "score", min_n: int = 500,
                     ece_min_n: int = 50) -> DataFrame:
    """metrics per ``(dimension, grp)`` at one shared threshold.

    The rows are aggregated once, to counts per (dimension, group, label, score), and written to the
    checkpoint folder; the four groups of metrics are weighted ones of those counts."""
    s = stack_dimensions(df, dims, [label, score]).withColumnRenamed(label, "label") \
        .withColumnRenamed(score, "score")
    keys, w = ["dimension", "grp"], "_n"
    s = s.groupBy(*keys, "label", "score").agg(F.count(F.lit(1)).alias(w)).checkpoint()
    conf = confusion(s, threshold, keys, weight=w)
    # every dimension holds all rows once, which leaves the ratio as it is
    overall = confusion(s, threshold, weight=w).select("recall").scalar()
    rm = rank_metrics(score_curve(s, keys, weight=w), keys).select(*keys, "average_precision")
    br = brier(s, keys, weight=w)
    ec = ece(calibration_bins(s, keys, weight=w), keys).select(*keys, F.col("ece").alias("_ece"))
    j = (conf.join(rm, keys, "left").join(br, keys, "left").join(ec, keys, "left")
             .withColumn("overall_recall", overall))
    n, npos = F.col("n"), F.col("n_positive")
    single = (npos == 0) | (npos == n)
    return j.select(
        *keys, "n", "n_positive", "prevalence",
        F.when(npos > 0, F.col("recall")).otherwise(F.lit(0.0)).alias("recall"),
        "precision",
        F.when(single, F.lit(None).cast("double")).otherwise(F.col("average_precision")).alias("pr_auc"),
        "brier",
        F.when(n >= ece_min_n, F.col("_ece")).alias("ece"),
        "flagged_rate",
        F.when(npos > 0, F.col("recall") - F.col("overall_recall")).otherwise(F.lit(0.0))
         .alias("recall_gap"),
        ((n >= min_n) & (npos > 0)).cast("int").alias("sufficient"),
        F.when(n < min_n, F.lit(f"n below {min_n}"))
         .when(npos == 0, F.lit("no positive cases")).otherwise(F.lit("")).alias("note"),
    )


def worst_gap(sub: DataFrame) -> DataFrame:
    """analysable groups, the worst recall gap and its group."""
    a = sub.where(F.col("sufficient") == 1)
    return a.agg(
        F.count(F.lit(1)).alias("n_analysable"),
        F.coalesce(F.min("recall_gap"), F.lit(0.0)).alias("worst_recall_gap"),
        F.min_by(F.concat_ws("=", "dimension", "grp"),
                 F.struct("recall_gap", "dimension", "grp")).alias("worst_group"))


def recall_spread(sub: DataFrame) -> DataFrame:
    """per dimension, min / max recall among analysable groups (needs >= 2)."""
    a = sub.where(F.col("sufficient") == 1)
    g = a.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min_by("grp", F.struct("recall", "grp")).alias("min_group"),
        F.min("recall").alias("min_recall"),
        F.max_by("grp", F.struct("recall", "grp")).alias("max_group"),
        F.max("recall").alias("max_recall"))
    return g.where(F.col("n_groups") >= 2).withColumn(
        "spread", F.col("max_recall") - F.col("min_recall"))


# -- F16-F18 baselines -----------------------------------------------------------

def constant_baselines(df: DataFrame, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """F16 majority class + F17 prevalence constant: closed forms from prevalence p
    (accuracy 1-p, recall 0, AP p, ROC-AUC 0.5, Brier mean((p - y)^2))."""
    keys = list(keys)
    g = df.groupBy(*keys).agg(F.avg(F.col(label).cast("double")).alias("p"),
                              F.count(F.lit(1)).alias("n"),
                              F.sum(F.col(label)).alias("_npos"))
    p = F.col("p")
    # mean((p - y)^2) = p (1-p)^2 + (1-p) p^2 written as the mean over rows
    br = (F.col("_npos") * F.pow(p - 1, 2) + (F.col("n") - F.col("_npos")) * F.pow(p, 2)) / F.col("n")
    rows = []
    for name in ("majority_class", "prevalence_constant"):
        rows.append(g.select(*keys, F.lit(name).alias("baseline"),
                             (1 - p).alias("accuracy"), F.lit(0.0).alias("recall"),
                             p.alias("pr_auc"), F.lit(0.5).alias("roc_auc"), br.alias("brier")))
    return rows[0].unionByName(rows[1])


def single_feature_baseline(df: DataFrame, feature: str, label: str = "label",
                            pct: float = 0.89) -> DataFrame:
    """rank by one feature; flag strictly above its 89th percentile; the
    score for rank metrics is the min-max scaled feature."""
    from driftline.operators.quantile import with_quantiles
    st = with_quantiles(df.agg(F.min(feature).cast("double").alias("mn"), F.max(feature).cast("double").alias("mx")),
                        df, feature, {"cut": pct})
    ss = scalars(st, "cut", "mn", "mx")
    cut, mn, mx = ss["cut"], ss["mn"], ss["mx"]
    rng = F.when((mx - mn) == 0, F.lit(1.0)).otherwise(mx - mn)
    s = df.select(F.col(label).alias("label"), F.col(feature).cast("double").alias("x")) \
          .select("label", "x", ((F.col("x") - mn) / rng).alias("score"))
    flag = (F.col("x") > cut).cast("int")
    rm = scalars(rank_metrics(score_curve(s, [])), "average_precision", "roc_auc")
    return s.agg(
        F.lit(f"heuristic_{feature}").alias("baseline"),
        F.avg((flag == F.col("label")).cast("double")).alias("accuracy"),
        safe_div(F.sum(flag * F.col("label")), F.sum("label")).alias("recall"),
        F.first(rm["average_precision"]).alias("pr_auc"),
        F.first(rm["roc_auc"]).alias("roc_auc"),
        F.avg(F.pow(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)) - F.col("label"), 2))
         .alias("brier"),
        F.first(cut).alias("threshold"),
        F.avg(flag.cast("double")).alias("flagged_rate"))
