"""Evaluation plans on ``scored``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions.exprs import linspace
from driftline.operators import bootstrap as BS
from driftline.operators import metrics as M
from driftline.operators import outcomes as O
from driftline.plans import sqlgen as S
from driftline.plans import views as V
from driftline.plans.registry import register
from driftline.plans.views import present

THR = 0.35
B = 1000
DIMS = ["o_orderpriority", "o_orderstatus"]

# ---------------------------------------------------------------- views (Spark)


def scored(spark, sf):
    """Predictions with the last-written outcome label (inner: matured only)."""
    # the last write alone: its number of writes, which costs another shuffle of all outcomes, is not read
    last = O.top_row(V.outc(spark, sf), ["prediction_id"], [F.col(c).desc_nulls_last() for c in ("outcome_ts", *V.OUTC_TIEBREAK)])
    return V.pred(spark, sf).join(
        last.select("prediction_id", F.col("outcome_label").alias("label"), "outcome_ts"),
        "prediction_id", "inner")


def scored_once(spark, sf):
    """``scored``, written once in the shared folder for plans that read it several times."""
    return scored(spark, sf).checkpoint()


def grouped_all(df, key):
    """Rows twice: once in the overall group 'ALL', once in their ``key`` group."""
    return df.withColumn("grp", F.explode(F.array(F.lit("ALL"), F.col(key).cast("string"))))


# ---------------------------------------------------------------- views (SQL)

PRED_SQL = ("_pred AS (SELECT o_orderkey AS prediction_id, o_orderdate AS pred_ts, "
            "least(o_totalprice / 500000.0::DOUBLE, 1.0::DOUBLE) AS score, o_custkey AS entity, "
            "o_orderpriority, o_orderstatus, o_totalprice FROM orders)")
OUTC_SQL = ("_outc AS (SELECT l_orderkey AS prediction_id, l_shipdate AS outcome_ts, "
            "CAST(l_returnflag = 'R' AS INTEGER) AS outcome_label, "
            + ", ".join(V.OUTC_TIEBREAK) + " FROM lineitem)")
LWW_SQL = ("_lww AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id "
           "ORDER BY outcome_ts DESC, " + ", ".join(f"{c} DESC" for c in V.OUTC_TIEBREAK)
           + ") AS _rn, count(*) OVER (PARTITION BY prediction_id) AS n_writes FROM _outc) WHERE _rn = 1)")
SCORED_SQL = (PRED_SQL + ",\n" + OUTC_SQL + ",\n" + LWW_SQL + ",\n"
              "_scored AS (SELECT p.*, l.outcome_label AS label, l.outcome_ts "
              "FROM _pred p JOIN _lww l ON p.prediction_id = l.prediction_id)")
GALL_SQL = ("_g AS (SELECT 'ALL' AS grp, label, score, prediction_id FROM _scored UNION ALL "
            "SELECT CAST(o_orderpriority AS VARCHAR), label, score, prediction_id FROM _scored)")


def curve_sql(src: str, keys: list[str], weight: str | None = None, name: str = "_curve") -> str:
    """Weighted PR curve per ``keys`` in SQL (descending distinct scores)."""
    w = weight or "1"
    ks = S.keysel(keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    cast = "CAST({} AS BIGINT)" if weight is None else "CAST({} AS DOUBLE)"
    return (
        f"{name}_p AS (SELECT {ks}score, {cast.format(f'sum(CASE WHEN label = 1 THEN {w} ELSE 0 END)')} AS pos, "
        f"{cast.format(f'sum(CASE WHEN label = 1 THEN 0 ELSE {w} END)')} AS neg FROM {src} GROUP BY {ks}score),\n"
        f"{name} AS (SELECT *, "
        f"{cast.format(f'sum(pos) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING)')} AS cum_pos, "
        f"{cast.format(f'sum(neg) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING)')} AS cum_neg, "
        f"{cast.format(f'sum(pos) OVER ({part[:-1]})' if part else 'sum(pos) OVER ()')} AS total_pos, "
        f"{cast.format(f'sum(neg) OVER ({part[:-1]})' if part else 'sum(neg) OVER ()')} AS total_neg "
        f"FROM {name}_p),\n"
        f"{name}_x AS (SELECT *, CASE WHEN cum_pos + cum_neg > 0 THEN cum_pos::DOUBLE / (cum_pos + cum_neg) ELSE 0 END AS precision, "
        f"CASE WHEN total_pos > 0 THEN cum_pos::DOUBLE / total_pos ELSE 1.0 END AS recall FROM {name})")


def rank_sql(curve: str, keys: list[str]) -> str:
    ks = S.keysel(keys)
    gb = f" GROUP BY {', '.join(keys)}" if keys else ""
    return (f"SELECT {ks}CASE WHEN any_value(total_pos) > 0 THEN sum(pos * precision) / any_value(total_pos) END AS average_precision, "
            f"CASE WHEN any_value(total_pos) > 0 AND any_value(total_neg) > 0 THEN "
            f"sum(pos * (total_neg - cum_neg + 0.5 * neg)) / (any_value(total_pos) * any_value(total_neg)) END AS roc_auc, "
            f"any_value(total_pos) AS total_pos, any_value(total_neg) AS total_neg FROM {curve}_x{gb}")


def confusion_sql(src: str, keys: list[str], thr: str) -> str:
    ks = S.keysel(keys)
    gb = f" GROUP BY {', '.join(keys)}" if keys else ""
    return (
        f"SELECT {ks}count(*) AS n, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_positive, "
        f"count(*) FILTER (WHERE label = 1 AND score >= {thr}) AS tp, "
        f"count(*) FILTER (WHERE label <> 1 AND score >= {thr}) AS fp, "
        f"count(*) FILTER (WHERE label <> 1 AND score < {thr}) AS tn, "
        f"count(*) FILTER (WHERE label = 1 AND score < {thr}) AS fn FROM {src}{gb}")


def derived_sql(c: str) -> str:
    """F2 columns from a confusion relation alias ``c``."""
    def sd(a, b):
        return f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"
    prec = sd(f"{c}.tp", f"{c}.tp + {c}.fp")
    prev = sd(f"{c}.n_positive", f"{c}.n")
    return (f"{prev} AS prevalence, {prec} AS precision, {sd(f'{c}.tp', f'{c}.tp + {c}.fn')} AS recall, "
            f"{sd(f'2 * {c}.tp', f'2 * {c}.tp + {c}.fp + {c}.fn')} AS f1, "
            f"{sd(f'{c}.tn', f'{c}.tn + {c}.fp')} AS specificity, "
            f"{sd(f'{c}.tp + {c}.tn', f'{c}.n')} AS accuracy, "
            f"{sd(f'{c}.tp + {c}.fp', f'{c}.n')} AS flagged_rate, "
            f"CASE WHEN {prev} > 0 THEN " + S.r6(f"({prec}) / ({prev})", 3) + f" ELSE 0.0 END AS lift")


def r6cols(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


F2 = ["prevalence", "precision", "recall", "f1", "specificity", "accuracy", "flagged_rate", "lift"]

# ---------------------------------------------------------------- F1/F2


@register("confusion_by_group",
          "WITH " + SCORED_SQL + ",\n_c AS (" + confusion_sql("_scored", ["o_orderpriority"], "0.35") + ")\n"
          "SELECT * EXCLUDE (" + ", ".join(F2) + "), " + r6cols(F2) + " FROM (SELECT _c.*, "
          + derived_sql("_c") + " FROM _c)")
def confusion_by_group(spark, sf):
    """F1 + F2: confusion counts and rates at score >= 0.35 per order priority."""
    return present(M.confusion(scored(spark, sf), THR, ["o_orderpriority"]))


# ---------------------------------------------------------------- F3, F5-F7


@register("pr_curve",
          "WITH " + SCORED_SQL + ",\n" + curve_sql("_scored", ["o_orderpriority"]) + "\n"
          "SELECT o_orderpriority, round(score, 6) AS score, pos, neg, cum_pos, cum_neg, "
          "round(precision, 6) AS precision, round(recall, 6) AS recall FROM _curve_x")
def pr_curve(spark, sf):
    """precision-recall curve over distinct scores per order priority."""
    c = M.score_curve(scored(spark, sf), ["o_orderpriority"])
    return present(c.select("o_orderpriority", "score", "pos", "neg", "cum_pos", "cum_neg",
                            "precision", "recall"))


def _rank_all(spark, sf):
    g = grouped_all(scored(spark, sf), "o_orderpriority")
    return M.rank_metrics(M.score_curve(g, ["grp"]), ["grp"])


_RANK_ALL_SQL = ("WITH " + SCORED_SQL + ",\n" + GALL_SQL + ",\n" + curve_sql("_g", ["grp"]) + ",\n"
                 "_r AS (" + rank_sql("_curve", ["grp"]) + ")\n")


@register("average_precision", _RANK_ALL_SQL + "SELECT grp, round(average_precision, 6) AS average_precision FROM _r")
def average_precision(spark, sf):
    """average precision (step sum over distinct scores), overall and per priority."""
    return present(_rank_all(spark, sf).select("grp", "average_precision"))


@register("roc_auc", _RANK_ALL_SQL + "SELECT grp, round(roc_auc, 6) AS roc_auc FROM _r")
def roc_auc(spark, sf):
    """ROC-AUC with ties at one half, overall and per priority."""
    return present(_rank_all(spark, sf).select("grp", "roc_auc"))


@register("brier", "WITH " + SCORED_SQL + ",\n" + GALL_SQL + "\n"
          "SELECT grp, round(avg(power(score - label, 2)), 6) AS brier FROM _g GROUP BY grp")
def brier(spark, sf):
    """Brier score, overall and per priority."""
    return present(M.brier(grouped_all(scored(spark, sf), "o_orderpriority"), ["grp"]))


# ---------------------------------------------------------------- F4


@register("choose_threshold",
          "WITH " + SCORED_SQL + ",\n" + curve_sql("_scored", []) + ",\n"
          "_e AS (SELECT * FROM _curve_x WHERE recall >= 0.5::DOUBLE)\n"
          "SELECT round(score, 6) AS threshold, round(recall, 6) AS achieved_recall, "
          "round(precision, 6) AS achieved_precision, 1 AS target_met FROM _e "
          "ORDER BY precision DESC, score ASC LIMIT 1")
def choose_threshold(spark, sf):
    """threshold with recall >= 0.5 and the highest precision (lowest on ties)."""
    return present(M.choose_threshold(M.score_curve(scored(spark, sf)), 0.5))


# ---------------------------------------------------------------- F11/F12

_INNER10 = S.dlist(linspace(10)[1:-1])
_EDGES10 = S.dlist(linspace(10))
ECE_BINS_SQL = (
    "_bins AS (SELECT least(greatest(len(list_filter(" + _INNER10 + ", lambda e: e < score)), 0), 9) AS bin, "
    "label, score FROM _scored),\n"
    "_bagg AS (SELECT bin, count(*) AS count, avg(score) AS confidence, avg(label::DOUBLE) AS accuracy "
    "FROM _bins GROUP BY bin),\n"
    "_rel AS (SELECT r.range::INTEGER AS bin, " + _EDGES10 + "[r.range + 1] AS lo, "
    + _EDGES10 + "[r.range + 2] AS hi, coalesce(b.count, 0) AS count, "
    "coalesce(b.confidence, 0.0) AS confidence, coalesce(b.accuracy, 0.0) AS accuracy "
    "FROM range(10) r LEFT JOIN _bagg b ON b.bin = r.range)")


@register("ece_bins", "WITH " + SCORED_SQL + ",\n" + ECE_BINS_SQL + "\n"
          "SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count, round(confidence, 6) AS confidence, "
          "round(accuracy, 6) AS accuracy FROM _rel")
def ece_bins(spark, sf):
    """reliability table, 10 right-closed bins, empty bins as zeros."""
    return present(M.calibration_bins(scored(spark, sf)))


@register("ece", "WITH " + SCORED_SQL + ",\n" + ECE_BINS_SQL + "\n"
          "SELECT round(CASE WHEN sum(count) > 0 THEN sum(count * CASE WHEN count > 0 THEN abs(confidence - accuracy) ELSE 0 END) / sum(count) ELSE 0 END, 6) AS ece, "
          "round(max(CASE WHEN count > 0 THEN abs(confidence - accuracy) ELSE 0 END), 6) AS mce, "
          "CAST(sum(count) AS BIGINT) AS n FROM _rel")
def ece(spark, sf):
    """count-weighted ECE and MCE over 10 bins."""
    return present(M.ece(M.calibration_bins(scored(spark, sf))))


# ---------------------------------------------------------------- F13-F15

def _sub(spark, sf):
    return M.subgroup_metrics(scored(spark, sf), DIMS, THR)


_SUB_COLS = ["dimension", "grp", "n", "n_positive", "prevalence", "recall", "precision", "pr_auc",
             "brier", "ece", "flagged_rate", "recall_gap", "sufficient", "note"]
SUB_SQL = (
    "_st AS (" + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), '<null>') AS grp, label, score FROM _scored"
        for d in DIMS) + "),\n"
    "_sc AS (" + confusion_sql("_st", ["dimension", "grp"], "0.35") + "),\n"
    "_sd AS (SELECT _sc.*, " + derived_sql("_sc") + " FROM _sc),\n"
    + curve_sql("_st", ["dimension", "grp"]) + ",\n"
    "_sr AS (" + rank_sql("_curve", ["dimension", "grp"]) + "),\n"
    "_sb AS (SELECT dimension, grp, avg(power(score - label, 2)) AS brier FROM _st GROUP BY dimension, grp),\n"
    "_se0 AS (SELECT dimension, grp, least(greatest(len(list_filter(" + _INNER10 + ", lambda e: e < score)), 0), 9) AS bin, "
    "score, label FROM _st),\n"
    "_se1 AS (SELECT dimension, grp, bin, count(*) AS cnt, avg(score) AS conf, avg(label::DOUBLE) AS acc "
    "FROM _se0 GROUP BY dimension, grp, bin),\n"
    "_se AS (SELECT dimension, grp, sum(cnt * abs(conf - acc)) / sum(cnt) AS ece FROM _se1 GROUP BY dimension, grp),\n"
    "_ov0 AS (" + confusion_sql("_scored", [], "0.35") + "),\n"
    "_ov AS (SELECT CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS overall_recall FROM _ov0),\n"
    "_sub AS (SELECT d.dimension, d.grp, d.n, d.n_positive, d.prevalence, "
    "CASE WHEN d.n_positive > 0 THEN d.recall ELSE 0.0 END AS recall, d.precision, "
    "CASE WHEN d.n_positive = 0 OR d.n_positive = d.n THEN NULL ELSE r.average_precision END AS pr_auc, "
    "b.brier, CASE WHEN d.n >= 50 THEN e.ece END AS ece, d.flagged_rate, "
    "CASE WHEN d.n_positive > 0 THEN d.recall - o.overall_recall ELSE 0.0 END AS recall_gap, "
    "CAST(d.n >= 500 AND d.n_positive > 0 AS INTEGER) AS sufficient, "
    "CASE WHEN d.n < 500 THEN 'n below 500' WHEN d.n_positive = 0 THEN 'no positive cases' ELSE '' END AS note "
    "FROM _sd d JOIN _sr r USING (dimension, grp) JOIN _sb b USING (dimension, grp) "
    "LEFT JOIN _se e USING (dimension, grp) CROSS JOIN _ov o)")


_SUB_NAMES = ["_st", "_sc", "_sd", "_curve_p", "_curve_x", "_curve", "_sr", "_sb", "_se0", "_se1", "_se",
              "_ov0", "_ov", "_sub"]


def sub_sql(src: str = "_scored", sfx: str = "") -> str:
    """SUB_SQL over another scored relation with suffixed CTE names (ends in ``_sub{sfx}``)."""
    import re
    out = SUB_SQL
    if sfx:
        out = re.sub(r"\b(" + "|".join(sorted(_SUB_NAMES, key=len, reverse=True)) + r")\b",
                     lambda m: m.group(1) + sfx, out)
    return re.sub(r"\b_scored\b", src, out)


@register("subgroup_metrics", "WITH " + SCORED_SQL + ",\n" + SUB_SQL + "\nSELECT dimension, grp, n, n_positive, "
          + r6cols(["prevalence", "recall", "precision", "pr_auc", "brier", "ece", "flagged_rate", "recall_gap"])
          + ", sufficient, note FROM _sub")
def subgroup_metrics(spark, sf):
    """per priority / status group at the shared threshold 0.35."""
    return present(_sub(spark, sf).select(*_SUB_COLS))


@register("worst_gap", "WITH " + SCORED_SQL + ",\n" + SUB_SQL + "\n"
          "SELECT count(*) AS n_analysable, round(coalesce(min(recall_gap), 0.0), 6) AS worst_recall_gap, "
          "(SELECT dimension || '=' || grp FROM _sub WHERE sufficient = 1 ORDER BY recall_gap, dimension, grp LIMIT 1) "
          "AS worst_group FROM _sub WHERE sufficient = 1")
def worst_gap(spark, sf):
    """analysable groups and the worst recall gap against the overall recall."""
    return present(M.worst_gap(_sub(spark, sf)))


def recall_spread(spark, sf):
    """per dimension, lowest / highest recall among analysable groups."""
    return present(M.recall_spread(_sub(spark, sf)))


ORACLE_RECALL_SPREAD = (
    "WITH " + SCORED_SQL + ",\n" + SUB_SQL + ",\n"
    "_a AS (SELECT * FROM _sub WHERE sufficient = 1),\n"
    "_mn AS (SELECT dimension, grp AS min_group, recall AS min_recall FROM (SELECT *, row_number() OVER "
    "(PARTITION BY dimension ORDER BY recall ASC, grp ASC) AS k FROM _a) WHERE k = 1),\n"
    "_mx AS (SELECT dimension, grp AS max_group, recall AS max_recall FROM (SELECT *, row_number() OVER "
    "(PARTITION BY dimension ORDER BY recall DESC, grp DESC) AS k FROM _a) WHERE k = 1),\n"
    "_n AS (SELECT dimension, count(*) AS n_groups FROM _a GROUP BY dimension)\n"
    "SELECT _n.dimension, n_groups, min_group, round(min_recall, 6) AS min_recall, max_group, "
    "round(max_recall, 6) AS max_recall, round(max_recall - min_recall, 6) AS spread "
    "FROM _n JOIN _mn USING (dimension) JOIN _mx USING (dimension) WHERE n_groups >= 2")
register("recall_spread", ORACLE_RECALL_SPREAD)(recall_spread)


# ---------------------------------------------------------------- F16-F18

BASE_COLS = ["baseline", "accuracy", "recall", "pr_auc", "roc_auc", "brier", "threshold", "flagged_rate"]


@register("baselines",
          "WITH " + SCORED_SQL + ",\n"
          "_p AS (SELECT avg(label::DOUBLE) AS p, count(*) AS n, sum(label) AS npos FROM _scored),\n"
          "_cb AS (SELECT b.name AS baseline, 1 - p AS accuracy, 0.0 AS recall, p AS pr_auc, 0.5 AS roc_auc, "
          "(npos * power(p - 1, 2) + (n - npos) * power(p, 2)) / n AS brier, NULL::DOUBLE AS threshold, "
          "NULL::DOUBLE AS flagged_rate FROM _p, (VALUES ('majority_class'), ('prevalence_constant')) b(name)),\n"
          "_st0 AS (SELECT quantile_cont(o_totalprice, 0.89::DOUBLE) AS cut, min(o_totalprice) AS mn, "
          "max(o_totalprice) AS mx FROM _scored),\n"
          "_hs AS (SELECT label, o_totalprice AS x, cut, (o_totalprice - mn) / (CASE WHEN mx - mn = 0 THEN 1.0 ELSE mx - mn END) "
          "AS score FROM _scored, _st0),\n"
          + curve_sql("_hs", []) + ",\n"
          "_hr AS (" + rank_sql("_curve", []) + "),\n"
          "_h AS (SELECT 'heuristic_o_totalprice' AS baseline, avg(CAST((CAST(x > cut AS INTEGER)) = label AS INTEGER)::DOUBLE) AS accuracy, "
          "CASE WHEN sum(label) > 0 THEN sum(CAST(x > cut AS INTEGER) * label)::DOUBLE / sum(label) ELSE 0.0 END AS recall, "
          "(SELECT average_precision FROM _hr) AS pr_auc, (SELECT roc_auc FROM _hr) AS roc_auc, "
          "avg(power(least(greatest(score, 0.0), 1.0) - label, 2)) AS brier, any_value(cut) AS threshold, "
          "avg(CAST(x > cut AS INTEGER)::DOUBLE) AS flagged_rate FROM _hs)\n"
          "SELECT baseline, " + r6cols(BASE_COLS[1:]) + " FROM (SELECT * FROM _cb UNION ALL SELECT * FROM _h)")
def baselines(spark, sf):
    """Majority class, prevalence constant, single-feature ranking (o_totalprice)."""
    s = scored(spark, sf)
    c = M.constant_baselines(s).withColumn("threshold", F.lit(None).cast("double")) \
         .withColumn("flagged_rate", F.lit(None).cast("double"))
    h = M.single_feature_baseline(s, "o_totalprice")
    return present(c.select(*BASE_COLS).unionByName(h.select(*BASE_COLS)))


# ---------------------------------------------------------------- F8 / F10

def boot_sql(src: str, keys: list[str], B: int, level: float = 0.95) -> str:
    """Bootstrap replicate metrics in SQL (cross join with range(B) is fine in
    the oracle); ends in ``_bci(keys, metric, point, lower, upper, se, n_replicates)``."""
    ks = S.keysel(keys)
    kr = keys + ["b"]
    on = " AND ".join([f"p.{k} = c.{k}" for k in keys] + ["p.metric = c.metric"]) or "p.metric = c.metric"
    gbk = f"GROUP BY {', '.join(keys)}" if keys else ""
    return (
        f"_rep AS ({S.replicate_sql(src, 'prediction_id', B)}),\n"
        + curve_sql("_rep", kr, weight="w", name="_bc") + ",\n"
        f"_brk AS (" + rank_sql("_bc", kr) + "),\n"
        f"_bbr AS (SELECT {S.keysel(kr)}sum(w * power(score - label, 2)) / sum(w) AS value, "
        f"sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS _p, sum(CASE WHEN label = 1 THEN 0 ELSE w END) AS _n "
        f"FROM _rep GROUP BY {', '.join(kr)}),\n"
        f"_bv AS (SELECT {ks}'pr_auc' AS metric, average_precision AS value FROM _brk WHERE total_pos > 0 AND total_neg > 0 "
        f"UNION ALL SELECT {ks}'roc_auc', roc_auc FROM _brk WHERE total_pos > 0 AND total_neg > 0 "
        f"UNION ALL SELECT {ks}'brier', value FROM _bbr WHERE _p > 0 AND _n > 0),\n"
        f"_bq AS (SELECT {ks}metric, quantile_cont(value, {S.dbl((1 - level) / 2)}) AS lower, "
        f"quantile_cont(value, {S.dbl(1 - (1 - level) / 2)}) AS upper, "
        f"stddev_pop(value) AS se, count(*) AS n_replicates FROM _bv GROUP BY {ks}metric),\n"
        + curve_sql(src, keys, name="_pc") + ",\n"
        f"_prk AS (" + rank_sql("_pc", keys) + "),\n"
        f"_pbr AS (SELECT {ks}avg(power(score - label, 2)) AS brier FROM {src} {gbk}),\n"
        f"_pt AS (SELECT {ks}'pr_auc' AS metric, average_precision AS point FROM _prk UNION ALL "
        f"SELECT {ks}'roc_auc', roc_auc FROM _prk UNION ALL SELECT {ks}'brier', brier FROM _pbr),\n"
        f"_bci AS (SELECT {S.keysel(keys, 'p.')}p.metric, p.point, coalesce(c.lower, p.point) AS lower, "
        f"coalesce(c.upper, p.point) AS upper, coalesce(c.se, 0.0) AS se, "
        f"coalesce(c.n_replicates, 0) AS n_replicates FROM _pt p LEFT JOIN _bq c ON {on})")


@register("bootstrap_ci", "WITH " + SCORED_SQL + ",\n" + boot_sql("_scored", [], B) + "\n"
          "SELECT metric, round(point, 6) AS point, round(lower, 6) AS lower, round(upper, 6) AS upper, "
          "round(se, 6) AS se, n_replicates FROM _bci")
def bootstrap_ci(spark, sf):
    """F8: 95% percentile bootstrap CI (B = 1000, md5-seeded Poisson weights) of
    PR-AUC, ROC-AUC and Brier on all scored predictions."""
    return present(BS.bootstrap_metrics(scored(spark, sf), ["prediction_id"], B=B))


SCORE_B = ("least(o_totalprice / 500000.0 * (1.0 + 0.1 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)), 1.0)")
#: candidate models: name, score expression over ``pred`` columns, complexity rank
CANDIDATES = [("price_linear", "score", 1), ("price_priority", SCORE_B, 2)]


def candidates(s):
    """Both models' scores of the scored predictions ``s``."""
    parts = [s.select(F.lit(m).alias("model"), "prediction_id", "label",
                      F.expr(e).cast("double").alias("score")) for m, e, _ in CANDIDATES]
    return parts[0].unionByName(parts[1])


CAND_SQL = ("_cand AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, prediction_id, label, CAST({e.replace('1.0)', '1.0::DOUBLE)')} AS DOUBLE) AS score "
    f"FROM _scored" for m, e, _ in CANDIDATES) + ")")
EVAL_COLS = ["n", "n_positive", "tp", "fp", "tn", "fn"]
EVAL_RATES = ["precision", "recall", "f1", "specificity", "flagged_rate", "lift"]
CI_COLS = [f"{m}{s}" for m in ("pr_auc", "roc_auc", "brier") for s in ("", "_lower", "_upper")]


def _report(spark, sf, s=None):
    r = BS.evaluation_report(candidates(s or scored_once(spark, sf)), THR, ["prediction_id"], ["model"], B=B)
    return r.select("model", *EVAL_COLS, *EVAL_RATES, *CI_COLS)


REPORT_SQL = (
    "WITH " + SCORED_SQL + ",\n" + CAND_SQL + ",\n" + boot_sql("_cand", ["model"], B) + ",\n"
    "_cc AS (" + confusion_sql("_cand", ["model"], "0.35") + "),\n"
    "_cd AS (SELECT _cc.*, " + derived_sql("_cc") + " FROM _cc),\n"
    "_w AS (SELECT model, " + ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN {src} END) AS {m}{suf}"
        for m in ("pr_auc", "roc_auc", "brier")
        for src, suf in (("point", ""), ("lower", "_lower"), ("upper", "_upper"))) + " FROM _bci GROUP BY model),\n"
    "_rep_all AS (SELECT d.model, " + ", ".join(f"d.{c}" for c in EVAL_COLS + EVAL_RATES) + ", "
    + ", ".join(f"w.{c}" for c in CI_COLS) + " FROM _cd d JOIN _w w USING (model))")


@register("evaluation_report", REPORT_SQL + "\nSELECT model, " + ", ".join(EVAL_COLS) + ", "
          + r6cols(EVAL_RATES + CI_COLS) + " FROM _rep_all")
def evaluation_report(spark, sf):
    """full report per candidate at 0.35 with bootstrap CIs (B = 1000)."""
    return present(_report(spark, sf))


@register("candidate_compare", REPORT_SQL + ",\n"
          "_cx AS (SELECT model, pr_auc, pr_auc_lower, pr_auc_upper, CASE model " + " ".join(
              f"WHEN '{m}' THEN {k}" for m, _, k in CANDIDATES) + " END AS complexity FROM _rep_all),\n"
          "_best AS (SELECT * FROM _cx ORDER BY pr_auc DESC, model LIMIT 1),\n"
          "_ov AS (SELECT c.*, CAST(c.pr_auc_lower <= b.pr_auc_upper AND b.pr_auc_lower <= c.pr_auc_upper AS INTEGER) AS overlaps_best, "
          "CAST(c.model = b.model AS INTEGER) AS is_best FROM _cx c, _best b),\n"
          "_ch AS (SELECT model FROM _ov WHERE overlaps_best = 1 ORDER BY complexity, model LIMIT 1),\n"
          "_bn AS (SELECT model, least(greatest(len(list_filter(" + _INNER10 + ", lambda e: e < score)), 0), 9) AS bin, label, score FROM _cand),\n"
          "_bg AS (SELECT model, bin, count(*) AS cnt, avg(score) AS conf, avg(label::DOUBLE) AS acc FROM _bn GROUP BY model, bin),\n"
          "_ece AS (SELECT model, sum(cnt * abs(conf - acc)) / sum(cnt) AS ece FROM _bg GROUP BY model)\n"
          "SELECT o.model, o.complexity, round(o.pr_auc, 6) AS pr_auc, round(o.pr_auc_lower, 6) AS pr_auc_lower, "
          "round(o.pr_auc_upper, 6) AS pr_auc_upper, o.is_best, o.overlaps_best, "
          "CAST(o.pr_auc > b.pr_auc AND o.is_best = 0 AND o.overlaps_best = 0 AS INTEGER) AS beats_best, "
          "CAST(o.model = (SELECT model FROM _ch) AS INTEGER) AS is_champion, round(e.ece, 6) AS ece, "
          "CASE WHEN e.ece <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS ece_gate "
          "FROM _ov o JOIN _ece e USING (model), _best b")
def candidate_compare(spark, sf):
    """F10 + F20 + G10: interval overlap with the best candidate, champion =
    simplest candidate overlapping the best, ECE gate (<= 0.05)."""
    s = scored_once(spark, sf)
    r = _report(spark, sf, s)
    cx = r.select("model", "pr_auc", "pr_auc_lower", "pr_auc_upper",
                  F.expr("CASE model " + " ".join(f"WHEN '{m}' THEN {k}" for m, _, k in CANDIDATES)
                         + " END").alias("complexity"))
    # the candidate table has one row per model: a window over it is bounded
    allm = Window.partitionBy()
    best = F.max_by(F.struct("model", "pr_auc", "pr_auc_lower", "pr_auc_upper"),
                    F.struct("pr_auc", F.lit(0))).over(allm)
    ov = cx.withColumn("_b", best).select(
        "*",
        ((F.col("pr_auc_lower") <= F.col("_b.pr_auc_upper")) &
         (F.col("_b.pr_auc_lower") <= F.col("pr_auc_upper"))).cast("int").alias("overlaps_best"),
        (F.col("model") == F.col("_b.model")).cast("int").alias("is_best"))
    ov = ov.withColumn("_champ", F.min_by("model", F.when(
        F.col("overlaps_best") == 1, F.struct("complexity", "model"))).over(allm))
    b = {"pr_auc": F.col("_b.pr_auc")}
    champ = F.col("_champ")
    e = M.ece(M.calibration_bins(candidates(s), ["model"]), ["model"]).select("model", "ece")
    out = ov.join(e, "model").select(
        "model", "complexity", "pr_auc", "pr_auc_lower", "pr_auc_upper", "is_best", "overlaps_best",
        ((F.col("pr_auc") > b["pr_auc"]) & (F.col("is_best") == 0) & (F.col("overlaps_best") == 0))
        .cast("int").alias("beats_best"),
        (F.col("model") == champ).cast("int").alias("is_champion"), "ece",
        F.when(F.col("ece") <= 0.05, "PASS").otherwise("FAIL").alias("ece_gate"))
    return present(out)
