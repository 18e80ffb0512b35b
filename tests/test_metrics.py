"""Metrics against brute-force numpy formulas (modelled on the evaluation suite)."""

import numpy as np
import pytest

from driftline.operators import bootstrap as BS
from driftline.operators import metrics as M


def ap_np(y, s):
    order = np.argsort(-s, kind="mergesort")
    y, s = y[order], s[order]
    distinct = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tp = np.cumsum(y)[distinct]
    fp = (distinct + 1) - tp
    prec = tp / (tp + fp)
    rec = tp / y.sum()
    return float(np.sum(np.diff(np.r_[0, rec]) * prec))


def auc_np(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    y = rng.binomial(1, 0.1, 2000)
    s = np.round(rng.uniform(size=2000) * 0.5 + 0.3 * y, 3)   # rounded: ties
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "id long, label int, score double")
    return df, y, s


def test_ap_auc_brier_match_brute_force(sample):
    df, y, s = sample
    r = M.rank_metrics(M.score_curve(df)).first()
    assert r["average_precision"] == pytest.approx(ap_np(y, s), abs=1e-9)
    assert r["roc_auc"] == pytest.approx(auc_np(y, s), abs=1e-9)
    assert M.brier(df).first()[0] == pytest.approx(float(np.mean((s - y) ** 2)), abs=1e-12)


def test_confusion_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, score double")
    r = M.confusion(df, 0.5).first()
    assert r["precision"] == 0 and r["recall"] == 0 and r["lift"] == 0 and r["specificity"] == 1.0


def test_threshold_ties_pick_lowest(spark):
    df = spark.createDataFrame([(1 if i < 10 else 0, 0.5) for i in range(100)], "label int, score double")
    r = M.choose_threshold(M.score_curve(df), 0.5).first()
    assert r["threshold"] == 0.5 and r["target_met"] == 1
    rng = np.random.default_rng(5)
    y = rng.binomial(1, 0.1, 3000)
    s = rng.uniform(size=3000) * 0.5 + 0.3 * y
    d2 = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    got = M.choose_threshold(M.score_curve(d2), 0.5).first()
    order = np.sort(np.unique(s))
    best = None
    for t in order:
        pred = s >= t
        rec = (pred & (y == 1)).sum() / y.sum()
        prec = (pred & (y == 1)).sum() / pred.sum()
        if rec >= 0.5 and (best is None or prec > best[1]):
            best = (t, prec)
    assert got["threshold"] == pytest.approx(best[0])


def test_ece_edge_cases(spark):
    df = spark.createDataFrame([(0, 0.9)] * 100, "label int, score double")
    assert M.ece(M.calibration_bins(df)).first()["ece"] > 0.8
    top = spark.createDataFrame([(1, 1.0)] * 10, "label int, score double")
    bins = {r["bin"]: r["count"] for r in M.calibration_bins(top).collect()}
    assert bins[9] == 10 and sum(bins.values()) == 10
    mix = spark.createDataFrame([(0, 0.05)] * 9900 + [(1, 0.95)] * 100, "label int, score double")
    r = M.ece(M.calibration_bins(mix)).first()
    assert r["mce"] >= r["ece"]


def test_subgroups_sufficiency(spark):
    rows = [(["A", "B", "TinyGroup"][0 if i < 1800 else 1 if i < 2940 else 2], int(i % 10 == 0), (i % 10) / 10.0)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "race string, label int, score double")
    sub = {r["grp"]: r for r in M.subgroup_metrics(df, ["race"], 0.5).collect()}
    assert sub["TinyGroup"]["sufficient"] == 0 and sub["A"]["sufficient"] == 1


def test_bootstrap_brackets_and_is_deterministic(sample):
    df, y, s = sample
    a = {r["metric"]: r for r in BS.bootstrap_metrics(df, ["id"], B=30).collect()}
    b = {r["metric"]: r for r in BS.bootstrap_metrics(df, ["id"], B=30).collect()}
    for m in ("pr_auc", "roc_auc", "brier"):
        assert a[m]["lower"] <= a[m]["point"] <= a[m]["upper"]
        # same weights every run; equal up to the order of floating-point sums across tasks
        assert a[m]["lower"] == pytest.approx(b[m]["lower"], rel=1e-12)
        assert a[m]["upper"] == pytest.approx(b[m]["upper"], rel=1e-12)
        assert a[m]["n_replicates"] == b[m]["n_replicates"]


def test_interval_overlap(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(0.11, 0.14, 0.10, 0.13), (0.18, 0.22, 0.10, 0.13)], "al double, ah double, bl double, bh double")
    got = [r[0] for r in df.select(BS.overlaps("al", "ah", "bl", "bh").alias("o")).collect()]
    assert got == [True, False]
    del F


def _bootstrap_brute(rows, B, seed=42):
    """Replicate metrics of (key, id, label, score) rows by Python integers and sorting."""
    import hashlib

    from driftline.functions.exprs import MIX, poisson1_cdf
    cdf, (shift, factor) = poisson1_cdf(12), MIX

    def mix(x):
        for s, m in zip(shift, factor):
            x = (x ^ (x >> s)) * m % 2**32
        return x ^ (x >> shift[-1])

    def weight(i, b):
        h = hashlib.md5(f"{i}|{seed}".encode()).hexdigest()
        u = mix(mix((int(h[:8], 16) + b * 0x9E3779B1) % 2**32) ^ int(h[8:16], 16)) / 2**32
        return next((k for k in range(12) if u <= cdf[k]), 12)

    out = {}
    for b in range(B + 1):
        drawn = [(k, y, s, 1 if b == B else weight(i, b)) for k, i, y, s in rows]
        for key in {r[0] for r in rows}:
            mine = [r[1:] for r in drawn if r[0] == key and r[3]]
            p, n = sum(w for y, _, w in mine if y), sum(w for y, _, w in mine if not y)
            ap = auc = cp = cn = 0
            for s in sorted({s for _, s, _ in mine}, reverse=True):
                gp, gn = (sum(w for y, t, w in mine if t == s and y == c) for c in (1, 0))
                cp, cn = cp + gp, cn + gn
                ap += gp * cp / (cp + cn)
                auc += gp * (n - cn + gn / 2)
            out[key, b] = (p, n, ap / p if p else None, auc / p / n if p and n else None,
                           sum(w * (s - y) ** 2 for y, s, w in mine) / (p + n) if mine else None)
    return out


def test_bootstrap_vectors_equal_brute_force(spark):
    """Hot scores (a third of the rows), ties, one key with one class, scores in many buckets, null rows."""
    import random
    rng = random.Random(3)
    rows = [("a", i, int(rng.random() < 0.3), 0.5 if rng.random() < 0.35 else round(rng.random(), 2)) for i in range(400)]
    rows += [("b", i, int(rng.random() < 0.5), 0.25) for i in range(400, 440)] + [("c", i, 0, rng.random()) for i in range(440, 450)]
    extra = [("a", 900, None, 0.3), ("a", 901, 1, None), ("a", 902, 1, float("nan"))]
    df = spark.createDataFrame(rows + extra, "k string, id long, label int, score double").repartition(5)
    want = _bootstrap_brute(rows, 12)
    got = {(r["k"], r["b"]): r for r in BS.replicate_metrics(df, ["id"], ["k"], B=12).collect()}
    assert set(got) == set(want)
    for key, values in want.items():
        for name, v in zip(("total_pos", "total_neg", "average_precision", "roc_auc", "brier"), values):
            assert got[key][name] == (None if v is None else pytest.approx(v, rel=1e-9)), (key, name)
    plan = BS.replicate_metrics(df, ["id"], ["k"], B=12)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_bootstrap_mean_equals_brute_force(spark):
    rows = [("a", i, 1, float(i % 7)) for i in range(50)] + [("b", i, 0, 2.0) for i in range(50, 60)]
    df = spark.createDataFrame([(k, i, s) for k, i, _, s in rows], "k string, id long, v double").repartition(3)
    got = {r["k"]: r for r in BS.bootstrap_mean(df, "v", ["id"], ["k"], B=40, level=0.9).collect()}
    brier = _bootstrap_brute([(k, i, 0, s) for k, i, _, s in rows], 40)       # squared errors of label 0 are v ** 2
    assert got["b"]["lower"] == got["b"]["upper"] == 2.0 and brier["b", 0][4] == 4.0
    assert got["a"]["lower"] < 3.0 < got["a"]["upper"] and got["a"]["n_replicates"] == 40
