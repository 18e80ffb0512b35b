"""PSI, calibration and alert properties (modelled on the reference's drift suite)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import drift as D


def _frame(spark, values, col="x"):
    return spark.createDataFrame([(float(v),) for v in values], f"{col} double")


def _cat(spark, values, col="c"):
    return spark.createDataFrame([(v,) for v in values], f"{col} string")


def _psi(spark, ref, cur, numeric=("x",), categorical=()):
    return D.psi(ref, cur, list(numeric), list(categorical)).select("psi").first()[0]


def numpy_psi(ref, cur, bins=10):
    edges = np.unique(np.quantile(np.asarray(ref, float), np.linspace(0, 1, bins + 1)))
    edges[0], edges[-1] = -np.inf, np.inf
    r, _ = np.histogram(ref, edges)
    c, _ = np.histogram(cur, edges)
    r = np.clip(r / max(r.sum(), 1), 1e-6, None)
    c = np.clip(c / max(c.sum(), 1), 1e-6, None)
    return float(np.sum((c - r) * np.log(c / r)))


def test_psi_identical_is_zero(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    assert _psi(spark, _frame(spark, x), _frame(spark, x)) == pytest.approx(0.0, abs=1e-12)


def test_psi_grows_with_shift_and_matches_numpy(spark):
    rng = np.random.default_rng(1)
    ref = rng.normal(size=3000)
    prev = -1.0
    for shift in (0.1, 0.5, 1.0, 2.0):
        cur = rng.normal(size=3000) + shift
        p = _psi(spark, _frame(spark, ref), _frame(spark, cur))
        assert p > prev
        assert p == pytest.approx(numpy_psi(ref, cur), abs=1e-3)
        prev = p
    assert prev > 0.25


def test_categorical_shift_and_new_category(spark):
    a = _cat(spark, ["x"] * 900 + ["y"] * 100)
    b = _cat(spark, ["x"] * 500 + ["y"] * 500)
    assert _psi(spark, a, b, (), ("c",)) > 0.2
    new = _cat(spark, ["x"] * 500 + ["new"] * 500)
    assert _psi(spark, _cat(spark, ["x"] * 1000), new, (), ("c",)) > 0.2
    disjoint = _psi(spark, _cat(spark, ["a"] * 100), _cat(spark, ["b"] * 100), (), ("c",))
    assert math.isfinite(disjoint)


def test_degenerate_reference_is_flagged(spark):
    ref = _frame(spark, [0.0] * 1000)
    cur = _frame(spark, [0.0] * 990 + [5.0] * 10)
    r = D.psi(ref, cur, ["x"], []).first()
    assert math.isfinite(r["psi"]) and r["degenerate"] == 1


def test_skewed_numeric(spark):
    ref = _frame(spark, [0] * 900 + list(range(1, 101)))
    cur = _frame(spark, [0] * 600 + list(range(1, 401)))
    assert _psi(spark, ref, cur) > 0.1


def test_null_calibration_bounds_and_determinism(spark):
    rng = np.random.default_rng(7)
    n = 4000
    rows = [(i, float(rng.integers(1, 14)), ["A", "B", "C"][int(rng.integers(0, 3))]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, t double, race string")
    nl = D.null_psi(df, ["id"], ["t"], ["race"], n_windows=20)
    assert nl.groupBy("feature").count().where("count <> 19").count() == 0
    cal = D.calibrate_thresholds(nl).collect()
    for r in cal:
        assert 0.10 <= r["threshold"] <= 0.25
        assert r["median"] <= r["p99"] <= r["maximum"] + 1e-12
    again = D.calibrate_thresholds(D.null_psi(df, ["id"], ["t"], ["race"], n_windows=20)).collect()
    # equal up to the order of floating-point summation across tasks
    for a, b in zip(sorted(map(tuple, cal)), sorted(map(tuple, again))):
        assert a[0] == b[0] and a[-1] == b[-1]
        assert a[1:-1] == pytest.approx(b[1:-1], rel=1e-12)


def test_too_few_rows_per_window_refused(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(500)], "id long, t double")
    with pytest.raises(ValueError):
        D.null_psi(df, ["id"], ["t"], [], n_windows=20)


def test_data_drift_thresholds_and_skips(spark):
    ref = _frame(spark, range(1000))
    cur = _frame(spark, [v + 500 for v in range(1000)])
    p = D.psi(ref, cur, ["x"], [])
    thr = spark.createDataFrame([("x", 0.01)], "feature string, threshold double")
    r = D.data_drift(p, thr).first()
    assert r["breaching"] == 1 and r["status"] == "checked"
    none = spark.createDataFrame([("other", 0.01)], "feature string, threshold double")
    r = D.data_drift(p, none).first()
    assert r["status"] == "skipped_no_threshold" and r["breaching"] == 0


def test_alert_state_two_window_confirmation(spark):
    def run(counts):
        df = spark.createDataFrame(list(enumerate(counts)), "w long, n long")
        return [r["confirmed"] for r in D.alert_state(df, "w", "n", 3, 2).orderBy("w").collect()]
    assert run([5])[-1] == 0
    assert run([5, 5])[-1] == 1
    assert run([5, 5, 0])[-1] == 0
    assert run([1, 1])[-1] == 0


def test_prediction_drift_requires_model_threshold(spark):
    df = spark.createDataFrame([(i, 0.1) for i in range(10)], "id long, score double")
    with pytest.raises(ValueError):
        D.prediction_drift(df, df, "score", ["id"], None)


def test_label_drift_refuses_small_or_single_class(spark):
    small = spark.createDataFrame([(i, i % 2, 0.5) for i in range(20)], "id long, label int, score double")
    r = D.label_drift(small, 0.5, ["id"], B=5).first()
    assert r["sufficient_labels"] == 0 and r["breaching"] == 0
    one = spark.createDataFrame([(i, 0, 0.5) for i in range(1000)], "id long, label int, score double")
    assert D.label_drift(one, 0.5, ["id"], B=5).first()["sufficient_labels"] == 0


def test_perturbations(spark):
    df = spark.createDataFrame([(i, float(i % 4), ["A", "B", "C"][i % 3]) for i in range(3000)],
                               "id long, n double, s string")
    sh = D.additive_shift(df, "n", 5, cap=6)
    assert sh.agg(F.max("n")).first()[0] == 6
    assert D.collapse(df, "s", "A").select("s").distinct().count() == 1
    rw = D.reweight_sample(df, "s", ["A"], 4.0, ["id"])
    shares = {r["s"]: r["count"] for r in rw.groupBy("s").count().collect()}
    assert shares["A"] > 1.5 * shares["B"]


def test_exact_quantiles_of_ties_nulls_and_few_or_many_buckets(spark):
    import numpy as np
    from driftline.operators.quantile import exact_quantiles
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=5000), rng.integers(0, 4, 5000).astype(float)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)], "x double, y double, z double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    for buckets in (1, 8, 300):
        got = {r["feature"]: r for r in exact_quantiles(df, ["x", "y", "z"], qs, n_buckets=buckets).collect()}
        assert np.allclose(got["x"]["q"], np.quantile(x, qs), atol=0, rtol=1e-12)
        assert np.allclose(got["y"]["q"], np.quantile(y, qs))
        assert got["z"]["q"] is None and got["z"]["n"] == 0


def test_grouped_quantiles_of_many_groups_hot_groups_and_null_keys(spark):
    import numpy as np
    from driftline.operators.quantile import grouped_quantiles
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.normal(size=4000)] + [("ties", 7.0)] * 3000 + [(None, float(v)) for v in rng.normal(50, 1, 40)]
    rows += [(f"g{i % 700}", float(v)) for i, v in enumerate(rng.exponential(size=5000))] + [("hot", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r["k"]: r for r in grouped_quantiles(df, "x", [0.05, 0.5, 0.99], ["k"], n_buckets=40).collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, v in by.items():
        assert got[k]["n"] == len(v) and np.allclose(got[k]["q"], np.quantile(v, [0.05, 0.5, 0.99]), rtol=1e-12)
    whole = grouped_quantiles(df, "x", [0.5]).collect()
    assert len(whole) == 1 and np.isclose(whole[0]["q"][0], np.median([v for _, v in rows if v is not None]))
    none = grouped_quantiles(df.where("k = 'nothing'"), "x", [0.5]).collect()
    assert [(r["q"], r["n"]) for r in none] == [(None, 0)] and grouped_quantiles(df.where("k = 'nothing'"), "x", [0.5], ["k"]).count() == 0


def test_psi_keeps_a_feature_without_values(spark):
    from driftline.operators.drift import psi
    df = spark.createDataFrame([(float(i), None) for i in range(50)], "a double, b double")
    got = {r["feature"]: r for r in psi(df, df, ["a", "b"]).collect()}
    assert set(got) == {"a", "b"} and got["b"]["degenerate"] == 1 and got["b"]["psi"] == 0.0


def test_reweighting_does_not_cap_copies(spark):
    from driftline.operators.drift import reweight_sample
    df = spark.createDataFrame([(i, "rare" if i < 20 else "common") for i in range(2000)], "id long, g string")
    got = {r["g"]: r["count"] for r in reweight_sample(df, "g", ["rare"], 5000.0, ["id"]).groupBy("g").count().collect()}
    assert abs(got["rare"] - 1961) < 150 and sum(got.values()) > 1800
