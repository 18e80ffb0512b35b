"""trees of large tables on counted cells."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from driftline.operators import ml as ML
from driftline.operators import trees as TR

NUM, CAT = ["x", "z"], ["c"]


@pytest.fixture(scope="module")
def df(spark):
    def h(i, n):
        return F.pmod(F.hash("id", F.lit(i)), F.lit(n))
    p = 25 + F.when(h(1, 20) > 12, 30).otherwise(0) + F.when(h(2, 7) > 3, 15).otherwise(0)
    return spark.range(6000).select(
        h(1, 20).cast("double").alias("x"), h(2, 7).cast("double").alias("z"), F.when(h(3, 3) == 0, "b").otherwise("a").alias("c"),
        (h(4, 100) < p).cast("int").alias("label")).checkpoint()


@pytest.fixture
def on_cells(monkeypatch):
    monkeypatch.setattr(TR, "LARGE", 1)


def _both(df, estimator, monkeypatch):
    a = ML.fit_pipeline(df, NUM, CAT, estimator)
    monkeypatch.setattr(TR, "LARGE", 10 ** 9)
    b = ML.fit_pipeline(df, NUM, CAT, estimator)
    assert isinstance(a.stages[-1], TR.CellTrees) and not isinstance(b.stages[-1], TR.CellTrees)
    return a, b


@pytest.mark.parametrize("depth,least", [(30, 1), (4, 50)])
def test_a_tree_on_cells_is_mllibs_tree(df, on_cells, monkeypatch, depth, least):
    a, b = _both(df, DecisionTreeClassifier(labelCol="label", maxDepth=depth, minInstancesPerNode=least, maxBins=64, seed=42), monkeypatch)
    assert a.stages[-1].depth == b.stages[-1].depth
    got = ML.score(b, ML.score(a, df, "p"), "q").agg(F.count(F.lit(1)), F.max(F.abs(F.col("p") - F.col("q")))).first()
    assert got[0] == 6000 and got[1] <= 1e-12
    counts = {(r["label"], round(r["score"], 9)): r["_n"] for r in ML.score_counts(a, df, ["label"]).collect()}
    assert counts == {(r["label"], r["s"]): r["count"] for r in ML.score(b, df).groupBy("label", F.round("score", 9).alias("s")).count().collect()}


def test_a_forest_on_cells_agrees_with_mllibs(df, on_cells, monkeypatch):
    a, b = _both(ML.balanced_weights(df, "label"), ML.forest(num_trees=40), monkeypatch)
    other = ML.fit_pipeline(ML.balanced_weights(df, "label"), NUM, CAT, ML.forest(num_trees=40, seed=7))     # MLlib, another seed
    assert len(a.stages[-1].trees) == 40 and a.stages[-1].depth <= 6
    s = ML.score(other, ML.score(b, ML.score(a, df, "p"), "q"), "r").agg(
        F.avg(F.abs(F.col("p") - F.col("q"))).alias("pq"), F.avg(F.abs(F.col("q") - F.col("r"))).alias("qr"), F.corr("p", "q").alias("c")).first()
    assert s["pq"] < 2 * s["qr"] and s["c"] > 0.99


def test_rows_of_many_cells_and_few_rows_go_to_mllib(df, monkeypatch):
    est = DecisionTreeClassifier(labelCol="label", maxDepth=3)
    assert not isinstance(ML.fit_pipeline(df, NUM, CAT, est).stages[-1], TR.CellTrees)
    monkeypatch.setattr(TR, "LARGE", 1)
    monkeypatch.setattr(TR, "ROWS_A_CELL", 1000)
    assert not isinstance(ML.fit_pipeline(df, NUM, CAT, est).stages[-1], TR.CellTrees)


def test_least_rows_weights_and_merged_leaves():
    bins, y = np.array([[0], [0], [1], [1], [2], [2]], np.uint16), np.array([0, 1, 0, 1, 0, 1])
    n = np.array([90, 10, 10, 90, 3, 4])
    t = TR.grow(bins, [3], y, np.ones(6), n, 5, 1)
    assert t.depth == 1 and t.at[0] == 0                          # a cut of 2 from 1 would part leaves of one prediction
    assert t.score(bins).tolist() == pytest.approx([.1, .1, 94 / 107, 94 / 107, 94 / 107, 94 / 107])
    assert TR.grow(bins, [3], y, np.ones(6), n, 5, 101).depth == 0
    w = np.array([1, 2, 1, 2, 1, 2.0])
    a, b = TR.grow(bins, [3], y, w, n, 5, 1), TR.grow(bins, [3], y, w + np.array([1e-13, 0, 0, 0, 0, 0]), n, 5, 1)
    assert a.score(bins).tolist() == pytest.approx(b.score(bins).tolist()) and a.p[0] == pytest.approx(208 / 311)


def test_bins_are_closed_above_and_hold_nan_and_infinity(spark):
    grid = TR.Grid(((1.0, 2.0), (), (0.5,)))
    rows = [(1.0, 0.0, 0.5), (1.0000001, 9.0, 0.6), (float("nan"), 0.0, float("-inf")), (float("inf"), 0.0, float("nan"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double")
    from pyspark.ml.functions import array_to_vector
    got = grid.coded(df.select("i", array_to_vector(F.array("a", "b", "c")).alias("v")), "v").orderBy("i").collect()
    assert grid.bins(np.array([r["_cell"] for r in got])).tolist() == [[0, 0, 0], [1, 0, 1], [2, 0, 0], [2, 0, 1]]


def test_separability_is_the_same_on_cells(df, on_cells, monkeypatch):
    train, test = df.where(F.pmod(F.hash("x", "z", "c", "label", F.spark_partition_id()), F.lit(2)) == 0).checkpoint(), df
    seen, scored = [], ML.score
    monkeypatch.setattr(ML, "score", lambda *a, **k: seen.append(1) or scored(*a, **k))
    on = ML.separability(train, test, NUM, CAT).first()
    assert not seen                                               # rows are counted, not scored one by one
    monkeypatch.setattr(TR, "LARGE", 10 ** 9)
    off = ML.separability(train, test, NUM, CAT).first()
    assert seen and tuple(on) == pytest.approx(tuple(off)) and on["depth"] > 3


def test_values_that_mllib_refuses_are_refused_on_large_tables(df, on_cells):
    broken = df.withColumn("x", F.when(F.col("z") < 6, F.col("x")))
    with pytest.raises(Exception, match="NaN or Infinity"):
        ML.fit_pipeline(broken, NUM, CAT, DecisionTreeClassifier(labelCol="label", maxDepth=3))
