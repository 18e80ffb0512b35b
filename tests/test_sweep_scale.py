"""what the model queries repeated per pass: the ranking, the class counts, and the stages that a sweep leaves alone."""

import datetime as dt

from pyspark.sql import functions as F

from driftline.operators import ml as ML
from driftline.operators.order import global_rank
from driftline.plans import q_ml as Q


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(spark):
    return spark.range(400).select(
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("z"),
        F.expr("CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'b' ELSE 'a' END").alias("c"),
        F.expr("int((id * 37 + id % 7 * 60) % 400 > 200)").alias("label"))


def test_lineitem_is_ranked_once(spark, tmp_path, monkeypatch):
    day = dt.datetime(2024, 1, 1)
    rows = [(i // 4, i % 50, i % 9, i % 4, float(i % 50), float(i * 31 % 997), i % 11 / 100, i % 9 / 100,
             "RAN"[i % 3], "OF"[i % 2], day + dt.timedelta(days=i % 60)) for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, fit = [], ML.fit_levels

    def watched(df, *a, **k):
        seen.append(_plan(df))
        return fit(df, *a, **k)
    monkeypatch.setattr(ML, "fit_levels", watched)
    sp = Q._splits(spark, str(tmp_path))
    assert len(seen) == 1 and "Window" not in seen[0]
    assert {k: v.count() for k, v in sp.items()} == {"train": 228, "val": 76, "test": 76}
    assert {r[0] for r in sp["train"].select("l_linestatus").distinct().collect()} == {"O", "F"}


def test_class_counts_are_not_counted_again(spark):
    tw = ML.balanced_weights(_rows(spark), "label")
    assert "subquery" not in _plan(tw).lower()
    n, p = tw.agg(F.count("*"), F.sum("label")).first()
    assert {tuple(r) for r in tw.select("label", "weight").distinct().collect()} == {(1, n / (2 * p)), (0, n / (2 * (n - p)))}


def test_rank_does_not_filter_on_copies_of_its_key(spark):
    df = spark.range(500).selectExpr("timestamp_ntz '2024-01-01' + make_dt_interval(int(id * 7 % 90)) AS t0", "id")
    df = df.withColumn("t", F.col("t0").cast("timestamp")).drop("t0")
    r = global_rank(df, ["t", "id"], "rank", n_buckets=32)
    assert not [line for line in _plan(r).splitlines() if "Filter" in line and "<=" in line]
    want = {x["id"]: i for i, x in enumerate(sorted(df.collect(), key=lambda x: (x["t"], x["id"])), 1)}
    assert {x["id"]: x["rank"] for x in r.collect()} == want


def test_response_runs_the_other_stages_once(spark):
    df = _rows(spark)
    model = ML.fit_pipeline(ML.balanced_weights(df, "label"), ["x", "z"], ["c"], ML.logistic(1.0, 400.0))
    still, moving = ML._moved_by(model, "x")
    assert [type(s).__name__ for s in still] == ["StringIndexerModel", "OneHotEncoderModel"]
    assert len(still) + len(moving) == len(model.stages)
    got = ML.response(model, df, "x", [3, 0, 6])
    assert got.columns == [*df.columns, "_response"]
    by = {(r.x, r.z, r.c): r["_response"] for r in got.collect()}
    for i, g in enumerate([0.0, 3.0, 6.0]):
        naive = ML.score(model, df.withColumn("own", F.col("x")).withColumn("x", F.lit(g))).collect()
        assert all(by[(r.own, r.z, r.c)][i] == r.score for r in naive)
