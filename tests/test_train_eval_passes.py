"""F2: candidates that share their preprocessed rows, hot scores drawn once, running sums without a filter by bucket."""

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from driftline.operators import bootstrap as BS
from driftline.operators import metrics as M
from driftline.operators import ml as ML
from driftline.operators.order import prefix_sum
from driftline.plans import q_ml as Q


def test_candidates_share_one_preprocessor(spark, monkeypatch):
    n = F.col("id")
    rows = spark.range(300).select(*[(n * (7 + i) % 23).cast("double").alias(c) for i, c in enumerate(Q.NUM)], F.when(n % 3 == 0, "O").otherwise("F").alias(
        Q.CAT[0]), (n * 7 % 23 + n % 11 > 15).cast("int").alias("label"), *[n.alias(c) for c in Q.ORDER if c not in Q.NUM]).checkpoint()
    sp = dict.fromkeys(("train", "val", "test"), rows)
    monkeypatch.setattr(Q, "_splits", lambda *_: sp)
    monkeypatch.setattr(ML, "forest", lambda: DecisionTreeClassifier(labelCol="label", weightCol="weight", maxDepth=2))
    seen, made = [], ML.preprocessor
    monkeypatch.setattr(ML, "preprocessor", lambda *a, **k: seen.append(1) or made(*a, **k))
    assert [c[0] for c in Q._candidates(spark, "")] == ["logistic_c1", "logistic_c005", "forest", "prior"]
    assert len(seen) == 1


def test_hot_scores_are_drawn_once(spark, monkeypatch):
    rows = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.when(F.col("id") % 5 < 4, 0.25).otherwise(F.col("id") / 3000).alias("score"))
    seen, combined = [], BS._combined
    monkeypatch.setattr(BS, "_combined", lambda *a, **k: seen.append(a[3]) or combined(*a, **k))
    reps = {r["b"]: r for r in BS.replicate_metrics(rows, ["id"], B=20).collect()}
    assert len(seen) == 2
    want = M.rank_metrics(M.score_curve(rows)).first()
    assert reps[20]["average_precision"] == pytest.approx(want["average_precision"]) and reps[20]["roc_auc"] == pytest.approx(want["roc_auc"])


def test_running_sums_do_not_filter_by_bucket(spark):
    own = F.udf(lambda v: v, "double")
    rows = spark.range(200).select(F.when(F.col("id") >= 0, F.col("id").cast("double")).alias("v")).select(own("v").alias("s"), F.lit(1).alias("n"))
    out = prefix_sum(rows, "s", ["n"], n_buckets=8)
    # on the side of the few offsets alone, not of the rows (a copy of the score's expression for each cut)
    assert "isnotnull((" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["cum_n"] for r in out.orderBy("s").collect()] == list(range(1, 201))
