"""Fitted models exported as tables and computed again in SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from driftline.operators import metrics as M
from driftline.operators import ml as ML
from driftline.plans import q_ml as Q


@pytest.fixture(scope="module")
def split(spark):
    return Q._splits(spark, SF_SMALL)


@pytest.fixture(scope="module")
def con(split):
    c = duckdb.connect()
    for k in ("train", "val", "test"):
        c.register(k, split[k].toPandas())
    return c


def _export(con, model):
    """Means, deviations, levels, coefficients and intercept of a fitted pipeline as the table ``coef``."""
    numeric, scaler, lr = model.stages[0], model.stages[1], model.stages[-1]
    w, at, rows = lr.coefficients.toArray(), 0, [("intercept", "", 0.0, 1.0, float(lr.intercept))]
    for c, m, s in zip(numeric.getInputCols(), scaler.mean, scaler.std):
        rows.append(("num", c, float(m), float(s), float(w[at])))
        at += 1
    for i in range(2, len(model.stages) - 2, 2):
        indexer, encoder = model.stages[i], model.stages[i + 1]
        for level in indexer.labelsArray[0][:encoder.categorySizes[0] - (0 if encoder.getHandleInvalid() == "keep" else 1)]:
            rows.append((indexer.getInputCol(), level, 0.0, 1.0, float(w[at])))
            at += 1
    con.execute("CREATE OR REPLACE TABLE coef (kind VARCHAR, name VARCHAR, mean DOUBLE, std DOUBLE, w DOUBLE)")
    con.executemany("INSERT INTO coef VALUES (?, ?, ?, ?, ?)", rows)


def _scores_sql(table):
    terms = " + ".join(f"(SELECT w * ({c} - mean) / std FROM coef WHERE kind = 'num' AND name = '{c}')" for c in Q.NUM)
    cats = " + ".join(f"coalesce((SELECT w FROM coef k WHERE k.kind = '{c}' AND k.name = t.{c}), 0)" for c in Q.CAT)
    key = ", ".join(Q.ORDER[:4])
    return f"SELECT {key}, label, 1 / (1 + exp(-((SELECT w FROM coef WHERE kind = 'intercept') + {terms} + {cats}))) AS score FROM {table} t"


def test_logistic_scores_weights_and_labels(spark, split, con):
    """Scores from the exported pipeline, the weights it was fitted with, labels at its own threshold."""
    model = Q._fit_lr(split["train"])
    _export(con, model)
    got = {tuple(r[c] for c in Q.ORDER[:4]): r["score"] for r in ML.score(model, split["test"]).collect()}
    want = con.sql(_scores_sql("test")).fetchall()
    assert len(want) == len(got) and all(got[tuple(r[:4])] == pytest.approx(r[5], abs=1e-9) for r in want)
    weights = dict(ML.balanced_weights(split["train"], "label").select("label", "weight").distinct().collect())
    n, p = con.sql("SELECT count(*), sum(label) FROM train").fetchall()[0]
    assert weights == {1: pytest.approx(n / (2 * p)), 0: pytest.approx(n / (2 * (n - p)))}
    # the fit is the optimum of the weighted, penalised likelihood: its gradient in SQL is zero
    grad = con.sql(f"SELECT sum(g * ({Q.NUM[0]} - m) / s), sum(g) FROM (SELECT (1 / (1 + exp(-z)) - label) * CASE label WHEN 1 THEN {n / (2 * p)} "
                   f"ELSE {n / (2 * (n - p))} END AS g, * FROM (SELECT *, ln(score / (1 - score)) AS z FROM ({_scores_sql('train')}) "
                   f"JOIN train USING ({', '.join(Q.ORDER[:4])}, label)), (SELECT mean AS m, std AS s FROM coef WHERE name = '{Q.NUM[0]}'))").fetchall()[0]
    w0 = con.sql(f"SELECT w FROM coef WHERE name = '{Q.NUM[0]}'").fetchall()[0][0]
    assert abs(grad[0] + w0) < 0.01 * n and abs(grad[1]) < 0.01 * n
    thr = M.choose_threshold(M.score_curve(ML.score(model, split["val"]).select("label", "score")), Q.TARGET_RECALL).first()["threshold"]
    best = con.sql(f"WITH s AS ({_scores_sql('val')}), c AS (SELECT v.score AS t, sum((s.score >= v.score AND s.label = 1)::INT) AS tp, "
                   "sum((s.score >= v.score)::INT) AS n FROM (SELECT DISTINCT score FROM s) v, s GROUP BY 1) "
                   f"SELECT t FROM c WHERE tp >= {Q.TARGET_RECALL} * (SELECT sum(label) FROM s) ORDER BY tp / n DESC, t LIMIT 1").fetchall()
    assert not best or best[0][0] == pytest.approx(thr, abs=1e-9)
    labelled = ML.label_at(ML.score(model, split["test"]).withColumn("t", F.lit(thr)), "score", "t").groupBy("predicted_label").count().collect()
    assert {r[0]: r[1] for r in labelled} == dict(con.sql(f"SELECT (score >= {thr!r} - 1e-12)::INT, count(*) FROM ({_scores_sql('test')}) GROUP BY 1").fetchall())


def test_prior_and_calibration(spark, split, con):
    """The prior; isotonic and sigmoid maps from their exported parameters; the one of lower ECE is chosen."""
    prior = ML.prior_score(split["train"], split["test"]).select("score").distinct().collect()
    assert [r[0] for r in prior] == [pytest.approx(con.sql("SELECT avg(label) FROM train").fetchall()[0][0])]
    model = Q._fit_lr(split["train"])
    val = ML.score(model, split["val"]).select("label", "score").checkpoint()
    con.register("scored", val.toPandas())
    iso, sig = ML.fit_isotonic(val), ML.fit_sigmoid(val)
    con.execute("CREATE OR REPLACE TABLE steps AS SELECT unnest(?::DOUBLE[]) AS x, unnest(?::DOUBLE[]) AS y", [list(iso.boundaries), list(iso.predictions)])
    a, b = float(sig.stages[-1].coefficients[0]), float(sig.stages[-1].intercept)
    want = con.sql(f"""WITH d AS (SELECT DISTINCT score FROM scored)
        SELECT score, 1 / (1 + exp(-({a!r} * score + {b!r}))) AS sig,
               CASE WHEN lo.x IS NULL THEN (SELECT arg_min(y, x) FROM steps) WHEN hi.x IS NULL OR lo.x = score THEN lo.y
                    ELSE lo.y + (hi.y - lo.y) * (score - lo.x) / (hi.x - lo.x) END AS iso
        FROM d LEFT JOIN LATERAL (SELECT max(x) AS x, arg_max(y, x) AS y FROM steps WHERE x <= score) lo ON true
               LEFT JOIN LATERAL (SELECT min(x) AS x, arg_min(y, x) AS y FROM steps WHERE x > score) hi ON true""").fetchall()
    got_i = {r["score"]: r["cal_score"] for r in ML.apply_calibration("isotonic", iso, val).collect()}
    got_s = {r["score"]: r["cal_score"] for r in ML.apply_calibration("sigmoid", sig, val).collect()}
    for x, s, i in want:
        assert got_s[x] == pytest.approx(s, abs=1e-9) and got_i[x] == pytest.approx(i, abs=1e-6)
    method, _, report = ML.choose_calibration(val)
    e = {r["method"]: r["ece"] for r in report.collect()}
    assert method == min(sorted(e), key=e.get)


def test_trees_by_their_splits(spark, split, con):
    """A forest's scores from its exported nodes, walked by a recursive query."""
    model = ML.fit_pipeline(ML.balanced_weights(split["train"], "label"), Q.NUM, Q.CAT, ML.forest(num_trees=4, depth=3, min_leaf=5))
    jvm_trees = model.stages[-1]._java_obj.trees()
    nodes = []

    def walk(tree, node, path):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            nodes.append((tree, path, None, None, stats[1] / sum(stats)))
            return
        sp = node.split()
        low, high, at = node.leftChild(), node.rightChild(), 0.5
        if sp.getClass().getSimpleName() == "ContinuousSplit":
            at = sp.threshold()
        elif 0.0 not in list(sp.leftCategories()):                         # an indicator: 0 or 1
            low, high = high, low
        nodes.append((tree, path, sp.featureIndex(), at, None))
        walk(tree, low, path + "l")
        walk(tree, high, path + "r")
    for i in range(len(jvm_trees)):
        walk(i, jvm_trees[i].rootNode(), "")
    con.execute("CREATE OR REPLACE TABLE nodes (tree INT, path VARCHAR, feature INT, threshold DOUBLE, p DOUBLE)")
    con.executemany("INSERT INTO nodes VALUES (?, ?, ?, ?, ?)", nodes)
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(split["test"].limit(300)).select(vector_to_array("features").alias("f"), vector_to_array("probability")[1].alias("score"))
    con.register("rows", scored.toPandas().reset_index(names="id"))
    want = con.sql("""WITH RECURSIVE w AS (SELECT id, f, tree, path, feature, threshold, p FROM rows, nodes WHERE path = ''
        UNION ALL SELECT w.id, w.f, n.tree, n.path, n.feature, n.threshold, n.p FROM w JOIN nodes n ON n.tree = w.tree
        AND n.path = w.path || CASE WHEN w.f[w.feature + 1] <= w.threshold THEN 'l' ELSE 'r' END WHERE w.feature IS NOT NULL)
        SELECT r.score, avg(w.p) FROM w JOIN rows r USING (id) WHERE w.feature IS NULL GROUP BY id, r.score""").fetchall()
    assert len(want) == con.sql("SELECT count(*) FROM rows").fetchall()[0][0]
    assert all(a == pytest.approx(b, abs=1e-9) for a, b in want)


def test_level_folding_needs_no_list_of_levels(spark):
    rows = [("a",)] * 40 + [("b",)] * 35 + [(f"rare{i}",) for i in range(5)] + [(None,)] * 3
    df = spark.createDataFrame(rows, "c string").withColumn("d", F.lit("only"))
    levels = ML.fit_levels(df, ["c", "d"])
    new = spark.createDataFrame([("a", "only"), ("rare1", "unseen"), ("unseen", None), (None, "only")], "c string, d string")
    got = [tuple(r) for r in levels.fold(new).collect()]
    assert sorted(got, key=str) == sorted([("a", "only"), (ML.INFREQUENT, None), (ML.INFREQUENT, None), (ML.INFREQUENT, "only")], key=str)
    assert sorted((r["column_name"], r["level"]) for r in levels.frequent.collect()) == [("c", "a"), ("c", "b"), ("d", "only")]
