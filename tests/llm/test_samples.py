"""Samples for fitting are chosen by hash, not by the order of the rows."""

import numpy as np

from driftline.llm import ann, toxicity
from driftline.llm.common import hash_sample
from tests.llm.test_models import labelled, vectors


def test_hash_sample_ignores_row_order(spark):
    rows = [(i, float(i)) for i in range(3000)]
    one = spark.createDataFrame(rows, "id long, v double").coalesce(1)
    other = spark.createDataFrame(rows[::-1], "id long, v double").repartition(5)
    for size in (100, 1000, 2999):
        a, b = ({r["id"] for r in hash_sample(df, 3000, size, 3, "id").collect()} for df in (one, other))
        assert a == b and len(a) == size and abs(np.mean(list(a)) - 1500) < 300


def test_labels_sorted_by_class_keep_their_toxic_rows(spark):
    rows, labels = labelled(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = spark.createDataFrame(sorted(labels, key=lambda r: r[1]), "doc_id long, toxic int").coalesce(1)
    assert all(y == 0 for _, y in sorted(labels, key=lambda r: r[1])[:500])
    model = toxicity.fit(docs, ordered, sample=500)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.severity(docs, model).collect()}
    assert sum(got[i] == bool(y) for i, y in labels) >= 0.98 * len(labels)


def test_label_sample_bounds_classes_and_weighs_them(spark):
    known = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(5000)], "_id long, label int")
    taken, stands = toxicity.label_sample(known, 1000, 1)
    held = {r["label"]: r["count"] for r in taken.groupBy("label").count().collect()}
    assert held == {0: 900, 1: 100} and stands == {0: 4900 / 900, 1: 1.0}
    x = np.random.default_rng(2).integers(0, 2, 4000)
    grade = (np.random.default_rng(3).random(4000) < np.where(x, 0.5, 0.05)).astype(int)
    take = (grade == 1) | (np.arange(4000) % 4 == 0)
    sparse = lambda x: toxicity.Sparse([[0] if v else [] for v in x], [[1] if v else [] for v in x], 1)
    w, t = toxicity.cumulative_link(sparse(x), grade, 2, 1e-6)
    w2, t2 = toxicity.cumulative_link(sparse(x[take]), grade[take], 2, 1e-6, weight=np.where(grade[take], 1.0, 4.0))
    assert abs(t[0] - t2[0]) < 0.2 and abs(w[0] - w2[0]) < 0.4


def test_search_does_not_depend_on_row_order(spark):
    rows, chosen, fit = vectors(600), [], ann.fit_router

    def spy(x, *rest):
        chosen.append(x.copy())
        return fit(x, *rest)

    ann.fit_router = spy
    try:
        for r in (rows, rows[::-1]):
            ann.search(spark.createDataFrame(r, "vec_id long, embedding array<float>, part int, rank string").coalesce(1),
                       "vec_id % 100 = 0", k=5, parts=4, sample=400, degree=8, hidden=16).count()
    finally:
        ann.fit_router = fit
    assert len(chosen[0]) == 400 and (chosen[0] == chosen[1]).all()
