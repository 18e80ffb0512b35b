"""Work that one task did, or that was done several times: bootstrap without keys, scored tables, null pairs."""

import numpy as np

from driftline.operators import bootstrap as BS


def test_bootstrap_without_keys_keeps_its_tasks(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, (i * 37 % 101) / 101) for i in range(300)], "id long, y boolean, score double")
    df = df.selectExpr("id", "int(y) AS label", "score")
    reps = BS.replicate_metrics(df, ["id"], B=5)
    assert "Coalesce" not in reps._jdf.queryExecution().toString()
    assert reps.count() == 6


def test_bucket_counts_ties_across_chunks():
    rng = np.random.default_rng(1)
    n, width = 150, 7
    score = np.sort(rng.integers(0, 12, n) / 12)[::-1]
    y, w, sq = (rng.random(n) < 0.4).astype(float), rng.integers(0, 3, (n, width)).astype(float), rng.random(n)
    bucket = BS._Bucket(width)
    bucket.start(np.full(width, 3.0), np.full(width, 2.0))
    for a in range(0, n, 32):
        bucket.add(score[a:a + 32], w[a:a + 32], y[a:a + 32], sq[a:a + 32])
    ap, s, p, neg = np.zeros(width), np.zeros(width), np.full(width, 3.0), np.full(width, 2.0)
    for v in sorted(set(score), reverse=True):
        at = score == v
        gp, gn = (w[at] * y[at, None]).sum(0), (w[at] * (1 - y[at, None])).sum(0)
        p, neg = p + gp, neg + gn
        ap += gp * p / (p + neg)
        s += gp * (neg - gn / 2)
    got = bucket.result()
    for want, have in zip((ap, s, sq @ w, p - 3, neg - 2), got):
        assert np.allclose(want, have, rtol=1e-12)


def test_count_windows_open_a_batch_once(spark, tmp_path):
    from driftline.streaming.stream import CountWindows
    opened, seen = [], {}

    class Counted(CountWindows):
        def _read(self, spark, runs):
            opened.append(len(runs))
            return super()._read(spark, runs)
    cw = Counted(str(tmp_path), ["id"], 10, on_window=lambda df, w: seen.update({w: sorted(r.id for r in df.collect())}))
    for epoch in range(2):
        cw.process(spark.range(epoch * 65, epoch * 65 + 65).select("id"), epoch)
    assert seen == {w: list(range(10 * w, 10 * w + 10)) for w in range(13)}
    assert len(opened) == 3                  # a batch's own run, and the window that began in the one before


def test_reweighted_copies_are_drawn_once(spark):
    from driftline.operators import drift as D
    df = spark.range(400).selectExpr("id", "IF(id % 4 = 0, 'a', 'b') AS seg")
    r = D.reweight_sample(df, "seg", ["a"], 30.0, ["id"])
    assert r.columns == ["id", "seg", "copy"] and "Filter (" not in r._jdf.queryExecution().optimizedPlan().toString()
    per = {x["id"]: x["c"] for x in r.groupBy("id").agg({"copy": "collect_set"}).toDF("id", "c").collect()}
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in per.values())
    assert r.count() == sum(map(len, per.values()))


def test_compressed_log_files_are_bounded(spark, tmp_path):
    from driftline.sources import files as FS
    path = str(tmp_path / "log")
    FS.append_ndjson(spark.range(10, numPartitions=1).selectExpr("id AS outcome_label"), path, "gzip", 4)
    assert len(list((tmp_path / "log").glob("*.json.gz"))) == 3
    good, bad = FS.read_ndjson(spark, path, FS.OUTCOME_SCHEMA)
    assert good.count() == 10 and bad.first()[0] == 0
