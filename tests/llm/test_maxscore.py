import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm import maxscore

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                        *[T.StructField(c, T.StringType()) for c in ("uid", "shard", "block", "v", "rank", "score", "theta", "kind")]])


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, *["z"] * 8) for i, v in rows], VECTORS).repartition(parts)


def brute(rows, k, step):
    """Python integers over all pairs of rows."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(whole):
        if q is None or q % step:
            continue
        scored = sorted((-min(max(sum(s * t for s, t in zip(x, y)), -2**63), 2**63 - 1), i is None, i or 0) for b, (i, y) in enumerate(whole) if a != b)
        out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(df, k, step, **options):
    got = maxscore.search(df, F.col("vec_id") % step == 0, k, **options).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_many_small_shards_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24)) / 5
    x[50:150] = x[:1] + rng.normal(size=(100, 24)) / 500                     # a cluster with close scores
    x[200:260] = x[7]                                                        # copies: ties
    x[300:] *= rng.random((100, 24)) < 0.15                                  # sparse vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, 10, 5)
    assert found(frame(spark, rows), 10, 5, shard_components=700, query_rows=13, sample=40) == want
    assert found(frame(spark, rows), 10, 5) == want
    assert found(frame(spark, rows), 10, 5, shard_components=900, sample=3) == want


def test_odd_vectors(spark):
    rng = random.Random(2)
    v = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(0, v(4)), (10, v(4)), (20, v(6)), (30, []), (40, [0.0] * 4), (50, None), (60, [1.0, None]), (70, [math.nan, 1.0]),
            (80, [math.inf]), (None, v(4)), (None, None), (1, v(4)), (10, v(4)), (90, [-1e-9, 0.0, 1e-9]), (100, [3e12, -2e12, 1.5, 0.0]),
            (110, [4e12, 0.3]), (2, v(300))]
    rows += [(3, rows[0][1]), (4, rows[0][1])]
    want = brute(rows, 10, 10)
    assert found(frame(spark, rows), 10, 10, shard_components=9, query_rows=2, sample=2) == want
    assert found(frame(spark, rows), 10, 10) == want
    assert [r for r in found(frame(spark, rows[:2]), 10, 10)] == brute(rows[:2], 10, 10)          # fewer than k candidates
    assert found(frame(spark, rows[:1]), 10, 10) == [] and found(frame(spark, []), 10, 10) == []


def test_pruning_leaves_out_work():
    """Non-essential terms are probed for a few vectors only, and hopeless shards not at all."""
    rng = np.random.default_rng(1)
    x = np.floor(1024 * rng.normal(size=(5000, 16)) * ([1.0] * 4 + [0.05] * 12)).astype(np.int64)
    shard = maxscore.Shard(np.arange(5000), np.arange(5000), np.ones(5000, bool), np.full(5000, 16), x.ravel())
    probed = []
    probe = shard.probe
    shard.probe = lambda t, w, docs, exact: probed.append(len(docs)) or probe(t, w, docs, exact)
    q = x[7].tolist()
    exact = sorted((-int(s), i) for i, s in enumerate(x @ x[7]) if i != 7)[:10]
    theta = -exact[-1][0]
    assert [(i, s) for i, s in shard.top(q, 10, 7, theta)] == [(i, -s) for s, i in exact]
    assert probed and max(probed) < 500
    probed.clear()
    assert shard.top(q, 10, 7, 1 << 40) == [] and not probed
