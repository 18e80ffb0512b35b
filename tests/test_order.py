"""Global order, bins and plan shape."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from driftline.operators.order import equal_count_bin, global_rank, prefix_sum
from driftline.plans.views import t


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_rank_equals_row_number(spark):
    ev = t(spark, SF_SMALL, "events").select("event_id", "ts")
    got = global_rank(ev, ["ts", "event_id"], "rank")
    ref = ev.withColumn("rank2", F.row_number().over(Window.orderBy("ts", "event_id")))
    assert got.join(ref, "event_id").where("rank <> rank2").count() == 0
    assert got.count() == ev.count()


def test_global_rank_hot_key_is_split(spark):
    # one order value holds a third of the rows: the hot bucket is cut again on the tiebreak
    rows = [(0 if i % 3 == 0 else i, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, tb long")
    got = global_rank(df, ["k", "tb"], "r", n_buckets=8, rows_per_bucket=100).toPandas()
    exp = pd.DataFrame(rows, columns=["k", "tb"]).sort_values(["k", "tb"]).reset_index(drop=True)
    exp["r"] = np.arange(1, len(exp) + 1)
    m = got.merge(exp, on=["k", "tb"], suffixes=("", "_e"))
    assert (m["r"] == m["r_e"]).all() and len(m) == 6000


def test_no_single_partition_window_on_rows(spark):
    ev = t(spark, SF_SMALL, "events").select("event_id", "ts")
    p = _plan(global_rank(ev, ["ts", "event_id"], "rank"))
    # the row-level window is partitioned by bucket; SinglePartition appears only
    # on aggregated per-bucket counts
    assert "Window [row_number()" in p or "row_number()" in p
    for line in p.splitlines():
        if "Window" in line and "row_number" in line:
            assert "_dl_bucket" in line


def test_equal_count_bins_match_qcut(spark):
    for n in (10, 101, 1000, 101766 // 97):
        df = spark.range(1, n + 1).withColumnRenamed("id", "r")
        got = [x[0] for x in df.orderBy("r").select(equal_count_bin("r", n, 10)).collect()]
        exp = pd.qcut(pd.Series(np.arange(1, n + 1)), 10, labels=False).tolist()
        assert got == exp


def test_prefix_sum_with_keys(spark):
    rows = [(k, float(v), 1) for k in ("a", "b") for v in range(100)]
    df = spark.createDataFrame(rows, "k string, s double, one int")
    got = prefix_sum(df, "s", ["one"], ["k"], descending=True, n_buckets=4).toPandas()
    for k in ("a", "b"):
        g = got[got.k == k].sort_values("s", ascending=False)
        assert g["cum_one"].tolist() == list(range(1, 101))


def _rank_of(spark, rows, schema, cols, descending=False, target=40):
    from driftline.operators.order import global_rank
    df = spark.createDataFrame(rows, schema)
    got = global_rank(df, cols, "r", n_buckets=8, rows_per_bucket=target, descending=descending).collect()
    order = [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in map(F.col, cols)]
    want = [str(tuple(x)) for x in df.orderBy(*order).collect()]
    assert [str(tuple(x)[:-1]) for x in sorted(got, key=lambda x: x["r"])] == want
    assert sorted(x["r"] for x in got) == list(range(1, len(rows) + 1))


def test_rank_text_tiebreak_and_two_hot_columns(spark):
    rows = [(1 if i % 3 else i, f"key{'é' if i % 2 else 'a'}{i % 7:03d}", i) for i in range(900)]
    for down in (False, True):
        _rank_of(spark, rows, "a long, b string, c long", ["a", "b", "c"], down)
    rows = [(5, "same", i) for i in range(900)] + [(None, "x", 1000 + i) for i in range(300)]
    for down in (False, True):
        _rank_of(spark, rows, "a long, b string, c long", ["a", "b", "c"], down)


def test_rank_nulls_and_nan_follow_the_sort(spark):
    rows = [(float(i % 50), i) for i in range(500)] + [(None, 900), (float("nan"), 901), (float("inf"), 902), (float("-inf"), 903)]
    for down in (False, True):
        _rank_of(spark, rows, "a double, b long", ["a", "b"], down)


def test_descending_prefix_sum_counts_a_null_key_last(spark):
    from driftline.operators.order import prefix_sum
    df = spark.createDataFrame([(4.0, 5), (3.0, 3), (2.0, 2), (None, 1)], "s double, v long")
    got = {r["s"]: r["cum_v"] for r in prefix_sum(df, "s", ["v"], descending=True).collect()}
    assert got == {4.0: 5, 3.0: 8, 2.0: 10, None: 11}


def _largest_part(spark, rows, schema, cols, target, keys=(), descending=False):
    from driftline.operators import order as O
    df = spark.createDataFrame(rows, schema).repartition(4)
    b, _ = O.bucketize(df, F.col(cols[0]), 8, descending)
    split, parts = O._split_overfull(b, list(keys), cols, target, descending)
    sizes = [r["count"] for r in split.groupBy(*keys, *parts).count().collect()]
    assert sum(sizes) == len(rows)
    return max(sizes)


def test_overfull_buckets_are_split_until_none_is_left(spark):
    """One leading value with text tiebreaks behind a long common prefix; two hot values a bucket; large whole numbers."""
    text = [(7, f"common-prefix-{'é' * (i % 3)}{i:06d}") for i in range(20_000)]
    two = [(1.0 if i % 2 else 1.0 + 1e-12, i) for i in range(6000)] + [(float(i), i) for i in range(500)]
    large = [(0, 2**62 + i) for i in range(5000)]
    for down in (False, True):
        assert _largest_part(spark, text, "a int, b string", ["a", "b"], 500, descending=down) <= 2000
        assert _largest_part(spark, two, "a double, b long", ["a", "b"], 100, descending=down) <= 400
        assert _largest_part(spark, large, "a int, b long", ["a", "b"], 100, descending=down) <= 400
        _rank_of(spark, text[:3000], "a int, b string", ["a", "b"], down)
        _rank_of(spark, two[:3000], "a double, b long", ["a", "b"], down)
        _rank_of(spark, large[:2000], "a int, b long", ["a", "b"], down)
    # rows that agree in all order columns stay together, and the search for more ends
    assert _largest_part(spark, [(1, "x")] * 3000, "a int, b string", ["a", "b"], 100) == 3000


def test_keyed_rank_keeps_rows_of_a_null_key(spark):
    from driftline.operators.order import global_rank
    df = spark.createDataFrame([(None if i % 3 else "k", i) for i in range(300)], "k string, v long")
    got = global_rank(df, ["v"], "r", keys=["k"], n_buckets=4, rows_per_bucket=20).collect()
    assert sorted(r["r"] for r in got if r["k"] is None) == list(range(1, 201)) and len(got) == 300
