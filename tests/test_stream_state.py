"""Streaming state lives on disk: restarts and repeated batches change nothing."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import scratch_dir
from driftline.streaming import stream as ST


def _outcomes(spark, rows):
    return spark.createDataFrame(rows, "id long, ts long, label int")


def test_upsert_survives_restart_and_repeated_batch(spark):
    base = scratch_dir(spark, "lww")
    make = lambda: ST.OutcomeTable(base, "id", "ts", leaf_rows=2)
    make().upsert(_outcomes(spark, [(1, 1, 0), (2, 1, 0), (3, 5, 1)]), 0)
    make().upsert(_outcomes(spark, [(2, 3, 1), (3, 4, 0), (9, 1, 1)]), 1)
    make().upsert(_outcomes(spark, [(2, 3, 1), (3, 4, 0), (9, 1, 1)]), 1)      # the batch is run again
    make().upsert(_outcomes(spark, [(4, 1, 1)]), 2)
    got = sorted(tuple(r) for r in make().current(spark).select("id", "ts", "label").collect())
    assert got == [(1, 1, 0), (2, 3, 1), (3, 5, 1), (4, 1, 1), (9, 1, 1)]


def test_count_windows_survive_restart_and_repeated_batch(spark):
    base, seen = scratch_dir(spark, "windows"), []
    make = lambda: ST.CountWindows(base, ["ts", "id"], 10, lambda df, w: seen.append((w, df.count())))
    part = lambda a, b: spark.range(a, b).select("id", (F.col("id") * 2).alias("ts"))
    make().process(part(0, 7), 0)
    make().process(part(7, 25), 1)
    make().process(part(7, 25), 1)
    make().process(part(25, 31), 2)
    counts = {r["window_id"]: r["count"] for r in make().log(spark).groupBy("window_id").count().collect()}
    assert counts == {0: 10, 1: 10, 2: 10, 3: 1} and set(seen) == {(0, 10), (1, 10), (2, 10)}


def test_count_windows_merge_runs_and_drop_superseded_ones(spark):
    """Runs stay logarithmic in the batches, positions are gapless, a repeated batch changes nothing, and a window
    reads the runs that overlap it only."""
    base, seen = scratch_dir(spark, "runs"), {}
    make = lambda: ST.CountWindows(base, ["ts", "id"], 5, lambda df, w: seen.update(
        {w: (sorted(r["id"] for r in df.collect()), len(df.inputFiles()))}), fan=3)
    at = 0
    for e in range(11):
        n = 0 if e == 4 else 3 + e % 3
        batch = spark.range(at, at + n, numPartitions=1).select("id", F.col("id").alias("ts"))
        make().process(batch, e)
        if e in (2, 8):                                                        # the batch is run again
            make().process(batch, e)
        at += n
    runs = make().runs(spark)
    assert runs[0][2] == 1 and runs[-1][3] == at and all(a[3] + 1 == b[2] for a, b in zip(runs, runs[1:]))
    assert [r[1] for r in runs] == [2, 0]                                      # ten batches with rows: 9 merged twice, 1 left
    assert sorted((r["_pos"], r["id"]) for r in make().log(spark).collect()) == [(i + 1, i) for i in range(at)]
    assert {w: rows for w, (rows, _) in seen.items()} == {w: list(range(5 * w, 5 * w + 5)) for w in range(at // 5)}
    named = {f"{base}/data/e{e}/t{t}" for e, t, *_ in runs}
    assert len({f.rsplit("/", 1)[0].split(":", 1)[-1] for f in _files(spark, f"{base}/data")} - {n.split(":", 1)[-1] for n in named}) <= 4
    assert len(ST.committed_batches(spark, f"{base}/index", 1 << 62)) <= 3


def test_watchdog_state_sees_few_rows_of_a_hot_key(spark):
    """A key with a third of all rows and one event in an otherwise empty day: gaps equal a plain search."""
    import datetime as dt
    base, t0 = scratch_dir(spark, "watchdog"), dt.datetime(2024, 1, 1)
    times = {1: [i * 7 for i in range(3000)] + [40_000, 40_001], 2: [0, 3599, 7200, 10_800, 14_401], None: [5, 50_000],
             3: [i * 31 for i in range(500)] + [90_000]}
    rows = [(k, t0 + dt.timedelta(seconds=s)) for k, ts in times.items() for s in ts] + [(2, None)]
    ST.write_ordered(spark, spark.createDataFrame(rows, "host long, ts timestamp"), "ts", f"{base}/in", files=4)
    sch = T.StructType([T.StructField("host", T.LongType()), T.StructField("ts", T.TimestampType())])
    s = ST.file_stream(spark, f"{base}/in", sch)
    got = ST.run_available_now(ST.heartbeat_watchdog(s, "host", "ts", "1 hour", "10 minutes"), f"{base}/out", f"{base}/ckpt").collect()
    want = {(k, a, b) for k, ts in times.items() for a, b in zip(sorted(ts), sorted(ts)[1:]) if b - a > 3600}
    at = lambda x: int((x - t0).total_seconds())
    assert {(r["host"], at(r["last_seen"]), at(r["next_seen"])) for r in got if r["alert"] == "heartbeat_gap"} == want
    assert all(r["next_seen"] is None for r in got if r["alert"] == "heartbeat_missing")
    assert len([r for r in got if r["alert"] == "heartbeat_gap"]) == len(want)


def test_replayed_ids_are_dropped_within_the_watermark(spark):
    """Ids sent again within the delay, in the same file or a later one, count once."""
    import datetime as dt
    base, t0 = scratch_dir(spark, "replay"), dt.datetime(2024, 1, 1)
    rows = [(i % 40, t0 + dt.timedelta(seconds=i)) for i in range(120)]
    ST.write_ordered(spark, spark.createDataFrame(rows, "id long, ts timestamp"), "ts", f"{base}/in", files=3)
    sch = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType())])
    s = ST.dedupe(ST.with_event_time(ST.file_stream(spark, f"{base}/in", sch), "ts", "10 minutes"), "id")
    got = ST.run_available_now(s, f"{base}/out", f"{base}/ckpt").collect()
    assert sorted(r["id"] for r in got) == list(range(40))


def test_ndjson_stream_sends_malformed_lines_aside(spark):
    base = scratch_dir(spark, "ndjson")
    spark.createDataFrame([('{"a": 1}',), ("{bad",), ('{"a": 2}',)], "value string").coalesce(1).write.text(f"{base}/in")
    s = ST.ndjson_stream(spark, f"{base}/in", T.StructType([T.StructField("a", T.IntegerType())]))
    ST.run_foreach_batch(s, ST.split_malformed(f"{base}/good", f"{base}/bad"), f"{base}/ckpt")
    assert sorted(r["a"] for r in spark.read.parquet(f"{base}/good/e0").collect()) == [1, 2]
    assert spark.read.parquet(f"{base}/bad/e0").count() == 1


def _files(spark, path):
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    it, out = fs.listFiles(jvm.org.apache.hadoop.fs.Path(path), True), []
    while it.hasNext():
        f = it.next()
        if f.getPath().getName().endswith(".parquet"):
            out.append(f.getPath().toString())
    return out


def test_small_batches_rewrite_little_and_leaves_split(spark):
    """A 1 % batch writes under a tenth of a large table; superseded files go; leaves follow the table's size."""
    base, n = scratch_dir(spark, "lsm"), 20_000
    table = ST.OutcomeTable(base, "id", "ts", leaf_rows=1000, max_deltas=4)
    table.upsert(spark.range(n).select("id", F.lit(0).cast("long").alias("ts"), F.lit(0).alias("label")), 0)
    leaves = {(r[0], r[1]) for r in table._index(spark, 1)}
    assert len(leaves) == 32 and sum(r[4] for r in table._index(spark, 1)) == n
    want, total = {i: 0 for i in range(n)}, 0
    for e in range(1, 8):
        ids = [(i * 7919 + e) % (n + 300) for i in range(200)]
        table.upsert(spark.createDataFrame([(i, e, 1) for i in ids], "id long, ts long, label int"), e)
        if e in (3, 5):                                                        # the batch is run again
            table.upsert(spark.createDataFrame([(i, e, 1) for i in ids], "id long, ts long, label int"), e)
        want |= {i: e for i in ids}
        wrote = spark.read.parquet(f"{base}/data/e{e}").count()
        total += wrote
        assert wrote < 0.1 * n or e == 4                                       # max_deltas: every leaf is rewritten once in four
    assert total < 7 * 200 + 1.1 * n
    assert {r["id"]: r["ts"] for r in table.current(spark).collect()} == want
    names = [f.split("/data/")[1].split("/")[0] for f in _files(spark, f"{base}/data")]
    assert "e0" not in names and set(names) <= {f"e{e}" for e in range(4, 8)}


def test_outcome_table_takes_null_ids_ties_and_empty_batches(spark):
    table = ST.OutcomeTable(scratch_dir(spark, "odd"), "id", "ts", ["label"], leaf_rows=2)
    table.upsert(_outcomes(spark, []), 0)
    assert table.current(spark) is None
    table.upsert(_outcomes(spark, [(None, 1, 0), (None, 2, 1), (5, 1, 0), (5, 1, 3), (6, None, 1), (7, 1, 1), (8, 1, 1)]), 1)
    table.upsert(_outcomes(spark, [(6, 0, 2), (5, 1, 2), (None, 1, 9)]), 2)
    table.upsert(_outcomes(spark, []), 3)
    got = sorted((tuple(r) for r in table.current(spark).select("id", "ts", "label").collect()), key=str)
    assert got == sorted([(None, 2, 1), (5, 1, 3), (6, 0, 2), (7, 1, 1), (8, 1, 1)], key=str)


EVENTS = T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("bad", T.IntegerType())])


def _events(spark, rows):
    import datetime as dt
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(k, start + dt.timedelta(minutes=m), b) for k, m, b in rows], EVENTS)


def _hold_rows(spark, base, out):
    s = ST.hold_stream(ST.file_stream(spark, f"{base}/in", EVENTS), "key", "at", "bad", lambda n, hits: hits > 0, "1 hour", "2 hours", "10 minutes")
    got = ST.run_available_now(s, f"{base}/{out}", f"{base}/ckpt_{out}", partitions=2).collect()
    return sorted((r["key"], r["window_start"].hour, r["n"], r["condition"], r["firing"], r["starts_firing"], r["resolved"]) for r in got)


def test_hold_stream_survives_restart_and_repeated_batch(spark):
    base = scratch_dir(spark, "hold")
    first = [("a", 60 * h + 5, 1) for h in range(3)] + [("b", 10, 1), ("b", 130, 1)]
    later = [("a", 60 * h + 5, 1) for h in (3, 4)] + [("a", 301, 0), ("c", 60 * 9 + 30, 0)]
    _events(spark, first).coalesce(1).write.parquet(f"{base}/in/p0")
    _hold_rows(spark, base, "x")                                               # the first run ends here
    _events(spark, later).coalesce(1).write.parquet(f"{base}/in/p1")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/ckpt_x/commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max((st.getPath() for st in fs.listStatus(path) if st.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    fs.delete(last, False)                                                     # its last batch counts as not run
    got = _hold_rows(spark, base, "x")
    assert got == _hold_rows(spark, base, "y")                                 # one run over everything
    assert [r for r in got if r[0] == "a"] == [("a", 0, 1, 1, 0, 0, 0), ("a", 1, 1, 1, 0, 0, 0), ("a", 2, 1, 1, 1, 1, 0), ("a", 3, 1, 1, 1, 0, 0),
                                              ("a", 4, 1, 1, 1, 0, 0), ("a", 5, 1, 0, 0, 0, 0)]
    # b falls silent: its open island is resolved by the timer, twice
    assert [r for r in got if r[0] == "b"] == [("b", 0, 1, 1, 0, 0, 0), ("b", 1, 0, 0, 0, 0, 1), ("b", 2, 1, 1, 0, 0, 0), ("b", 3, 0, 0, 0, 0, 1)]


def test_island_closes_in_order_and_drops_late_windows():
    i = ST.Island(1000, 1000, lambda n, hits: hits >= n)
    for step in (3, 1, 2):
        i.add(step, 2, 2)
    assert i.timer() == 2000 and i.close(1999) == []
    assert [r[0] for r in i.close(3000)] == [1, 2] and i.start == 1
    i = ST.Island(1000, 1000, lambda n, hits: hits >= n, i.saved())
    i.add(2, 5, 0)                                                             # too late: window 2 is closed
    i.add(3, 1, 0)
    assert i.close(4000) == [(3, 3, 2, 0, None, 0, 0, 0)] and i.timer() is None
