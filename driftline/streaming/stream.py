"""Structured Streaming operators.

Each operator is the streaming twin of a batch operator in ``driftline.operators``;
the batch twin is the correctness reference.  Sources are file streams (one
file per trigger keeps event time ordered across micro-batches); sinks are
``foreachBatch`` and Parquet sinks with checkpoints in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.sources.files import parse_ndjson


# -- file helpers (test inputs written in event-time order) ----------------------------

def write_ordered(spark: SparkSession, df: DataFrame, ts_col: str, base: str, fmt: str = "parquet", files: int = 8) -> list[str]:
    """Write ``files`` files that cover consecutive ranges of ``ts_col``, in one job with a task a file, and give
    them modification times in that order: a file stream then reads them in event-time order, however many
    files it takes in a batch. Returns their paths."""
    df.repartitionByRange(files, ts_col).write.format(fmt).save(base)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(st.getPath().toString() for st in fs.listStatus(path) if st.getPath().getName().startswith("part-"))
    for i, p in enumerate(parts):                           # bounded by ``files``
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(p), 1_000_000_000_000 + i * 60_000, -1)
    return parts


# -- S1 / S2 / S9 ---------------------------------------------------------------------------

def ndjson_stream(spark: SparkSession, path: str, schema: T.StructType,
                  files_per_trigger: int = 1) -> DataFrame:
    """Tolerant NDJSON stream; ``_malformed`` marks lines that did not parse
    (route them to a side sink with ``foreachBatch``)."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) \
                            .option("recursiveFileLookup", "true").text(path)
    return parse_ndjson(lines, schema)


def split_malformed(good_base: str, bad_base: str):
    """A ``foreachBatch`` function that writes parsed records and malformed lines to two
    folders, each batch in a place of its own (a repeated batch overwrites itself)."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.where("_malformed = 0").drop("_malformed").write.mode("overwrite").parquet(f"{good_base}/e{epoch_id}")
        batch.where("_malformed = 1").write.mode("overwrite").parquet(f"{bad_base}/e{epoch_id}")
    return write


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                files_per_trigger: int = 1) -> DataFrame:
    """Typed file stream, ``files_per_trigger`` files per micro-batch in
    modification-time order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger) \
                           .option("recursiveFileLookup", "true").format(fmt).load(path)


def with_event_time(df: DataFrame, ts_col: str, delay: str) -> DataFrame:
    """Event-time watermark (the column must be TIMESTAMP, not NTZ)."""
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)


def dedupe(df: DataFrame, key: str) -> DataFrame:
    """Drop replays / retries of the same id while the watermark holds it."""
    return df.dropDuplicatesWithinWatermark([key])


# -- S3 late-outcome join -------------------------------------------------------------------------

def late_outcome_join(pred: DataFrame, outc: DataFrame, id_col: str, pred_ts: str, outcome_ts: str,
                      within: str = "37 days") -> DataFrame:
    """S3: predictions left-outer outcomes on the id with
    ``pred_ts <= outcome_ts <= pred_ts + within``; both sides must carry
    watermarks.  Unmatched predictions are emitted once the watermark passes."""
    o = outc.withColumnRenamed(id_col, "_oid")
    cond = ((F.col(id_col) == F.col("_oid")) & (F.col(outcome_ts) >= F.col(pred_ts)) &
            (F.col(outcome_ts) <= F.col(pred_ts) + F.expr(f"INTERVAL {within}")))
    return pred.join(o, cond, "leftOuter").drop("_oid")


# -- S4 corrected outcomes: last write wins via foreachBatch upsert ----------------------------

def committed_batches(spark: SparkSession, folder: str, before: int) -> list[int]:
    """Ids below ``before`` of the batches whose ``folder/e<id>`` write was committed, in order.

    The state is what is on disk: a new process, or a batch that is run again, finds the same."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n[:1] == "e" and n[1:].isdigit() and int(n[1:]) < before
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def drop_unnamed(spark: SparkSession, base: str, index_schema: str, folder, before: int, keep: int) -> None:
    """Remove the folders under ``data/e<id>`` that no index among the last ``keep`` ones before this batch names
    (``folder(row)`` is the name that an index row gives), and the older indexes: readers of the kept ones go on."""
    done = committed_batches(spark, f"{base}/index", before)
    if len(done) <= keep:
        return
    named = {(r["epoch"], folder(r)) for r in spark.read.schema(index_schema).parquet(
        *[f"{base}/index/e{e}" for e in done[-keep:]]).collect()}
    jvm = spark._jvm
    data = jvm.org.apache.hadoop.fs.Path(f"{base}/data")
    fs = data.getFileSystem(spark._jsc.hadoopConfiguration())
    for epoch in fs.listStatus(data):
        name = epoch.getPath().getName()
        if not name[1:].isdigit() or int(name[1:]) >= before:
            continue
        runs = [st.getPath() for st in fs.listStatus(epoch.getPath()) if st.isDirectory()]
        dead = [path for path in runs if (int(name[1:]), path.getName()) not in named]
        for path in dead:
            fs.delete(path, True)
        if len(dead) == len(runs):
            fs.delete(epoch.getPath(), True)
    for e in done[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{base}/index/e{e}"), True)


class OutcomeTable:
    """Outcomes keyed by id, a newer ``(ts, tiebreak)`` replaces the older row.

    Ids lie in the leaves of an extendible hash: leaf ``(depth, prefix)`` holds the ids whose hash ends in
    the ``depth`` bits of ``prefix``. A leaf is a base and some deltas. A micro-batch writes its own rows only, as a delta of the
    leaves they fall into; a leaf whose deltas have grown to ``compact`` times its base (or to ``max_deltas``) is
    rewritten as a new base, and splits when it then holds more than ``leaf_rows`` rows. So a batch rewrites about
    what it touches, and a leaf stays small however large the table grows.

    All files of a batch go under ``data/e<batch id>``; then an index of all leaves is committed under
    ``index/e<batch id>``; readers follow the last committed index, so they never see half a batch.
    Nothing is kept in this object: after a restart the table is found on disk, and a
    repeated batch id starts from the index before it and writes the same files again. A batch begins by
    removing the files that the last ``keep`` indexes before it no longer name."""

    INDEX = "depth int, prefix long, epoch long, base boolean, n long"

    def __init__(self, base: str, id_col: str, ts_col: str, tiebreak: Sequence[str] = (), leaf_rows: int = 1_000_000,
                 compact: float = 0.5, max_deltas: int = 16, keep: int = 2):
        self.base, self.id_col, self.ts_col, self.tiebreak = base.rstrip("/"), id_col, ts_col, list(tiebreak)
        self.leaf_rows, self.compact, self.max_deltas, self.keep = leaf_rows, compact, max_deltas, keep

    def _index(self, spark: SparkSession, before: int) -> list[tuple]:
        """Runs ``(depth, prefix, epoch, base, n)`` of the last committed index: a few a leaf, no rows of the table."""
        done = committed_batches(spark, f"{self.base}/index", before)
        if not done:
            return []
        return sorted(tuple(r) for r in spark.read.schema(self.INDEX).parquet(f"{self.base}/index/e{done[-1]}").collect())

    def _read(self, spark: SparkSession, runs: Sequence[tuple], schema: T.StructType | None = None) -> DataFrame:
        paths = [f"{self.base}/data/e{e}/_leaf={d}-{p}" for d, p, e, *_ in runs]
        return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)

    def _last(self, rows: DataFrame) -> DataFrame:
        from driftline.operators.outcomes import top_row
        return top_row(rows, [self.id_col], [F.col(c).desc_nulls_last() for c in (self.ts_col, *self.tiebreak)])

    def current(self, spark: SparkSession) -> DataFrame | None:
        runs = self._index(spark, 1 << 62)
        if not runs:
            return None
        changed = {(d, p) for d, p, _, base, _ in runs if not base}
        clean, mixed = ([r for r in runs if ((r[0], r[1]) in changed) == c] for c in (False, True))
        parts = ([self._read(spark, clean)] if clean else []) + ([self._last(self._read(spark, mixed))] if mixed else [])
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _hash(self):
        return F.xxhash64(self.id_col)

    def _placed(self, rows: DataFrame, leaves: Sequence[tuple[int, int]]) -> DataFrame:
        """``rows`` with the ``_leaf`` that their id falls into: a join with the directory, one slot per
        hash suffix of the greatest depth."""
        spark, depth = rows.sparkSession, max(d for d, _ in leaves)
        table = spark.createDataFrame([(d, p) for d, p in leaves], "depth int, prefix long")
        slots = table.select(F.concat_ws("-", "depth", "prefix").alias("_leaf"), F.explode(F.transform(
            F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, {depth} - depth) - 1")),
            lambda i: F.col("prefix") + i * F.expr("shiftleft(1L, depth)"))).alias("_slot"))
        return rows.withColumn("_slot", F.pmod(self._hash(), F.lit(1 << depth))).join(slots, "_slot").drop("_slot")

    def upsert(self, batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        self._clean(spark, epoch_id)
        runs = self._index(spark, epoch_id)
        leaves = sorted({(d, p) for d, p, *_ in runs}) or [(0, 0)]
        # counted, and written in two ways: reduced to its last writes once
        rows = self._placed(self._last(batch), leaves).checkpoint()
        added = {self._name(r["_leaf"]): r["count"] for r in rows.groupBy("_leaf").count().collect()}     # at most a row a leaf
        if not added:
            return
        held = {leaf: [r for r in runs if (r[0], r[1]) == leaf] for leaf in leaves}
        full = [leaf for leaf, n in added.items() if self._due(held[leaf], n)]
        named = [f"{d}-{p}" for d, p in full]
        out = rows.where(~F.col("_leaf").isin(named)) if full else rows
        if full:
            old = [r for leaf in full for r in held[leaf]]
            fresh = rows.where(F.col("_leaf").isin(named)).drop("_leaf")
            merged = self._last(self._read(spark, old, batch.schema).unionByName(fresh) if old else fresh)
            out = out.unionByName(self._placed(merged, self._split(full, held, added)))
        folder = f"{self.base}/data/e{epoch_id}"
        # a leaf's rows of this batch go to one file: it holds leaf_rows rows at most
        out.repartition("_leaf").write.mode("overwrite").partitionBy("_leaf").parquet(folder)
        written = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("_leaf", T.StringType())])).parquet(folder)
        counts = {self._name(r["_leaf"]): r["count"] for r in written.groupBy("_leaf").count().collect()}
        keep = [r for r in runs if (r[0], r[1]) not in full]
        new = [(d, p, epoch_id, (d, p) not in added or (d, p) in full, n) for (d, p), n in counts.items()]
        # leaves of a split that no row fell into keep their place in the directory
        empty = [(d, p, epoch_id, True, 0) for d, p in (self._split(full, held, added) if full else []) if (d, p) not in counts]
        self._touch(spark, folder, empty, batch.schema)
        spark.createDataFrame(sorted(keep + new + empty), self.INDEX).coalesce(1).write.mode("overwrite").parquet(
            f"{self.base}/index/e{epoch_id}")

    @staticmethod
    def _name(leaf: str) -> tuple[int, int]:
        d, p = leaf.split("-")
        return int(d), int(p)

    def _due(self, runs: Sequence[tuple], n: int) -> bool:
        """Whether a leaf that ``n`` rows are added to is rewritten."""
        base, deltas = sum(r[4] for r in runs if r[3]), [r[4] for r in runs if not r[3]]
        return sum(deltas) + n > self.compact * base or len(deltas) + 1 >= self.max_deltas

    def _split(self, full: Sequence[tuple], held: dict, added: dict) -> list[tuple[int, int]]:
        """The leaves that rewritten ones become: split until none can hold more than ``leaf_rows`` rows on average."""
        out = []
        for d, p in full:
            n, k = sum(r[4] for r in held[d, p]) + added[d, p], 0
            while n > self.leaf_rows << k:
                k += 1
            out += [(d + k, p + (i << d)) for i in range(1 << k)]
        return out

    def _touch(self, spark: SparkSession, folder: str, runs: Sequence[tuple], schema: T.StructType) -> None:
        for d, p, *_ in runs:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/_leaf={d}-{p}")

    def _clean(self, spark: SparkSession, before: int) -> None:
        drop_unnamed(spark, self.base, self.INDEX, lambda r: f"_leaf={r['depth']}-{r['prefix']}", before, self.keep)


# -- S5 windowed counts ---------------------------------------------------------------------------

def windowed_counts(df: DataFrame, ts_col: str, size: str, slide: str, measures: dict) -> DataFrame:
    """Sliding event-time windows; with a watermark, append mode emits each
    window once, when it can no longer change."""
    return df.groupBy(F.window(ts_col, size, slide).alias("w")).agg(
        *[m.alias(n) for n, m in measures.items()]).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *measures.keys())


# -- S8 hold time and consecutive windows ----------------------------------------------------

HOLD_OUT = ("window_start timestamp, n long, hits long, condition int, active_since timestamp, firing int, starts_firing int, "
            "resolved int")
HOLD_STATE = "steps array<long>, n array<long>, hits array<long>, last long, start long"


class Island:
    """One key's windows: open ones with their counts, the last closed one, and the first of the run of windows
    that meet the condition. Windows are numbered by ``step`` since the epoch."""

    def __init__(self, step_ms: int, hold_ms: int, condition, saved=None):
        steps, n, hits, last, start = saved or ([], [], [], None, None)
        self.step, self.hold, self.condition = step_ms, hold_ms, condition
        self.open = {s: [a, b] for s, a, b in zip(steps, n, hits)}
        self.last, self.start = last, start

    def add(self, step: int, n: int, hits: int) -> None:
        """Events of a window; those of a window that was closed come too late."""
        if self.last is None or step > self.last:
            have = self.open.setdefault(step, [0, 0])
            have[0] += n
            have[1] += hits

    def close(self, watermark_ms: int) -> list[tuple]:
        """Rows (window, n, hits, condition, island start, firing, starts_firing, resolved) of what the watermark has passed."""
        rows = []

        def silence():
            if self.start is not None:
                rows.append((self.last + 1, 0, 0, 0, None, 0, 0, 1))
                self.start = None
        for step in sorted(self.open):
            if (step + 1) * self.step > watermark_ms:
                break
            n, hits = self.open.pop(step)
            if self.last is not None and step != self.last + 1:
                silence()
            true = bool(self.condition(n, hits))
            self.start = (step if self.start is None else self.start) if true else None
            age = (step - self.start) * self.step if true else -1
            rows.append((step, n, hits, int(true), self.start, int(age >= self.hold), int(self.hold <= age < self.hold + self.step), 0))
            self.last = step
        if self.start is not None and self.last + 1 not in self.open and (self.last + 2) * self.step <= watermark_ms:
            silence()
        return rows

    def timer(self) -> int | None:
        """The end of the next window to be closed or missed."""
        ends = [(s + 1) * self.step for s in self.open]
        if self.start is not None and self.last + 1 not in self.open:
            ends.append((self.last + 2) * self.step)
        return min(ends, default=None)

    def saved(self) -> tuple:
        steps = sorted(self.open)
        return steps, [self.open[s][0] for s in steps], [self.open[s][1] for s in steps], self.last, self.start


def hold_stream(events: DataFrame, key: str, ts_col: str, hit_col: str, condition, step: str, hold: str, delay: str) -> DataFrame:
    """Per key, a condition over consecutive windows of ``step`` fires once it has held for ``hold`` (``for:``);
    with a hold of one step that is the confirmation by two windows in a row.

    ``condition(n, hits)`` judges a window by its events and by those whose ``hit_col`` is 1. Tasks combine
    their events to counts per key and window first, so a key's state sees a few rows a batch however
    many events it has. The keyed state holds the open windows' counts (as many as ``delay`` spans), the last closed
    window and the window in which the island of true windows began. A window is closed by an event-time timer, once
    the watermark has passed its end; a missing window ends an open island (a row with ``resolved`` 1), even when
    the key stays silent from then on. Output: one row per closed window (batch twin: ``slo.hold``). A batch
    that is run again starts from the state before it."""
    step_ms, hold_ms = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (step, hold))
    key_type = events.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in HOLD_OUT.split(", ")]

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for e in batches:
            at = e["ts"].astype("datetime64[us]")
            e = e.assign(step=at.astype("int64") // (step_ms * 1000), at=at)
            yield e.groupby(["key", "step"], as_index=False, dropna=False).agg(n=("hit", "size"), hits=("hit", "sum"), at=("at", "max"))

    rows = events.where(F.col(ts_col).isNotNull()).select(F.col(key).alias("key"), F.col(ts_col).cast("timestamp").alias("ts"),
                                                          F.coalesce(F.col(hit_col).cast("long"), F.lit(0)).alias("hit"))
    parts = rows.mapInPandas(counts, f"key {key_type}, step long, n long, hits long, at timestamp").withWatermark("at", delay)

    def fn(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        island = Island(step_ms, hold_ms, condition, state.get if state.exists else None)
        if not state.hasTimedOut:
            for p in pdfs:
                for x in p[["step", "n", "hits"]].itertuples(index=False):
                    island.add(int(x.step), int(x.n), int(x.hits))
        closed = island.close(state.getCurrentWatermarkMs())
        state.update(island.saved())
        if (end := island.timer()) is not None:
            state.setTimeoutTimestamp(end)
        when = lambda number: pd.NaT if number is None else pd.Timestamp(number * step_ms, unit="ms")
        out = [(k[0], when(w), n, h, c, when(since), f, s, r) for w, n, h, c, since, f, s, r in closed]
        if out:
            yield pd.DataFrame(out, columns=[key, *names]).astype({"window_start": "datetime64[us]", "active_since": "datetime64[us]"})

    return parts.groupBy("key").applyInPandasWithState(fn, f"`{key}` {key_type}, {HOLD_OUT}", HOLD_STATE, "append", "EventTimeTimeout")


# -- S6 count-based monitoring windows ----------------------------------------------------------

class CountWindows:
    """Assigns consecutive ids of ``size`` records across micro-batches.

    The log is a list of runs, each a folder that holds the records of consecutive positions. A batch
    writes its records as a run of tier 0 under ``data/e<batch id>``; ``fan`` runs of one tier at the end of the
    list are merged into one of the next tier, so after n batches there are about ``fan`` runs for each power of
    ``fan`` in n and a record is rewritten once a tier. The list, with the positions that each run covers, is committed
    under ``index/e<batch id>``: the position a batch starts at and the runs of a window are read from
    the last list, without looking into files. A restart goes on where that list ends, and a repeated batch
    starts from the list before it and writes the same folders again. Superseded folders go once the last ``keep``
    lists do not name them.

    Inside a batch the order is the distributed ``global_rank``. Windows that the batch completes are handed to
    ``on_window`` (e.g. the drift analysis) from the runs that overlap them, again if the batch is run again."""

    INDEX = "epoch long, tier int, first long, last long"

    def __init__(self, base: str, order_cols: Sequence[str], size: int, on_window=None, fan: int = 8, keep: int = 2):
        self.base, self.order_cols, self.size, self.on_window = base.rstrip("/"), list(order_cols), size, on_window
        self.fan, self.keep = fan, keep

    def runs(self, spark: SparkSession, before: int = 1 << 62) -> list[tuple]:
        """Runs ``(epoch, tier, first, last)`` of the last committed list, in order of position."""
        done = committed_batches(spark, f"{self.base}/index", before)
        if not done:
            return []
        rows = spark.read.schema(self.INDEX).parquet(f"{self.base}/index/e{done[-1]}").collect()
        return sorted((tuple(r) for r in rows), key=lambda r: r[2])

    def _read(self, spark: SparkSession, runs: Sequence[tuple]) -> DataFrame:
        return spark.read.parquet(*[f"{self.base}/data/e{e}/t{tier}" for e, tier, *_ in runs])

    def log(self, spark: SparkSession, before: int = 1 << 62) -> DataFrame | None:
        runs = self.runs(spark, before)
        return self._read(spark, runs) if runs else None

    def process(self, batch: DataFrame, epoch_id: int) -> None:
        from driftline.operators.order import global_rank
        spark = batch.sparkSession
        drop_unnamed(spark, self.base, self.INDEX, lambda r: f"t{r['tier']}", epoch_id, self.keep)
        runs = self.runs(spark, epoch_id)
        offset = runs[-1][3] if runs else 0
        n = batch.count()
        if n == 0:
            return
        r = global_rank(batch, self.order_cols, "_r").withColumn("_pos", F.col("_r") + offset) \
            .withColumn("window_id", F.floor((F.col("_pos") - 1) / self.size).cast("long")).drop("_r")
        r.write.mode("overwrite").parquet(f"{self.base}/data/e{epoch_id}/t0")
        runs = self._merged(spark, [*runs, (epoch_id, 0, offset + 1, offset + n)], epoch_id)
        spark.createDataFrame(runs, self.INDEX).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/index/e{epoch_id}")
        if self.on_window is not None:
            # opening runs lists their files: the windows that lie in the same runs, nearly all of a batch, share one frame
            opened, part = None, None
            for w in range(offset // self.size, (offset + n) // self.size):   # bounded: windows completed by this batch
                mine = [x for x in runs if x[2] <= (w + 1) * self.size and x[3] > w * self.size]
                if mine != part:
                    opened, part = self._read(spark, mine), mine
                self.on_window(opened.where(F.col("window_id") == w), w)

    def _merged(self, spark: SparkSession, runs: list[tuple], epoch_id: int) -> list[tuple]:
        """The list after merging its end while that is ``fan`` runs of one tier."""
        while len(runs) >= self.fan and len({x[1] for x in runs[-self.fan:]}) == 1:
            last, tier = runs[-self.fan:], runs[-1][1] + 1
            self._read(spark, last).write.mode("overwrite").parquet(f"{self.base}/data/e{epoch_id}/t{tier}")
            runs = [*runs[:-self.fan], (epoch_id, tier, last[0][2], last[-1][3])]
        return runs


# -- S7 heartbeat watchdog ----------------------------------------------------------------------

WATCHDOG_OUT = "last_seen timestamp, next_seen timestamp, alert string"
WATCHDOG_STATE = "last_seen timestamp"


def heartbeat_watchdog(df: DataFrame, key: str, ts_col: str, gap: str, delay: str) -> DataFrame:
    """Per-key last-seen state.  Gaps longer than ``gap`` between
    consecutive events are reported inside a micro-batch and across batches
    (the state holds the last event seen); when the watermark passes
    ``last_seen + gap`` with no new event, an event-time timeout reports
    ``heartbeat_missing`` (batch twin: consecutive gaps, J16). The watermark trails the latest event by ``delay``.

    Two events of one slot of ``gap`` lie closer than that, so tasks first reduce their events to the earliest and
    latest of each key and slot: a key's state sees a few rows a task and slot, however many events it has.
    Events without a time are left out."""
    gap_td = pd.Timedelta(gap)
    gap_us = int(gap_td.total_seconds() * 1_000_000)
    key_type = df.schema[key].dataType.simpleString()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for e in batches:
            slot = e["at"].astype("datetime64[us]").astype("int64") // gap_us
            yield e.assign(slot=slot).groupby(["key", "slot"], as_index=False, dropna=False).agg(
                first=("at", "min"), at=("at", "max"))[["key", "first", "at"]]

    rows = df.where(F.col(ts_col).isNotNull()).select(F.col(key).alias("key"), F.col(ts_col).cast("timestamp").alias("at"))
    parts = rows.mapInPandas(ends, f"key {key_type}, first timestamp, at timestamp").withWatermark("at", delay)

    def fn(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get                # kept: a later event still reports the whole gap
            state.update((last,))
            yield pd.DataFrame({key: [k[0]], "last_seen": [pd.Timestamp(last)], "next_seen": [pd.NaT],
                                "alert": ["heartbeat_missing"]})
            return
        seen = [x for p in pdfs for x in (p["first"], p["at"])]
        if state.exists:
            (prev,) = state.get
            seen.append(pd.Series([pd.Timestamp(prev)]))
        ts = pd.concat(seen, ignore_index=True).sort_values(ignore_index=True)
        nxt = ts.shift(-1)
        m = (nxt - ts) > gap_td
        latest = ts.iloc[-1]
        state.update((latest.to_pydatetime(),))
        state.setTimeoutTimestamp(int(latest.timestamp() * 1000) + gap_us // 1000)
        if m.any():
            yield pd.DataFrame({"last_seen": ts[m].values, "next_seen": nxt[m].values, "alert": "heartbeat_gap"}).assign(
                **{key: k[0]})[[key, "last_seen", "next_seen", "alert"]]

    return parts.groupBy("key").applyInPandasWithState(fn, f"`{key}` {key_type}, {WATCHDOG_OUT}", WATCHDOG_STATE, "append",
                                                       "EventTimeTimeout")


class state_partitions:
    """Context manager: shuffle / state-store partitions for a streaming query.

    A stateful query fixes its partition count in the checkpoint when it first
    starts; the default follows the cluster's parallelism rather than the
    session's batch setting (200 state tasks per micro-batch are pure overhead
    for small streams)."""

    def __init__(self, spark: SparkSession, n: int | None = None):
        self.spark = spark
        self.n = n or max(8, spark.sparkContext.defaultParallelism)

    def __enter__(self):
        self.old = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.n))
        return self

    def __exit__(self, *exc):
        self.spark.conf.set("spark.sql.shuffle.partitions", self.old)
        return False


def run_available_now(df: DataFrame, out: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    """Run a streaming query over everything available into a Parquet sink (exactly once per
    batch, by the sink's own log) and return the table; nothing passes through the driver."""
    spark = df.sparkSession
    with state_partitions(spark, partitions):
        q = (df.writeStream.format("parquet").option("path", out).outputMode("append")
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_foreach_batch(df: DataFrame, fn, checkpoint: str, partitions: int | None = None) -> None:
    """Run ``fn(batch_df, epoch_id)`` over everything available (availableNow)."""
    with state_partitions(df.sparkSession, partitions):
        q = (df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
        q.awaitTermination()
