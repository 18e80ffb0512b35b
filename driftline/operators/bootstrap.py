"""Bootstrap confidence intervals (F8-F10; used by H7, H8, K8).

A resample with replacement is represented by multiplicity weights: the weight of a row in
replicate b is Poisson(1), the inverse CDF of a 32-bit number mixed from two words of the md5 of
``row key|seed`` and from b. It depends on nothing else, so it is reproducible, independent of
partitioning and executor loss, and can be computed again instead of being moved.

No table ever has rows x B rows. A task draws the weights of a chunk of its rows as a (rows, B + 1)
array (the last column is 1: the point estimate is one more replicate) and keeps only B-vectors:

* additive metrics (means) are sums per key and task, added up after one shuffle of those vectors;
* rank metrics cut the scores into buckets of equal scores or equal share. The narrow rows are dealt by
  bucket, a first pass gives each bucket's B-vectors of weighted positives and negatives;
  their prefix sums are the buckets' offsets; in the second pass a task streams a bucket's
  rows by falling score from its offsets and returns the bucket's share of every replicate's average
  precision, ROC-AUC and Brier score. A score that holds a bucket's worth of rows is a bucket of its own,
  whose rows are summed to vectors before the shuffle.

A row costs thousands of draws however few bytes it has, so rows are dealt over a fixed number of tasks, which
adaptive execution does not merge by size; without keys, only sums of buckets meet in one task.

Rows whose label or score is null or NaN take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.exprs import MIX, poisson1_cdf
from driftline.operators import metrics as M
from driftline.operators.order import bucketize, cut_points

#: Rows whose weights are drawn at a time: their arrays stay in a core's cache.
CHUNK = 32
#: (key, bucket) sums that a map task holds before it passes them on.
HELD = 256


# -- weights --------------------------------------------------------------------------------

def row_words(row_key: Sequence[str], seed: int) -> list:
    """Columns ``_h1, _h2``: two 32-bit words of the md5 of ``row key|seed``."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in row_key], F.lit(str(seed))))
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(2)]


def _mix(x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``x`` mixed in place; ``other`` is scratch space of its shape."""
    shift, factor = MIX
    for s, m in zip(shift, factor):
        np.right_shift(x, np.uint32(s), out=other)
        np.bitwise_xor(x, other, out=x)
        np.multiply(x, np.uint32(m), out=x)
    np.right_shift(x, np.uint32(shift[-1]), out=other)
    return np.bitwise_xor(x, other, out=x)


class Weights:
    """Poisson(1) multiplicities of rows in ``B`` replicates, and a column of ones."""

    def __init__(self, B: int):
        step = 0x9E3779B1
        self.B = B
        self.b = (np.arange(B, dtype=np.uint64) * np.uint64(step) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.cuts = [np.uint32(min(int(c * 2**32), 2**32 - 1)) for c in poisson1_cdf(12)[:12]]

    def draw(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        x = h1[:, None] + self.b
        other = np.empty_like(x)
        np.bitwise_xor(_mix(x, other), h2[:, None], out=x)
        _mix(x, other)
        w, over, top = np.zeros(x.shape, np.uint8), np.empty(x.shape, np.bool_), x.max(initial=0)
        for c in self.cuts:
            if top <= c:
                break
            np.greater(x, c, out=over)
            np.add(w, over.view(np.uint8), out=w)
        out = np.ones((len(w), self.B + 1))
        out[:, :-1] = w
        return out


# -- sums of vectors -----------------------------------------------------------------------

def _pack(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v, np.float64).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float64)


def _runs(batches: Iterable[pa.RecordBatch], n_keys: int):
    """(key, slice) for runs of rows with equal first ``n_keys`` columns; a run may continue in the next slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)))) if n_keys else [()] * batch.num_rows
        a = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[a]:
                yield keys[a], batch.slice(a, i - a)
                a = i


def _emit(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _arrow(df: DataFrame, names: Sequence[str]) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    known = to_arrow_schema(df.select(*names).schema) if names else pa.schema([])
    return [known.field(n) for n in names]


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def sum_vectors(df: DataFrame, keys: Sequence[str], vectors: Sequence[str]) -> DataFrame:
    """The binary ``vectors`` of float64, added up per ``keys``."""
    keys, k = list(keys), len(keys)
    fields = pa.schema([*_arrow(df, keys), *[(v, pa.binary()) for v in vectors]])

    def run(batches):
        now, total = None, None
        for key, part in _runs(batches, k):
            if now != key:
                if now is not None:
                    yield _emit(fields, [(*now, *map(_pack, total))])
                now, total = key, [0.0] * len(vectors)
            for i in range(len(vectors)):
                for x in part.column(k + i):
                    total[i] = total[i] + _unpack(x.as_py())
        if now is not None:
            yield _emit(fields, [(*now, *map(_pack, total))])

    dealt, shape = df.select(*keys, *vectors), _ddl(df, keys) + ", ".join(f"{v} binary" for v in vectors)
    if keys:
        return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, shape)
    # a sum a task, then the sum of those: a shuffle, for a mere coalesce would draw all work before it into the one task
    return dealt.mapInArrow(run, shape).repartition(1).mapInArrow(run, shape)


def _combined(df: DataFrame, keys: Sequence[str], values: Sequence[str], vectors: Sequence[str], B: int,
              amounts: Callable[[np.ndarray, Sequence[np.ndarray]], Sequence[np.ndarray]]) -> DataFrame:
    """Per task and ``keys``: the vectors ``sum over rows of weight x amount``, for the amounts of the rows' ``values``.

    ``df`` has the keys, ``_h1``, ``_h2`` and the values. A task passes its sums on when it holds ``HELD`` keys."""
    keys, k = list(keys), len(keys)
    fields = pa.schema([*_arrow(df, keys), *[(v, pa.binary()) for v in vectors]])

    def run(batches):
        weights, held = Weights(B), {}
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(k)))) if k else [()] * batch.num_rows
            h1, h2 = (batch.column(k + i).to_numpy().astype(np.uint32) for i in range(2))
            x = [batch.column(k + 2 + i).to_numpy(zero_copy_only=False) for i in range(len(values))]
            group = {}
            for i, n in enumerate(names):
                group.setdefault(n, []).append(i)
            for n, rows in group.items():
                rows = np.array(rows)
                for a in range(0, len(rows), CHUNK):
                    at = rows[a:a + CHUNK]
                    w = weights.draw(h1[at], h2[at])
                    add = amounts(w, [v[at] for v in x])
                    held[n] = [s + v for s, v in zip(held[n], add)] if n in held else list(add)
            if len(held) > HELD:
                yield _emit(fields, [(*n, *map(_pack, v)) for n, v in held.items()])
                held = {}
        if held:
            yield _emit(fields, [(*n, *map(_pack, v)) for n, v in held.items()])

    part = df.select(*keys, "_h1", "_h2", *values)
    return part.mapInArrow(run, _ddl(df, keys) + ", ".join(f"{v} binary" for v in vectors))


# -- intervals ------------------------------------------------------------------------------

def percentile_interval(reps: DataFrame, value: str, keys: Sequence[str],
                        level: float = 0.95) -> DataFrame:
    """Percentile interval (linear interpolation), replicate count and population SE; ``reps`` has at most B rows per key."""
    a = (1 - level) / 2
    return reps.groupBy(*keys).agg(
        F.percentile(F.col(value), F.lit(float(a))).alias("lower"),
        F.percentile(F.col(value), F.lit(float(1 - a))).alias("upper"),
        F.stddev_pop(value).alias("se"),
        F.count(F.lit(1)).alias("n_replicates"))


# -- F8: rank metrics -----------------------------------------------------------------------

class _Bucket:
    """One bucket of one key: its rows by falling score, from the sums of the buckets before it."""

    def __init__(self, width: int):
        self.p, self.n = np.zeros(width), np.zeros(width)                     # sums above the open score
        self.first = None                                                     # sums of the buckets before
        self.ap, self.s, self.sq = np.zeros(width), np.zeros(width), np.zeros(width)
        self.score, self.gp, self.gn = None, np.zeros(width), np.zeros(width)
        self.ties = False                                                     # whether the open score has positives
        self.a, self.b = np.empty(width), np.empty(width)                     # scratch space

    def start(self, p: np.ndarray, n: np.ndarray):
        self.p, self.n, self.first = p.copy(), n.copy(), (p, n)

    def _count(self, gp: np.ndarray, gn: np.ndarray | None):
        """Positives of one score; its negatives ``gn``, if any, are counted with them."""
        p, n, a, b = self.p, self.n, self.a, self.b
        np.add(p, gp, out=p)
        if gn is not None:
            np.add(n, gn, out=n)
        # weights are whole numbers: a sum below 1 is 0, and so is its p
        np.add(p, n, out=a)
        np.maximum(a, 1.0, out=a)
        np.divide(p, a, out=a)
        np.multiply(a, gp, out=a)
        np.add(self.ap, a, out=self.ap)
        if gn is None:
            np.multiply(gp, n, out=a)
        else:
            np.multiply(gn, -0.5, out=b)
            np.add(b, n, out=b)
            np.multiply(gp, b, out=a)
        np.add(self.s, a, out=self.s)

    def close(self):
        """Count the open score."""
        if self.ties:
            self._count(self.gp, self.gn)
        else:
            np.add(self.n, self.gn, out=self.n)

    def _open(self, score: float, gp: np.ndarray, gn: np.ndarray, positives: bool):
        """More of the open score, or the next one."""
        if self.score is not None and score != self.score:
            self.close()
            self.score = None
        if self.score is None:
            self.score, self.ties = score, positives
            self.gp[:], self.gn[:] = gp, gn
        else:
            self.ties |= positives
            self.gp += gp
            self.gn += gn

    def add_sums(self, score: float, gp: np.ndarray, gn: np.ndarray, sq: np.ndarray):
        """Rows of one score: weighted positives and negatives, sum of weighted squared errors."""
        self.sq += sq
        self._open(score, gp, gn, True)

    def add(self, score: np.ndarray, w: np.ndarray, y: np.ndarray, sq: np.ndarray):
        """Rows in order: scores, weights (rows, B + 1), labels 0 or 1, squared errors."""
        self.sq += sq @ w
        starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]])).tolist() + [len(score)]
        last, labels, scores = len(starts) - 2, y.tolist(), score.tolist()
        for i, (a, b) in enumerate(zip(starts, starts[1:])):
            if 0 < i < last and b == a + 1:
                # a row of its own, and a score that no other batch of rows can hold
                if self.score is not None:
                    self.close()
                    self.score = None
                if labels[a]:
                    self._count(w[a], None)
                else:
                    np.add(self.n, w[a], out=self.n)
            else:
                gp = y[a:b] @ w[a:b]
                self._open(scores[a], gp, w[a:b].sum(0) - gp, any(labels[a:b]))

    def result(self):
        if self.score is not None:
            self.close()
        first = self.first or (0.0, 0.0)
        return [self.ap, self.s, self.sq, self.p - first[0], self.n - first[1]]


VECTORS = ["ap", "s", "sq", "p", "n"]


def replicate_metrics(df: DataFrame, row_key: Sequence[str], keys: Sequence[str] = (), label: str = "label",
                      score: str = "score", B: int = 1000, seed: int = 42) -> DataFrame:
    """``(keys, b, total_pos, total_neg, average_precision, roc_auc, brier)`` for b in 0..B-1, and the point estimates
    as b = B. Metrics without the classes they need are null."""
    keys, k = list(keys), len(keys)
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    # read by the cut points and by both passes: cut the lineage once
    base = df.where(y.isNotNull() & s.isNotNull() & ~F.isnan(y) & ~F.isnan(s)).select(
        *keys, *row_words(row_key, seed), (y == 1).cast("double").alias("_y"), s.alias("_s"),
        F.pow(s - y, 2).alias("_sq")).checkpoint()
    cuts = cut_points(base, "_s", M._nb(base), descending=True)
    hot = [i + 1 for i in range(len(cuts) - 1) if cuts[i + 1] == math.nextafter(cuts[i], math.inf)]
    rows, _ = bucketize(base, F.col("_s"), len(cuts) + 1, True, cuts=cuts)
    rows = rows.withColumnRenamed("_dl_bucket", "_b")
    by = [*keys, "_b"]

    def sums(w, x):
        return [x[0] @ w, (1 - x[0]) @ w]

    single = rows.where(~F.col("_b").isin(hot)) if hot else rows
    tasks = M._nb(base)
    # a bucket's rows lie together, so a task passes a bucket's sums on once
    together = single.repartition(tasks, *by).sortWithinPartitions(*by)
    parts = _combined(together, by, ["_y"], ["p", "n"], B, sums)
    if hot:
        # a score with a bucket's worth of rows: its tasks' sums, instead of its rows; drawn once for both passes
        def hot_sums(w, x):
            return [x[0] @ w, (1 - x[0]) @ w, x[1] @ w]
        many = sum_vectors(_combined(rows.where(F.col("_b").isin(hot)), [*by, "_s"], ["_y", "_sq"], ["p", "n", "q"], B, hot_sums),
                           [*by, "_s"], ["p", "n", "q"]).checkpoint()
        parts = parts.unionByName(many.select(*by, "p", "n"))
    totals = sum_vectors(parts, by, ["p", "n"])
    before = _offsets(totals, keys, B)
    null = F.lit(None)
    shape = [*by, F.lit(1).alias("_kind"), "_s", "_y", "_sq", "_h1", "_h2", *[null.cast("binary").alias(c) for c in ("p", "n", "q")]]
    union = single.select(*shape).unionByName(before.select(
        *by, F.lit(0).alias("_kind"), *[null.cast("double").alias(c) for c in ("_s", "_y", "_sq")],
        *[null.cast("long").alias(c) for c in ("_h1", "_h2")], "p", "n", null.cast("binary").alias("q")))
    if hot:
        union = union.unionByName(many.select(*by, F.lit(1).alias("_kind"), "_s", *[null.cast("double").alias(c) for c in ("_y", "_sq")],
                                              *[null.cast("long").alias(c) for c in ("_h1", "_h2")], "p", "n", "q"))
    fields = pa.schema([*_arrow(rows, by), *[(v, pa.binary()) for v in VECTORS]])

    def run(batches):
        weights, now, bucket = Weights(B), None, None
        for key, part in _runs(batches, k + 1):
            if key != now:
                if now is not None:
                    yield _emit(fields, [(*now, *map(_pack, bucket.result()))])
                now, bucket = key, _Bucket(B + 1)
            kind, s_, y_, sq_, h1, h2 = (part.column(k + 1 + i).to_numpy(zero_copy_only=False) for i in range(6))
            vectors = [part.column(k + 7 + i) for i in range(3)]
            plain = vectors[0].is_null().to_pylist()
            i = 0
            while i < len(kind):
                if not plain[i]:
                    p, n = (_unpack(v[i].as_py()) for v in vectors[:2])
                    if kind[i] == 0:
                        bucket.start(p, n)
                    else:
                        bucket.add_sums(s_[i], p, n, _unpack(vectors[2][i].as_py()))
                    i += 1
                    continue
                j = i + 1
                while j < len(kind) and j - i < CHUNK and plain[j]:
                    j += 1
                w = weights.draw(h1[i:j].astype(np.uint32), h2[i:j].astype(np.uint32))
                bucket.add(s_[i:j], w, y_[i:j], sq_[i:j])
                i = j
        if now is not None:
            yield _emit(fields, [(*now, *map(_pack, bucket.result()))])

    dealt = union.repartition(tasks, *by).sortWithinPartitions(*by, "_kind", F.col("_s").desc())
    per_bucket = dealt.mapInArrow(run, _ddl(rows, by) + ", ".join(f"{v} binary" for v in VECTORS))
    return _metric_rows(sum_vectors(per_bucket, keys, VECTORS), keys)


def _offsets(totals: DataFrame, keys: Sequence[str], B: int) -> DataFrame:
    """Sums of the buckets before each bucket of a key, its buckets read as a stream."""
    keys, k = list(keys), len(keys)
    fields = pa.schema([*_arrow(totals, [*keys, "_b"]), ("p", pa.binary()), ("n", pa.binary())])

    def run(batches):
        now, p, n = None, None, None
        for key, part in _runs(batches, k):
            if key != now:
                now, p, n = key, np.zeros(B + 1), np.zeros(B + 1)
            out = []
            for b, bp, bn in zip(*(part.column(k + i).to_pylist() for i in range(3))):
                out.append((*key, b, _pack(p), _pack(n)))
                p, n = p + _unpack(bp), n + _unpack(bn)
            yield _emit(fields, out)

    dealt = totals.select(*keys, "_b", "p", "n")
    dealt = (dealt.repartition(*keys) if keys else dealt.repartition(1)).sortWithinPartitions(*keys, "_b")
    return dealt.mapInArrow(run, _ddl(totals, [*keys, "_b"]) + "p binary, n binary")


def _metric_rows(total: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys, k = list(keys), len(keys)
    names = ["b", "total_pos", "total_neg", "average_precision", "roc_auc", "brier"]
    key_fields = _arrow(total, keys)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ap, s, sq, p, n = (_unpack(batch.column(k + j)[i].as_py()) for j in range(5))
                with np.errstate(all="ignore"):
                    values = [(p, None), (n, None), (ap / p, p > 0), ((n * p - s) / (p * n), (p > 0) & (n > 0)), (sq / (p + n), p + n > 0)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.repeat(batch.column(j)[i], len(p)).cast(key_fields[j].type) for j in range(k)], pa.array(np.arange(len(p)), pa.int32()),
                     *[pa.array(v, pa.float64(), mask=None if ok is None else ~ok) for v, ok in values]], names=[*keys, *names])

    return total.mapInArrow(run, _ddl(total, keys) + "b int, " + ", ".join(f"{c} double" for c in names[1:]))


def bootstrap_metrics(df: DataFrame, row_key: Sequence[str], keys: Sequence[str] = (),
                      label: str = "label", score: str = "score", B: int = 1000,
                      level: float = 0.95, seed: int = 42,
                      metrics: Sequence[str] = ("pr_auc", "roc_auc", "brier")) -> DataFrame:
    """F8: point estimate and percentile CI of AP / ROC-AUC / Brier per ``keys``.

    Replicates with a single class are skipped; with no valid replicate the
    interval collapses to the point.  Output: ``(keys, metric, point, lower,
    upper, se, n_replicates)``."""
    keys = list(keys)
    # keys x (B + 1) rows, read by the points and by the intervals
    reps = replicate_metrics(df, row_key, keys, label, score, B, seed).checkpoint()
    names = {"pr_auc": "average_precision", "roc_auc": "roc_auc", "brier": "brier"}
    long = reps.select(*keys, "b", ((F.col("total_pos") > 0) & (F.col("total_neg") > 0)).alias("_ok"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(names[m]).alias("value")) for m in metrics])).alias("_m")).select(
        *keys, "b", "_ok", "_m.metric", "_m.value")
    points = long.where(F.col("b") == B).select(*keys, "metric", F.col("value").alias("point"))
    ci = percentile_interval(long.where((F.col("b") < B) & F.col("_ok")), "value", [*keys, "metric"], level)
    j = points.join(ci, [*keys, "metric"], "left")
    return j.select(*keys, "metric", "point",
                    F.coalesce("lower", "point").alias("lower"),
                    F.coalesce("upper", "point").alias("upper"),
                    F.coalesce("se", F.lit(0.0)).alias("se"),
                    F.coalesce("n_replicates", F.lit(0)).cast("long").alias("n_replicates"))


def bootstrap_mean(df: DataFrame, value: str, row_key: Sequence[str], keys: Sequence[str] = (),
                   B: int = 500, level: float = 0.99, seed: int = 42) -> DataFrame:
    """Percentile CI of a mean: two B-vectors per task and key are all that is shuffled."""
    keys, k = list(keys), len(keys)
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, *row_words(row_key, seed), v.alias("_v"))
    total = sum_vectors(_combined(rows, keys, ["_v"], ["w", "wv"], B, lambda w, x: [w.sum(0), x[0] @ w]), keys, ["w", "wv"])
    key_fields = _arrow(total, keys)

    def means(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                w, wv = (_unpack(batch.column(k + j)[i].as_py())[:-1] for j in range(2))
                m = np.divide(wv, w, out=np.zeros_like(w), where=w > 0)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.repeat(batch.column(j)[i], B).cast(key_fields[j].type) for j in range(k)], pa.array(m, mask=w == 0)],
                    names=[*keys, "m"])

    reps = total.mapInArrow(means, _ddl(total, keys) + "m double").where("m is not null")
    return percentile_interval(reps, "m", keys, level)


def overlaps(a_lo, a_hi, b_lo, b_hi):
    """closed intervals overlap."""
    return (F.col(a_lo) <= F.col(b_hi)) & (F.col(b_lo) <= F.col(a_hi))


def evaluation_report(df: DataFrame, threshold: float, row_key: Sequence[str], keys: Sequence[str] = (),
                      label: str = "label", score: str = "score", B: int = 1000, seed: int = 42) -> DataFrame:
    """confusion-based rates at the threshold joined with point and
    percentile CI of PR-AUC, ROC-AUC and Brier, one row per ``keys``."""
    keys = list(keys)
    d = df.withColumnRenamed(label, "label").withColumnRenamed(score, "score") if (label, score) != ("label", "score") else df
    conf = M.confusion(d, threshold, keys)
    ci = bootstrap_metrics(d, row_key, keys, B=B, seed=seed)
    aggs = []
    for m in ("pr_auc", "roc_auc", "brier"):
        for src, suf in (("point", ""), ("lower", "_lower"), ("upper", "_upper")):
            aggs.append(F.max(F.when(F.col("metric") == m, F.col(src))).alias(f"{m}{suf}"))
    wide = ci.groupBy(*keys).agg(*aggs) if keys else ci.agg(*aggs)
    return conf.join(wide, keys) if keys else conf.join(wide)
