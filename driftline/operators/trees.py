"""Trees of large tables, fitted on counted cells.

A tree reads a feature only by the candidate thresholds it was given, at most ``maxBins - 1`` a feature. Rows on the same
side of all of them, with the same label and weight, are one cell to every tree: they are counted once, on the executors,
and a tree is grown from the counts in one task by MLlib's own rules (histograms by bin, Gini gain, least rows of a child, the
features tried at a node, sibling leaves of one prediction merged). The resample of a forest's tree gives each row a
Poisson(1) multiplicity, so a cell of n rows gets Poisson(n) of them. The cells grow with the bins, not with the
rows; a table whose cells are not far fewer than its rows is left to MLlib.

A fitted tree scores every cell once, and a row takes the score of its cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows below which MLlib fits on the rows themselves.
LARGE = 1_000_000
#: Rows that a cell must stand for on average, and cells that a task (and once the driver) holds.
ROWS_A_CELL, MOST_CELLS = 4, 4_000_000
#: Quantiles of a class from which a feature's thresholds are chosen.
SAMPLE = 10_000
#: Scored cells up to which they are broadcast to the rows.
BROADCAST_CELLS = 2_000_000
#: Histogram entries held at a time while a tree grows.
ENTRIES = 2_000_000
EPSILON = 2.0 ** -52


# -- cells -----------------------------------------------------------------------------------

def choose_cuts(values: np.ndarray, weights: np.ndarray, n_cuts: int) -> list[float]:
    """MLlib's rule: the midpoints of all distinct values if they are few enough, else those that cut the weight most evenly."""
    known = np.isfinite(values)
    distinct, at = np.unique(values[known], return_inverse=True)
    if len(distinct) < 2:
        return []
    middle = distinct[:-1] / 2 + distinct[1:] / 2
    if len(middle) > n_cuts:
        upto = np.cumsum(np.bincount(at, weights[known]))
        stride, kept = upto[-1] / (n_cuts + 1), []
        target = stride
        for i in range(len(middle)):
            if abs(upto[i] - target) < abs(upto[i + 1] - target):
                kept.append(i)
                target += stride
        middle = middle[kept]
    return sorted(set(middle.tolist()))


@dataclass(frozen=True)
class Grid:
    """Ascending thresholds of every feature; a value's bin is the number of thresholds below it (NaN: all of them)."""

    cuts: tuple[tuple[float, ...], ...]

    @property
    def sizes(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]

    @property
    def n_cells(self) -> int:
        return math.prod(self.sizes)

    def coded(self, df: DataFrame, features: str, out: str = "_cell") -> DataFrame:
        """``df`` with ``out``: the number of the row's cell."""
        used = [i for i, c in enumerate(self.cuts) if c]
        if not used:
            return df.withColumn(out, F.lit(0).cast("long"))
        x, b = [f"_x{i}" for i in used], [f"_b{i}" for i in used]
        values = df.withColumn("_x", vector_to_array(features)).withColumns({n: F.get("_x", F.lit(i)) for n, i in zip(x, used)})
        # its buckets are closed below, a tree's are closed above
        splits = [[-math.inf, *(math.nextafter(c, math.inf) for c in self.cuts[i]), math.inf] for i in used]
        binned = Bucketizer(splitsArray=splits, inputCols=x, outputCols=b, handleInvalid="keep").transform(values)
        cell, stride = F.lit(0).cast("long"), 1
        for n, i in zip(b, used):
            cell = cell + F.least(F.col(n).cast("long"), F.lit(len(self.cuts[i])).cast("long")) * F.lit(stride).cast("long")
            stride *= len(self.cuts[i]) + 1
        return binned.withColumn(out, cell).drop("_x", *x, *b)

    def bins(self, cell: np.ndarray) -> np.ndarray:
        """The (cells, features) bins of cell numbers."""
        out, left = np.zeros((len(cell), len(self.cuts)), np.uint16), cell.copy()
        for i, n in enumerate(self.sizes):
            left, out[:, i] = np.divmod(left, n)
        return out


def fit_grid(rows: DataFrame, features: str, label: str, weight: Column, n_bins: int) -> Grid | None:
    """Thresholds of every feature from evenly spaced quantiles of all its rows in each class, weighted as the class is:
    where MLlib reads a random sample of as many rows. None with NaN or infinite values, which MLlib refuses."""
    y = F.col(label).cast("double")
    x = rows.select(F.when(y.isin(0.0, 1.0), y).alias("_y"), weight.alias("_w"), vector_to_array(features).alias("_x"))
    n = len(x.first()["_x"])
    shares = f"cast(split('{','.join(repr((i + 0.5) / SAMPLE) for i in range(SAMPLE))}', ',') as array<double>)"    # a literal to the parser
    finite = F.forall("_x", lambda v: F.abs(v) < math.inf)
    got = x.select("_y", "_w", finite.alias("_ok"), *[F.get("_x", F.lit(i)).alias(f"_x{i}") for i in range(n)]).groupBy("_y").agg(
        F.sum("_w").alias("_w"), F.min("_ok").alias("_ok"), *[F.expr(f"percentile_approx(_x{i}, {shares}, {SAMPLE})").alias(f"_x{i}") for i in range(n)]).collect()
    if not all(r["_ok"] for r in got):
        return None
    cuts = []
    for i in range(n):
        values = [np.array(r[f"_x{i}"] or [], float) for r in got]
        weights = [np.full(len(v), r["_w"] / max(len(v), 1)) for v, r in zip(values, got)]
        cuts.append(tuple(choose_cuts(np.concatenate(values), np.concatenate(weights), n_bins - 1)))
    return Grid(tuple(cuts))


# -- growing ---------------------------------------------------------------------------------

FIELDS = (("feature", np.int32), ("at", np.int32), ("low", np.int32), ("high", np.int32), ("p", np.float64))


@dataclass
class Tree:
    """Nodes, the root first. A node sends bins of ``feature`` up to ``at`` to ``low`` and others to ``high``; a leaf
    sends all to itself. ``p``: share of class 1 in the node."""

    feature: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    p: np.ndarray
    depth: int

    def score(self, bins: np.ndarray) -> np.ndarray:
        row, node = np.arange(len(bins)), np.zeros(len(bins), np.int32)
        for _ in range(self.depth):
            node = np.where(bins[row, self.feature[node]] <= self.at[node], self.low[node], self.high[node])
        return self.p[node]


def _gini(s: np.ndarray, total: np.ndarray) -> np.ndarray:
    p = s / np.where(total > 0, total, 1.0)[..., None]
    return 1.0 - p[..., 0] * p[..., 0] - p[..., 1] * p[..., 1]


def _best_splits(bins, sizes, node, y, k, kw, of_class, stats, raw, may, least_rows, least_gain):
    """Best (gain, feature, bin) of every node; cells lie by node. ``of_class``: the weight of a class's rows, if they
    have one (then ``kw`` is not read); ``may``: (nodes, features) that a node may try."""
    m, total = len(raw), stats.sum(1)
    best, feature, at = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
    impurity, step = _gini(stats, total), max(1, ENTRIES // max(sizes))
    for a in range(0, m, step):
        b = min(m, a + step)
        lo, hi = np.searchsorted(node, [a, b])
        for f, n in enumerate(sizes):
            if n < 2 or not may[a:b, f].any():
                continue
            i = 2 * ((node[lo:hi] - a) * n + bins[lo:hi, f]) + y[lo:hi]
            left = np.bincount(i, k[lo:hi], 2 * n * (b - a)).reshape(b - a, n, 2).cumsum(1)[:, :-1]
            rows = left.sum(2)
            left = left * of_class if of_class is not None else np.bincount(
                i, kw[lo:hi], 2 * n * (b - a)).reshape(b - a, n, 2).cumsum(1)[:, :-1]
            right, t = stats[a:b, None] - left, total[a:b, None]
            wl, wr = left.sum(2), right.sum(2)
            gain = impurity[a:b, None] - wl / t * _gini(left, wl) - wr / t * _gini(right, wr)
            gain[(rows < least_rows) | (raw[a:b, None] - rows < least_rows) | (gain < least_gain) | ~may[a:b, f, None]] = -1.0
            j = gain.argmax(1)
            g = gain[np.arange(b - a), j]
            better = np.flatnonzero(g > best[a:b])
            best[a + better], feature[a + better], at[a + better] = g[better], f, j[better]
    return best, feature, at


def grow(bins: np.ndarray, sizes: Sequence[int], y: np.ndarray, w: np.ndarray, k: np.ndarray, depth: int, least_rows: int,
         least_gain: float = 0.0, tried: int | None = None, rng: np.random.Generator | None = None) -> Tree:
    """A tree of ``k`` rows of weight ``w`` and class ``y`` in each cell, level by level; ``tried`` features a node, by
    default all."""
    on = k > 0
    one = [np.unique(w[y == c]) for c in (0, 1)]
    of_class = np.array([u[0] if len(u) else 0.0 for u in one]) if max(map(len, one)) < 2 else None
    bins, y, k, kw = bins[on], y[on].astype(np.int64), k[on].astype(float), (k * w)[on]
    node, base, levels = np.zeros(len(y), np.int64), 0, []
    m = 1
    for level in range(depth + 1):
        stats = np.bincount(2 * node + y, k if of_class is not None else kw, 2 * m).reshape(m, 2)
        if of_class is not None:
            stats = stats * of_class
        raw, total = np.bincount(node, k, m), stats.sum(1)
        self_ = base + np.arange(m)
        this = {"feature": np.zeros(m, np.int64), "at": np.zeros(m, np.int64), "low": self_.copy(), "high": self_.copy(),
                "p": stats[:, 1] / np.where(total > 0, total, 1.0), "one": stats[:, 1] > stats[:, 0], "leaf": np.ones(m, bool)}
        levels.append(this)
        if level == depth:
            break
        may = np.ones((m, len(sizes)), bool)
        if tried is not None and tried < len(sizes):
            may = rng.random(may.shape).argsort(1).argsort(1) < tried
        may &= (_gini(stats, total) >= EPSILON)[:, None]
        gain, feature, at = _best_splits(bins, sizes, node, y, k, kw, of_class, stats, raw, may, least_rows, least_gain)
        split = gain > 0
        if not split.any():
            break
        child = base + m + 2 * (np.cumsum(split) - 1)
        this["feature"][split], this["at"][split], this["leaf"] = feature[split], at[split], ~split
        this["low"][split], this["high"][split] = child[split], child[split] + 1
        goes = split[node]
        bins, y, k, kw, node = bins[goes], y[goes], k[goes], kw[goes], node[goes]
        node = child[node] - base - m + (bins[np.arange(len(node)), feature[node]] > at[node])
        order = np.argsort(node, kind="stable")
        bins, y, k, kw, node = bins[order], y[order], k[order], kw[order], node[order]
        base, m = base + m, 2 * int(split.sum())
    # from the lowest level up: siblings that are leaves of one prediction are one leaf
    below, start = [np.zeros(len(levels[-1]["p"]), np.int64)], base
    for this, under in zip(levels[-2::-1], levels[:0:-1]):
        lo, hi = this["low"] - start, this["high"] - start
        inner = ~this["leaf"]
        lo, hi = lo[inner], hi[inner]
        same = under["leaf"][lo] & under["leaf"][hi] & (under["one"][lo] == under["one"][hi])
        merged = np.flatnonzero(inner)[same]
        deep = np.zeros(len(inner), np.int64)
        deep[inner] = 1 + np.maximum(below[-1][lo], below[-1][hi])
        deep[merged] = 0
        start -= len(inner)
        this["leaf"][merged], this["feature"][merged], this["at"][merged] = True, 0, 0
        this["low"][merged] = this["high"][merged] = start + merged
        below.append(deep)
    return Tree(*[np.concatenate([v[n] for v in levels]).astype(t) for n, t in FIELDS], int(below[-1][0]))


# -- the fit and its model --------------------------------------------------------------------

class CellTrees(Transformer, HasFeaturesCol, HasProbabilityCol, HasPredictionCol):
    """A fitted tree or forest over the cells of ``grid``: adds the probabilities of the two classes, the mean of the
    trees' leaves, and the prediction."""

    def __init__(self, grid: Grid, trees: Sequence[Tree], featuresCol: str = "features", probabilityCol: str = "probability",
                 predictionCol: str = "prediction"):
        super().__init__()
        self.grid, self.trees = grid, list(trees)
        self._set(featuresCol=featuresCol, probabilityCol=probabilityCol, predictionCol=predictionCol)

    @property
    def depth(self) -> int:
        return max(t.depth for t in self.trees)

    def scored(self, cells: DataFrame, out: str = "_p") -> DataFrame:
        """``cells`` with ``out``: the share of class 1 in the cell that the column ``_cell`` names."""
        model, at = cells.sparkSession.sparkContext.broadcast((self.grid, self.trees)), cells.columns.index("_cell")

        def run(batches):
            grid, trees = model.value
            for batch in batches:
                bins = grid.bins(batch.column(at).to_numpy())
                p = sum((t.score(bins) for t in trees), np.zeros(len(bins))) / len(trees)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out])

        return cells.mapInArrow(run, StructType([*cells.schema.fields, StructField(out, DoubleType())]))

    def score_counts(self, df: DataFrame, by: Sequence[str], out: str = "score") -> DataFrame:
        """Rows of each ``by`` and score, ``(*by, out, _n)``: counted by cell before the cells are scored."""
        cells = self.grid.coded(df, self.getFeaturesCol()).groupBy("_cell", *by).agg(F.count(F.lit(1)).alias("_n"))
        return self.scored(cells, out).groupBy(*by, out).agg(F.sum("_n").alias("_n"))

    def _transform(self, df: DataFrame) -> DataFrame:
        coded = self.grid.coded(df, self.getFeaturesCol())
        scored = self.scored(coded.select("_cell").distinct())
        if self.grid.n_cells <= BROADCAST_CELLS:
            scored = F.broadcast(scored)
        p = F.col("_p")
        return coded.join(scored, "_cell").withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p, p))).withColumn(
            self.getPredictionCol(), (p > 0.5).cast("double")).drop("_cell", "_p")


def _counted(rows: DataFrame, grid: Grid, features: str, label: str, weight: Column, n: int) -> pa.Table | None:
    """``(_cell, _y, _w, _n)``: rows of every cell, class and weight; None if they are not far fewer than the ``n`` rows."""
    cells = grid.coded(rows.select(features, F.col(label).cast("double").alias("_y"), weight.alias("_w")), features).groupBy(
        "_cell", "_y", "_w").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    many = cells.count()
    if many > MOST_CELLS or many * ROWS_A_CELL > n or cells.where("_y is null or _w is null or _y not in (0, 1) or isnan(_w) or not _w >= 0").head(1):
        return None
    return cells.orderBy("_cell", "_y", "_w").toArrow()


def fit_on_cells(estimator, rows: DataFrame) -> CellTrees | None:
    """The estimator's tree or forest fitted on the counted cells of ``rows``; None where its rows are to be read by MLlib:
    few rows, cells that hold few of them, or settings other than those of this module."""
    forest = isinstance(estimator, RandomForestClassifier)
    if not (forest or isinstance(estimator, DecisionTreeClassifier)):
        return None
    usual = estimator.getImpurity() == "gini" and estimator.getMinWeightFractionPerNode() == 0.0
    if forest:
        usual &= estimator.getSubsamplingRate() == 1.0 and estimator.getBootstrap() and estimator.getFeatureSubsetStrategy() == "auto"
    if not usual or (n := rows.count()) < LARGE:
        return None
    features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    weighted = estimator.isDefined("weightCol") and estimator.getWeightCol()
    weight = (F.col(estimator.getWeightCol()) if weighted else F.lit(1.0)).cast("double")
    grid = fit_grid(rows, features, label, weight, estimator.getMaxBins())
    if grid is None or grid.n_cells >= 2 ** 62 or (cells := _counted(rows, grid, features, label, weight, n)) is None:
        return None
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(tuple(cells.column(c).to_numpy() for c in ("_cell", "_y", "_w", "_n")))
    n_trees = estimator.getNumTrees() if forest else 1
    tried = math.ceil(math.sqrt(len(grid.cuts))) if n_trees > 1 else None
    seed, depth = estimator.getSeed(), estimator.getMaxDepth()
    least_rows, least_gain = estimator.getMinInstancesPerNode(), estimator.getMinInfoGain()

    def run(batches):
        cell, y, w, count = shared.value
        bins = grid.bins(cell)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed & 0xFFFFFFFFFFFFFFFF, i])
                t = grow(bins, grid.sizes, y, w, rng.poisson(count) if forest else count, depth, least_rows, least_gain, tried, rng)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([t.depth], pa.int32()), *[pa.array([getattr(t, f).tobytes()], pa.binary()) for f, _ in FIELDS]],
                    names=["tree", "depth", *[f for f, _ in FIELDS]])

    tasks = min(n_trees, 4 * sc.defaultParallelism)
    grown = rows.sparkSession.range(0, n_trees, 1, tasks).mapInArrow(
        run, "tree long, depth int, " + ", ".join(f"{f} binary" for f, _ in FIELDS)).collect()   # nodes of all trees
    trees = [Tree(*[np.frombuffer(r[f], t) for f, t in FIELDS], r["depth"]) for r in sorted(grown, key=lambda r: r["tree"])]
    return CellTrees(grid, trees, features, estimator.getProbabilityCol(), estimator.getPredictionCol())
