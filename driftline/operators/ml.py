"""Feature pipelines, models and scoring with MLlib.

Fitting is MLlib's distributed training; everything around it (level
folding, class weights, calibration choice, sweeps) is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.storagelevel import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.trees import CellTrees, fit_on_cells

INFREQUENT = "__infrequent__"


# -- G14 class weights ------------------------------------------------------------------

def balanced_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """``n / (2 * n_class)`` per row. The two class counts reach the driver: as scalar subqueries they would be
    counted again by every pass of a fit that reads the weights."""
    g = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    n, p = F.lit(g["n"]).cast("long"), F.lit(g["p"]).cast("long")
    w = F.when(F.col(label) == 1, n / (2 * p)).otherwise(n / (2 * (n - p)))
    return df.withColumn(weight_col, w.cast("double"))


# -- G2 infrequent folding ------------------------------------------------------------------

@dataclass(frozen=True)
class Levels:
    """Fitted levels: ``frequent`` (column_name, level), per column whether an infrequent bucket exists, and the columns
    whose levels are few enough to be broadcast."""

    frequent: DataFrame
    infrequent: dict[str, bool]
    few: frozenset[str] = frozenset()

    def fold(self, df: DataFrame) -> DataFrame:
        """G2 transform: infrequent and unseen values -> the infrequent bucket when it exists, else null (all-zero
        indicators). A join per column with its level table, which is broadcast while its levels are few: their counted
        number says so, Spark's estimate from the rows that they were counted in does not."""
        out = df
        for c, bucket in self.infrequent.items():
            level = self.frequent.where(F.col("column_name") == c).select(F.col("level").alias("_level"))
            other = F.lit(INFREQUENT) if bucket else F.lit(None)
            if c in self.few:
                level = F.broadcast(level)
            out = out.join(level, out[c].cast("string") == F.col("_level"), "left").withColumn(
                c, F.coalesce("_level", other)).drop("_level")
        return out


#: Levels of a column up to which its level table is broadcast.
BROADCAST_LEVELS = 10_000


def fit_levels(df: DataFrame, cols: Sequence[str], min_frequency: int = 30) -> Levels:
    """G2 fit: the frequent levels of each column (``min_frequency`` rows or more) and whether an infrequent bucket
    exists. One value count for all columns, written once in the shared folder; three numbers a column reach the driver."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "level")
    counts = long.where(F.col("level").isNotNull()).groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    known = {r["column_name"]: r for r in counts.groupBy("column_name").agg(
        F.count_if(F.col("n") < min_frequency).alias("rare"), F.count_if(F.col("n") >= min_frequency).alias("frequent")).collect()}
    return Levels(counts.where(F.col("n") >= min_frequency).select("column_name", "level"),
                  {c: c in known and known[c]["rare"] > 0 for c in cols},
                  frozenset(c for c in cols if c not in known or known[c]["frequent"] <= BROADCAST_LEVELS))


def preprocessor(numeric: Sequence[str], categorical: Sequence[str], with_mean: bool = True) -> list:
    """G1 + G2 + G3 stages: standardised numerics, one-hot categoricals (unseen
    -> zeros), assembled into ``features``."""
    stages = []
    vec_in = []
    if numeric:
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="_num", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="_num", outputCol="_num_s", withMean=with_mean, withStd=True))
        vec_in.append("_num_s")
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"_{c}_i", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_v", dropLast=True, handleInvalid="keep"))
        vec_in.append(f"_{c}_v")
    stages.append(VectorAssembler(inputCols=vec_in, outputCol="features"))
    return stages


# -- G4 / G5 / G6 candidates ------------------------------------------------------------------

def logistic(C: float, sum_w: float, max_iter: int = 2000, label: str = "label", weight: str = "weight"):
    """L2 logistic regression; scikit-learn's C penalises the **sum** of
    losses, MLlib averages over weights: ``regParam = 1 / (C * sum_w)``."""
    return LogisticRegression(labelCol=label, weightCol=weight, regParam=1.0 / (C * sum_w), elasticNetParam=0.0,
                              standardization=False, maxIter=max_iter, tol=1e-6)


def forest(num_trees: int = 300, depth: int = 6, min_leaf: int = 50, seed: int = 42, label: str = "label",
           weight: str = "weight"):
    """Shallow balanced random forest."""
    return RandomForestClassifier(labelCol=label, weightCol=weight, numTrees=num_trees, maxDepth=depth,
                                  minInstancesPerNode=min_leaf, seed=seed)


def fit_pipelines(train: DataFrame, numeric, categorical, estimators: Mapping[str, object]) -> dict[str, PipelineModel]:
    """Preprocessor + estimator fitted together, for several estimators with one preprocessor. An estimator reads its
    rows several times before it holds them in a form of its own, so the preprocessed ones (what the estimators read of
    them) are kept, on disk where memory ends, until all are fitted. Trees of a large table are fitted on its counted cells."""
    prepared = Pipeline(stages=preprocessor(numeric, categorical)).fit(train)
    wanted = dict.fromkeys(e.getOrDefault(p) for e in estimators.values() for p in ("featuresCol", "labelCol", "weightCol")
                           if e.hasParam(p) and e.isDefined(p))
    rows = prepared.transform(train).select(*[c for c in wanted if c]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {name: PipelineModel(stages=[*prepared.stages, fit_on_cells(e, rows) or e.fit(rows)]) for name, e in estimators.items()}
    finally:
        rows.unpersist()


def fit_pipeline(train: DataFrame, numeric, categorical, estimator) -> PipelineModel:
    """``fit_pipelines`` of one estimator."""
    return fit_pipelines(train, numeric, categorical, {"": estimator})[""]


def score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Batch scoring; positive-class probability as a double column."""
    t = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    helpers = [c for c in t.columns if c not in df.columns and c != out]
    return t.drop(*helpers)


def score_counts(model: PipelineModel, df: DataFrame, by: Sequence[str], out: str = "score") -> DataFrame:
    """G11 counted: rows of each ``by`` and score, ``(*by, out, _n)``."""
    if isinstance(model.stages[-1], CellTrees):
        return model.stages[-1].score_counts(PipelineModel(stages=model.stages[:-1]).transform(df), by, out)
    return score(model, df, out).groupBy(*by, out).agg(F.count(F.lit(1)).alias("_n"))


def prior_score(train: DataFrame, df: DataFrame, label: str = "label", out: str = "score") -> DataFrame:
    """The prior model scores every row with the training prevalence."""
    return df.withColumn(out, train.agg(F.avg(F.col(label).cast("double"))).scalar())


def label_at(df: DataFrame, score_col: str, threshold_col: str, out: str = "predicted_label") -> DataFrame:
    """Label from the score at the **model's own** threshold column."""
    return df.withColumn(out, (F.col(score_col) >= F.col(threshold_col)).cast("int"))


# -- G7 / G8 calibration ------------------------------------------------------------------------

def fit_isotonic(val: DataFrame, score_col: str = "score", label: str = "label"):
    return IsotonicRegression(featuresCol=score_col, labelCol=label, predictionCol="_cal").fit(val)


def fit_sigmoid(val: DataFrame, score_col: str = "score", label: str = "label"):
    va = VectorAssembler(inputCols=[score_col], outputCol="_sf")
    lr = LogisticRegression(featuresCol="_sf", labelCol=label, regParam=0.0, predictionCol="_sp",
                            probabilityCol="_sprob", rawPredictionCol="_sraw")
    return Pipeline(stages=[va, lr]).fit(val)


def apply_calibration(method: str, cal, df: DataFrame, score_col: str = "score", out: str = "cal_score") -> DataFrame:
    if method == "isotonic":
        return cal.transform(df).withColumnRenamed("_cal", out)
    t = cal.transform(df)
    return t.withColumn(out, vector_to_array("_sprob")[1]).drop("_sf", "_sp", "_sprob", "_sraw")


def choose_calibration(val: DataFrame, score_col: str = "score", label: str = "label") -> tuple[str, object, DataFrame]:
    """G7 + G8: fit both maps on validation (base model frozen), keep the one
    with the lower validation ECE; both reports are returned as one frame."""
    from driftline.operators.metrics import calibration_bins, ece
    iso, sig = fit_isotonic(val, score_col, label), fit_sigmoid(val, score_col, label)
    stacked = (apply_calibration("isotonic", iso, val, score_col, "p").select(F.lit("isotonic").alias("method"),
                                                                              F.col(label).alias("label"), F.col("p").alias("score"))
               .unionByName(apply_calibration("sigmoid", sig, val, score_col, "p")
                            .select(F.lit("sigmoid").alias("method"), F.col(label).alias("label"), F.col("p").alias("score"))))
    rep = ece(calibration_bins(stacked, ["method"]), ["method"])
    best = rep.orderBy("ece", "method").first()["method"]   # two rows
    return best, (iso if best == "isotonic" else sig), rep


# -- G13 response sweep and behaviour suites --------------------------------------------------------

def _columns(stage, params: Sequence[str]) -> set[str]:
    """The columns that the stage's parameters name."""
    named = [stage.getOrDefault(p) for p in params if stage.hasParam(p) and stage.isDefined(p)]
    return {c for v in named for c in ([v] if isinstance(v, str) else v)}


def _moved_by(model: PipelineModel, feature: str) -> tuple[list, list]:
    """The stages that read nothing of ``feature``, and those that do, themselves or by an earlier stage's output."""
    moved, still, moving = {feature}, [], []
    for stage in model.stages:
        if _columns(stage, ("inputCol", "inputCols", "featuresCol")) & moved:
            moving.append(stage)
            moved |= _columns(stage, ("outputCol", "outputCols", "predictionCol", "probabilityCol", "rawPredictionCol"))
        else:
            still.append(stage)
    return still, moving


def response(model: PipelineModel, rows: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    """``rows`` with ``_response``: the row's scores along the ascending ``grid`` of ``feature``. One scoring a grid value
    beside the others on the same row: nothing is repeated or shuffled, and the stages that do not read the feature
    run once a row."""
    still, moving = _moved_by(model, feature)
    if moving and moving[-1].hasParam("rawPredictionCol"):
        moving[-1] = moving[-1].copy({moving[-1].rawPredictionCol: ""})      # the probability in one step
    out = PipelineModel(stages=still).transform(rows.withColumn("_kept", F.col(feature)))
    helpers = [c for c in out.columns if c not in rows.columns and c != "_kept"]
    for i, g in enumerate(sorted(grid)):
        out = score(PipelineModel(stages=moving), out.withColumn(feature, F.lit(float(g))), f"_at{i}")
    names = [f"_at{i}" for i in range(len(grid))]
    return out.withColumn(feature, F.col("_kept")).withColumn("_response", F.array(*names)).drop("_kept", *helpers, *names)


def monotone(response_col: str, direction: int, slack: float = 1e-12) -> Column:
    """Whether a response never goes against ``direction``."""
    r = F.col(response_col)
    steps = F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: (F.get(r, i) - F.get(r, i - 1)) * direction)
    return F.forall(steps, lambda d: d >= -slack)


def sweep(model: PipelineModel, rows: DataFrame, feature: str, grid: Sequence[float], direction: int = 1) -> DataFrame:
    """G13 + K4: every row scored at every grid value of ``feature``; share of rows whose score is monotone in the
    expected ``direction``."""
    per = response(model, rows, feature, grid).select(monotone("_response", direction).alias("_ok"))
    return per.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("_ok").cast("double")).alias("monotone_share"))


def behaviour_suites(model: PipelineModel, rows: DataFrame, key: Sequence[str], numeric: Sequence[str], categorical: Sequence[str],
                     sweeps: Mapping[str, tuple[Sequence[float], int]], extremes: Sequence[float] = (-1e6, 0.0, 1e6),
                     copies: int = 5) -> DataFrame:
    """G13 + K4: ``(suite, n_checked, n_failed, passed)``. Every row is scored again under a change that must not
    matter, beside its own score on the same row: columns reversed, rows dealt and ordered anew, rows in
    copies; or under one that must leave a probability: unseen levels in all categories, numeric
    extremes; and along the grid of each feature of ``sweeps`` ((grid, direction) by feature)."""
    # read by every suite
    base = score(model, rows, "_own").select(*key, *numeric, *categorical, "_own").checkpoint()
    same = F.abs(F.col("_again") - F.col("_own")) <= 1e-12
    valid = F.col("_again").isNotNull() & ~F.isnan("_again") & (F.col("_again") >= 0) & (F.col("_again") <= 1)

    def again(df):
        return score(model, df, "_again")
    order = F.xxhash64(F.lit(91), *key)
    checks = [("column_order", again(base.select(*reversed(base.columns))), same),
              ("batch_position", again(base.repartition(7, order).sortWithinPartitions(order)), same),
              ("batch_size", again(base.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))), same),
              ("probability", base.withColumn("_again", F.col("_own")), valid)]
    unseen = base
    for c in categorical:
        unseen = unseen.withColumn(c, F.lit("a level that no fit has seen"))
    checks.append(("unseen_levels", again(unseen), valid))
    for x in extremes:
        far = base
        for c in numeric:
            far = far.withColumn(c, F.lit(float(x)))
        checks.append((f"extreme_{x:g}", again(far), valid))
    for feature, (grid, direction) in sweeps.items():
        checks.append((f"monotone_{feature}", response(model, base, feature, grid), monotone("_response", direction)))
    out = None
    for name, df, ok in checks:
        one = df.agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_failed")).select(
            F.lit(name).alias("suite"), "n_checked", "n_failed", (F.col("n_failed") == 0).cast("int").alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


# -- F19 separability ------------------------------------------------------------------------------

def separability(train: DataFrame, test: DataFrame, numeric, categorical, max_depth: int = 30) -> DataFrame:
    """an unconstrained tree (MLlib caps depth at 30); test ROC-AUC above
    0.95 means the label is trivially separable (leakage alarm)."""
    from driftline.operators.metrics import rank_metrics, score_curve
    # the tree has about as many nodes as rows: cached node ids spare each level the walk from the root, more
    # memory for the nodes' statistics spares passes
    dt = DecisionTreeClassifier(labelCol="label", maxDepth=max_depth, minInstancesPerNode=1, maxBins=64, seed=42,
                                cacheNodeIds=True, maxMemoryInMB=512)
    m = fit_pipeline(train, numeric, categorical, dt)

    def curve(df: DataFrame) -> DataFrame:
        # scored once, to the counts of its scores, which are read several times
        return score_curve(score_counts(m, df, ["label"]).checkpoint(), weight="_n")
    tr = rank_metrics(curve(train)).select(F.col("roc_auc").alias("train_auc"))
    te = rank_metrics(curve(test)).select("roc_auc").scalar()
    depth = m.stages[-1].depth
    return tr.select("train_auc", te.alias("test_auc"), F.lit(depth).alias("depth"),
                     (te > 0.95).cast("int").alias("alarm"))
