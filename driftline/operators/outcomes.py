"""Prediction log x outcome log.

The only join of the monitored service is a lookup of outcomes by prediction
id.  Outcomes arrive late and can be corrected, so they are reduced to the
last write per id first (by a window-group limit: a hot id collapses map-side),
then joined; AQE picks broadcast / shuffle-hash / sort-merge at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_write_wins(outcomes: DataFrame, id_col: str, ts_col: str,
                    tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per id: the latest ``(ts, tiebreak...)`` wins, nulls before all; with ``n_writes``.

    A distributed table has no file order, so "last line" becomes "latest
    timestamp, then a total tiebreak". The rank filter is a window-group limit: every map task
    keeps one row per id before the shuffle, so a hot id costs a row a task; the writes are counted by a
    hash aggregate."""
    order = [F.col(c).desc_nulls_last() for c in (ts_col, *tiebreak)]
    last = top_row(outcomes, [id_col], order)
    writes = outcomes.groupBy(F.col(id_col).alias("_wid")).agg(F.count(F.lit(1)).alias("n_writes"))
    cols = [c for c in outcomes.columns if c != id_col]
    return last.join(writes, F.col(id_col).eqNullSafe(F.col("_wid"))).select(id_col, *cols, "n_writes")


def top_row(df: DataFrame, keys: Sequence[str], order: Sequence[F.Column]) -> DataFrame:
    """The first row of every key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_dl_rn", F.row_number().over(w)).where("_dl_rn = 1").drop("_dl_rn")


def join_outcomes(predictions: DataFrame, lww: DataFrame, id_col: str) -> DataFrame:
    """Predictions left-outer outcomes on the id (every prediction kept)."""
    return predictions.join(lww, id_col, "left")


def maturity_counts(joined: DataFrame, label_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """I4: matured (label known) and unmatured predictions."""
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.count(label_col).alias("n_matured"),
        (F.count(F.lit(1)) - F.count(label_col)).alias("n_unmatured"))


def unmatched_outcomes(outcomes: DataFrame, predictions: DataFrame, id_col: str) -> DataFrame:
    """Outcome rows whose id has no prediction (anti join)."""
    return outcomes.join(predictions.select(id_col), id_col, "left_anti")


def maturation(joined: DataFrame, pred_ts: str, outcome_ts: str, days: int = 30) -> DataFrame:
    """A label counts as matured only ``days`` after the prediction."""
    return joined.withColumn(
        "lag_days", (F.col(outcome_ts).cast("long") - F.col(pred_ts).cast("long")) / 86400.0
    ).withColumn(
        "matured", F.coalesce(F.col(outcome_ts) >= F.col(pred_ts) + F.expr(f"INTERVAL {days} DAYS"),
                              F.lit(False)).cast("int"))


def label_watchdog(outcomes: DataFrame, ts_col: str, as_of: F.Column,
                   limit_hours: float = 888.0) -> DataFrame:
    """Hours since the last outcome as of a time; breach above the limit."""
    g = outcomes.agg(F.max(ts_col).alias("last_outcome_ts"), F.count(F.lit(1)).alias("n_outcomes"))
    hours = (as_of.cast("long") - F.col("last_outcome_ts").cast("long")) / 3600.0
    return g.select("last_outcome_ts", "n_outcomes", hours.alias("hours_since_last"),
                    F.coalesce(hours > F.lit(limit_hours), F.lit(True)).cast("int").alias("breaching"))


def entity_overlap(df: DataFrame, entity_col: str, split_col: str) -> DataFrame:
    """Entities that appear in more than one split (must be empty)."""
    return (df.groupBy(entity_col)
              .agg(F.countDistinct(split_col).alias("n_splits"),
                   F.array_sort(F.collect_set(split_col)).alias("splits"))
              .where(F.col("n_splits") > 1))
