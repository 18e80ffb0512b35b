"""Profiling aggregations.

Per-column statistics are computed for all columns in one aggregate pass
(``count_if`` per column) and reshaped with ``unpivot``; value-count statistics
use one ``groupBy(column, value)`` over the unpivoted table, after pruning
columns that cannot qualify (distinct-count bound), so one shuffle serves all
columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.exprs import NULL_TOKEN, safe_div
from driftline.operators.quantile import with_quantiles


def _is_string(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def missing_profile(df: DataFrame, sentinel: str = "?",
                    null_meaning: Mapping[str, str] | None = None,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """D1 + D2: sentinel and null counts per column (one pass), with a meaning tag."""
    cols = list(columns or df.columns)
    meaning = dict(null_meaning or {})
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        s = F.count_if(F.col(c) == sentinel) if _is_string(df, c) else F.lit(0).cast("long")
        aggs += [s.alias(f"s__{c}"), F.count_if(F.col(c).isNull()).alias(f"n__{c}")]
    g = df.agg(*aggs)
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s__{c}").alias("n_sentinel"),
                                      F.col(f"n__{c}").alias("n_null"),
                                      F.lit(meaning.get(c, "missing")).alias("null_meaning"))
                             for c in cols]))
    long = g.select("_n", st.alias("s")).select(F.col("_n").alias("n_rows"), "s.*")
    return long.select("column_name", "n_rows", "n_sentinel",
                       (100.0 * F.col("n_sentinel") / F.col("n_rows")).alias("pct_sentinel"),
                       "n_null", (100.0 * F.col("n_null") / F.col("n_rows")).alias("pct_null"),
                       "null_meaning")


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D3: a column is constant when it has no null and min = max (partial aggregates)."""
    cols = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs += [F.count(c).alias(f"c__{c}"),
                 (F.min(c) == F.max(c)).alias(f"e__{c}")]
    g = df.agg(*aggs)
    st = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"),
        F.coalesce((F.col(f"c__{c}") == F.col("_n")) & F.col(f"e__{c}"), F.lit(False))
         .cast("int").alias("constant")) for c in cols]))
    return g.select(st.alias("s")).select("s.*")


def top_value_share(df: DataFrame, columns: Sequence[str] | None = None,
                    low: float = 0.995, high: float = 1.0) -> DataFrame:
    """Share of the most frequent value (null counted as a value) per column;
    ``near_zero_variance`` when the share is in ``[low, high)``.

    All columns share one shuffle of value counts, combined in the map tasks first, so a frequent value
    costs a row a task."""
    cols = list(columns or df.columns)
    d = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(NULL_TOKEN)).alias(c) for c in cols])
    counts = d.unpivot([], cols, "column_name", "value").groupBy("column_name", "value").count()
    s = F.col("top_share")
    return counts.groupBy("column_name").agg((F.max("count") / F.sum("count")).alias("top_share")).select(
        "column_name", "top_share", ((s >= low) & (s < high)).cast("int").alias("near_zero_variance"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Counts per class, positive rate, negative:positive ratio, majority accuracy."""
    g = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_positive"))
    return g.select("n", "n_positive", (F.col("n") - F.col("n_positive")).alias("n_negative"),
                    safe_div(F.col("n_positive"), F.col("n")).alias("positive_rate"),
                    safe_div(F.col("n") - F.col("n_positive"), F.col("n_positive")).alias("imbalance_ratio"),
                    F.greatest(safe_div(F.col("n_positive"), F.col("n")),
                               safe_div(F.col("n") - F.col("n_positive"), F.col("n"))).alias("majority_accuracy"))


def subgroup_population(df: DataFrame, dims: Sequence[str], label: str,
                        min_n: int = 500) -> DataFrame:
    """N, share, positive rate and sufficiency per value of each dimension,
    in one pass with GROUPING SETS; null is its own group."""
    dims = list(dims)
    d = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(NULL_TOKEN)).alias(c) for c in dims],
                  F.col(label).cast("int").alias("_y"))
    g = d.groupingSets([[c] for c in dims], *dims).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("positive_rate"))
    total = df.select(F.count(F.lit(1))).scalar()
    dim_name = F.lit(None).cast("string")
    grp = F.lit(None).cast("string")
    for c in reversed(dims):
        dim_name = F.when(F.col(c).isNotNull(), F.lit(c)).otherwise(dim_name)
        grp = F.when(F.col(c).isNotNull(), F.col(c)).otherwise(grp)
    return g.select(dim_name.alias("dimension"), grp.alias("grp"), "n",
                    (100.0 * F.col("n") / total).alias("pct"), "positive_rate",
                    (F.col("n") >= min_n).cast("int").alias("sufficient"))


def top_shares(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """Normalised value counts, top ``k`` (ties by value)."""
    vc = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(NULL_TOKEN)).alias("value")).count()
    total = df.select(F.count(F.lit(1))).scalar()
    return (vc.select("value", (F.col("count") / total).alias("share"))
              .orderBy(F.col("share").desc(), F.col("value")).limit(k))


def contract_fingerprint(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """sha256 (first 16 hex) of the canonical text of sorted column names and
    the sorted level set of every categorical column.  Level sets are bounded
    (categorical by contract); the final concatenation is one row."""
    names = sorted(df.columns)
    cats = sorted(categorical)
    lv = df.select(*[F.col(c).cast("string").alias(c) for c in cats]).unpivot([], cats, "column_name", "value") \
           .where(F.col("value").isNotNull()).distinct()
    per = lv.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("levels"))
    item = F.concat(F.lit('"'), F.col("column_name"), F.lit('":["'),
                    F.array_join("levels", '","'), F.lit('"]'))
    body = per.agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("lv"))
    txt = F.concat(F.lit('{"columns":["' + '","'.join(names) + '"],"levels":{'), F.col("lv"), F.lit("}}"))
    return body.select(txt.alias("canonical"), F.substring(F.sha2(txt, 256), 1, 16).alias("fingerprint"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact and approximate distinct counts per column."""
    g = df.agg(*[F.countDistinct(c).alias(f"d__{c}") for c in columns],
               *[F.approx_count_distinct(c).alias(f"a__{c}") for c in columns])
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d__{c}").alias("n_distinct"),
                                      F.col(f"a__{c}").alias("approx_distinct")) for c in columns]))
    return g.select(st.alias("s")).select("s.*")


def moments(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and exact 90th percentile."""
    return with_quantiles(df.groupBy(*keys).agg(F.avg(col).alias("mean")), df, col, {"p90": 0.9}, keys)
