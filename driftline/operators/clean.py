"""Cleaning operators and the step ledger.

Each step is a ``DataFrame -> DataFrame`` function usable with ``df.transform``;
evidence (counts per step) comes from aggregates over the same inputs, never
from driver loops over rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.profile import distinct_counts
from driftline.functions.exprs import binarise, col_of, safe_div  # noqa: F401


# -- B2 exclusion with reason classes ------------------------------------------

@dataclass(frozen=True)
class ExclusionClass:
    name: str
    column: str
    codes: tuple
    classification: str
    reason: str = ""


def _in_class(c: ExclusionClass) -> Column:
    # pandas isin is False on null: null codes are kept
    return F.coalesce(F.col(c.column).isin(list(c.codes)), F.lit(False))


def exclusion_evidence(df: DataFrame, classes: Sequence[ExclusionClass], label: str) -> DataFrame:
    """B2 evidence: rows, positives and positive rate per class (0 when empty),
    every class in one conditional aggregate."""
    aggs = []
    for c in classes:
        m = _in_class(c)
        aggs += [F.count_if(m).alias(f"n__{c.name}"),
                 F.sum(F.when(m, F.col(label)).otherwise(0)).cast("long").alias(f"p__{c.name}")]
    g = df.agg(*aggs)
    st = F.explode(F.array(*[F.struct(
        F.lit(c.name).alias("step"), F.lit(c.classification).alias("classification"),
        F.col(f"n__{c.name}").alias("n_rows"), F.col(f"p__{c.name}").alias("n_positive")) for c in classes]))
    return g.select(st.alias("s")).select("s.*").withColumn(
        "positive_rate", safe_div(F.col("n_positive"), F.col("n_rows")))


def exclude(df: DataFrame, classes: Sequence[ExclusionClass]) -> DataFrame:
    """B2: drop rows in any class."""
    m = F.lit(False)
    for c in classes:
        m = m | _in_class(c)
    return df.where(~m)


# -- B3 first row per entity ---------------------------------------------------------

def first_per_entity(df: DataFrame, entity: str, order_cols: Sequence[str]) -> DataFrame:
    """Earliest row of every entity by ``order_cols``, nulls first.

    The rank filter is a window-group limit: a map task keeps one row per entity
    before the shuffle, so a hot entity costs a row a task; there is no global sort."""
    from driftline.operators.outcomes import top_row
    return top_row(df, [entity], [F.col(c).asc_nulls_first() for c in order_cols])


# -- B4 / B5 missing values ----------------------------------------------------------

def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def replace_sentinel(df: DataFrame, sentinel: str = "?", replacement: str = "Unknown",
                     columns: Sequence[str] | None = None) -> DataFrame:
    """Sentinel -> explicit category on every string column (one projection)."""
    cols = set(columns or string_columns(df))
    return df.select(*[F.when(F.col(c) == sentinel, F.lit(replacement)).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def sentinel_counts(df: DataFrame, sentinel: str = "?", columns: Sequence[str] | None = None) -> DataFrame:
    """B4 evidence: ``(column_name, n, pct)`` for every column holding the sentinel."""
    cols = list(columns or string_columns(df))
    g = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c) == sentinel).alias(c) for c in cols])
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in cols]))
    return g.select("_n", st.alias("s")).select("s.column_name", "s.n",
                                               (100.0 * F.col("s.n") / F.col("_n")).alias("pct")) \
            .where(F.col("n") > 0)


def fill_not_measured(df: DataFrame, columns: Sequence[str], value: str = "NotMeasured") -> DataFrame:
    """Null -> ``value`` on the listed columns only."""
    present = [c for c in columns if c in df.columns]
    return df.fillna({c: value for c in present}) if present else df


# -- B6 code banding -------------------------------------------------------------------

@dataclass(frozen=True)
class Band:
    name: str
    ranges: tuple = ()        # closed numeric ranges (lo, hi)
    exact: tuple = ()         # exact numeric values
    int_equal: tuple = ()     # integer part equals


@dataclass(frozen=True)
class BandRules:
    bands: tuple
    missing_tokens: tuple = ("Unknown", "?", "nan", "None")
    missing_band: str = "Unknown"
    text_prefixes: tuple = ()
    default: str = "Other"


# The clinical bands of ICD-9 diagnosis codes used by the monitored
# service, in rule order (first match wins).
ICD9_RULES = BandRules(
    bands=(
        Band("Circulatory", ranges=((390, 459),), exact=(785,)),
        Band("Respiratory", ranges=((460, 519),), exact=(786,)),
        Band("Digestive", ranges=((520, 579),), exact=(787,)),
        Band("Diabetes", int_equal=(250,)),
        Band("Injury", ranges=((800, 999),)),
        Band("Musculoskeletal", ranges=((710, 739),)),
        Band("Genitourinary", ranges=((580, 629),), exact=(788,)),
        Band("Neoplasms", ranges=((140, 239),)),
    ),
    text_prefixes=("V", "E"),
)


def band_expr(c: str | Column, rules: BandRules) -> Column:
    """Text code -> band with the ordered rules; no UDF (``try_cast`` + ``when``)."""
    txt = col_of(c).cast("string")
    v = txt.try_cast("double")
    e = F.when(txt.isNull() | txt.isin(list(rules.missing_tokens)), F.lit(rules.missing_band))
    for p in rules.text_prefixes:
        e = e.when(txt.startswith(p), F.lit(rules.default))
    e = e.when(v.isNull(), F.lit(rules.default))
    for b in rules.bands:
        cond = F.lit(False)
        for lo, hi in b.ranges:
            cond = cond | ((v >= lo) & (v <= hi))
        for x in b.exact:
            cond = cond | (v == x)
        for x in b.int_equal:
            cond = cond | (F.when(F.abs(v) < 9.2e18, v.cast("long")) == x)
        e = e.when(cond, F.lit(b.name))
    return e.otherwise(F.lit(rules.default))


def band_codes(df: DataFrame, columns: Sequence[str], rules: BandRules) -> DataFrame:
    """B6 on several columns (one projection)."""
    cols = set(columns)
    return df.select(*[band_expr(c, rules).alias(c) if c in cols else F.col(c) for c in df.columns])


# -- B7 / B9 / B10 / B11 column contract ------------------------------------------------

def drop_with_reasons(df: DataFrame, reasons: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Drop the present columns of ``reasons``; return what was dropped and why."""
    present = {c: r for c, r in reasons.items() if c in df.columns}
    return df.drop(*present), present


def feature_projection(df: DataFrame, contract_columns: Sequence[str]) -> DataFrame:
    """Contract columns that are present, in contract order."""
    return df.select(*[c for c in contract_columns if c in df.columns])


def split_xy(df: DataFrame, label: str, identifiers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Features without identifiers and the label."""
    return df.drop(label, *[c for c in identifiers if c in df.columns]), df.select(label)


def align_columns(train_cols: Sequence[str], df: DataFrame, fill=0) -> DataFrame:
    """Reorder ``df`` to ``train_cols``, adding missing ones filled with ``fill``
    and dropping extras (the one-hot reindex)."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in train_cols])


def indicator_columns(df: DataFrame, col: str, levels: Sequence[str], prefix: str | None = None) -> DataFrame:
    """One 0/1 column per level (fitted levels; unseen values give all zeros)."""
    p = prefix or col
    return df.select("*", *[(F.col(col) == lv).cast("int").alias(f"{p}_{lv}") for lv in levels])


# -- B12 defaults and trimming -------------------------------------------------------------

def apply_defaults(df: DataFrame, defaults: Mapping[str, object], trim: Sequence[str] = ()) -> DataFrame:
    """Trim listed string fields, then fill nulls with defaults."""
    out = df
    for c in trim:
        out = out.withColumn(c, F.trim(F.col(c)))
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(out.schema[c].dataType)))
    return out


# -- B13 masking ------------------------------------------------------------------------------

def _mask(c: Column, dt: T.DataType, keys: set[str], token: str) -> Column:
    if isinstance(dt, T.StructType):
        out = c
        for f in dt.fields:
            if f.name.lower() in keys:
                masked = (F.when(c[f.name].isNull(), F.lit(None).cast("string")).otherwise(F.lit(token))
                          if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType))
                out = out.withField(f.name, masked)
            elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                out = out.withField(f.name, _mask(c[f.name], f.dataType, keys, token))
        return F.when(c.isNull(), F.lit(None)).otherwise(out)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _mask(x, dt.elementType, keys, token))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(list(keys)), F.lit(token))
                                  .otherwise(v.cast("string")) if isinstance(dt.valueType, T.StringType) else v)
    return c


def mask_fields(df: DataFrame, keys: Sequence[str], token: str = "***") -> DataFrame:
    """Mask sensitive keys at any depth (structs, arrays of structs, maps)."""
    ks = {k.lower() for k in keys}
    cols = []
    for f in df.schema.fields:
        if f.name.lower() in ks:
            cols.append((F.when(F.col(f.name).isNull(), F.lit(None)).otherwise(F.lit(token))
                         if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(_mask(F.col(f.name), f.dataType, ks, token).alias(f.name))
    return df.select(*cols)


# -- B14-B16 request helpers -----------------------------------------------------------------

def batch_attribution(df: DataFrame, batch_col: str, order_cols: Sequence[str], total_col: str) -> DataFrame:
    """Each item of a batch gets its 0-based index and ``total / n``.

    The index is a keyed ``global_rank`` (a hot batch is split across buckets);
    the batch size is a partial aggregate joined back."""
    from driftline.operators.order import global_rank
    r = global_rank(df, order_cols, "_idx", keys=[batch_col])
    n = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("batch_size"))
    return r.join(n, batch_col).withColumn("batch_index", F.col("_idx") - 1).drop("_idx") \
            .withColumn("item_ms", F.col(total_col) / F.col("batch_size"))


def normalise_routes(df: DataFrame, key: Column, routes: DataFrame, key_col: str = "route_key",
                     template_col: str = "template") -> DataFrame:
    """Concrete path -> template via a left join on the route table (which Spark broadcasts
    while it is small); unmatched paths share one bucket."""
    j = df.withColumn(key_col, key).join(routes, key_col, "left")
    return j.withColumn("route", F.coalesce(F.col(template_col), F.lit("unmatched"))).drop(key_col, template_col)



def cleaning_ledger(df: DataFrame, classes: Sequence[ExclusionClass], entity: str, order_cols: Sequence[str],
                    sentinel: str, label: str, replacement: str = "Unknown", not_measured: Sequence[str] = (),
                    bands: tuple[Sequence[str], BandRules] | None = None, drops: Mapping[str, str] | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and the step ledger ``(step, metric, value)``, the steps in fixed order: exclusion
    classes, first row per entity, sentinel -> ``replacement``, null -> ``NotMeasured`` on ``not_measured``, code banding of
    ``bands`` (columns, rules), ``drops`` (column -> reason).

    Row counts come from one aggregate before and one behind the entity step, and all evidence of the column
    steps from one pass over the rows that are kept."""
    from driftline.functions.exprs import scalars
    ev = exclusion_evidence(df, classes, label)
    rows = [ev.select("step", F.lit("n_rows").alias("metric"), F.col("n_rows").cast("double").alias("value")),
            ev.select("step", F.lit("n_positive").alias("metric"), F.col("n_positive").cast("double").alias("value")),
            ev.select("step", F.lit("positive_rate").alias("metric"), F.col("positive_rate").alias("value"))]
    kept = exclude(df, classes)
    first = first_per_entity(kept, entity, order_cols)
    ks = scalars(kept.agg(F.count(F.lit(1)).alias("b"), F.countDistinct(entity).alias("u")), "b", "u")
    b, u, a = ks["b"], ks["u"], first.select(F.count(F.lit(1))).scalar()
    one = df.sparkSession.range(1)
    for m, v in (("rows_before", b), ("rows_after", a), ("rows_removed", b - a), ("unique_entities", u)):
        rows.append(one.select(F.lit("first_per_entity").alias("step"), F.lit(m).alias("metric"),
                               v.cast("double").alias("value")))
    sc = sentinel_counts(first, sentinel)
    rows.append(sc.select(F.lit("sentinel_to_text").alias("step"),
                          F.concat(F.lit("sentinel:"), "column_name").alias("metric"),
                          F.col("n").cast("double").alias("value")))
    clean = replace_sentinel(first, sentinel, replacement)
    filled = fill_not_measured(clean, not_measured)
    banded = band_codes(filled, bands[0], bands[1]) if bands else filled
    out, reasons = drop_with_reasons(banded, drops or {})
    if not_measured:
        counts = clean.agg(*[F.count_if(F.col(c).isNull()).cast("double").alias(c) for c in not_measured])
        rows.append(_metrics(counts, "null_to_not_measured", {f"filled:{c}": c for c in not_measured}))
    if bands:
        # cardinality of the codes before and of the bands after
        before, after = distinct_counts(filled, bands[0]), distinct_counts(banded, bands[0])
        for name, d in (("levels_before", before), ("levels_after", after)):
            rows.append(d.select(F.lit("code_banding").alias("step"), F.concat(F.lit(f"{name}:"), "column_name").alias("metric"),
                                 F.col("n_distinct").cast("double").alias("value")))
    for c, reason in sorted(reasons.items()):
        rows.append(one.select(F.lit("drop_columns").alias("step"), F.lit(f"dropped:{c}:{reason}").alias("metric"),
                               F.lit(1.0).alias("value")))
    fs = scalars(out.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("r")), "n", "r")
    nin, nout = df.select(F.count(F.lit(1))).scalar(), fs["n"]
    for m, v in (("rows_in", nin), ("rows_out", nout), ("rows_removed", nin - nout),
                 ("pct_removed", (nin - nout) * 100.0 / nin), ("positive_rate", fs["r"]), ("columns_out", F.lit(len(out.columns)))):
        rows.append(one.select(F.lit("all_steps").alias("step"), F.lit(m).alias("metric"),
                               v.cast("double").alias("value")))
    ledger = rows[0]
    for r in rows[1:]:
        ledger = ledger.unionByName(r)
    return out, ledger


def _metrics(one_row: DataFrame, step: str, named: Mapping[str, str]) -> DataFrame:
    """``(step, metric, value)`` rows of a one-row table's columns."""
    st = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in named.items()]))
    return one_row.select(st.alias("s")).select(F.lit(step).alias("step"), "s.metric", "s.value")
