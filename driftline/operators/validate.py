"""Record validation and table expectations.

Validation is a pure projection: every rule becomes a nullable error struct and
the row's errors are ``filter(array(...), e -> e IS NOT NULL)``, one pass, no UDF.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_TYPE = "struct<field:string,type:string,message:string,received:string>"


@dataclass(frozen=True)
class FieldRule:
    """C1 rule for one field; all checks optional."""
    field: str
    required: bool = False
    dtype: str | None = None          # "int" | "double" | "string"
    ge: float | None = None
    le: float | None = None
    max_len: int | None = None
    starts_with: str | None = None
    contains: str | None = None
    allowed: tuple | None = None


def _err(field: str, typ: str, msg: str, received: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(typ).alias("type"), F.lit(msg).alias("message"),
                    received.cast("string").alias("received"))


def rule_errors(r: FieldRule) -> list[Column]:
    c = F.col(r.field)
    out = []
    if r.required:
        out.append(F.when(c.isNull(), _err(r.field, "missing", "field required", F.lit(None))))
    num = c.cast("string").try_cast("double") if r.dtype in ("int", "double") else None
    if r.dtype in ("int", "double"):
        bad = c.isNotNull() & num.isNull()
        if r.dtype == "int":
            bad = bad | (num.isNotNull() & (num != F.floor(num)))
        out.append(F.when(bad, _err(r.field, f"{r.dtype}_parsing", f"input should be a valid {r.dtype}", c)))
    v = num if num is not None else c
    if r.ge is not None:
        out.append(F.when(v < r.ge, _err(r.field, "greater_than_equal",
                                          f"input should be greater than or equal to {r.ge:g}", c)))
    if r.le is not None:
        out.append(F.when(v > r.le, _err(r.field, "less_than_equal",
                                          f"input should be less than or equal to {r.le:g}", c)))
    if r.max_len is not None:
        out.append(F.when(F.length(c.cast("string")) > r.max_len,
                          _err(r.field, "string_too_long", f"at most {r.max_len} characters", c)))
    if r.starts_with is not None:
        out.append(F.when(~c.cast("string").startswith(r.starts_with),
                          _err(r.field, "value_error", f"must start with '{r.starts_with}'", c)))
    if r.contains is not None:
        out.append(F.when(~c.cast("string").contains(r.contains),
                          _err(r.field, "value_error", f"must contain '{r.contains}'", c)))
    if r.allowed is not None:
        out.append(F.when(c.isNotNull() & ~c.isin(list(r.allowed)),
                          _err(r.field, "enum", "input should be one of " + ", ".join(map(str, r.allowed)), c)))
    return out


def validate(df: DataFrame, rules: Sequence[FieldRule], extra_errors: Sequence[Column] = ()) -> DataFrame:
    """Add ``errors array<struct<field,type,message,received>>`` and ``valid``."""
    errs = [e for r in rules for e in rule_errors(r)] + list(extra_errors)
    arr = F.filter(F.array(*[e.cast(ERROR_TYPE) for e in errs]), lambda x: x.isNotNull())
    return df.withColumn("errors", arr).withColumn("valid", (F.size("errors") == 0).cast("int"))


def unknown_keys_error(json_col: str, allowed: Sequence[str], field: str | None = None) -> Column:
    """Keys of a JSON object outside the contract (``extra = forbid``)."""
    keys = F.map_keys(F.from_json(F.col(json_col), "map<string,string>"))
    extra = F.array_except(F.coalesce(keys, F.array().cast("array<string>")),
                           F.array(*[F.lit(k) for k in allowed]))
    return F.when(F.size(extra) > 0, _err(field or json_col, "extra_forbidden", "extra inputs are not permitted",
                                          F.array_join(F.array_sort(extra), ",")))


def flatten_errors(validated: DataFrame, id_cols: Sequence[str], max_received: int = 120) -> DataFrame:
    """One row per error, received text truncated."""
    e = validated.select(*id_cols, F.explode("errors").alias("e"))
    return e.select(*id_cols, F.col("e.field").alias("field"), F.col("e.type").alias("type"),
                    F.col("e.message").alias("message"),
                    F.substring(F.col("e.received"), 1, max_received).alias("received"))


def error_counts(flat: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """C4: error counts by field (and optional keys such as a time window)."""
    return flat.groupBy(*keys, "field").agg(F.count(F.lit(1)).alias("n_errors"))


def shape_profile(df: DataFrame, entity: str, pinned: tuple[int, int] | None = None) -> DataFrame:
    """Rows, columns, distinct entities, rows per entity, pinned-shape match."""
    ncol = len(df.columns)
    g = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(entity).alias("n_entities"))
    m = (F.lit(None).cast("int") if pinned is None else
         ((F.col("n_rows") == pinned[0]) & F.lit(ncol == pinned[1])).cast("int"))
    return g.select("n_rows", F.lit(ncol).alias("n_columns"), "n_entities",
                    (F.col("n_rows") / F.col("n_entities")).alias("rows_per_entity"), m.alias("matches_pinned"))


# -- C6 expectations -------------------------------------------------------------------

def expect_unique(df: DataFrame, keys: Sequence[str], name: str | None = None) -> DataFrame:
    """Key uniqueness: number of key values occurring more than once."""
    d = df.groupBy(*keys).count().where(F.col("count") > 1)
    return d.agg(F.count(F.lit(1)).alias("n_violations")).select(
        F.lit(name or f"unique({','.join(keys)})").alias("check"), "n_violations")


def expect_no_nulls(df: DataFrame, columns: Sequence[str], sentinel: str | None = None) -> DataFrame:
    conds = [F.col(c).isNull() for c in columns]
    if sentinel is not None:
        conds += [F.coalesce(F.col(c).cast("string") == sentinel, F.lit(False)) for c in columns]
    bad = conds[0]
    for c in conds[1:]:
        bad = bad | c
    return df.agg(F.count_if(bad).alias("n_violations")).select(
        F.lit("no_null_or_sentinel").alias("check"), "n_violations")


def expect_levels(df: DataFrame, column: str, expected: Sequence) -> DataFrame:
    """Label levels exactly the expected set: distinct other levels and expected ones that never occur are
    violations. Levels are counted, not gathered, so a column of many wrong ones fails like any other."""
    c, exp = F.col(column).cast("string"), sorted(set(map(str, expected)))
    absent = [F.when(F.coalesce(F.max(c == x), F.lit(False)), 0).otherwise(1) for x in exp]
    return df.agg((F.count_distinct(F.when(~c.isin(exp), c)) + sum(absent, F.lit(0))).cast("long").alias("n_violations")).select(
        F.lit(f"levels({column})").alias("check"), "n_violations")


def expect_columns(df: DataFrame, present: Sequence[str] = (), absent: Sequence[str] = ()) -> DataFrame:
    """Required columns present, dropped columns gone (driver metadata only)."""
    cols = set(df.columns)
    missing = [c for c in present if c not in cols]
    leftover = [c for c in absent if c in cols]
    spark = df.sparkSession
    return spark.createDataFrame(
        [("columns_present", len(missing)), ("dropped_columns_gone", len(leftover))],
        "check string, n_violations long")


def expect_codes_gone(df: DataFrame, column: str, codes: Sequence) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(F.col(column).isin(list(codes)), F.lit(False))).alias("n_violations")) \
             .select(F.lit(f"codes_gone({column})").alias("check"), "n_violations")


def expectations(*checks: DataFrame) -> DataFrame:
    """Union of checks -> ``(check, passed, n_violations)``."""
    u = checks[0]
    for c in checks[1:]:
        u = u.unionByName(c)
    return u.select("check", (F.col("n_violations") == 0).cast("int").alias("passed"),
                    F.col("n_violations").cast("long").alias("n_violations"))


def probability_rule(field: str = "score") -> FieldRule:
    """A probability is in [0, 1]."""
    return FieldRule(field, required=True, dtype="double", ge=0.0, le=1.0)
