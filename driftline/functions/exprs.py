"""Column-expression helpers shared by the operators.

All helpers return ``Column`` objects so they stay inside whole-stage codegen;
none of them touches Python per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "NULL_TOKEN", "EPSILON", "col_of", "binarise", "safe_div", "as_category",
    "linspace", "lit_array", "count_le", "count_lt", "hash_uniform",
    "poisson1_cdf", "poisson_from_uniform", "t_test_p", "r6", "round_half_up",
    "status_class", "percentile_exact", "scalars",
]

# Fixed values -------------------------------------------------------------
#: text a null group key becomes when keys are compared as strings
NULL_TOKEN = "<null>"
#: probability floor used by the population stability index
EPSILON = 1e-6


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binarise(c: str | Column, positive) -> Column:
    """B1: 1 where ``c == positive``; everything else, null included, is 0."""
    return F.coalesce(col_of(c) == F.lit(positive), F.lit(False)).cast("int")


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    """``a / b`` with a zero (or null) denominator mapped to ``default``."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def as_category(c: str | Column) -> Column:
    """String form of a group key; null is its own category."""
    return F.coalesce(col_of(c).cast("string"), F.lit(NULL_TOKEN))


def linspace(bins: int) -> list[float]:
    """``bins + 1`` evenly spaced points on [0, 1], computed as ``i * step``
    with the last point pinned to 1.0 (the same floats a linspace yields)."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def lit_array(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def count_le(edges: Column | Sequence[float], x: str | Column, max_len: int | None = None) -> Column:
    """Number of edges ``<= x`` (index of a half-open bin ``[lo, hi)``).

    With literal edges or a known maximum array length this is a sum of plain
    comparisons (whole-stage codegen); otherwise a higher-order ``filter``."""
    return _count(edges, x, max_len, strict=False)


def count_lt(edges: Column | Sequence[float], x: str | Column, max_len: int | None = None) -> Column:
    """Number of edges ``< x`` (index of a right-closed bin ``(lo, hi]``)."""
    return _count(edges, x, max_len, strict=True)


def _count(edges, x, max_len, strict):
    xc = col_of(x)
    if isinstance(edges, (list, tuple)):
        terms = [((F.lit(float(e)) < xc) if strict else (F.lit(float(e)) <= xc)).cast("int") for e in edges]
    elif max_len is not None:
        terms = []
        for i in range(1, max_len + 1):
            e = F.try_element_at(edges, F.lit(i))
            terms.append(F.coalesce((e < xc) if strict else (e <= xc), F.lit(False)).cast("int"))
    else:
        return F.size(F.filter(edges, (lambda e: e < xc) if strict else (lambda e: e <= xc)))
    out = F.lit(0)
    for t in terms:
        out = out + t
    return out


def hash_uniform(*parts: str | Column, seed: int = 42) -> Column:
    """Reproducible uniform in [0, 1) from the md5 of ``parts`` joined by '|'.

    The first 8 hex digits are read as an unsigned 32-bit integer, so the same
    value can be computed by any SQL engine with md5 and hex parsing.
    """
    txt = F.concat_ws("|", *[col_of(p).cast("string") for p in parts], F.lit(str(seed)))
    hex8 = F.substring(F.md5(txt), 1, 8)
    return F.conv(hex8, 16, 10).cast("double") / F.lit(float(2 ** 32))


#: Shifts and factors of the 32-bit mixer behind replicate weights; products stay below 2**63.
MIX = ((16, 15, 16), (0x7FEB352D, 0x45D9F3B))


def poisson1_cdf(kmax: int = 12) -> list[float]:
    """CDF of Poisson(1) at 0..kmax (a rule, not a table)."""
    out, acc, term = [], 0.0, math.exp(-1.0)
    for k in range(kmax + 1):
        if k > 0:
            term /= k
        acc += term
        out.append(acc)
    return out


def poisson_from_uniform(u: Column, kmax: int = 12) -> Column:
    """Inverse CDF of Poisson(1): smallest k with CDF(k) >= u."""
    cdf = poisson1_cdf(kmax)
    expr = F.lit(kmax)
    for k in range(kmax - 1, -1, -1):
        expr = F.when(u <= F.lit(cdf[k]), F.lit(k)).otherwise(expr)
    return expr


def t_test_p(rho: Column, k: int) -> Column:
    """Two-sided p-value of a Spearman/Pearson coefficient over ``k`` points.

    Student t with ``df = k - 2`` degrees of freedom: ``p = I_x(df / 2, 1 / 2)`` at ``x = 1 - rho**2``, the regularised
    incomplete beta function by its continued fraction (modified Lentz), for any number of points.
    |rho| = 1 gives p = 0, and fewer than three points give null."""
    dof = k - 2
    if dof <= 0:
        return F.lit(None).cast("double")
    r2 = rho * rho
    return F.when(r2 >= 1.0, F.lit(0.0)).when(rho.isNotNull(), incomplete_beta(F.lit(1.0) - r2, dof / 2, 0.5))


def incomplete_beta(x: Column, a: float, b: float, steps: int = 200) -> Column:
    """Regularised ``I_x(a, b)`` for x in [0, 1]; ``steps`` bounds the continued fraction, which settles to 1e-14 long before."""
    # the fraction converges fast below the mean; above it the other tail is computed
    low = x < F.lit((a + 1) / (a + b + 2))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(low, _beta_tail(x, a, b, steps)).otherwise(
        F.lit(1.0) - _beta_tail(F.lit(1.0) - x, b, a, steps))


def _beta_tail(x: Column, a: float, b: float, steps: int) -> Column:
    tiny = F.lit(1e-300)
    front = F.exp(F.lit(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - math.log(a)) + F.lit(a) * F.log(x) + F.lit(b) * F.log1p(-x))

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def once(s: Column, factor: Column) -> Column:
        d = F.lit(1.0) / away(F.lit(1.0) + factor * s["d"])
        c = away(F.lit(1.0) + factor / s["c"])
        return F.struct((s["h"] * d * c).alias("h"), c.alias("c"), d.alias("d"))

    def step(s: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (F.lit(b) - m) * x / ((F.lit(a - 1) + 2 * m) * (F.lit(a) + 2 * m))
        odd = -(F.lit(a) + m) * (F.lit(a + b) + m) * x / ((F.lit(a) + 2 * m) * (F.lit(a + 1) + 2 * m))
        return once(s, F.when(j % 2 == 0, even).otherwise(odd))

    d0 = F.lit(1.0) / away(F.lit(1.0) - F.lit((a + b) / (a + 1)) * x)
    start = F.struct(d0.alias("h"), F.lit(1.0).alias("c"), d0.alias("d"))
    return front * F.aggregate(F.sequence(F.lit(2), F.lit(2 * steps + 1)), start, step, lambda s: s["h"])


def round_half_up(c: str | Column, dp: int = 6) -> Column:
    """``floor(x * 10^dp + 0.5) / 10^dp`` on doubles.

    Every SQL engine evaluates these IEEE operations identically, unlike
    ``round`` (which some engines apply to the shortest decimal text of the
    double); magnitudes of 1e12 and more are returned unrounded."""
    x = col_of(c).cast("double")
    m = float(10 ** dp)
    return F.when(F.abs(x) < 1e12, F.floor(x * m + 0.5) / m).otherwise(x)


def scalars(df, *cols: str) -> dict:
    """Several values of a one-row frame as scalar-subquery columns that share
    ONE subquery (a struct), so the frame is evaluated once, not once per value."""
    s = df.select(F.struct(*cols).alias("_s")).scalar()
    return {c: s[c] for c in cols}


def r6(c: str | Column, dp: int = 6) -> Column:
    return round_half_up(c, dp)


def status_class(code: str | Column) -> Column:
    """HTTP status code -> class label such as ``5xx``."""
    return F.concat(F.floor(col_of(code) / 100).cast("string"), F.lit("xx"))


def percentile_exact(c: str | Column, qs: Sequence[float]) -> Column:
    """Exact linear-interpolated percentiles (array) of ``c``."""
    return F.percentile(col_of(c), lit_array(qs))
