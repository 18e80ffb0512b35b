"""Small SQL text builders for the DuckDB oracle of the query catalogue.

They spell out, in plain SQL, the same arithmetic the Spark operators use, so
the literal constants (quantile levels, Poisson CDF, bin edges) are shared.
"""

from __future__ import annotations

from collections.abc import Sequence

from driftline.functions.exprs import MIX, NULL_TOKEN, linspace, poisson1_cdf


def dbl(v: float) -> str:
    if v == float("inf"):
        return "'inf'::DOUBLE"
    if v == float("-inf"):
        return "'-inf'::DOUBLE"
    return f"{float(v)!r}::DOUBLE"


def dlist(vals: Sequence[float]) -> str:
    return "[" + ", ".join(dbl(v) for v in vals) + "]"


def r6(x: str, dp: int = 6) -> str:
    """SQL twin of ``round_half_up``."""
    m = f"{float(10 ** dp)!r}::DOUBLE"
    return (f"(CASE WHEN abs(({x})::DOUBLE) < 1e12 THEN floor(({x})::DOUBLE * {m} + 0.5) / {m} "
            f"ELSE ({x})::DOUBLE END)")


def keysel(keys: Sequence[str], prefix: str = "") -> str:
    return "".join(f"{prefix}{k}, " for k in keys)


def hash_uniform_sql(*parts: str, seed: int = 42) -> str:
    inner = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return (f"(('0x' || substr(md5({inner} || '|{seed}'), 1, 8))::BIGINT::DOUBLE"
            f" / 4294967296.0)")


def replicate_sql(src: str, key: str, B: int, seed: int = 42) -> str:
    """Rows of ``src`` for each replicate that draws them, with ``b`` and weight ``w``: SQL twin of the bootstrap weights."""
    word = lambda i: f"('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), {1 + 8 * i}, 8))::BIGINT"
    step, mask = 0x9E3779B1, 0xFFFFFFFF
    x = f"SELECT s.*, r.range AS b, (_h1 + (r.range * {step}) % {mask + 1}) % {mask + 1} AS _x FROM (SELECT *, {word(0)} AS _h1, {word(1)} AS _h2 FROM {src}) s CROSS JOIN range({B}) r"

    def mixed(inner: str) -> str:
        (a, c, e), factors = MIX
        for shift, factor in zip((a, c), factors):
            inner = f"SELECT * REPLACE ((xor(_x, _x >> {shift}) * {factor}) % {mask + 1} AS _x) FROM ({inner})"
        return f"SELECT * REPLACE (xor(_x, _x >> {e}) AS _x) FROM ({inner})"
    x = mixed(f"SELECT * REPLACE (xor(_x, _h2) AS _x) FROM ({mixed(x)})")
    u = "(_x::DOUBLE / 4294967296.0)"
    return f"SELECT * EXCLUDE (_x, _h1, _h2) FROM (SELECT *, {poisson_sql(u)} AS w FROM ({x})) WHERE w > 0"


def poisson_sql(u: str, kmax: int = 12) -> str:
    cdf = poisson1_cdf(kmax)
    whens = " ".join(f"WHEN {u} <= {dbl(cdf[k])} THEN {k}" for k in range(kmax))
    return f"(CASE {whens} ELSE {kmax} END)"


def psi_sql(ref: str, cur: str, numeric: Sequence[str], categorical: Sequence[str],
            keys: Sequence[str] = (), bins: int = 10, edges_cte: str | None = None) -> str:
    """CTE chain (ending in ``_psi``) computing PSI / JS per ``(keys, feature)``.

    ``ref`` and ``cur`` are names of relations visible to the query.
    """
    ks = keysel(keys)
    gb = f" GROUP BY {', '.join(keys)}" if keys else ""
    qs = dlist(linspace(bins))
    ctes = []
    if numeric:
        if edges_cte is None:
            qparts = [
                f"SELECT {ks}'{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), {qs}) AS q, "
                f"min(CAST({c} AS DOUBLE)) AS mn, max(CAST({c} AS DOUBLE)) AS mx FROM {ref}{gb}"
                for c in numeric]
            ctes.append("_q AS (" + " UNION ALL ".join(qparts) + ")")
            ctes.append("_e AS (SELECT *, list_sort(list_distinct(coalesce(q, []::DOUBLE[]))) AS e FROM _q)")
            ctes.append(
                f"_edges AS (SELECT {ks}feature, "
                "CASE WHEN len(e) >= 2 THEN e[2:len(e)-1] ELSE []::DOUBLE[] END AS inner_e, "
                "CASE WHEN len(e) >= 2 THEN '-inf'::DOUBLE ELSE mn - 1 END AS lo, "
                "CASE WHEN len(e) >= 2 THEN 'inf'::DOUBLE ELSE mx + 1 END AS hi, "
                "CAST(len(e) <= 2 AS INTEGER) AS degenerate FROM _e)")
        else:
            ctes.append(f"_edges AS ({edges_cte})")
        nl = []
        for side, rel in (("reference", ref), ("current", cur)):
            for c in numeric:
                nl.append(f"SELECT {ks}'{side}' AS side, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {rel}")
        ctes.append("_nl AS (" + " UNION ALL ".join(nl) + ")")
    cells = []
    if numeric:
        on = " AND ".join([f"n.{k} = d.{k}" for k in keys] + ["n.feature = d.feature"])
        cells.append(
            f"SELECT {keysel(keys, 'n.')}n.feature, "
            "CAST(len(list_filter(d.inner_e, lambda v: v <= n.x)) AS VARCHAR) AS cell, n.side "
            f"FROM _nl n JOIN _edges d ON {on} "
            "WHERE n.x IS NOT NULL AND n.x >= d.lo AND n.x <= d.hi")
    for side, rel in (("reference", ref), ("current", cur)):
        for c in categorical:
            cells.append(f"SELECT {ks}'{c}' AS feature, coalesce(CAST({c} AS VARCHAR), '{NULL_TOKEN}') AS cell, "
                         f"'{side}' AS side FROM {rel}")
    ctes.append("_cells AS (" + " UNION ALL ".join(cells) + ")")
    ctes.append(f"_cnt AS (SELECT {ks}feature, cell, "
                "count(*) FILTER (WHERE side = 'reference') AS ref_n, "
                "count(*) FILTER (WHERE side = 'current') AS cur_n "
                f"FROM _cells GROUP BY {ks}feature, cell)")
    ctes.append(f"_tot AS (SELECT {ks}feature, CAST(sum(ref_n) AS BIGINT) AS reference_n, "
                "CAST(sum(cur_n) AS BIGINT) AS current_n, count(*) AS n_cells "
                f"FROM _cnt GROUP BY {ks}feature)")
    on = " AND ".join([f"c.{k} = t.{k}" for k in keys] + ["c.feature = t.feature"])
    p = "(c.ref_n::DOUBLE / greatest(t.reference_n, 1))"
    q = "(c.cur_n::DOUBLE / greatest(t.current_n, 1))"
    pc, qc = f"greatest({p}, 1e-6)", f"greatest({q}, 1e-6)"
    m = f"(({p} + {q}) / 2)"
    ctes.append(
        f"_psi0 AS (SELECT {keysel(keys, 'c.')}c.feature, t.reference_n, t.current_n, t.n_cells, "
        f"({qc} - {pc}) * ln({qc} / {pc}) AS _psi, "
        f"0.5 * (CASE WHEN {p} > 0 THEN {p} * ln({p} / {m}) ELSE 0 END) + "
        f"0.5 * (CASE WHEN {q} > 0 THEN {q} * ln({q} / {m}) ELSE 0 END) AS _js "
        f"FROM _cnt c JOIN _tot t ON {on})")
    deg = "0"
    join_deg = ""
    if numeric:
        on2 = " AND ".join([f"p.{k} = d.{k}" for k in keys] + ["p.feature = d.feature"])
        join_deg = f" LEFT JOIN _edges d ON {on2}"
        deg = "coalesce(any_value(d.degenerate), 0)"
    numlist = ", ".join(f"'{c}'" for c in numeric) or "NULL"
    ctes.append(
        f"_psi AS (SELECT {keysel(keys, 'p.')}p.feature, sum(p._psi) AS psi, sum(p._js) AS js_divergence, "
        "any_value(p.reference_n) AS reference_n, any_value(p.current_n) AS current_n, "
        f"any_value(p.n_cells) AS n_cells, {deg} AS degenerate, "
        f"CASE WHEN p.feature IN ({numlist}) THEN 'numeric' ELSE 'categorical' END AS kind "
        f"FROM _psi0 p{join_deg} GROUP BY {keysel(keys, 'p.')}p.feature)")
    return ",\n".join(ctes)


def half_up_rounds(sql: str) -> str:
    """Rewrite every ``round(x, dp)`` call of an oracle query into :func:`r6`."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            elif ch == "'":
                k = sql.index("'", k + 1)
            k += 1
        inner = sql[j + len(key):k - 1]
        if comma < 0:
            arg, dp = inner, 0
        else:
            arg, dp = sql[j + len(key):comma], int(sql[comma + 1:k - 1].strip())
        out.append(sql[i:j])
        out.append(r6(half_up_rounds(arg), dp))
        i = k


def poisson_inverse_sql(lam: str, u: str, kmax: int = 40) -> str:
    """SQL twin of ``drift.poisson_inverse`` (same evaluation order)."""
    term = f"exp(-({lam}))"
    cdf = term
    conds = []
    for k in range(kmax):
        conds.append(f"WHEN {u} <= {cdf} THEN {k}")
        term = f"(({term}) * ({lam}) / {float(k + 1)!r}::DOUBLE)"
        cdf = f"({cdf} + {term})"
    return "(CASE " + " ".join(conds) + f" ELSE {kmax} END)"
