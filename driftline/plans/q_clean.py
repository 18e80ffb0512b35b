"""Cleaning, validation and expectation plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.exprs import binarise, scalars
from driftline.operators import clean as C
from driftline.operators import validate as VL
from driftline.plans.registry import register
from driftline.plans.views import present, t

LABEL_SQL = "CAST(coalesce(o_orderstatus = 'F', false) AS INTEGER)"
CLASSES = [C.ExclusionClass("exclude_status_p", "o_orderstatus", ("P",), "OPEN_ORDER",
                            "status P rows carry a deterministic label"),
           C.ExclusionClass("exclude_low_priority", "o_orderpriority", ("5-LOW",), "LOW_URGENCY",
                            "low priority orders are out of scope")]
SENTINEL = "4-NOT SPECIFIED"


def _in_sql(c):
    return f"coalesce({c.column} IN (" + ", ".join(f"'{x}'" for x in c.codes) + "), false)"


def _orders(spark, sf):
    return t(spark, sf, "orders").withColumn("label", binarise("o_orderstatus", "F"))


#: Stand-ins: a weight that only even orders have measured, and a code from the price.
CODE_BANDS = C.BandRules(bands=(C.Band("low", ranges=((0, 149),)), C.Band("middle", ranges=((150, 299),), exact=(305,)),
                                C.Band("round", int_equal=(400,))), text_prefixes=("V",), default="other")
DROPS = {"o_clerk": "free text", "o_weight": "rarely measured", "o_custkey": "identifier"}


def _coded_orders(spark, sf):
    """Orders with a column that is often not measured and a text code."""
    key = F.col("o_orderkey")
    return _orders(spark, sf).withColumn("o_weight", F.when(key % 2 == 0, (key % 10).cast("string"))).withColumn(
        "o_grade", F.when(key % 7 == 0, F.lit(None)).otherwise((key % 5).cast("string"))).withColumn(
        "o_code", F.when(key % 11 == 0, F.concat(F.lit("V"), (key % 3).cast("string"))).otherwise(
            F.floor(F.col("o_totalprice") / 1000).cast("string")))


# ---------------------------------------------------------------- B2

_EVID_SQL = " UNION ALL ".join(
    f"SELECT '{c.name}' AS step, '{c.classification}' AS classification, count(*) FILTER (WHERE {_in_sql(c)}) AS n_rows, "
    f"CAST(coalesce(sum({LABEL_SQL}) FILTER (WHERE {_in_sql(c)}), 0) AS BIGINT) AS n_positive FROM orders" for c in CLASSES)


@register("exclusion_evidence", "SELECT step, classification, n_rows, n_positive, "
          "round(CASE WHEN n_rows > 0 THEN n_positive::DOUBLE / n_rows ELSE 0.0 END, 6) AS positive_rate FROM (" + _EVID_SQL + ")")
def exclusion_evidence(spark, sf):
    """B2: rows, positives and positive rate (label status F) of the two exclusion
    classes (status P as leakage, priority 5-LOW as judgement), null codes kept."""
    return present(C.exclusion_evidence(_orders(spark, sf), CLASSES, "label"))


# ---------------------------------------------------------------- B3

_EX_WHERE = " AND ".join(f"NOT {_in_sql(c)}" for c in CLASSES)


@register("first_per_entity",
          "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderdate, o_orderpriority "
          "FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_per_entity(spark, sf):
    """Each customer's first order by o_orderkey (partial-aggregate min_by)."""
    o = t(spark, sf, "orders")
    return present(C.first_per_entity(o, "o_custkey", ["o_orderkey"]))


# ---------------------------------------------------------------- B8 ledger

def _ledger(spark, sf):
    _, ledger = C.cleaning_ledger(_coded_orders(spark, sf), CLASSES, "o_custkey", ["o_orderkey"], SENTINEL, "label",
                                  not_measured=["o_grade", "o_weight"], bands=(["o_code"], CODE_BANDS), drops=DROPS)
    return ledger


_FIRST_SQL = (f"_o AS (SELECT *, {LABEL_SQL} AS label, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 10 AS VARCHAR) END AS o_weight, "
              "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 5 AS VARCHAR) END AS o_grade, "
              "CASE WHEN o_orderkey % 11 = 0 THEN 'V' || (o_orderkey % 3) ELSE CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) END AS o_code "
              "FROM orders),\n"
              f"_k AS (SELECT * FROM _o WHERE {_EX_WHERE}),\n"
              "_f AS (SELECT * FROM _k QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)")


# ---------------------------------------------------------------- B6

SIZE_RULES = C.BandRules(bands=(C.Band("small", ranges=((1, 10),), exact=(25,)),
                                C.Band("medium", ranges=((11, 30),)),
                                C.Band("large", ranges=((31, 45),), int_equal=(50,))),
                         default="other")
BRAND_RULES = C.BandRules(bands=(C.Band("maker1", ranges=((11, 15),)),
                                 C.Band("maker2", ranges=((21, 25),)),
                                 C.Band("maker3", exact=(31, 32, 33))),
                          text_prefixes=("5",), default="other")


def band_sql(col: str, rules: C.BandRules) -> str:
    """SQL twin of ``band_expr``."""
    v = f"TRY_CAST(CAST({col} AS VARCHAR) AS DOUBLE)"
    txt = f"CAST({col} AS VARCHAR)"
    toks = ", ".join(f"'{x}'" for x in rules.missing_tokens)
    parts = [f"WHEN {txt} IS NULL OR {txt} IN ({toks}) THEN '{rules.missing_band}'"]
    parts += [f"WHEN starts_with({txt}, '{p}') THEN '{rules.default}'" for p in rules.text_prefixes]
    parts.append(f"WHEN {v} IS NULL THEN '{rules.default}'")
    for b in rules.bands:
        cs = [f"({v} >= {lo} AND {v} <= {hi})" for lo, hi in b.ranges]
        cs += [f"{v} = {x}" for x in b.exact]
        cs += [f"trunc({v}) = {x}" for x in b.int_equal]
        parts.append(f"WHEN {' OR '.join(cs)} THEN '{b.name}'")
    return "CASE " + " ".join(parts) + f" ELSE '{rules.default}' END"


@register("clean_ledger",
          "WITH " + _FIRST_SQL + ",\n_ev AS (SELECT step, n_rows, n_positive, CASE WHEN n_rows > 0 THEN n_positive::DOUBLE / n_rows ELSE 0.0 END AS positive_rate FROM ("
          + _EVID_SQL + ")),\n"
          "_l AS (SELECT step, 'n_rows' AS metric, n_rows::DOUBLE AS value FROM _ev UNION ALL "
          "SELECT step, 'n_positive', n_positive::DOUBLE FROM _ev UNION ALL SELECT step, 'positive_rate', positive_rate FROM _ev UNION ALL "
          "SELECT 'first_per_entity', 'rows_before', (SELECT count(*) FROM _k)::DOUBLE UNION ALL "
          "SELECT 'first_per_entity', 'rows_after', (SELECT count(*) FROM _f)::DOUBLE UNION ALL "
          "SELECT 'first_per_entity', 'rows_removed', ((SELECT count(*) FROM _k) - (SELECT count(*) FROM _f))::DOUBLE UNION ALL "
          "SELECT 'first_per_entity', 'unique_entities', (SELECT count(DISTINCT o_custkey) FROM _k)::DOUBLE UNION ALL "
          f"SELECT 'sentinel_to_text', 'sentinel:' || c, n::DOUBLE FROM (SELECT 'o_orderstatus' AS c, count(*) FILTER (WHERE o_orderstatus = '{SENTINEL}') AS n FROM _f "
          f"UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority = '{SENTINEL}') FROM _f) WHERE n > 0 UNION ALL "
          "SELECT 'null_to_not_measured', 'filled:o_grade', count(*) FILTER (WHERE o_grade IS NULL)::DOUBLE FROM _f UNION ALL "
          "SELECT 'null_to_not_measured', 'filled:o_weight', count(*) FILTER (WHERE o_weight IS NULL)::DOUBLE FROM _f UNION ALL "
          "SELECT 'code_banding', 'levels_before:o_code', count(DISTINCT o_code)::DOUBLE FROM _f UNION ALL "
          "SELECT 'code_banding', 'levels_after:o_code', count(DISTINCT " + band_sql("o_code", CODE_BANDS) + ")::DOUBLE FROM _f UNION ALL "
          "SELECT 'drop_columns', 'dropped:o_custkey:identifier', 1.0 UNION ALL SELECT 'drop_columns', 'dropped:o_weight:rarely measured', 1.0 UNION ALL "
          "SELECT 'all_steps', 'columns_out', (SELECT count(*) + 2 FROM (DESCRIBE orders)) UNION ALL "
          "SELECT 'all_steps', 'rows_in', (SELECT count(*) FROM orders)::DOUBLE UNION ALL "
          "SELECT 'all_steps', 'rows_out', (SELECT count(*) FROM _f)::DOUBLE UNION ALL "
          "SELECT 'all_steps', 'rows_removed', ((SELECT count(*) FROM orders) - (SELECT count(*) FROM _f))::DOUBLE UNION ALL "
          "SELECT 'all_steps', 'pct_removed', ((SELECT count(*) FROM orders) - (SELECT count(*) FROM _f)) * 100.0 / (SELECT count(*) FROM orders) UNION ALL "
          "SELECT 'all_steps', 'positive_rate', (SELECT avg(label) FROM _f))\n"
          "SELECT step, metric, round(value, 6) AS value FROM _l")
def clean_ledger(spark, sf):
    """B1-B8 + D9: orders cleaned in the fixed order (exclusion classes, first order per customer, sentinel
    '4-NOT SPECIFIED' -> 'Unknown', null -> 'NotMeasured', code banding, dropped columns with reasons),
    with the step ledger ``(step, metric, value)``."""
    return present(_ledger(spark, sf))


@register("clean_features",
          "WITH " + _FIRST_SQL + "\nSELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '" + SENTINEL + "' THEN 'Unknown' ELSE o_orderpriority END AS o_orderpriority, "
          "round(o_totalprice, 6) AS o_totalprice, coalesce(o_grade, 'NotMeasured') AS o_grade, " + band_sql("o_code", CODE_BANDS) + " AS o_code, "
          "'label' AS y_columns FROM _f")
def clean_features(spark, sf):
    """B5 + B7 + B8 + B10: the cleaned rows' features, without identifier, label and dropped columns; the label apart."""
    clean, _ = C.cleaning_ledger(_coded_orders(spark, sf), CLASSES, "o_custkey", ["o_orderkey"], SENTINEL, "label",
                                 not_measured=["o_grade", "o_weight"], bands=(["o_code"], CODE_BANDS), drops=DROPS)
    x, y = C.split_xy(clean, "label", ["o_orderdate", "o_custkey"])
    return present(x.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_grade", "o_code",
                            F.lit(",".join(y.columns)).alias("y_columns")))


@register("band_codes",
          "WITH _p AS (SELECT p_size, regexp_extract(p_brand, '#([0-9]+)', 1) AS brand_code FROM part)\n"
          f"SELECT {band_sql('p_size', SIZE_RULES)} AS size_band, {band_sql('brand_code', BRAND_RULES)} AS brand_band, "
          "count(*) AS n, count(DISTINCT p_size) AS size_codes, count(DISTINCT brand_code) AS brand_codes FROM _p GROUP BY ALL")
def band_codes(spark, sf):
    """Ordered banding rules (ranges, exact values, integer-equal, text
    prefixes, non-numeric) on p_size and on the numeric suffix of p_brand;
    rows per band pair with the distinct codes each band absorbed."""
    p = t(spark, sf, "part").select("p_size", F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("brand_code"))
    b = p.select("p_size", "brand_code", C.band_expr("p_size", SIZE_RULES).alias("size_band"),
                 C.band_expr("brand_code", BRAND_RULES).alias("brand_band"))
    return present(b.groupBy("size_band", "brand_band").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("p_size").alias("size_codes"),
        F.countDistinct("brand_code").alias("brand_codes")))


# ---------------------------------------------------------------- B13

@register("mask_fields",
          "SELECT conv_id, turn, role, CASE WHEN text IS NULL THEN NULL ELSE '***' END AS text, "
          "role AS hist_role, CASE WHEN text IS NULL THEN NULL ELSE '***' END AS hist_text, "
          "CASE WHEN text IS NULL THEN NULL ELSE '***' END AS meta_text FROM conversations")
def mask_fields(spark, sf):
    """Conversation turns packed in nested structs / arrays; every ``text``
    key is masked at any depth."""
    c = t(spark, sf, "conversations")
    packed = c.select("conv_id", "turn",
                      F.struct("role", "text", F.struct(F.col("text").alias("text"),
                                                        F.length("text").alias("n")).alias("meta")).alias("message"),
                      F.array(F.struct("role", "text")).alias("history"))
    m = C.mask_fields(packed, ["text"])
    return m.select("conv_id", "turn", F.col("message.role").alias("role"), F.col("message.text").alias("text"),
                    F.col("history")[0]["role"].alias("hist_role"), F.col("history")[0]["text"].alias("hist_text"),
                    F.col("message.meta.text").alias("meta_text"))


# ---------------------------------------------------------------- C1-C4, B12

LI_RULES = [VL.FieldRule("l_quantity", required=True, dtype="int", ge=1, le=45),
            VL.FieldRule("l_discount", required=True, dtype="double", le=0.08),
            VL.FieldRule("l_returnflag", required=True, allowed=("A", "N"))]
LI_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _li_validated(spark, sf):
    li = t(spark, sf, "lineitem")
    li = C.apply_defaults(li, {"l_returnflag": "N"}, trim=["l_returnflag"])
    return VL.validate(li, LI_RULES)


_LI_ERR_SQL = (
    "_li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, "
    "coalesce(trim(l_returnflag), 'N') AS l_returnflag FROM lineitem),\n"
    "_e AS ("
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_quantity' AS field, 'int_parsing' AS type, "
    "'input should be a valid int' AS message, CAST(l_quantity AS VARCHAR) AS received FROM _li WHERE l_quantity <> floor(l_quantity) UNION ALL "
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_quantity', 'greater_than_equal', 'input should be greater than or equal to 1', "
    "CAST(l_quantity AS VARCHAR) FROM _li WHERE l_quantity < 1 UNION ALL "
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_quantity', 'less_than_equal', 'input should be less than or equal to 45', "
    "CAST(l_quantity AS VARCHAR) FROM _li WHERE l_quantity > 45 UNION ALL "
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_discount', 'less_than_equal', 'input should be less than or equal to 0.08', "
    "CAST(l_discount AS VARCHAR) FROM _li WHERE l_discount > 0.08::DOUBLE UNION ALL "
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_returnflag', 'enum', 'input should be one of A, N', "
    "l_returnflag FROM _li WHERE l_returnflag NOT IN ('A', 'N')"
    ")")


@register("validate_rows", "WITH " + _LI_ERR_SQL + "\nSELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, field, type, "
          "message, substr(received, 1, 120) AS received FROM _e")
def validate_rows(spark, sf):
    """C1 + C3 + B12: lineitem rows checked against field rules (quantity int in
    1..45, discount <= 0.08, return flag in {A, N}; flag trimmed and defaulted),
    one row per error."""
    return VL.flatten_errors(_li_validated(spark, sf), LI_ID)


PROPS_ALLOWED = ["k"]


@register("error_counts", "WITH " + _LI_ERR_SQL + ",\n"
          "_pe AS (SELECT count(*) AS n FROM events WHERE len(list_filter(json_keys(props), lambda x: x NOT IN ('k'))) > 0)\n"
          "SELECT field, count(*) AS n_errors FROM _e GROUP BY field UNION ALL "
          "SELECT 'props', n FROM _pe WHERE n > 0")
def error_counts(spark, sf):
    """C4 (+ C2): error counts per field on lineitem, plus events whose ``props``
    JSON carries keys outside the contract."""
    li = VL.error_counts(VL.flatten_errors(_li_validated(spark, sf), LI_ID))
    ev = VL.validate(t(spark, sf, "events"), [], [VL.unknown_keys_error("props", PROPS_ALLOWED)])
    pe = VL.error_counts(VL.flatten_errors(ev, ["event_id"]))
    return li.unionByName(pe)


# ---------------------------------------------------------------- C5 / C6 / C7

@register("table_expectations",
          "SELECT 'unique(o_orderkey)' AS check, CAST((SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) = 0 AS INTEGER) AS passed, "
          "(SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS n_violations UNION ALL "
          "SELECT 'unique(l_orderkey,l_linenumber)', CAST((SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) = 0 AS INTEGER), "
          "(SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) UNION ALL "
          "SELECT 'levels(o_orderstatus)', CAST(list_sort(list(DISTINCT o_orderstatus)) = ['F', 'O', 'P'] AS INTEGER), "
          "CAST(len(list_filter(list(DISTINCT o_orderstatus), lambda x: x NOT IN ('F', 'O', 'P'))) + len(list_filter(['F', 'O', 'P'], lambda x: NOT list_contains(list(DISTINCT o_orderstatus), x))) AS BIGINT) FROM orders UNION ALL "
          "SELECT 'no_null_or_sentinel', CAST(count(*) FILTER (WHERE o_orderkey IS NULL OR o_orderstatus IS NULL OR o_orderpriority IS NULL OR o_orderstatus = '?' OR o_orderpriority = '?') = 0 AS INTEGER), "
          "count(*) FILTER (WHERE o_orderkey IS NULL OR o_orderstatus IS NULL OR o_orderpriority IS NULL OR o_orderstatus = '?' OR o_orderpriority = '?') FROM orders UNION ALL "
          "SELECT 'codes_gone(o_orderstatus)', CAST(count(*) FILTER (WHERE o_orderstatus IN ('P')) = 0 AS INTEGER), count(*) FILTER (WHERE o_orderstatus IN ('P')) FROM orders "
          f"WHERE {_EX_WHERE} UNION ALL "
          "SELECT 'columns_present', 1, 0 UNION ALL SELECT 'dropped_columns_gone', 1, 0")
def table_expectations(spark, sf):
    """C6 + C7: key uniqueness (orders passes, lineitem (orderkey, linenumber)
    fails), label levels, no nulls/sentinels, excluded codes gone after cleaning,
    column contract."""
    o = t(spark, sf, "orders")
    li = t(spark, sf, "lineitem")
    kept = C.exclude(o, CLASSES)
    return VL.expectations(
        VL.expect_unique(o, ["o_orderkey"]),
        VL.expect_unique(li, ["l_orderkey", "l_linenumber"]),
        VL.expect_levels(o, "o_orderstatus", ["F", "O", "P"]),
        VL.expect_no_nulls(o, ["o_orderkey", "o_orderstatus", "o_orderpriority"], sentinel="?"),
        VL.expect_codes_gone(kept, "o_orderstatus", ["P"]),
        VL.expect_columns(o, present=["o_orderkey", "o_custkey", "o_orderstatus"], absent=["o_comment"]))


@register("table_shape",
          "SELECT count(*) AS n_rows, 6 AS n_columns, count(DISTINCT o_custkey) AS n_entities, "
          "round(count(*) / count(DISTINCT o_custkey), 6) AS rows_per_entity FROM orders")
def table_shape(spark, sf):
    """Rows, columns, distinct customers and orders per customer."""
    o = t(spark, sf, "orders")
    return present(VL.shape_profile(o, "o_custkey").drop("matches_pinned"))


# ---------------------------------------------------------------- C8

@register("score_range_check",
          "SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice / 400000.0::DOUBLE < 0 OR o_totalprice / 400000.0::DOUBLE > 1) AS n_out_of_range, "
          "CAST(count(*) FILTER (WHERE o_totalprice / 400000.0::DOUBLE < 0 OR o_totalprice / 400000.0::DOUBLE > 1) = 0 AS INTEGER) AS canary_passed FROM orders")
def score_range_check(spark, sf):
    """Unclipped scores (o_totalprice / 400000) must be probabilities; counted
    over the whole batch."""
    o = t(spark, sf, "orders").select((F.col("o_totalprice") / 400000.0).alias("score"))
    v = VL.validate(o, [VL.probability_rule("score")])
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid") == 0).alias("n_out_of_range")) \
            .withColumn("canary_passed", (F.col("n_out_of_range") == 0).cast("int"))


# ---------------------------------------------------------------- B9-B11, B14

CONTRACT = ["l_quantity", "l_discount", "l_shipmode", "l_tax", "l_comment"]


@register("feature_projection", "SELECT l_quantity, l_discount, l_tax FROM lineitem")
def feature_projection(spark, sf):
    """B9 + B10 + C7: contract columns that are present (absent ones skipped)."""
    return present(C.feature_projection(t(spark, sf, "lineitem"), CONTRACT))


@register("align_columns",
          "SELECT count(*) AS n, " + ", ".join(
              f"CAST(sum(CAST(l_returnflag = '{x}' AS INTEGER)) AS BIGINT) AS l_returnflag_{x}" for x in ("A", "N", "R"))
          + " FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'")
def align_columns(spark, sf):
    """Indicator columns fitted on the pre-1996 window (levels A, N, R)
    applied to the later window, where unseen / missing levels are zeros."""
    li = t(spark, sf, "lineitem")
    cut = F.lit("1996-01-01").cast("timestamp")
    train = li.where(F.col("l_shipdate") < cut)
    levels = sorted(r[0] for r in train.select("l_returnflag").distinct().collect())  # bounded levels
    test = C.indicator_columns(li.where(F.col("l_shipdate") >= cut), "l_returnflag", levels)
    cols = [f"l_returnflag_{x}" for x in levels]
    aligned = C.align_columns(cols, test)
    return aligned.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(c) for c in cols])


@register("batch_attribution",
          "WITH _c AS (SELECT *, 0.01 * sum(length(text)) OVER (PARTITION BY conv_id) AS total_ms, "
          "count(*) OVER (PARTITION BY conv_id) AS batch_size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS batch_index FROM conversations)\n"
          "SELECT conv_id, turn, batch_index, batch_size, round(total_ms / batch_size, 6) AS item_ms FROM _c")
def batch_attribution(spark, sf):
    """Conversations as batches (batch = conv_id, items ordered by turn);
    the batch's total latency (0.01 ms per character) is attributed per item."""
    c = t(spark, sf, "conversations")
    tot = c.groupBy("conv_id").agg((F.sum(F.length("text")) * 0.01).alias("total_ms"))
    b = C.batch_attribution(c.join(tot, "conv_id"), "conv_id", ["turn"], "total_ms")
    return present(b.select("conv_id", "turn", "batch_index", "batch_size", "item_ms"))
