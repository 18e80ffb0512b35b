"""Logs, outcomes, stores and cleaning (modelled on the log and data-quality suites)."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import clean as C
from driftline.operators import outcomes as O
from driftline.operators import validate as VL
from driftline.session import scratch_dir
from driftline.sources import files as FS


def test_truncated_line_and_limit(spark):
    path = scratch_dir(spark, "t_ndjson")
    good = '{"prediction_id": "a", "predicted_proba": 0.5, "predicted_label": 1}'
    spark.createDataFrame([(good,), ("",), ('{"prediction_id": "trunc',)], "value string").coalesce(1) \
         .write.text(path)
    g, bad = FS.read_ndjson(spark, path, FS.PREDICTION_SCHEMA)
    assert g.count() == 1 and bad.first()[0] == 1
    many = scratch_dir(spark, "t_ndjson10")
    spark.createDataFrame([(good,)] * 10, "value string").coalesce(1).write.text(many)
    assert FS.read_ndjson(spark, many, FS.PREDICTION_SCHEMA, limit=4)[0].count() == 4
    missing, _ = FS.read_ndjson(spark, scratch_dir(spark, "nope"), FS.PREDICTION_SCHEMA)
    assert missing.count() == 0


def test_last_write_wins_and_join(spark):
    outc = spark.createDataFrame([("p1", 0, "2024-01-01 00:00:00", "first"), ("p1", 1, "2024-01-02 00:00:00", "corrected")],
                                 "prediction_id string, outcome_label int, ts string, source string") \
                .withColumn("ts", F.to_timestamp("ts"))
    lww = O.last_write_wins(outc, "prediction_id", "ts", ["source"]).first()
    assert lww["outcome_label"] == 1 and lww["n_writes"] == 2
    pred = spark.createDataFrame([("p1",), ("p2",)], "prediction_id string")
    j = O.join_outcomes(pred, O.last_write_wins(outc, "prediction_id", "ts"), "prediction_id")
    c = O.maturity_counts(j, "outcome_label").first()
    assert (c["n_predictions"], c["n_matured"], c["n_unmatured"]) == (2, 1, 1)


def test_threshold_store_refuses_placeholder(spark):
    df = spark.createDataFrame([("x", 0.2)], "feature string, threshold double")
    ok, bad = scratch_dir(spark, "t_thr"), scratch_dir(spark, "t_thr_bad")
    FS.write_thresholds(df, ok, "r1")
    assert FS.read_thresholds(spark, ok).count() == 1
    FS.write_thresholds(df, bad, "r0", provenance="PLACEHOLDER")
    with pytest.raises(ValueError):
        FS.read_thresholds(spark, bad)


def test_reference_written_once(spark):
    p = scratch_dir(spark, "t_ref")
    df = spark.range(5)
    FS.write_reference(df, p, "abc")
    with pytest.raises(Exception):
        FS.write_reference(df, p, "abc")
    assert FS.read_reference(spark, p).select("feature_schema_hash").distinct().first()[0] == "abc"


def test_csv_na_tokens(spark):
    from pyspark.sql import types as T
    p = scratch_dir(spark, "t_csv")
    spark.createDataFrame([("1", "NA"), ("2", "x"), ("n/a", "")], "a string, b string").write.option("header", True).csv(p)
    sch = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    rows = sorted(FS.read_csv(spark, p, sch).collect(), key=lambda r: (r["a"] is None, r["a"] or 0))
    assert [r["a"] for r in rows] == [1, 2, None]
    assert [r["b"] for r in rows] == [None, "x", None]


def test_banding_rules(spark):
    codes = ["250.01", "785", "V45", "E812", "abc", None, "?", "401", "800", "150", "600"]
    df = spark.createDataFrame([(c,) for c in codes], "d string")
    got = [r[0] for r in df.select(C.band_expr("d", C.ICD9_RULES)).collect()]
    assert got == ["Diabetes", "Circulatory", "Other", "Other", "Other", "Unknown", "Unknown",
                   "Circulatory", "Injury", "Neoplasms", "Genitourinary"]


def test_exclusion_keeps_null_codes_and_first_per_entity(spark):
    df = spark.createDataFrame([(1, 10, "P", 1), (2, 10, None, 0), (3, 11, "F", 1), (4, 11, "F", 0)],
                               "id long, ent long, code string, y int")
    cls = [C.ExclusionClass("a", "code", ("P",), "OPEN_ORDER")]
    kept = C.exclude(df, cls)
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 4]
    first = C.first_per_entity(kept, "ent", ["id"])
    assert sorted(r["id"] for r in first.collect()) == [2, 3]
    ev = C.exclusion_evidence(df, cls, "y").first()
    assert (ev["n_rows"], ev["n_positive"]) == (1, 1)


def test_mask_nested(spark):
    df = spark.createDataFrame([(1, ("u", "secret", ("secret",)), [("u", "secret")])],
                               "id long, m struct<role:string,text:string,meta:struct<text:string>>, h array<struct<role:string,text:string>>")
    r = C.mask_fields(df, ["text"]).first()
    assert r["m"]["text"] == "***" and r["m"]["meta"]["text"] == "***" and r["h"][0]["text"] == "***"
    assert r["m"]["role"] == "u"


def test_validation_rules(spark):
    df = spark.createDataFrame([("3", 0.5, "A"), ("x", 2.0, "Z"), (None, None, "A")], "q string, p double, f string")
    rules = [VL.FieldRule("q", required=True, dtype="int", ge=1, le=45), VL.probability_rule("p"),
             VL.FieldRule("f", allowed=("A", "N"))]
    v = VL.validate(df, rules).collect()
    assert [r["valid"] for r in v] == [1, 0, 0]
    types = sorted(e["type"] for e in v[1]["errors"])
    assert types == ["enum", "int_parsing", "less_than_equal"]


def test_expected_levels_count_other_and_absent_ones(spark):
    from driftline.operators.validate import expect_levels
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("x",), ("y",)], "c string")
    n = lambda d, exp: d.select("*").transform(lambda v: expect_levels(v, "c", exp)).first()["n_violations"]
    assert n(df.where("c in ('a', 'b') or c is null"), ["b", "a", "a"]) == 0
    assert n(df, ["a", "b", "z"]) == 3                                          # x and y are others, z never occurs
    assert n(df.limit(0), ["a", "b"]) == 2 and n(df.where("c = 'a'"), ["a", 1]) == 1
