"""Plan-shape checks: built-in expressions only, no whole-table window task."""

import re

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

BATCH = ["drift_report", "null_calibration", "pr_curve", "average_precision", "bootstrap_ci", "subgroup_metrics",
         "global_rank", "chrono_split", "clean_ledger", "validate_rows", "join_outcomes", "request_rate",
         "burn_rate_alerts", "latency_quantiles", "prediction_drift"]


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_udf_in_batch_plans(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert node not in p, f"{name}: {node}"


@pytest.mark.parametrize("name", ["global_rank", "pr_curve", "chrono_split"])
def test_row_level_windows_are_partitioned(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    for line in p.splitlines():
        if "AS _dl_rn" in line:
            # the first row per key: a window-group limit leaves each task one row a key before the shuffle
            assert re.search(r"WindowGroupLimit .*row_number\(\), 1, Partial", p), line
            continue
        m = re.search(r"Window \[.*row_number\(\)|Window \[.*sum\(", line)
        if m and "RowFrame, unboundedpreceding$(), currentrow$()" in line:
            # running sums / row numbers over rows carry the bucket in their partition spec
            assert "_dl_bucket" in line, line


@pytest.mark.parametrize("name", ["join_outcomes", "first_per_entity", "clean_ledger"])
def test_latest_and_first_rows_without_sort_aggregate(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert "SortAggregate" not in p
    if name != "clean_ledger":
        assert p.count("WindowGroupLimit") >= 2, "a partial limit before the shuffle and a final one"


def test_subgroup_metrics_aggregate_the_rows_once(spark):
    """The four groups of metrics read the counts per (dimension, group, label, score), not the scored table again."""
    p = _plan(E.queries()["subgroup_metrics"](spark, SF_SMALL))
    assert "FileScan" not in p and "Scan ExistingRDD" in p
