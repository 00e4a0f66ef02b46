"""Physical-plan checks: JVM-only operators, no single-partition windows on
partitioned paths, filters pushed to the scan."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
PYTHON_OK = {"custom_run_features", "stream_run_features", "model_search", "batch_scoring_proba",
             "feature_importance", "predict_all"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["run_features", "run_groups", "target_after", "agg_mode", "feature_matrix",
                                  "detect_language", "prediction_monitor", "goal_probs"])
def test_no_python_in_jvm_operators(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "FlatMapGroupsInPandas" not in plan


def test_partitioned_runs_do_not_gather_into_one_partition(spark):
    plan = _plan(E.queries()["run_groups"](spark, SF))
    assert "SinglePartition" not in plan


def test_filter_and_projection_pushdown(spark):
    df = E.queries()["time_range"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan
