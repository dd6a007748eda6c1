"""Queries whose gates cost most deal their rows over all cores, as a given table may be one row group."""
import pytest

from cataloom.workloads import registry


@pytest.mark.parametrize("name", ["best_candidate", "identity_match", "identity_summary"])
def test_gates_read_dealt_rows(spark, small, name):
    plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
