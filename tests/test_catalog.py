"""The registered queries against their SQL on the smallest tables, and what the plans must not hold."""

import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
from fleetdrift import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")

SAMPLE = """snapshot_diff signature_positional_params target_version vulnerable_versions located_findings binding_sites python_sites merged_dependencies
 route_matches http_calls spec_diff version_pins anchored_hunks diff_touched_lines dependency_paths rename_candidates yarn_lock requirements scan_deltas engine_summary
 resolver_sites scan_counts_detected contract_since dashboard_newest dashboard_findings""".split()


@pytest.fixture(scope="module")
def duck():
    import check

    return check.connect(SF)


def test_every_query_has_sql():
    catalog.load_all()
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_registries_need_no_session():
    code = "import __spark_entry__ as c; assert len(c.queries()) >= len(c.oracle_sql()) > 200"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    import check

    status, _n, _took, note = check.compare(spark, duck, name, contract.queries()[name], contract.oracle_sql()[name], SF)
    assert status == "ok", note


@pytest.mark.parametrize("name", ["vulnerable_versions", "route_matches", "anchored_hunks", "module_root_join", "contract_outcomes", "related_symbols"])
def test_no_pairwise_joins(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert contract.entry(spark).count() > 0
