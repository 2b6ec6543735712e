"""The named queries against their reference SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles  # noqa: E402

import __spark_entry__ as driver  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
# The slowest keys are left to tools/check_oracles.py; their operators have tests of their own.
SLOW = {"model_sweep", "feature_table", "release_model_sweep", "release_best_model", "release_variant_gaps", "h4_overall"}
KEYS = [k for k in driver.queries() if k not in SLOW]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(FOLDER)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_reference(spark, con, key):
    sql = driver.oracle_sql().get(key)
    diff, n = check_oracles.compare(spark, con, FOLDER, key, driver.queries()[key], sql)
    assert diff is None
    assert n > 0


def test_every_reference_text_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
