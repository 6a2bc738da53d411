import pytest

import __spark_entry__ as contract
from checks.compare import connect, difference
from checks.registry import ORACLES, QUERIES

# One query per area; `python -m checks.compare` runs them all.
SAMPLE = [
    "src3_integrity", "gen2_constant_rho", "hsh6_registry", "bit5_sparse_decode", "str4_path_fields",
    "agg5_hllpp_dense_small", "agg10_hllpp_auto", "mrg5_merge_hllpp_sparse", "mrg12_rollup",
    "evl2_prefix_eval", "evl3_merge_eval", "evl6_precision_mismatch", "win5_interpolated_points",
    "sta7_consistency_checks", "snk2_merge_results", "stm2_live_estimates",
]


@pytest.fixture(scope="module")
def oracles(spark):
    return contract.oracle_sql()


def test_every_query_has_an_oracle(oracles):
    assert set(ORACLES) == set(QUERIES)
    assert set(oracles) <= set(contract.queries())
    assert set(SAMPLE) <= set(oracles)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, sf_dir, oracles, name):
    got = contract.queries()[name](spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(oracles[name]).df()
    assert difference(got, want) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 3
