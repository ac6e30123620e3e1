"""A spread of registered queries against DuckDB at the smallest scale; ``check.py`` runs all of them."""

import pytest

import __spark_entry__ as contract
from check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = [
    "P07_first_failure_audit", "A01_conflict_report", "A02_dedup_records", "A03_dataset_summary", "W01_sequential_ids", "X07_exact_length_match",
    "X08_length_matched_library", "X13_bin_search", "X09_cluster_split", "A13_shortcut_profile", "D05_qc_flags", "D10_phys8", "D12_dpc_profile",
    "D26_autocorrelation", "M02_threshold_metrics", "M03_roc_auc", "M05_best_threshold", "M08_bootstrap_ci", "A28_paired_delta_stats",
    "W02_global_rank", "A20_pool_summary", "A35_cluster_indices", "J13_novelty_levenshtein",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert compare(got, duck.sql(contract.oracle_sql()[name]).df()).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 1
