"""Registered queries against their SQL on the smallest tables."""

import pytest

from maskwright.plans import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
CHECKED = [
    "quantile_category", "inner_holdout", "nested_subsets", "repeated_splits", "fold_and_pooled_metrics", "notable_cases", "residual_correlations",
    "learning_summary", "paired_bootstrap", "feature_evidence", "feature_redundancy", "mask_features", "mask_features_scaled", "component_labels",
    "mask_quality", "mask_topology", "sensitivity_records", "mask_letterbox", "mask_distance_channel", "neighbour_pairs", "contradicting_masks",
    "prediction_coverage_check", "evidence_key_grid", "number_text", "best_epochs", "table_freshness",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    text, ok = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF)
    assert ok, text


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
