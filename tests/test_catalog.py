"""Every registered query against its SQL in DuckDB; those that SQL cannot express have their values tested by name."""

import pytest
from quarry import catalog

from parity import connect, differ

QUERIES, ORACLES = catalog.queries(), catalog.oracles()
#: Queries without SQL, and the test of their values.
ELSEWHERE = {
    "recall_code": "test_code_recall", "recall_code_filtered": "test_code_recall", "recall_code_degraded": "test_code_recall", "recall_code_projects": "test_code_recall",
    "recall_graph": "test_graph_values", "communities": "test_graph_values", "ann_topk": "test_graph_values", "ann_topk_filtered": "test_graph_values",
}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    if name in ORACLES:
        assert differ(QUERIES[name](spark, sf), con, ORACLES[name]) is None
    else:
        assert name in ELSEWHERE and QUERIES[name](spark, sf).collect()
