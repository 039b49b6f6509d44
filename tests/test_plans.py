"""Plans: what reaches the scan, and what must never appear."""

import pytest

from grainguard.bindings import QUERIES
from tests.oracle import DATA

FOLDER = f"{DATA}/sf0.001"
# The one operator whose purpose is a product.
PRODUCT = {"cross_join_bounded"}
STREAMS = {k for k in QUERIES if k.startswith("stream_")}


def plan(spark, key):
    return QUERIES[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - PRODUCT - STREAMS))
def test_no_products_and_no_python(spark, key):
    text = plan(spark, key)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "InPandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "missing_time_filter")
    assert "EqualTo(o_orderstatus,F)" in text
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "o_orderpriority" not in schema and "o_custkey" not in schema


def test_fan_out_is_counted_not_built(spark):
    """Each side is aggregated below the join."""
    text = plan(spark, "fanout_proof")
    assert text.index("Join") < text.index("partial_count(1)")


def test_pages_and_top_lists_keep_only_their_rows(spark):
    assert "TakeOrderedAndProject" in plan(spark, "page")
    assert "TakeOrderedAndProject" in plan(spark, "top_issue_types")
