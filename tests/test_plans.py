"""What the plans must look like at scale."""

import os

import pytest

from loamstone.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plan(spark, name):
    return catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "ready_repositories")
    assert "EqualTo(status,ready)" in p
    p = plan(spark, "page_envelope")
    assert "EqualTo(lang,en)" in p and "ReadSchema: struct<lang:string>" in p


def test_pages_keep_only_their_rows(spark):
    assert "TakeOrderedAndProject" in plan(spark, "list_conversations")


@pytest.mark.parametrize("name", ["vector_topk", "last_n_history", "facts_text"])
def test_groups_are_limited_before_their_exchange(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["sliding_window_chunks", "structural_chunks_js", "line_stats", "edit_once", "error_sanitizer", "file_filter"])
def test_row_work_shuffles_at_most_for_repeated_rows(spark, name):
    p = plan(spark, name)
    assert p.count("Exchange hashpartitioning") <= (1 if name == "structural_chunks_js" else 0)
    assert "Python" not in p and "Arrow" not in p


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - {"vector_topk", "vector_topk_filtered", "relevance_score", "best_scores", "owner_filter", "vector_topk_matrix", "vector_topk_indexed", "p5_found", "p5_sources"}))
def test_no_products(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
