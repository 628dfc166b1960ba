"""Plans are the ones that scale: pruned scans, cuts before the shuffle, no products, no Python on hot paths."""

import os

import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["nearest_time_batch", "segment_interval_first", "dedup_actions", "entity_memory", "eval_cases"])
def test_no_products(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p or name == "eval_cases"  # a handful of modes


@pytest.mark.parametrize("name", ["kw_bm25_prefix", "fuzzy_rank", "intent_rank", "chunks", "grounding_score", "indel_ratio", "soundex_variant"])
def test_no_python(spark, name):
    assert not any(w in plan(spark, name) for w in ("ArrowEvalPython", "BatchEvalPython", "InPandas", "MapInArrow"))


def test_topk_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "knn_clip")
    assert "TakeOrderedAndProject" in plan(spark, "catalog_page") or "Limit" in plan(spark, "catalog_page")


def test_scans_are_pruned(spark):
    p = plan(spark, "timeline_lineitem")
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in p
    assert "PushedFilters: [In(p_partkey" in plan(spark, "lookup_ids")
