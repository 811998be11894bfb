"""What the plans must and mustn't hold."""

import re

import pytest

from tessella.plans import catalog

#: One row on one side: a global aggregate, or the dictionary.
ONE_ROW_JOINS = {"score_by_source", "label_extract"}


def plan(spark, sf, name):
    return catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_joins(spark, sf, name):
    found = plan(spark, sf, name)
    assert "CartesianProduct" not in found
    assert name in ONE_ROW_JOINS or "BroadcastNestedLoopJoin" not in found


@pytest.mark.parametrize(
    "name, columns",
    [("token_stats", "text:string,lang:string"), ("retention_ring", "event_id:bigint,ts:timestamp_ntz,user_id:bigint"), ("argmax_mask", "vec_id:bigint,embedding:array<float>"), ("missing_assets", "l_partkey:bigint,l_quantity:double")],
)
def test_scans_read_only_what_is_asked_for(spark, sf, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, sf, name)


def test_filters_reach_the_scan(spark, sf):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(l_quantity,49.0\)", plan(spark, sf, "missing_assets"))


@pytest.mark.parametrize("name", ["normalize_text", "line_classify", "line_noise", "frontmatter", "note_render", "uri_encode", "size_bucket", "argmax_mask", "wrap_angle_fit", "safe_filename"])
def test_projections_do_not_shuffle(spark, sf, name):
    assert not re.search(r"Exchange (hash|range|Single)", plan(spark, sf, name))


def test_newest_are_limited_before_the_exchange(spark, sf):
    found = plan(spark, sf, "retention_ring")
    assert found.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"convex_hulls", "plane_components", "label_extract", "screen_flow", "row_bands"}))
def test_python_stays_out(spark, sf, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, sf, name))
