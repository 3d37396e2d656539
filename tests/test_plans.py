"""Promises about physical plans: what is pushed down, what is never planned, where Python runs."""

import pytest

from workload import registry

SF_DIR = "/root/testdata/sf0.01"
# Work that columns cannot express well: chunk packing, counting terms inside a row, top-k scoring, and the text hook.
PYTHON = {
    "d03_chunk_documents", "d03_chunk_totals", "d04_postings", "d05_bm25_top_k", "d05_bm25_okapi", "d06_dense_top_k", "d06_dense_top_k_blocks", "d06_dense_top_k_cosine", "d07_dense_top_k_in_cells",
    "d08_fuse_ranks", "d09_rewrite_questions", "d10_retrieve", "d14_embed_text", "d14_search_by_text", "u01_apply_text_fn",
}
WRITES_FIRST = {n for n in registry.QUERIES if n.startswith(("s01", "s03", "s05", "s06", "s07", "x"))}


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan(fn(spark, SF_DIR)) for n, fn in registry.QUERIES.items() if n not in WRITES_FIRST}


def test_no_cross_joins(plans):
    assert [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p] == []


def test_python_only_where_named(plans):
    used = {n for n, p in plans.items() if any(w in p for w in ("MapInArrow", "ArrowEvalPython", "BatchEvalPython", "FlatMapCoGroupsInArrow", "MapInPandas"))}
    assert used == PYTHON
    assert [n for n, p in plans.items() if "BatchEvalPython" in p] == []


@pytest.mark.parametrize("name", ["r08_top_k_in_group", "t02_slowest_runs", "d05_bm25_top_k", "d06_dense_top_k", "v04_split_short_chats", "v06_compact_history"])
def test_top_k_is_cut_before_the_shuffle(plans, name):
    assert plans[name].count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["r07_top_k", "k03_table_preview", "g05_guarded_sql"])
def test_limits_are_top_n(plans, name):
    assert "TakeOrderedAndProject" in plans[name]


@pytest.mark.parametrize("name,parts", [
    ("r01_filter_project", ["GreaterThanOrEqual(l_discount,0.05)", "LessThan(l_quantity,24.0)"]),
    ("r02_count_rows", ["EqualTo(o_orderstatus,O)", "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>"]),
    ("r15_in_last_period", ["GreaterThanOrEqual(o_orderdate,1998-02-01T00:00)", "LessThan(o_orderdate,1998-03-01T00:00)"]),
    ("r10_compare_groups", ["ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>"]),
    ("v10_prepare_turns", ["In(role, [assistant,user])"]),
])
def test_filters_and_columns_reach_the_scan(plans, name, parts):
    for part in parts:
        assert part in plans[name]


def test_row_wise_work_has_no_shuffle(spark):
    for name in ("d03_chunk_documents", "d02_chunk_tier", "s04_extract_page_text", "g06_extract_fenced_block", "v07_normalize_content"):
        assert plan(registry.QUERIES[name](spark, SF_DIR), "simple").count("Exchange") == 0


@pytest.mark.parametrize("name", ["g03_unknown_table_refs", "k04_resolve_table", "t01_trace_rollup", "r13_describe_numeric", "d13_assemble_context"])
def test_small_sides_of_known_size_are_broadcast(plans, name):
    assert "BroadcastHashJoin" in plans[name]
