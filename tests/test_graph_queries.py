import pytest

from tests.oracle import connect, differences
from vertexflow.plans import catalog
from vertexflow.plans.oracles import LINES, _blocks_by_rounds
from vertexflow.plans.tables import lines_where

SF = "/root/testdata/sf0.001"
con = None


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    global con
    con = con or connect(SF)
    assert differences(con, catalog.QUERIES[name](spark, SF), catalog.ORACLES[name]) == (0, 0)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


#: Queries whose results need a graph with many components; the whole graph is nearly one.
SHAPED = [
    "sssp", "distributed_sssp", "bfs_levels", "distributed_bfs_levels", "undirected_bfs_levels", "klevel_edges", "multi_root_bfs", "wcc", "wcc_topk", "component_total", "component_levels", "undirected_component_levels", "component_vmap",
    "forward_reach", "backward_reach", "giant_scc", "big_scc_edges", "small_scc_edges", "bowtie_counts", "bowtie_vmap", "scc", "distributed_scc", "scc_check", "residual_wcc", "vertex_program_labels", "msbfs_blocks", "voronoi_check", "dag_check",
    "degree_sort_vmap", "partition_file_vmap", "boundary_ratio", "metis_lines", "parse_metis", "parse_cassovary", "budget_intervals", "edge_balanced_intervals", "greedy_assignment", "dynamic_delete",
]


@pytest.mark.parametrize("name", SHAPED)
def test_query_matches_sql_on_a_graph_of_many_components(spark, name):
    """A small fixture: the graph of every sixth order."""
    condition = "l_orderkey % 6 = 0"
    sql = catalog.ORACLES[name].replace(LINES, f"lineitem WHERE {condition}")
    if name == "msbfs_blocks":  # takes more rounds here
        sql = _blocks_by_rounds(25, 8, 4).replace(LINES, f"lineitem WHERE {condition}")
    with lines_where(condition):
        assert differences(connect(SF), catalog.QUERIES[name](spark, SF), sql) == (0, 0)


def test_queries_read_all_lines():
    assert not any("WHERE l_orderkey" in sql or "LIMIT" in sql and "% 20" in sql for sql in catalog.ORACLES.values())
