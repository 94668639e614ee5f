import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from arcweave.operators import mutation, partition, relabel
from arcweave.operators.model import DiGraph, Graph, InvalidIdType, InvalidNodeValues, InvalidPartitioning, Layout, MissingNode, WrongGraphType

SIX = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 4), (3, 4)]


def lists(df):
    return {r["id"]: list(r["neighbors"]) for r in df.collect()}


def degrees(df):
    return [r["degree"] for r in df.orderBy("id").collect()]


def test_topology_of_six_edges(spark):
    g = DiGraph.from_rows(spark, SIX, Layout.SORTED)
    assert (g.node_count, g.edge_count) == (5, 6)
    assert lists(g.all_out_neighbors()) == {0: [1, 2], 1: [2, 3], 2: [4], 3: [4]}
    assert lists(g.all_in_neighbors()) == {1: [0], 2: [0, 1], 3: [1], 4: [2, 3]}
    assert degrees(g.out_degrees()) == [2, 2, 1, 1, 0]
    assert degrees(g.in_degrees()) == [0, 1, 2, 1, 2]
    u = g.to_undirected(Layout.SORTED)
    assert lists(u.all_neighbors()) == {0: [1, 2], 1: [0, 2, 3], 2: [0, 1, 4], 3: [1, 4], 4: [2, 3]}
    assert u.edge_count == 6 and degrees(u.degrees()) == [2, 3, 3, 2, 2]
    assert g.out_neighbors(1) == [2, 3] == g.copy_out_neighbors(1) and g.in_degree(4) == 2
    assert "node_count: 5" in repr(g)


def test_layouts(spark):
    rows = [(0, 7), (0, 3), (0, 3), (0, 1)]
    assert Graph.from_rows(spark, rows, Layout.SORTED).neighbors(0) == [1, 3, 3, 7]
    assert Graph.from_rows(spark, rows, Layout.DEDUPLICATED).neighbors(0) == [1, 3, 7]
    loops = [(0, 1), (0, 1), (0, 0), (1, 4), (1, 2), (1, 3), (1, 2), (3, 5), (3, 6), (3, 7)]
    d = DiGraph.from_rows(spark, loops, Layout.DEDUPLICATED)
    assert lists(d.all_out_neighbors()) == {0: [1], 1: [2, 3, 4], 3: [5, 6, 7]}
    kept = DiGraph.from_rows(spark, loops, Layout.DEDUPLICATED, adjacency_list=True)
    assert kept.out_neighbors(0) == [0, 1]


def test_parallel_edges_keep_the_smallest_value(spark):
    g = DiGraph.from_rows(spark, [(0, 1, 5.0), (0, 1, 2.0), (1, 0, 3.0)], Layout.DEDUPLICATED)
    assert g.out_neighbors_with_values(0) == [(1, 2.0)] and g.in_neighbors_with_values(0) == [(1, 3.0)]


def test_to_undirected(spark):
    g = DiGraph.from_rows(spark, [(0, 1), (3, 0), (0, 3), (7, 0), (0, 42), (21, 0)])
    assert g.to_undirected(Layout.SORTED).neighbors(0) == [1, 3, 3, 7, 21, 42]
    assert g.to_undirected(Layout.DEDUPLICATED).neighbors(0) == [1, 3, 7, 21, 42]
    assert g.to_undirected().degree(0) == 6


def test_two_cycle_and_self_loop(spark):
    g = Graph.from_rows(spark, [(0, 1), (1, 0)], Layout.SORTED)
    assert (g.node_count, g.edge_count, g.degree(0), g.neighbors(0)) == (2, 2, 2, [1, 1])
    loop = Graph.from_rows(spark, [(0, 0)], Layout.SORTED)
    assert loop.degree(0) == 2 and loop.edge_count == 1


def test_node_values(spark):
    g = DiGraph.from_rows(spark, [(0, 1), (1, 2)], node_values=[0, 1, 2, 3])
    assert g.node_count == 4 and g.node_value(3) == 3 and degrees(g.out_degrees()) == [1, 1, 0, 0]
    assert g.node_values().count() == 4
    with pytest.raises(InvalidNodeValues):
        DiGraph.from_rows(spark, [(0, 5)], node_values=[1, 2])


def test_empty(spark):
    g = DiGraph.from_rows(spark, [])
    assert g.node_count == 0 and g.edge_count == 0 and g.out_degrees().count() == 0
    assert partition.out_degree_partition(g, 3) == []
    assert g.wcc().components.count() == 0


def test_numpy_pandas_arrow(spark):
    array = np.array([[0, 1], [2, 3], [4, 1]], np.uint32)
    g = Graph.from_numpy(spark, array, Layout.SORTED)
    assert (g.node_count, g.edge_count, g.neighbors(1)) == (5, 3, [0, 4])
    assert Graph.from_pandas(spark, pd.DataFrame(array)).edge_count == 3
    assert DiGraph.from_arrow(spark, pa.table({"a": pa.array([0, 1]), "b": pa.array([1, 2])})).node_count == 3
    with pytest.raises(TypeError):
        Graph.from_numpy(spark, np.array([1, 2]))
    with pytest.raises(InvalidIdType):
        DiGraph.from_arrow(spark, pa.table({"a": pa.array([0.5]), "b": pa.array([1])}))


def test_relabel(spark):
    g = Graph.from_rows(spark, [(0, 1), (1, 2), (1, 3), (3, 0)]).make_degree_ordered()
    assert degrees(g.degrees()) == [3, 2, 2, 1] and g.neighbors(0) == [1, 2, 3]
    ties = Graph.from_rows(spark, [(0, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 3), (3, 0), (3, 2)])
    assert {(r["old_id"], r["new_id"]) for r in relabel.degree_order(ties).collect()} == {(0, 3), (1, 2), (2, 0), (3, 1)}
    assert ties.make_degree_ordered().neighbors(0) == [1, 1, 2, 2, 3]
    with pytest.raises(WrongGraphType):
        relabel.degree_order(DiGraph.from_rows(spark, [(0, 1)]))


def test_offsets_and_dense_ids(spark):
    g = DiGraph.from_rows(spark, SIX)
    assert [r["offset"] for r in relabel.offsets(g.out_degrees()).orderBy("id").collect()] == [0, 2, 4, 5, 6]
    edges, ids = relabel.dense_ids(spark.createDataFrame([("x", "a"), ("a", "m")], "s string, t string"), "s", "t")
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (2, 0)] and ids.count() == 3


def test_partitions(spark):
    assert partition.degree_partition(Graph.from_rows(spark, [(0, 1), (0, 2), (0, 3), (0, 3)]), 2) == [(0, 1), (1, 4)]
    assert partition.out_degree_partition(DiGraph.from_rows(spark, [(0, 1), (0, 2), (2, 1), (2, 3)]), 2) == [(0, 1), (1, 4)]
    assert partition.in_degree_partition(DiGraph.from_rows(spark, [(1, 0), (1, 2), (2, 0), (3, 2)]), 2) == [(0, 1), (1, 4)]
    amounts = spark.range(10).withColumnRenamed("id", "i").selectExpr("i AS id", "i AS degree")
    assert partition.greedy_ranges(amounts, 10, 6, 99999) == [(0, 4), (4, 6), (6, 7), (7, 8), (8, 9), (9, 10)]
    assert partition.greedy_ranges(amounts, 10, 6, 3) == [(0, 4), (4, 6), (6, 10)]


def test_for_each_node(spark):
    g = DiGraph.from_rows(spark, [(0, 1), (0, 2), (1, 2)])
    states = partition.for_each_node(g.out_degrees(), lambda t: t["degree"])
    assert [r["state"] for r in states.orderBy("id").collect()] == [2, 1, 0]
    run = lambda f: f[["id"]].assign(state=f["degree"] * 10)
    out = partition.for_each_node_by_partition(g, g.out_degrees(), [(0, 1), (1, 3)], run, "id long, state long")
    assert sorted(map(tuple, out.collect())) == [(0, 20), (1, 10), (2, 0)]
    with pytest.raises(InvalidPartitioning):
        partition.for_each_node_by_partition(g, g.out_degrees(), [(0, 1)], run, "id long, state long")
    with pytest.raises(InvalidNodeValues):
        partition.for_each_node_by_partition(g, g.out_degrees().limit(1), [(0, 3)], run, "id long, state long")


def test_add_edges(spark):
    base = DiGraph.from_rows(spark, [(0, 2), (1, 2)])
    assert sorted(mutation.add_edge(mutation.add_edge(base, 0, 1), 0, 2).out_neighbors(0)) == [1, 2, 2]
    s = base.with_layout(Layout.SORTED)
    assert mutation.add_edge(mutation.add_edge(s, 0, 1), 0, 1).out_neighbors(0) == [1, 1, 2]
    d = DiGraph.from_rows(spark, [(0, 2), (1, 2), (1, 3)], Layout.DEDUPLICATED)
    for target, expected in ((1, [1, 2]), (1, [1, 2]), (3, [1, 2, 3])):
        d = mutation.add_edge(d, 0, target)
        assert d.out_neighbors(0) == expected
    with pytest.raises(MissingNode, match="3"):
        mutation.add_edge(base, 0, 3)
    w = DiGraph.from_rows(spark, [(0, 1, 1.0)], Layout.DEDUPLICATED)
    assert mutation.add_edge(w, 0, 1, 0.5).out_neighbors_with_values(0) == [(1, 1.0)]
    u = mutation.add_edge(Graph.from_rows(spark, [(0, 2), (1, 2)], Layout.DEDUPLICATED), 0, 1)
    assert u.neighbors(1) == [0, 2] and u.degree(0) == 2
