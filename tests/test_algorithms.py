import random

import pytest

from arcweave.operators import wcc as components
from arcweave.operators.components import star_labels
from arcweave.operators.model import DiGraph, Graph, GraphError, Layout, WrongGraphType
from arcweave.operators.pagerank import PageRankConfig, fixed_rounds, page_rank
from arcweave.operators.paths import UNREACHABLE, DeltaSteppingConfig, delta_stepping
from arcweave.operators.triangles import global_triangle_count

THIRTEEN = [(1, 2), (2, 1), (4, 0), (4, 1), (5, 4), (5, 1), (5, 6), (6, 1), (6, 5), (7, 1), (7, 5), (8, 1), (8, 5), (9, 1), (9, 5), (10, 1), (10, 5), (11, 5), (12, 5)]
TWO = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]


def ordered(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def test_pagerank_in_place(spark):
    result = page_rank(DiGraph.from_rows(spark, THIRTEEN), PageRankConfig(10, 1e-4, 0.85), "in_place")
    expected = [0.024064068, 0.3145448, 0.27890152, 0.01153846, 0.029471997, 0.06329483, 0.029471997] + [0.01153846] * 6
    assert result.ran_iterations == 10
    assert ordered(result.scores, "score") == pytest.approx(expected, abs=1e-7)


def test_pagerank_synchronous(spark):
    g = DiGraph.from_rows(spark, THIRTEEN)
    assert ordered(fixed_rounds(g, 10), "score")[:3] == pytest.approx([0.024064403, 0.28163156, 0.28952807], abs=1e-6)
    fixed = page_rank(g, PageRankConfig(0, 1e-9))
    assert ordered(fixed.scores, "score")[:3] == pytest.approx([0.02406406, 0.302509, 0.26867113], abs=1e-6)
    assert fixed.error < 1e-9


def test_pagerank_two_components(spark):
    g = DiGraph.from_rows(spark, TWO)
    for update in ("in_place", "synchronous"):
        scores = ordered(page_rank(g, update=update).scores, "score")
        assert scores == pytest.approx([0.024999997, 0.035624996, 0.06590624] * 2, abs=1e-6)
    flat = g.page_rank(damping_factor=0.0)
    assert flat.ran_iterations == 1 and ordered(flat.scores, "score") == pytest.approx([1 / 6] * 6)
    with pytest.raises(TypeError):
        g.page_rank(5)
    with pytest.raises(GraphError):
        page_rank(g, update="other")


def test_wcc(spark):
    g = DiGraph.from_rows(spark, [(0, 1), (2, 3)])
    for variant in components.VARIANTS:
        assert ordered(components.wcc(g, variant=variant).components, "component") == [0, 0, 2, 2]
    with pytest.raises(TypeError):
        g.wcc(5)
    isolated = DiGraph.from_edges(spark.createDataFrame([(3, 1)], "s long, t long"), node_count=5)
    assert ordered(components.component_ids(isolated), "component") == [0, 1, 2, 1, 4]


def test_wcc_long_random_chain(spark):
    ids = list(range(600))
    random.Random(5).shuffle(ids)
    labels = star_labels(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long"))
    assert {r["component"] for r in labels.collect()} == {0} and labels.count() == 599


def test_wcc_random_graphs(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    g = DiGraph.from_edges(spark.createDataFrame(edges, "s long, t long"), node_count=200)
    assert ordered(components.component_ids(g), "component") == [find(i) for i in range(200)]


def test_sssp(spark):
    rows = [(0, 1, 4.0), (0, 2, 2.0), (1, 2, 5.0), (1, 3, 10.0), (2, 4, 3.0), (3, 5, 11.0), (4, 3, 4.0)]
    g = DiGraph.from_rows(spark, rows, value_type="float")
    for delta in (3.0, 100.0, 0.5):
        assert ordered(delta_stepping(g, DeltaSteppingConfig(0, delta)).distances, "distance") == [0, 4, 2, 9, 5, 20]
    far = g.sssp(start_node=3, delta=1.0).distances
    assert ordered(far, "distance") == [pytest.approx(UNREACHABLE)] * 3 + [0, pytest.approx(UNREACHABLE), 11]
    for bad in (DeltaSteppingConfig(0, 0.0), DeltaSteppingConfig(99, 1.0)):
        with pytest.raises(GraphError):
            delta_stepping(g, bad)
    with pytest.raises(GraphError):
        delta_stepping(DiGraph.from_rows(spark, [(0, 1, -1.0)]), DeltaSteppingConfig(0, 1.0))
    with pytest.raises(WrongGraphType):
        delta_stepping(DiGraph.from_rows(spark, [(0, 1)]), DeltaSteppingConfig(0, 1.0))


def test_triangles(spark):
    two = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]
    corner = [(0, 1), (1, 2), (0, 2), (0, 3), (3, 4), (0, 4)]
    diamond = [(0, 1), (1, 2), (0, 2), (2, 3), (1, 3)]
    for rows in (two, corner, diamond):
        g = Graph.from_rows(spark, rows, Layout.DEDUPLICATED)
        assert g.global_triangle_count().triangles == 2
        assert g.make_degree_ordered().global_triangle_count().triangles == 2
    parallel = [(0, 1), (0, 1), (1, 2), (2, 0)]
    assert global_triangle_count(Graph.from_rows(spark, parallel, Layout.SORTED), multigraph=True).triangles == 2
    assert global_triangle_count(Graph.from_rows(spark, parallel, Layout.DEDUPLICATED)).triangles == 1
    assert global_triangle_count(Graph.from_rows(spark, [(0, 0)], Layout.SORTED), multigraph=True).triangles == 4


def test_afforest_steps(spark):
    g = DiGraph.from_rows(spark, [(0, 1), (0, 2), (0, 3), (4, 5)])
    assert components.first_neighbors(g.edges, 2).count() == 3
    found = components.component_ids(g)
    assert tuple(components.largest_component(found).first()) == (0, 4)
    assert [tuple(r) for r in components.remaining_edges(g.edges, found, 0).collect()] == [(4, 5)]
