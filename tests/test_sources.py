import pyarrow as pa
import pytest

from arcweave.functions import labels
from arcweave.operators.model import DiGraph, Direction, FileFormat, Graph, InvalidIdType, Layout, NotFound, WrongGraphType
from arcweave.plans.registry import GraphRegistry
from arcweave.sources import graph500
from arcweave.sources.gdl import graph_from_gdl, parse
from arcweave.sources.labelled import read_labelled
from arcweave.sources.saved import restore, save

SIX = "0 1\n0 2\n1 2\n1 3\n2 4\n3 4\n"
LABELLED = "t 5 6\nv 0 0 2\nv 1 1 3\nv 2 2 3\nv 3 1 2\nv 4 2 2\ne 0 1\ne 0 2\ne 1 2\ne 1 3\ne 2 4\ne 3 4\n"


def written(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_edge_list(spark, tmp_path):
    g = DiGraph.load(spark, written(tmp_path, "a.el", SIX), Layout.SORTED, FileFormat.EDGE_LIST)
    assert (g.node_count, g.edge_count) == (5, 6)
    crlf = DiGraph.load(spark, written(tmp_path, "b.el", "0 1\r\n0 2\r\n1 3\r\n"), file_format=FileFormat.EDGE_LIST)
    assert crlf.node_count == 4
    w = DiGraph.load(spark, written(tmp_path, "c.wel", "0 1 0.5\n0 2 0.7\n1 2 0.25\n1 3 1.0\n2 3\n"), file_format=FileFormat.EDGE_LIST_WEIGHTED)
    assert w.out_neighbors_with_values(1) == [(2, 0.25), (3, 1.0)] and w.in_neighbors_with_values(1) == [(0, 0.5)]
    assert w.out_neighbors_with_values(2) == [(3, 0.0)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        DiGraph.load(spark, written(tmp_path, "d.el", "x 1\n"), file_format=FileFormat.EDGE_LIST)


def test_graph500(spark, tmp_path):
    pairs = [(i % 4, (i * 3) % 4) for i in range(64)]
    g = DiGraph.load(spark, written(tmp_path, "g.bin", graph500.encode(pairs)))
    assert (g.node_count, g.edge_count) == (4, 64)
    assert sorted((r["src"], r["dst"]) for r in g.edges.collect()) == sorted(pairs)
    big = [(1 << 47 | 5, 1 << 40 | 7)]
    assert [x.tolist() for x in graph500.decode(graph500.encode(big) + b"xx")] == [[1 << 47 | 5], [1 << 40 | 7]]
    with pytest.raises(InvalidIdType):
        DiGraph.load(spark, written(tmp_path, "h.bin", graph500.encode([(9, 1)] * 16)))


def test_labelled(spark, tmp_path):
    path = written(tmp_path, "a.network", LABELLED)
    stats = read_labelled(spark, path).stats()
    assert stats == {"node_count": 5, "max_label": 2, "max_degree": 3, "label_slots": 3, "max_label_frequency": 2}
    g = Graph.load(spark, path, Layout.SORTED, FileFormat.LABELLED)
    assert tuple(labels.label_stats(g).first()) == (3, 3, 2, 2)
    assert {r["label"]: r["frequency"] for r in labels.label_frequencies(g).collect()} == {0: 1, 1: 2, 2: 2}
    found = {r["id"]: r["frequencies"] for r in labels.neighbor_label_frequency(g).collect()}
    assert found == {0: {1: 1, 2: 1}, 1: {0: 1, 1: 1, 2: 1}, 2: {0: 1, 1: 1, 2: 1}, 3: {1: 1, 2: 1}, 4: {1: 1, 2: 1}}
    assert sorted(map(tuple, labels.label_index(g).collect())) == [(0, 0, 0), (1, 0, 1), (1, 1, 3), (2, 0, 2), (2, 1, 4)]
    assert labels.nodes_with_label(g, 1) == [1, 3]
    other = LABELLED.replace("v ", "n ")
    assert read_labelled(spark, written(tmp_path, "b.network", other)).nodes.count() == 5


def test_gdl(spark):
    g = graph_from_gdl(spark, "(a)-[{w: 0.5}]->(b), (a)-->(c)<-[:T {w: 2.0}]-(b), (d)", weighted=True)
    assert g.node_count == 4
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 0.5), (0, 2, 0.0), (1, 2, 2.0)]
    parsed = parse("(x:L7 {v: 3}), (y:L2 {v: 4}), (x)-->(y)")
    assert parsed.label_numbers() == [7, 2] and parsed.values == [3, 4]
    assert graph_from_gdl(spark, parsed, Graph, node_values=True).node_value(1) == 4
    with pytest.raises(ValueError):
        parse("(a)->>(b)")


def test_save_and_restore(spark, tmp_path):
    g = DiGraph.from_rows(spark, [(0, 1, 1.5), (1, 2, 2.5)], Layout.SORTED, node_values=[7, 8, 9])
    save(g, str(tmp_path / "g"))
    back = restore(spark, str(tmp_path / "g"))
    assert (back.node_count, back.layout, back.node_value(2)) == (3, Layout.SORTED, 9)
    assert sorted(map(tuple, back.edges.collect())) == [(0, 1, 1.5), (1, 2, 2.5)]
    spark.createDataFrame([(0, 1)], "src int, dst int").write.mode("overwrite").parquet(str(tmp_path / "g/edges"))
    with pytest.raises(InvalidIdType):
        restore(spark, str(tmp_path / "g"))


def test_registry(spark, tmp_path):
    r = GraphRegistry(spark)
    made = r.create("g", written(tmp_path, "a.el", SIX), FileFormat.EDGE_LIST, layout=Layout.DEDUPLICATED)
    assert (made["node_count"], made["edge_count"]) == (5, 6) and set(r.actions()) >= {"create", "compute"}
    r.create("w", written(tmp_path, "a.wel", "0 1 1.0\n1 2 2.0\n"), FileFormat.EDGE_LIST_WEIGHTED)
    assert [i.graph_type for i in r.list()] == ["Directed", "Directed weighted"]
    said = r.compute("g", "PageRank", "rank", max_iterations=5)
    assert said["property_id"] == {"graph_name": "g", "property_key": "rank"} and said["iterations"] <= 5
    assert sum(b.num_rows for b in r.fetch("g", "rank")) == 5
    assert dict(r.property("g", "rank").dtypes)["page_rank"] == "float"
    r.compute("g", "Wcc")
    assert r.property("g", "wcc").where("component = 0").count() == 5
    assert [x["distance"] for x in r.property("w", r.compute("w", "Sssp", start_node=0, delta=1.0)["property_id"]["property_key"]).orderBy("id").collect()] == [0, 1, 3]
    for name, algorithm in (("w", "PageRank"), ("g", "Sssp"), ("g", "TriangleCount")):
        with pytest.raises(WrongGraphType):
            r.compute(name, algorithm)
    assert r.to_undirected("g").graph_type == "Undirected"
    r.to_relabeled("g")
    assert r.compute("g", "TriangleCount")["triangle_count"] == 1
    with pytest.raises(NotFound):
        r.property("g", "rank")
    r.upload("up", pa.table({"a": pa.array([0]), "b": pa.array([1])}), Direction.UNDIRECTED)
    r.remove("g")
    for call in (lambda: r.remove("g"), lambda: r.compute("none", "Wcc"), lambda: r.compute("up", "Other")):
        with pytest.raises(NotFound):
            call()


def test_streamed_edges(spark, tmp_path):
    from arcweave.streaming.edges import append_edges

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long").write.parquet(source)
    stream = spark.readStream.schema("src long, dst long").parquet(source)
    for _ in range(2):
        append_edges(stream, out, str(tmp_path / "cp")).awaitTermination(60)
        spark.createDataFrame([(2, 3)], "src long, dst long").write.mode("append").parquet(source)
    assert DiGraph.from_edges(spark.read.parquet(out).select("src", "dst")).edge_count == 3


def test_command_line(spark, tmp_path, capsys):
    from arcweave.__main__ import main

    path = written(tmp_path, "a.el", SIX)
    once = ["--path", path, "--runs", "1", "--warmup-runs", "0"]
    main(["page-rank", *once, "--max-iterations", "2"])
    main(["triangle-count", *once, "--relabel"])
    main(["serialize", *once, "--output", str(tmp_path / "saved")])
    main(["sssp", "--path", written(tmp_path, "a.wel", "0 1 1.0\n1 2 2.0\n"), "--runs", "1", "--warmup-runs", "0", "--start-node", "0", "--delta", "2"])
    said = capsys.readouterr().out
    assert "triangles: 1" in said and "saved DiGraph" in said and "page-rank: mean" in said and "sssp: mean" in said


def test_results_as_arrays(spark):
    g = DiGraph.from_rows(spark, [(0, 1), (2, 3)])
    assert g.wcc().to_numpy().tolist() == [0, 0, 2, 2]
    scores = g.page_rank(max_iterations=1).to_numpy()
    assert len(scores) == 4 and not scores.flags.writeable
    assert Layout.Sorted is Layout.SORTED and FileFormat.EdgeList is FileFormat.EDGE_LIST
