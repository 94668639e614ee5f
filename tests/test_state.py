"""Shared folders, saving after insertion, variants, actions and extension points."""

import os
import subprocess
import sys

import pytest

from arcweave import sources
from arcweave.__main__ import main
from arcweave.operators import storage
from arcweave.operators.model import DiGraph, Graph, InvalidIdType, Layout, NotFound
from arcweave.operators.mutation import add_edges
from arcweave.operators.ordering import with_place, with_previous
from arcweave.operators.paths import DeltaSteppingConfig, delta_stepping
from arcweave.operators.wcc import VARIANTS, WccConfig, wcc
from arcweave.plans.registry import GraphRegistry
from arcweave.sources.saved import restore, save

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class _Session:
    """What ``shared_dir`` asks of a session."""

    def __init__(self, key=None, directory=None, master="local[2]"):
        self.key, self.directory, self.master = key, directory, master
        self.conf = self.sparkContext = self

    def get(self, name, default):
        return self.key or default

    def getCheckpointDir(self):  # noqa: N802
        return self.directory

    def setCheckpointDir(self, path):  # noqa: N802
        self.directory = path


def test_shared_folder():
    assert storage.shared_dir(_Session(key="hdfs:/a/")) == "hdfs:/a"
    chosen = _Session(directory="hdfs:/b", master="spark://host:7077")
    assert storage.shared_dir(chosen) == "hdfs:/b" and chosen.directory == "hdfs:/b"
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(_Session(master=master))
    assert storage.shared_dir(_Session()).startswith("file:///")


def test_restore_after_insert(spark, tmp_path):
    directed = add_edges(DiGraph.from_rows(spark, [(0, 1, 5.0), (1, 2, 3.0)], Layout.DEDUPLICATED), spark.createDataFrame([(1, 1, 7.0), (0, 1, 0.5)], "src long, dst long, value double"))
    save(directed, str(tmp_path / "d"))
    assert sorted(map(tuple, restore(spark, str(tmp_path / "d")).edges.collect())) == [(0, 1, 5.0), (1, 1, 7.0), (1, 2, 3.0)]
    new = spark.createDataFrame([(1, 0, 0.5), (2, 2, 1.0), (0, 2, 4.0), (2, 0, 9.0)], "src long, dst long, value double")
    undirected = add_edges(Graph.from_rows(spark, [(0, 1, 5.0), (1, 2, 3.0)], Layout.DEDUPLICATED), new)
    expected = [(0, 1, 5.0), (0, 2, 4.0), (1, 0, 5.0), (1, 2, 3.0), (2, 0, 4.0), (2, 1, 3.0), (2, 2, 1.0)]
    save(undirected, str(tmp_path / "u"))
    back = restore(spark, str(tmp_path / "u"))
    for found in (undirected, back):
        assert sorted(map(tuple, found.stored_edges().select("src", "dst", "value").collect())) == expected
    assert sorted(map(tuple, add_edges(back, new).stored_edges().select("src", "dst", "value").collect())) == expected


def test_component_variants(spark):
    rows = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 42), (50, 40), (60, 60), (70, 10)]
    network = DiGraph.from_rows(spark, rows)
    labels = []
    for variant in VARIANTS:
        for config in (WccConfig(), WccConfig(neighbor_rounds=1, sampling_size=1)):
            labels.append(sorted(map(tuple, wcc(network, config, variant).components.select("id", "component").collect())))
    assert all(x == labels[0] for x in labels) and dict(labels[0])[70] == 0 and dict(labels[0])[50] == 40


def test_buckets(spark):
    rows = [(i, i + 1, 1.5) for i in range(12)] + [(0, 12, 30.0), (0, 6, 8.0), (20, 1, 1.0)]
    network = DiGraph.from_rows(spark, rows)
    expected = {i: min(1.5 * i, 8 + 1.5 * (i - 6) if i >= 6 else 99) for i in range(13)}
    seen = set()
    for delta in (0.5, 3.0, 1000.0):
        found = delta_stepping(network, DeltaSteppingConfig(0, delta))
        near = {r["id"]: r["distance"] for r in found.distances.collect() if r["distance"] < 1e6}
        assert near == expected
        seen.add(found.buckets)
    assert min(seen) == 1 and max(seen) == 13


def test_places_and_previous_rows(spark):
    rows = [(i % 3 if i % 7 else None, i, f"v{i}") for i in range(60)]
    table = spark.createDataFrame(rows, "g int, t int, v string").repartition(5)
    placed = {(r["g"], r["t"]): r["pos"] for r in with_place(table.where("g is not null"), ["g"], ["t"]).collect()}
    before = {(r["g"], r["t"]): r["previous"] for r in with_previous(table, ["g"], ["t"], "v").collect()}
    for g in (None, 0, 1, 2):
        times = [t for k, t, _ in rows if k == g]
        for at, t in enumerate(times):
            assert g is None or placed[g, t] == at
            assert before[g, t] == (f"v{times[at - 1]}" if at else None)
    hub = DiGraph.from_rows(spark, [(0, i % 40) for i in range(80)] + [(1, 5)])
    assert [(r["id"], r["pos"], r["neighbor"]) for r in hub.out_neighbor_rows().orderBy("id", "pos").collect()] == [(0, i, i // 2) for i in range(80)] + [(1, 0, 5)]


def test_actions(spark, tmp_path):
    path = tmp_path / "a.el"
    path.write_text("0 1\n1 2\n2 0\n3 2\n")
    registry = GraphRegistry(spark)
    made = registry.action("create", f'{{"graph_name": "g", "file_format": "EdgeList", "path": "{path}", "csr_layout": "Deduplicated"}}')
    assert made["edge_count"] == 4
    said = registry.action("compute", b'{"graph_name": "g", "algorithm": {"Wcc": {"chunk_size": 8}}, "property_key": "w"}')
    assert registry.ticket(said["property_id"]).where("component = 0").count() == 4
    assert [b.num_rows for b in registry.fetch("g", "w")] == [4]
    assert registry.action("to_undirected", '{"graph_name": "g"}')["graph_type"] == "Undirected"
    assert registry.action("to_relabeled", '{"graph_name": "g"}')["node_count"] == 4
    assert registry.action("compute", '{"graph_name": "g", "algorithm": "TriangleCount"}')["triangle_count"] == 1
    assert [x["name"] for x in registry.action("list")] == ["g"]
    assert registry.action("remove", '{"graph_name": "g"}')["name"] == "g" and registry.action("list") == []
    with pytest.raises(NotFound):
        registry.action("sing")


def test_registered_reader(spark, tmp_path):
    sources.register_reader("pairs", lambda session, path: session.createDataFrame([(0, 1), (1, 2)], "a int, b int"))
    network = DiGraph.load(spark, str(tmp_path), Layout.SORTED, "pairs")
    assert (network.node_count, network.edge_count) == (3, 2)


def test_ids_of_32_bits(spark, tmp_path):
    path = tmp_path / "big.el"
    path.write_text(f"0 {2**32}\n")
    with pytest.raises(InvalidIdType):
        main(["loading", "--path", str(path), "--use-32-bit", "--warmup-runs", "0"])


@pytest.mark.parametrize("missing", ["zstandard", "arcweave.llm", "corpus_pipeline"])
def test_entry_without_the_training_data_operators(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; assert 'sssp' in e.queries() and 'pipeline' not in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
