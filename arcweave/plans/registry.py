"""Named networks and the properties computed on them."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcweave.operators.model import DiGraph, Direction, FileFormat, Graph, Layout, NotFound, WrongGraphType
from arcweave.operators.pagerank import PageRankConfig, page_rank
from arcweave.operators.paths import DeltaSteppingConfig, delta_stepping
from arcweave.operators.storage import Scratch
from arcweave.operators.triangles import global_triangle_count
from arcweave.operators.wcc import WccConfig, wcc

#: Rows of a record batch when a property is fetched.
BATCH_ROWS = 10_000
#: Ids that the driver holds at a time while it hands out a property.
FETCH_IDS = 1_000_000
ACTIONS = {
    "create": "create a network from a file",
    "list": "list all networks",
    "remove": "remove a network and its properties",
    "compute": "run an algorithm on a network",
    "to_undirected": "replace a directed network by its undirected form",
    "to_relabeled": "replace an undirected network by its degree-ordered form",
}


@dataclass(frozen=True)
class GraphInfo:
    name: str
    graph_type: str
    node_count: int
    edge_count: int


def graph_type(network) -> str:
    return ("Directed" if network.directed else "Undirected") + (" weighted" if network.weighted else "")


class GraphRegistry:
    """In-process counterpart of a network server: the same actions on names."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._graphs: dict[str, object] = {}
        self._properties: dict[tuple[str, str], DataFrame] = {}
        self._scratch = Scratch(spark, "properties")

    def actions(self) -> dict[str, str]:
        return dict(ACTIONS)

    def network(self, name: str):
        if name not in self._graphs:
            raise NotFound(f"no network named {name!r}")
        return self._graphs[name]

    def put(self, name: str, network) -> None:
        """Register a network; an older one of this name and its properties go."""
        self._forget(name)
        self._graphs[name] = network

    def create(self, name: str, path: str, file_format: FileFormat = FileFormat.GRAPH500, direction: Direction = Direction.OUTGOING, layout: Layout = Layout.UNSORTED) -> dict:
        began = time.perf_counter()
        cls = Graph if direction is Direction.UNDIRECTED else DiGraph
        self.put(name, cls.load(self.spark, path, layout, file_format))
        return self._made(name, began)

    def upload(self, name: str, table, direction: Direction = Direction.OUTGOING, layout: Layout = Layout.UNSORTED) -> dict:
        """Register a network from an Arrow table of two int64 columns."""
        began = time.perf_counter()
        cls = Graph if direction is Direction.UNDIRECTED else DiGraph
        self.put(name, cls.from_arrow(self.spark, table, layout))
        return self._made(name, began)

    def _made(self, name: str, began: float) -> dict:
        network = self._graphs[name]
        return {"node_count": network.node_count, "edge_count": network.edge_count, "create_millis": int((time.perf_counter() - began) * 1e3)}

    def list(self) -> list[GraphInfo]:
        return [GraphInfo(n, graph_type(g), g.node_count, g.edge_count) for n, g in sorted(self._graphs.items())]

    def remove(self, name: str) -> GraphInfo:
        network = self.network(name)
        info = GraphInfo(name, graph_type(network), network.node_count, network.edge_count)
        self._forget(name)
        del self._graphs[name]
        return info

    def _forget(self, name: str) -> None:
        for key in [k for k in self._properties if k[0] == name]:
            del self._properties[key]

    def to_undirected(self, name: str, layout: Layout | None = None) -> GraphInfo:
        network = self.network(name)
        if network.directed:
            self.put(name, network.to_undirected(layout or network.layout))
        network = self.network(name)
        return GraphInfo(name, graph_type(network), network.node_count, network.edge_count)

    def to_relabeled(self, name: str) -> GraphInfo:
        network = self.network(name)
        if network.directed or network.weighted:
            raise WrongGraphType("relabelling needs an undirected network without values")
        self.put(name, network.make_degree_ordered())
        network = self.network(name)
        return GraphInfo(name, graph_type(network), network.node_count, network.edge_count)

    def compute(self, name: str, algorithm: str, property_key: str | None = None, **config) -> dict:
        """Run PageRank, Wcc, Sssp or TriangleCount; all but the last keep a property."""
        network = self.network(name)
        began = time.perf_counter()
        needs = {"PageRank": (True, False), "Wcc": (True, False), "Sssp": (True, True), "TriangleCount": (False, False)}
        if algorithm not in needs:
            raise NotFound(f"no algorithm named {algorithm!r}")
        if (network.directed, network.weighted) != needs[algorithm]:
            raise WrongGraphType(f"{algorithm} does not run on a network of type {graph_type(network)}")
        said: dict = {}
        if algorithm == "TriangleCount":
            said["triangle_count"] = global_triangle_count(network).triangles
        elif algorithm == "PageRank":
            result = page_rank(network, PageRankConfig(**config))
            column = result.scores.select("id", F.col("score").cast("float").alias("page_rank"))
            said |= {"iterations": result.ran_iterations, "error": result.error}
        elif algorithm == "Wcc":
            column = wcc(network, WccConfig(**config)).components
        else:
            column = delta_stepping(network, DeltaSteppingConfig(**config)).distances
        if algorithm != "TriangleCount":
            key = property_key or algorithm.lower()
            column = column.repartitionByRange("id").sortWithinPartitions("id")
            self._properties[name, key] = self._scratch.keep(column, f"{name}-{key}-{len(self._properties)}-{time.time_ns()}")
            said["property_id"] = {"graph_name": name, "property_key": key}
        return said | {"compute_millis": int((time.perf_counter() - began) * 1e3)}

    def property(self, name: str, key: str) -> DataFrame:
        if (name, key) not in self._properties:
            raise NotFound(f"no property {key!r} of a network named {name!r}")
        return self._properties[name, key]

    def fetch(self, name: str, key: str):
        """The property as Arrow record batches of at most ``BATCH_ROWS`` rows, ordered by node.

        One range of ids comes to the driver at a time; the property is kept in id order,
        so a range reads only the row groups that hold it.
        """
        table = self.property(name, key)
        for first in range(0, self.network(name).node_count, FETCH_IDS):
            part = table.where(F.col("id").between(first, first + FETCH_IDS - 1)).orderBy("id").toArrow()
            yield from part.to_batches(max_chunksize=BATCH_ROWS)

    def ticket(self, body: str | bytes | dict) -> DataFrame:
        """The property that a JSON ticket ``{"graph_name", "property_key"}`` names."""
        wanted = body if isinstance(body, dict) else json.loads(body)
        return self.property(wanted["graph_name"], wanted["property_key"])

    def action(self, kind: str, body: str | bytes = "{}"):
        """Run an action given by its name and a JSON body, and return what it says.

        Bodies: ``create`` ``{graph_name, file_format, path, csr_layout, orientation}``,
        ``remove`` and ``to_relabeled`` ``{graph_name}``, ``to_undirected`` ``{graph_name,
        csr_layout}``, ``compute`` ``{graph_name, algorithm: {name: config}, property_key}``.
        """
        if kind not in ACTIONS:
            raise NotFound(f"no action named {kind!r}")
        asked = json.loads(body) if body else {}
        if kind == "list":
            return [vars(x) for x in self.list()]
        name = asked["graph_name"]
        layout = Layout(asked["csr_layout"]) if "csr_layout" in asked else None
        if kind == "create":
            direction = Direction.UNDIRECTED if asked.get("orientation") == "Undirected" else Direction.OUTGOING
            return self.create(name, asked["path"], FileFormat(asked["file_format"]), direction, layout or Layout.UNSORTED)
        if kind == "compute":
            wanted = asked["algorithm"]
            algorithm, config = next(iter(wanted.items())) if isinstance(wanted, dict) else (wanted, {})
            return self.compute(name, algorithm, asked.get("property_key"), **(config or {}))
        found = {"remove": self.remove, "to_relabeled": self.to_relabeled}.get(kind)
        return vars(found(name) if found else self.to_undirected(name, layout))


def with_node_values(network, values: DataFrame):
    return replace(network, nodes=values)
