"""Networks as DataFrames: ``edges(src, dst[, value])`` and ``nodes(id[, value])``.

Node ids are dense longs ``0 .. node_count - 1``; gaps are isolated nodes.  Graphs
are immutable: each change returns a new one.  A directed network keeps one edge
table (incoming neighbours are the same rows keyed by ``dst``); an undirected one
reads each edge from both ends, so a self-loop counts twice in a degree and once
in the edge count.

Edge-list and adjacency-list networks differ in one rule: de-duplication drops
self-loops in the former and keeps them in the latter.
"""

from __future__ import annotations

import enum
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcweave.operators.storage import Scratch


class Layout(enum.Enum):
    """Order of neighbour lists; ``DEDUPLICATED`` also drops parallel edges."""

    SORTED = "Sorted"
    UNSORTED = "Unsorted"
    DEDUPLICATED = "Deduplicated"
    # The same members in the spelling of the public Python interface.
    Sorted = "Sorted"
    Unsorted = "Unsorted"
    Deduplicated = "Deduplicated"


class FileFormat(enum.Enum):
    GRAPH500 = "Graph500"
    EDGE_LIST = "EdgeList"
    EDGE_LIST_WEIGHTED = "EdgeListWeighted"
    LABELLED = "Labelled"
    Graph500 = "Graph500"
    EdgeList = "EdgeList"


class Direction(enum.Enum):
    OUTGOING = "Outgoing"
    INCOMING = "Incoming"
    UNDIRECTED = "Undirected"


class GraphError(ValueError):
    """Base of all errors of this package."""


class InvalidNodeValues(GraphError):
    pass


class InvalidPartitioning(GraphError):
    pass


class InvalidIdType(GraphError):
    pass


class MissingNode(GraphError):
    pass


class NotFound(GraphError):
    pass


class WrongGraphType(GraphError):
    pass


def reversed_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends."""
    return edges.unionByName(reversed_edges(edges))


def max_node_id(edges: DataFrame) -> int:
    """Largest id on either end; -1 without edges."""
    found = edges.agg(F.max(F.greatest("src", "dst")).alias("m")).first()["m"]
    return -1 if found is None else int(found)


def computed_once(edges: DataFrame) -> DataFrame:
    """The edges as a table where they come from a shuffle or from Python, else as they are.

    Every operator reads its edges several times; a plain scan is read again, anything
    dearer is computed once.
    """
    plan = edges._jdf.queryExecution().executedPlan().toString()
    if not any(mark in plan for mark in ("Exchange", "RDD", "Python", "MapIn")):
        return edges
    return Scratch(edges.sparkSession, "edges").keep(edges, "edges")


def deduplicated(edges: DataFrame, keep_self_loops: bool = False) -> DataFrame:
    """One edge per ordered pair; of parallel edges the smallest value stays."""
    kept = edges if keep_self_loops else edges.where("src <> dst")
    if "value" in edges.columns:
        return kept.groupBy("src", "dst").agg(F.min("value").alias("value"))
    return kept.select("src", "dst").distinct()


@dataclass(frozen=True)
class _Base:
    edges: DataFrame
    node_count: int
    layout: Layout = Layout.UNSORTED
    nodes: DataFrame | None = None
    adjacency_list: bool = False
    load_micros: int = field(default=0, compare=False)

    directed = True

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def weighted(self) -> bool:
        return "value" in self.edges.columns

    @classmethod
    def from_edges(cls, edges: DataFrame, node_count: int | None = None, layout: Layout = Layout.UNSORTED, nodes: DataFrame | None = None, adjacency_list: bool = False):
        """A network from any DataFrame whose first columns are source and target.

        A third column, if there is one, is the value.  ``nodes(id, value)`` sets
        the node count to one above its largest id.  Null ids are an error.
        """
        began = time.perf_counter()
        names = edges.columns
        if len(names) < 2:
            raise TypeError("edges need a source and a target column")
        checked = [F.coalesce(F.col(c).cast("long"), F.raise_error(F.lit("null node id")).cast("long")).alias(n) for c, n in zip(names, ("src", "dst"), strict=False)]
        edges = edges.select(*checked, *([F.col(names[2]).alias("value")] if len(names) > 2 else []))
        if node_count is None:
            edges = computed_once(edges)
        if nodes is not None:
            nodes = nodes.select(F.col(nodes.columns[0]).cast("long").alias("id"), F.col(nodes.columns[1]).alias("value"))
            valued = nodes.agg(F.max("id").alias("m")).first()["m"]
            given = 0 if valued is None else int(valued) + 1
            if max_node_id(edges) >= given:
                raise InvalidNodeValues(f"{given} node values for larger node ids")
            node_count = given
        if node_count is None:
            node_count = max_node_id(edges) + 1
        network = cls(edges, node_count, Layout.UNSORTED, nodes, adjacency_list)
        return replace(network.with_layout(layout), load_micros=int((time.perf_counter() - began) * 1e6))

    @classmethod
    def from_rows(cls, spark: SparkSession, rows, layout: Layout = Layout.UNSORTED, node_values=None, value_type: str = "double", **options):
        """A network from ``(source, target)`` or ``(source, target, value)`` tuples."""
        rows = [tuple(r) for r in rows]
        schema = "src long, dst long" + (f", value {value_type}" if rows and len(rows[0]) > 2 else "")
        nodes = None
        if node_values is not None:
            nodes = spark.createDataFrame(list(enumerate(node_values))) if node_values else spark.createDataFrame([], "id long, value long")
        return cls.from_edges(spark.createDataFrame(rows, schema), layout=layout, nodes=nodes, **options)

    @classmethod
    def from_numpy(cls, spark: SparkSession, array, layout: Layout = Layout.UNSORTED):
        """A network from the first two columns of a 2-d integer array."""
        import numpy as np
        import pandas as pd

        array = np.asarray(array)
        if array.ndim != 2 or array.shape[1] < 2:
            raise TypeError("a 2-d array with at least two columns is needed")
        return cls.from_pandas(spark, pd.DataFrame(array[:, :2].astype("int64"), columns=["src", "dst"]), layout)

    @classmethod
    def from_pandas(cls, spark: SparkSession, frame, layout: Layout = Layout.UNSORTED):
        if not len(frame):
            return cls.from_rows(spark, [], layout)
        return cls.from_edges(spark.createDataFrame(frame.iloc[:, :2]), layout=layout)

    @classmethod
    def from_arrow(cls, spark: SparkSession, table, layout: Layout = Layout.UNSORTED):
        """A network from the first two int64 columns of an Arrow table."""
        import pyarrow as pa

        if any(table.column(i).type != pa.int64() for i in (0, 1)):
            raise InvalidIdType("both id columns must be int64")
        return cls.from_edges(spark.createDataFrame(table.select([0, 1])), layout=layout)

    @classmethod
    def load(cls, spark: SparkSession, path: str, layout: Layout = Layout.UNSORTED, file_format: FileFormat = FileFormat.GRAPH500):
        from arcweave import sources

        return sources.load(cls, spark, path, layout, file_format)

    @property
    def edge_count(self) -> int:
        return self.stored_edges().count()

    def ids(self) -> DataFrame:
        return self.spark.range(self.node_count)

    def node_values(self) -> DataFrame:
        """``(id, value)`` of every node; null where no value was given."""
        if self.nodes is None:
            raise InvalidNodeValues("the network has no node values")
        return self.ids().join(self.nodes, "id", "left")

    def node_value(self, node: int):
        row = None if self.nodes is None else self.nodes.where(F.col("id") == node).first()
        return None if row is None else row["value"]

    def stored_edges(self) -> DataFrame:
        return self.edges

    def _degrees(self, keyed: DataFrame, key: str) -> DataFrame:
        counted = keyed.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("degree"))
        return self.ids().join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))

    def _lists(self, keyed: DataFrame, values: bool) -> DataFrame:
        target = F.struct(F.col("dst").alias("target"), "value") if values else F.col("dst")
        return keyed.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(target)).alias("neighbors"))

    def _rows(self, keyed: DataFrame, values: bool) -> DataFrame:
        from arcweave.operators.ordering import with_place

        columns = ["dst", *(["value"] if values else [])]
        placed = with_place(keyed.select("src", *columns), ["src"], columns, "pos")
        return placed.select(F.col("src").alias("id"), "pos", F.col("dst").alias("neighbor"), *columns[1:])

    def _one(self, keyed: DataFrame, node: int) -> list[int]:
        found = keyed.where(F.col("src") == node).select("dst")
        ordered = found if self.layout is Layout.UNSORTED else found.orderBy("dst")
        return [r["dst"] for r in ordered.collect()]

    def __repr__(self) -> str:
        return f"{type(self).__name__} {{ node_count: {self.node_count}, edge_count: {self.edge_count}, load_took: {self.load_micros} us }}"


@dataclass(frozen=True, repr=False)
class DiGraph(_Base):
    """Directed network."""

    directed = True

    def with_layout(self, layout: Layout) -> DiGraph:
        edges = deduplicated(self.edges, self.adjacency_list) if layout is Layout.DEDUPLICATED else self.edges
        return replace(self, edges=edges, layout=layout)

    def out_degrees(self) -> DataFrame:
        """``(id, degree)`` of every node."""
        return self._degrees(self.edges, "src")

    def in_degrees(self) -> DataFrame:
        return self._degrees(self.edges, "dst")

    def out_degree(self, node: int) -> int:
        return self.edges.where(F.col("src") == node).count()

    def in_degree(self, node: int) -> int:
        return self.edges.where(F.col("dst") == node).count()

    def all_out_neighbors(self, values: bool = False) -> DataFrame:
        """``(id, neighbors)`` of nodes that have outgoing edges; lists are sorted."""
        return self._lists(self.edges, values)

    def all_in_neighbors(self, values: bool = False) -> DataFrame:
        return self._lists(reversed_edges(self.edges), values)

    def out_neighbor_rows(self, values: bool = False) -> DataFrame:
        """``(id, pos, neighbor[, value])`` in ascending order: the lists as rows, whatever a node's degree."""
        return self._rows(self.edges, values)

    def in_neighbor_rows(self, values: bool = False) -> DataFrame:
        return self._rows(reversed_edges(self.edges), values)

    def out_neighbors(self, node: int) -> list[int]:
        return self._one(self.edges, node)

    def in_neighbors(self, node: int) -> list[int]:
        return self._one(reversed_edges(self.edges), node)

    copy_out_neighbors = out_neighbors
    copy_in_neighbors = in_neighbors

    def out_neighbors_with_values(self, node: int) -> list[tuple]:
        return [tuple(r) for r in self.edges.where(F.col("src") == node).select("dst", "value").orderBy("dst", "value").collect()]

    def in_neighbors_with_values(self, node: int) -> list[tuple]:
        return [tuple(r) for r in self.edges.where(F.col("dst") == node).select("src", "value").orderBy("src", "value").collect()]

    def to_undirected(self, layout: Layout = Layout.UNSORTED) -> Graph:
        """Every edge from both ends, with node values."""
        return Graph(self.edges, self.node_count, Layout.UNSORTED, self.nodes, self.adjacency_list).with_layout(layout)

    def page_rank(self, *, max_iterations: int = 20, tolerance: float = 1e-4, damping_factor: float = 0.85, update: str = "synchronous"):
        from arcweave.operators.pagerank import PageRankConfig, page_rank

        return page_rank(self, PageRankConfig(max_iterations, tolerance, damping_factor), update)

    def wcc(self, *, chunk_size: int = 16384, neighbor_rounds: int = 2, sampling_size: int = 1024):
        from arcweave.operators.wcc import WccConfig, wcc

        return wcc(self, WccConfig(chunk_size, neighbor_rounds, sampling_size))

    def sssp(self, *, start_node: int, delta: float):
        from arcweave.operators.paths import DeltaSteppingConfig, delta_stepping

        return delta_stepping(self, DeltaSteppingConfig(start_node, delta))


@dataclass(frozen=True, repr=False)
class Graph(_Base):
    """Undirected network; ``edges`` has each edge once, :meth:`stored_edges` from both ends."""

    directed = False
    _stored: DataFrame | None = field(default=None, compare=False)

    def with_layout(self, layout: Layout) -> Graph:
        stored = both_ways(self.edges)
        if layout is Layout.DEDUPLICATED:
            stored = deduplicated(stored, self.adjacency_list)
        return replace(self, layout=layout, _stored=stored)

    def stored_edges(self) -> DataFrame:
        return self._stored if self._stored is not None else both_ways(self.edges)

    @property
    def edge_count(self) -> int:
        return self.stored_edges().count() // 2

    def degrees(self) -> DataFrame:
        """``(id, degree)`` of every node."""
        return self._degrees(self.stored_edges(), "src")

    def degree(self, node: int) -> int:
        return self.stored_edges().where(F.col("src") == node).count()

    def all_neighbors(self, values: bool = False) -> DataFrame:
        return self._lists(self.stored_edges(), values)

    def neighbor_rows(self, values: bool = False) -> DataFrame:
        """``(id, pos, neighbor[, value])`` in ascending order: the lists as rows, whatever a node's degree."""
        return self._rows(self.stored_edges(), values)

    def neighbors(self, node: int) -> list[int]:
        return self._one(self.stored_edges(), node)

    copy_neighbors = neighbors

    def neighbors_with_values(self, node: int) -> list[tuple]:
        return [tuple(r) for r in self.stored_edges().where(F.col("src") == node).select("dst", "value").orderBy("dst", "value").collect()]

    def make_degree_ordered(self) -> Graph:
        from arcweave.operators.relabel import relabel_by_degree

        return relabel_by_degree(self)

    def global_triangle_count(self, multigraph: bool = False):
        from arcweave.operators.triangles import global_triangle_count

        return global_triangle_count(self, multigraph)
