"""Graphs saved as Parquet tables with a small description."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from arcweave.operators.model import DiGraph, Graph, InvalidIdType, Layout


def save(network, path: str) -> None:
    """Write edges, node values and description below ``path``."""
    network.edges.write.mode("overwrite").parquet(f"{path}/edges")
    if _has_own_stored(network):
        network.stored_edges().write.mode("overwrite").parquet(f"{path}/stored")
    if network.nodes is not None:
        network.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    about = [(type(network).__name__, network.node_count, network.layout.value, network.nodes is not None, network.adjacency_list)]
    network.spark.createDataFrame(about, "kind string, node_count long, layout string, has_nodes boolean, adjacency_list boolean").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def _has_own_stored(network) -> bool:
    """Whether the stored edges are more than the edges read from both ends."""
    return not network.directed and network.layout is Layout.DEDUPLICATED


def _checked(table: DataFrame) -> DataFrame:
    if dict(table.dtypes).get("src") != "bigint" or dict(table.dtypes).get("dst") != "bigint":
        raise InvalidIdType("node ids must be longs")
    return table


def restore(spark: SparkSession, path: str):
    """The network that :func:`save` wrote; layout and values as they were."""
    about = spark.read.schema("kind string, node_count long, layout string, has_nodes boolean, adjacency_list boolean").json(f"{path}/about").first()
    cls = {"DiGraph": DiGraph, "Graph": Graph}[about["kind"]]
    nodes = spark.read.parquet(f"{path}/nodes") if about["has_nodes"] else None
    edges = _checked(spark.read.parquet(f"{path}/edges"))
    # The edges are as the layout and later insertions left them: it is not applied again.
    network = cls(edges, about["node_count"], Layout(about["layout"]), nodes, about["adjacency_list"])
    if _has_own_stored(network):
        return replace(network, _stored=_checked(spark.read.parquet(f"{path}/stored")))
    return network
