"""Adding edges: a batch of new edges gives a new network."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from arcweave.operators.model import Layout, MissingNode, reversed_edges


def missing_nodes(network, new: DataFrame) -> DataFrame:
    """``(node)``: ends of new edges that are no node of the network."""
    ends = new.select(F.col("src").alias("node")).unionByName(new.select(F.col("dst").alias("node")))
    return ends.where((F.col("node") < 0) | (F.col("node") >= network.node_count)).distinct()


def add_edges(network, new: DataFrame):
    """The network with ``new(src, dst[, value])``; of equal edges the older value stays.

    Raises :class:`MissingNode` for an end outside the network.  Under the
    de-duplicated layout an edge that exists already is not added; self-loops are
    kept, as an inserted edge always is.
    """
    lost = missing_nodes(network, new).agg(F.min("node").alias("node")).first()["node"]
    if lost is not None:
        raise MissingNode(str(lost))
    new = new.select(*network.edges.columns)
    if network.layout is Layout.DEDUPLICATED:
        fresh = new.groupBy("src", "dst").agg(F.min("value").alias("value")) if network.weighted else new.distinct()
        if network.directed:
            return replace(network, edges=network.edges.unionByName(fresh.join(network.edges, ["src", "dst"], "left_anti")))
        # One edge for both directions, and none that exists; a self-loop is stored once.
        least = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
        pairs = fresh.select(*least, *fresh.columns[2:])
        pairs = pairs.groupBy("src", "dst").agg(F.min("value").alias("value")) if network.weighted else pairs.distinct()
        added = pairs.join(network.stored_edges(), ["src", "dst"], "left_anti")
        ends = added.unionByName(reversed_edges(added.where("src <> dst")))
        return replace(network, edges=network.edges.unionByName(added), _stored=network.stored_edges().unionByName(ends))
    if network.directed:
        return replace(network, edges=network.edges.unionByName(new))
    turned = new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *new.columns[2:])
    return replace(network, edges=network.edges.unionByName(new), _stored=network.stored_edges().unionByName(new).unionByName(turned))


def add_edge(network, source: int, target: int, value=None):
    """The network with one more edge."""
    row = (source, target) if value is None else (source, target, value)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in network.edges.schema.fields[: len(row)])
    return add_edges(network, network.spark.createDataFrame([row], schema))
