"""Degree-ordered relabelling, offsets, and dense ids for arbitrary keys."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from arcweave.operators.model import Graph, Layout, WrongGraphType, both_ways, deduplicated
from arcweave.operators.ordering import with_rank, with_running_sum


def degree_order(network: Graph) -> DataFrame:
    """``(old_id, degree, new_id)``: by degree, then id, both descending."""
    if network.directed:
        raise WrongGraphType("degree order needs an undirected network")
    ranked = with_rank(network.degrees(), [F.desc("degree"), F.desc("id")], "new_id")
    return ranked.select(F.col("id").alias("old_id"), "degree", "new_id")


def rename_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``edges`` with both ends sent through ``mapping(old_id, new_id)``."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    source = mapping.select(F.col("old_id").alias("src"), F.col("new_id").alias("new_src"))
    target = mapping.select(F.col("old_id").alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(source, "src").join(target, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *rest)


def relabel_by_degree(network: Graph) -> Graph:
    """The network with node 0 of the highest degree; node values move with their nodes."""
    mapping = degree_order(network)
    edges = rename_nodes(network.edges, mapping)
    stored = rename_nodes(network.stored_edges(), mapping)
    nodes = network.nodes
    if nodes is not None:
        nodes = nodes.join(mapping, nodes["id"] == mapping["old_id"]).select(F.col("new_id").alias("id"), "value")
    layout = Layout.SORTED if network.layout is Layout.UNSORTED else network.layout
    return replace(network, edges=edges, nodes=nodes, layout=layout, _stored=stored)


def offsets(degrees: DataFrame) -> DataFrame:
    """``(id, offset)``: sum of the degrees of all smaller ids."""
    return with_running_sum(degrees, "id", "degree", "offset").select("id", "offset")


def dense_ids(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame]:
    """Edges over arbitrary keys as ``(src, dst)`` over ``0..n-1``, and ``(key, id)``."""
    keys = edges.select(F.col(src).alias("key")).union(edges.select(F.col(dst).alias("key"))).distinct()
    ids = with_rank(keys, [F.col("key")], "id")
    mapping = ids.select(F.col("key").alias("old_id"), F.col("id").alias("new_id"))
    return rename_nodes(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")), mapping), ids


def to_undirected(edges: DataFrame, layout: Layout) -> DataFrame:
    stored = both_ways(edges)
    return deduplicated(stored) if layout is Layout.DEDUPLICATED else stored
