"""Ranges of nodes with about equal sums, and work by node or by range."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from arcweave.operators.model import DiGraph, Graph, InvalidNodeValues, InvalidPartitioning
from arcweave.operators.ordering import with_running_sum
from arcweave.operators.storage import Scratch


def greedy_ranges(amounts: DataFrame, node_count: int, batch_size: int, max_ranges: int) -> list[tuple[int, int]]:
    """Half-open id ranges; each but the last ends where its sum reaches ``batch_size``.

    ``amounts`` has ``(id, degree)``.  The running sum is made in one pass and kept as
    a table in id order.  A cut stands where the sum passes its target, at most the
    largest degree beyond it, so each lookup reads only the row groups there.
    """
    if node_count == 0:
        return []
    scratch = Scratch(amounts.sparkSession, "ranges")
    running = with_running_sum(amounts, "id", "degree", "before").select("id", (F.col("before") + F.col("degree")).alias("upto"), "degree")
    running = scratch.keep(running, "running")
    most = running.agg(F.max("degree").alias("m")).first()["m"] or 0
    ranges, start, reached = [], 0, 0
    while start < node_count and len(ranges) < max_ranges - 1:
        target = reached + batch_size
        near = running.where((F.col("id") >= start) & (F.col("upto") >= target) & (F.col("upto") <= max(target, reached) + most))
        cut = near.agg(F.min(F.struct("id", "upto")).alias("c")).first()["c"]
        if cut is None:
            break
        ranges.append((start, cut["id"] + 1))
        start, reached = cut["id"] + 1, cut["upto"]
    if start < node_count:
        ranges.append((start, node_count))
    scratch.drop("running")
    return ranges


def _batch(total: int, parts: int) -> int:
    return -(-total // parts)


def degree_partition(network: Graph, parts: int) -> list[tuple[int, int]]:
    return greedy_ranges(network.degrees(), network.node_count, _batch(2 * network.edge_count, parts), parts)


def out_degree_partition(network: DiGraph, parts: int) -> list[tuple[int, int]]:
    return greedy_ranges(network.out_degrees(), network.node_count, _batch(network.edge_count, parts), parts)


def in_degree_partition(network: DiGraph, parts: int) -> list[tuple[int, int]]:
    return greedy_ranges(network.in_degrees(), network.node_count, _batch(network.edge_count, parts), parts)


def ranges_table(spark, ranges: Iterable[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "part long, first long, end long")


def node_parts(network, ranges: list[tuple[int, int]]) -> DataFrame:
    """``(id, part)``: the range that holds each node.

    Ids are cut into blocks of one width, a few for each range; a range is listed under
    the blocks that it meets, so the join is by block.  The list is as long as the ranges
    given, a few times over.
    """
    width = max(1, network.node_count // max(1, 4 * len(ranges)))
    listed = [(i, a, b, block) for i, (a, b) in enumerate(ranges) if a < b for block in range(a // width, (b - 1) // width + 1)]
    bounds = network.spark.createDataFrame(listed, "part long, first long, end long, block long")
    ids = network.ids().withColumn("block", F.expr(f"id div {width}"))
    return ids.join(F.broadcast(bounds), "block").where("id >= first and id < end").select("id", "part")


def for_each_node(table: DataFrame, node_fn: Callable[[DataFrame], Column]) -> DataFrame:
    """``table`` (one row per node) with the new state that ``node_fn`` gives each node."""
    return table.withColumn("state", node_fn(table))


def for_each_node_by_partition(network, values: DataFrame, ranges: list[tuple[int, int]], fn: Callable, schema: str) -> DataFrame:
    """Run ``fn(pandas frame) -> pandas frame`` over ``values`` by node range, one task per range.

    ``values(id, ...)`` needs a row per node, and the ranges must cover all nodes in order.
    """
    if not ranges or ranges[0][0] != 0 or ranges[-1][1] != network.node_count or any(a[1] != b[0] for a, b in zip(ranges, ranges[1:], strict=False)):
        raise InvalidPartitioning("ranges must follow each other from 0 to the node count")
    if values.count() != network.node_count:
        raise InvalidNodeValues("one value per node is needed")
    return values.join(node_parts(network, ranges), "id").groupBy("part").applyInPandas(fn, schema)
