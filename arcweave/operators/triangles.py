"""Global triangle count.

Edges are de-duplicated and directed from the end of lower (degree, id) to the
other, which bounds every list of targets by sqrt(2m) however skewed the degrees
are.  Each edge carries its source's list to its target, where the intersection
with the target's list is counted: one shuffle of packed ids instead of one row
for each pair of edges.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from arcweave.operators.model import Graph, WrongGraphType
from arcweave.operators.storage import Scratch


@dataclass(frozen=True)
class TriangleCountResult:
    triangles: int
    micros: int

    def __repr__(self) -> str:
        return f"TriangleCountResult {{ triangles: {self.triangles}, took: {self.micros} us }}"


def _corners(pairs: DataFrame) -> DataFrame:
    """``(src, v, common)`` per pair ``(a, b)``: its ends, and the third corners of its triangles."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    # The smaller id is always in a, so equal degrees go from a to b.
    low = F.col("da") <= F.col("db")
    up = ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("dst"))
    lists = up.groupBy("src").agg(F.collect_list("dst").alias("targets"))
    carried = lists.select("src", F.explode("targets").alias("v"), F.col("targets").alias("of_source"))
    met = carried.join(lists.withColumnRenamed("src", "v"), "v")
    return met.select("src", "v", F.array_intersect("of_source", "targets").alias("common"))


def triangle_total(network: Graph) -> DataFrame:
    """One row ``(triangles)``: unordered triples of mutually linked nodes."""
    pairs = network.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = Scratch(network.spark, "triangles").keep(pairs, "pairs")
    return _corners(pairs).agg(F.coalesce(F.sum(F.size("common").cast("long")), F.lit(0)).cast("long").alias("triangles"))


def multigraph_total(network: Graph) -> DataFrame:
    """One row ``(triangles)`` as a merge over sorted lists with repeats counts them.

    The sum over u >= v >= w of the multiplicities of (u, v) and (v, w) where w is a
    neighbour of u; it depends on the labelling and counts self-loops.  Proper
    triangles are found by degree, as in :func:`triangle_total`, and looked up in the
    multiplicities; a loop at u meets each (u, w) with w <= u, and one at v each (u, v).
    """
    scratch = Scratch(network.spark, "triangles")
    multi = network.stored_edges().where("dst <= src").groupBy(F.col("src").alias("u"), F.col("dst").alias("w")).agg(F.count("*").alias("c"))
    multi = scratch.keep(multi, "multi")
    corners = _corners(multi.where("w < u").select(F.col("w").alias("a"), F.col("u").alias("b")))
    found = corners.select("src", "v", F.explode("common").alias("x"))
    top, low = F.greatest("src", "v", "x"), F.least("src", "v", "x")
    found = found.select(top.alias("u"), (F.col("src") + F.col("v") + F.col("x") - top - low).alias("v"), low.alias("w"))
    upper = multi.select("u", F.col("w").alias("v"), F.col("c").alias("c1"))
    lower = multi.select(F.col("u").alias("v"), "w", F.col("c").alias("c2"))
    proper = found.join(upper, ["u", "v"]).join(lower, ["v", "w"]).select((F.col("c1") * F.col("c2")).alias("n"))
    loops = multi.where("u = w").select(F.col("u").alias("at"), F.col("c").alias("loop"))
    first = multi.join(loops, F.col("u") == F.col("at"))
    second = multi.where("w < u").join(loops, F.col("w") == F.col("at"))
    both = first.unionByName(second).select((F.col("c") * F.col("loop")).alias("n"))
    return proper.unionByName(both).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))


def global_triangle_count(network: Graph, multigraph: bool = False) -> TriangleCountResult:
    if network.directed:
        raise WrongGraphType("triangle counts need an undirected network")
    began = time.perf_counter()
    total = multigraph_total(network) if multigraph else triangle_total(network)
    return TriangleCountResult(int(total.first()["triangles"]), int((time.perf_counter() - began) * 1e6))
