"""Weakly connected components by alternating large-star / small-star rounds.

Method of Kiveris et al., "Connected Components in MapReduce and Beyond"
(SoCC 2014).  Each round is two aggregates and two joins over the edge table;
the component id is the smallest node id of the component.  Hubs never meet in
one task: minima are partial aggregates and the joins are plain equi-joins
whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, functions as F

from .storage import Scratch

log = logging.getLogger(__name__)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def star_labels(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """``(id, component)`` for every node that is not the smallest of its component.

    Self-loops and parallel edges are ignored.  A node missing from the result
    is its own component, so callers left-join and coalesce.  The tables of the rounds
    are kept in ``scratch`` where the caller gives one.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    mark = uuid.uuid4().hex[:8]
    now = edges.where(F.col(src) != F.col(dst)).select(
        F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")
    ).distinct()
    now = scratch.keep(now, f"{mark}-r0")
    fingerprint = None
    for step in range(1, max_rounds + 1):
        now = scratch.keep(_small_star(_large_star(now)), f"{mark}-r{step}")
        scratch.drop(f"{mark}-r{step - 1}")
        seen = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        log.debug("round %d: %d edges", step, seen["n"])
        if seen == fingerprint:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        fingerprint = seen
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
