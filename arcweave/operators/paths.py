"""Single-source shortest paths by delta stepping over a log of distances.

Distances are 32-bit floats; a node that cannot be reached has the largest finite
one.  Each round relaxes the pending nodes of the lowest bucket ``floor(distance /
delta)``: one join of the frontier with the edges and one minimum per target.  A
round writes only the distances that it lowers; a node's distance is the smallest
in the log.  Every entry below the current bucket has been relaxed, and of the
current one all but those of the last round, so the log alone says what is pending.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from arcweave.operators.model import DiGraph, GraphError, MissingNode, WrongGraphType
from arcweave.operators.storage import Scratch

log = logging.getLogger(__name__)
UNREACHABLE = 3.4028234663852886e38
_MERGE_EVERY = 16
_LOG = "id long, dist float"


@dataclass(frozen=True)
class DeltaSteppingConfig:
    start_node: int
    delta: float


@dataclass(frozen=True)
class PathResult:
    distances: DataFrame
    rounds: int
    micros: int
    #: How many buckets held a frontier.
    buckets: int = 0


def delta_stepping(network: DiGraph, config: DeltaSteppingConfig) -> PathResult:
    """``distances(id, distance float)`` of every node from the start node."""
    began = time.perf_counter()
    if not network.directed or not network.weighted:
        raise WrongGraphType("shortest paths need a directed network with values")
    if not config.delta > 0:
        raise GraphError("delta must be positive")
    if not 0 <= config.start_node < network.node_count:
        raise MissingNode(str(config.start_node))
    spark = network.spark
    scratch = Scratch(spark, "paths")
    # Of parallel edges only the shortest can matter; self-loops never do.
    weights = network.edges.where("src <> dst").groupBy("src", "dst").agg(F.min(F.col("value").cast("float")).alias("w"))
    weights = scratch.keep_bucketed(weights, "weights", ["src"])
    if (weights.agg(F.min("w").alias("w")).first()["w"] or 0) < 0:
        raise GraphError("negative edge value")
    bucket = F.floor(F.col("dist") / config.delta)
    entries = ["log0"]
    scratch.keep(spark.createDataFrame([(config.start_node, 0.0)], _LOG), "log0")
    active, lowest, rounds, buckets = spark.createDataFrame([(config.start_node, 0.0)], _LOG), 0, 0, 1

    def known() -> DataFrame:
        return spark.read.schema(_LOG).parquet(*(scratch.paths[t] for t in entries))

    while True:
        rounds += 1
        reached = active.join(weights, active["id"] == weights["src"]).select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).cast("float").alias("new"))
        both = known().withColumn("new", F.lit(None).cast("float")).unionByName(reached.withColumn("dist", F.lit(None).cast("float")))
        least = both.groupBy("id").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
        lowered = least.where("new < dist or dist is null").select("id", F.col("new").alias("dist"))
        changed = scratch.keep(lowered, f"log{rounds}")
        entries.append(f"log{rounds}")
        log.debug("round %d of bucket %s", rounds, lowest)
        if len(entries) > _MERGE_EVERY:
            merged = f"merged{rounds}"
            scratch.keep(known().groupBy("id").agg(F.min("dist").alias("dist")), merged)
            scratch.drop(*(t for t in entries if t != f"log{rounds}"))
            entries = [merged]
        if changed.where(bucket == lowest).head() is not None:
            active = changed.where(bucket == lowest)
            continue
        best = known().groupBy("id").agg(F.min("dist").alias("dist"))
        lowest = best.where(bucket > lowest).agg(F.min(bucket).alias("b")).first()["b"]
        if lowest is None:
            break
        buckets += 1
        active = best.where(bucket == lowest)
    nearest = scratch.keep(known().groupBy("id").agg(F.min("dist").alias("dist")), "nearest")
    scratch.drop_all_but("nearest")
    found = network.ids().join(nearest, "id", "left")
    distances = found.select("id", F.coalesce("dist", F.lit(UNREACHABLE).cast("float")).alias("distance"))
    return PathResult(distances, rounds, int((time.perf_counter() - began) * 1e6), buckets)
