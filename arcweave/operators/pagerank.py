"""PageRank.

``synchronous`` rounds are the scalable form: a join of the edges, with parallel
edges summed to one weight, and a partial aggregate per round.  ``in_place`` updates
nodes in id order in 32-bit floats and reads what the same round has written; it
is sequential by nature and limited to 16,384 nodes.  Both have the same fixed
point.  Nodes without outgoing edges give nothing away, so scores need not sum to 1.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from arcweave.operators.model import DiGraph, GraphError
from arcweave.operators.storage import Scratch

log = logging.getLogger(__name__)
IN_PLACE_NODES = 16_384
_CUT_EVERY = 5


@dataclass(frozen=True)
class PageRankConfig:
    """``max_iterations`` 0 runs until the error is below ``tolerance``."""

    max_iterations: int = 20
    tolerance: float = 1e-4
    damping_factor: float = 0.85


@dataclass(frozen=True)
class PageRankResult:
    scores: DataFrame
    ran_iterations: int
    error: float
    micros: int

    def to_numpy(self):
        """The score of each node by id, as a read-only array on the driver."""
        array = self.scores.orderBy("id").toArrow()["score"].to_numpy()
        array.setflags(write=False)
        return array

    def __repr__(self) -> str:
        return f"PageRankResult {{ ran_iterations: {self.ran_iterations}, error: {self.error}, took: {self.micros} us }}"


def transitions(network: DiGraph) -> DataFrame:
    """``(src, dst, w)``: the share of its score that ``src`` hands to ``dst``."""
    parallel = network.edges.groupBy("src", "dst").agg(F.count("*").alias("c"))
    degree = parallel.groupBy("src").agg(F.sum("c").alias("d"))
    return parallel.join(degree, "src").select("src", "dst", (F.col("c") / F.col("d")).alias("w"))


def one_round(network: DiGraph, moves: DataFrame, scores: DataFrame, damping: float, old: DataFrame | None = None) -> DataFrame:
    """``(id, score, old)`` after a round; ``old(id, old)`` has every node, by default without a score.

    ``moves`` is bucketed by ``src``: a round shuffles scores and partial sums, not edges.
    """
    got = moves.join(scores, moves["src"] == scores["id"]).select(F.col("dst").alias("id"), (F.col("score") * F.col("w")).alias("got"), F.lit(None).cast("double").alias("old"))
    nodes = network.ids().withColumn("old", F.lit(None).cast("double")) if old is None else old
    summed = got.unionByName(nodes.withColumn("got", F.lit(0.0))).groupBy("id").agg(F.sum("got").alias("got"), F.max("old").alias("old"))
    return summed.select("id", (F.lit((1 - damping) / network.node_count) + damping * F.col("got")).alias("score"), "old")


def fixed_rounds(network: DiGraph, rounds: int, damping: float = 0.85) -> DataFrame:
    """``(id, score)`` after a number of synchronous rounds, without stop test."""
    scratch = Scratch(network.spark, "pagerank")
    moves = scratch.keep_bucketed(transitions(network), "moves", ["src"])
    scores = network.ids().select("id", F.lit(1 / max(1, network.node_count)).alias("score"))
    for at in range(1, rounds + 1):
        scores = one_round(network, moves, scores, damping).select("id", "score")
        if at % _CUT_EVERY == 0 and at < rounds:
            scores = scratch.keep(scores, f"scores{at}")
    return scores


def page_rank(network: DiGraph, config: PageRankConfig = PageRankConfig(), update: str = "synchronous") -> PageRankResult:
    """Scores, iterations and last error; stops below the tolerance or at the limit."""
    began = time.perf_counter()
    if update == "in_place":
        scores, iterations, error = _in_place(network, config)
    elif update == "synchronous":
        scores, iterations, error = _synchronous(network, config)
    else:
        raise GraphError(f"unknown update {update!r}")
    return PageRankResult(scores, iterations, error, int((time.perf_counter() - began) * 1e6))


def _synchronous(network: DiGraph, config: PageRankConfig) -> tuple[DataFrame, int, float]:
    scratch = Scratch(network.spark, "pagerank")
    moves = scratch.keep_bucketed(transitions(network), "moves", ["src"])
    scores = network.ids().select("id", F.lit(1 / max(1, network.node_count)).alias("score"))
    at = 0
    while True:
        at += 1
        fresh = one_round(network, moves, scores, config.damping_factor, scores.withColumnRenamed("score", "old"))
        fresh = scratch.keep(fresh, f"scores{at}")
        change = fresh.agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("e")).first()["e"] or 0.0
        log.info("round %d: error %g", at, change)
        scratch.drop(f"scores{at - 1}")
        scores = fresh.select("id", "score")
        if change < config.tolerance or at == config.max_iterations:
            scratch.drop("moves")
            return scores, at, float(change)


def _in_place(network: DiGraph, config: PageRankConfig) -> tuple[DataFrame, int, float]:
    import numpy as np
    import pandas as pd

    n = network.node_count
    if n > IN_PLACE_NODES:
        raise GraphError(f"in-place updates are limited to {IN_PLACE_NODES} nodes")
    if n == 0:
        return network.ids().select("id", F.lit(0.0).cast("float").alias("score")), 0, 0.0
    lists = network.ids().join(network.all_in_neighbors(), "id", "left").join(network.out_degrees(), "id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        sources = [np.array(x if x is not None else [], np.int64) for x in frame["neighbors"]]
        degree = frame["degree"].to_numpy(np.float32)
        damping = np.float32(config.damping_factor)
        base = (np.float32(1) - damping) / np.float32(n)
        score = np.full(n, np.float32(1) / np.float32(n), np.float32)
        with np.errstate(divide="ignore"):
            out = score / degree
            at = 0
            while True:
                at += 1
                error = 0.0
                for u in range(n):
                    got = np.float32(0)
                    for v in sources[u]:
                        got += out[v]
                    fresh = np.float32(base + damping * got)
                    error += abs(float(fresh) - float(score[u]))
                    score[u], out[u] = fresh, fresh / degree[u]
                if error < config.tolerance or at == config.max_iterations:
                    break
        return pd.DataFrame({"id": np.arange(n), "score": score, "rounds": at, "error": error})

    found = Scratch(network.spark, "pagerank").keep(lists.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "id long, score float, rounds int, error double"), "scores")
    last = found.select("rounds", "error").first()
    return found.select("id", "score"), last["rounds"], last["error"]
