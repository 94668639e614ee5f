"""Weakly connected components of a network; a component's id is its smallest node."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from arcweave.operators.components import star_labels
from arcweave.operators.storage import Scratch

VARIANTS = ("baseline", "afforest", "afforest_dss")


@dataclass(frozen=True)
class WccConfig:
    """Of ``afforest``: first links taken of each node, and nodes sampled for the largest component.

    No value changes a result; ``chunk_size`` is a name of the public interface only, as
    Spark deals the work.
    """

    chunk_size: int = 16384
    neighbor_rounds: int = 2
    sampling_size: int = 1024


@dataclass(frozen=True)
class WccResult:
    components: DataFrame
    micros: int

    def to_numpy(self):
        """The component of each node by id, as a read-only array on the driver."""
        array = self.components.orderBy("id").toArrow()["component"].to_numpy()
        array.setflags(write=False)
        return array

    def __repr__(self) -> str:
        return f"WccResult {{ took: {self.micros} us }}"


def component_ids(network) -> DataFrame:
    """``(id, component)`` of every node."""
    return _labelled(network, star_labels(network.edges))


def sampled_component(labels: DataFrame, node_count: int, sampling_size: int) -> int | None:
    """The commonest component among about ``sampling_size`` nodes picked by a hash of their id."""
    every = max(1, node_count // max(1, sampling_size))
    picked = labels.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).groupBy("component").agg(F.count("*").alias("n"))
    top = picked.orderBy(F.desc("n"), "component").first()
    return None if top is None else top["component"]


def afforest(network, config: WccConfig = WccConfig()) -> DataFrame:
    """``(id, component)`` of every node: link a few edges, skip the largest component, link the rest.

    After the first ``neighbor_rounds`` edges of each node are linked, only edges with an end
    outside the commonest component can change anything.  They are moved to the components
    of their ends, which leaves few distinct ones for the second contraction.
    """
    scratch = Scratch(network.spark, "afforest")
    links = network.edges.select("src", "dst").where("src <> dst")
    few = first_neighbors(links.distinct(), config.neighbor_rounds).select("src", "dst")
    labels = scratch.keep(_labelled(network, star_labels(few)), "sampled")
    skip = sampled_component(labels, network.node_count, config.sampling_size)
    source = labels.select(F.col("id").alias("src"), F.col("component").alias("a"))
    target = labels.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    rest = links.join(source, "src").join(target, "dst").where("a <> b")
    if skip is not None:
        rest = rest.where((F.col("a") != skip) | (F.col("b") != skip))
    merged = star_labels(scratch.keep(rest.select("a", "b").distinct(), "rest"), "a", "b")
    merged = merged.select(F.col("id").alias("component"), F.col("component").alias("into"))
    return labels.join(merged, "component", "left").select("id", F.coalesce("into", "component").alias("component"))


def _labelled(network, labels: DataFrame) -> DataFrame:
    return network.ids().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def wcc(network, config: WccConfig = WccConfig(), variant: str = "afforest") -> WccResult:
    """``afforest`` and ``afforest_dss`` sample first; ``baseline`` contracts all edges at once."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    began = time.perf_counter()
    found = component_ids(network) if variant == "baseline" else afforest(network, config)
    return WccResult(found, int((time.perf_counter() - began) * 1e6))


def first_neighbors(edges: DataFrame, k: int) -> DataFrame:
    """The first ``k`` targets of each source, by target, then value."""
    order = [F.col(c) for c in edges.columns if c != "src"]
    ranked = edges.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy(*order)))
    return ranked.where(F.col("pos") <= k)


def largest_component(components: DataFrame) -> DataFrame:
    """``(component, size)`` of the largest component; the smaller id wins a tie."""
    return components.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)


def remaining_edges(edges: DataFrame, components: DataFrame, skip: int) -> DataFrame:
    """Edges whose source is outside the component ``skip``."""
    inside = components.where(F.col("component") == skip).select(F.col("id").alias("src"))
    return edges.join(inside, "src", "left_anti")
