"""Labelled networks as text: ``t nodes edges``, ``v id label degree``, ``e source target``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class LabelledGraph:
    """``nodes(id, label, declared_degree)`` and ``edges(src, dst)``."""

    nodes: DataFrame
    edges: DataFrame

    def stats(self) -> dict:
        """Counts, largest label and declared degree, and the largest label frequency.

        ``label_slots`` is the largest label plus one, used or not.
        """
        base = self.nodes.agg(F.count("*").alias("node_count"), F.max("label").alias("max_label"), F.max("declared_degree").alias("max_degree")).first().asDict()
        top = self.nodes.groupBy("label").count().agg(F.max("count").alias("m")).first()["m"]
        return base | {"label_slots": (base["max_label"] or 0) + 1, "max_label_frequency": top}


def write_labelled(network, path: str) -> None:
    """``v`` and ``e`` lines of a network with labels as node values, below their ``t`` line's counts."""
    degrees = network.out_degrees() if network.directed else network.degrees()
    edges = network.edges.select(F.concat_ws(" ", F.lit("e"), "src", "dst").alias("value"))
    nodes = network.nodes.join(degrees, "id").select(F.concat_ws(" ", F.lit("v"), "id", "value", "degree").alias("value"))
    counts = network.spark.createDataFrame([(f"t {network.node_count} {network.edges.count()}",)], "value string")
    counts.coalesce(1).unionByName(nodes).unionByName(edges).write.mode("overwrite").text(path)


def read_labelled(spark: SparkSession, path: str) -> LabelledGraph:
    """Node lines may begin with ``v`` or ``n``; ids are read, not assumed."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    number = lambda i: F.get("p", F.lit(i)).cast("long")
    kind = F.get("p", F.lit(0))
    nodes = parts.where(kind.isin("v", "n")).select(number(1).alias("id"), number(2).alias("label"), number(3).alias("declared_degree"))
    edges = parts.where(kind == "e").select(number(1).alias("src"), number(2).alias("dst"))
    return LabelledGraph(nodes, edges)
