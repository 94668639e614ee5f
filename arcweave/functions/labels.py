"""Statistics over node labels (``network.nodes.value``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def label_frequencies(network) -> DataFrame:
    """``(label, frequency)``."""
    return network.nodes.groupBy(F.col("value").alias("label")).agg(F.count("*").alias("frequency"))


def degree_table(network) -> DataFrame:
    return network.out_degrees() if network.directed else network.degrees()


def label_stats(network) -> DataFrame:
    """One row: ``max_degree``, distinct ``label_count``, ``max_label``, ``max_label_frequency``."""
    labels = label_frequencies(network).agg(F.count("*").alias("label_count"), F.max("label").alias("max_label"), F.max("frequency").alias("max_label_frequency"))
    # Two single rows side by side.
    return degree_table(network).agg(F.max("degree").alias("max_degree")).crossJoin(labels)


def neighbor_label_counts(network) -> DataFrame:
    """``(id, label, frequency)`` over the neighbours of each node."""
    stored = network.stored_edges().select("src", "dst")
    labels = network.nodes.select(F.col("id").alias("dst"), F.col("value").alias("label"))
    return stored.join(labels, "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("frequency"))


def neighbor_label_frequency(network) -> DataFrame:
    """``(id, frequencies map<label, count>)``."""
    entries = F.sort_array(F.collect_list(F.struct("label", "frequency")))
    return neighbor_label_counts(network).groupBy("id").agg(F.map_from_entries(entries).alias("frequencies"))


def label_index(network) -> DataFrame:
    """``(label, pos, id)``: node ids of each label in ascending order, from 0.

    A row per node rather than a list per label, as a label may hold any share of
    all nodes; places come from one global order and the first place of each label.
    """
    from arcweave.operators.ordering import with_place

    return with_place(network.nodes.select(F.col("value").alias("label"), "id"), ["label"], ["id"]).select("label", "pos", "id")


def nodes_with_label(network, label) -> list[int]:
    return [r["id"] for r in network.nodes.where(F.col("value") == label).select("id").orderBy("id").collect()]
