"""Readers and writers of networks."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from arcweave.operators.model import FileFormat, GraphError
from arcweave.sources.edge_list import read_edge_list
from arcweave.sources.graph500 import read_graph500
from arcweave.sources.labelled import read_labelled


#: Readers added by :func:`register_reader`, by name.
READERS: dict[str, Callable] = {}


def register_reader(name: str, reader: Callable) -> None:
    """Add a format: ``reader(spark, path)`` gives edges, or edges and ``nodes(id, value)``."""
    READERS[name] = reader


def load(cls, spark, path, layout, file_format: FileFormat | str = FileFormat.GRAPH500):
    """A network of class ``cls`` from a file or folder of the given format.

    A format is one of :class:`FileFormat` or the name of a registered reader.
    """
    began = time.perf_counter()
    if file_format in READERS:
        found = READERS[file_format](spark, path)
        edges, nodes = found if isinstance(found, tuple) else (found, None)
        network = cls.from_edges(edges, layout=layout, nodes=nodes)
    elif file_format is FileFormat.GRAPH500:
        edges, count = read_graph500(spark, path)
        network = cls.from_edges(edges, node_count=count, layout=layout)
    elif file_format in (FileFormat.EDGE_LIST, FileFormat.EDGE_LIST_WEIGHTED):
        network = cls.from_edges(read_edge_list(spark, path, weighted=file_format is FileFormat.EDGE_LIST_WEIGHTED), layout=layout)
    elif file_format is FileFormat.LABELLED:
        found = read_labelled(spark, path)
        network = cls.from_edges(found.edges, layout=layout, nodes=found.nodes.select("id", "label"))
    else:
        raise GraphError(f"unknown format {file_format}")
    return replace(network, load_micros=int((time.perf_counter() - began) * 1e6))
