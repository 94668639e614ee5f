"""Graph500 binary edges: records of three little-endian 32-bit words.

The words hold the low 32 bits of both ids and, in the last word, 16 more bits of
the first id below 16 more bits of the second.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arcweave.operators.model import InvalidIdType, computed_once

RECORD_BYTES, EDGES_PER_NODE = 12, 16


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Source and target ids of packed records; trailing bytes are ignored."""
    words = np.frombuffer(data[: len(data) // RECORD_BYTES * RECORD_BYTES], "<u4").reshape(-1, 3).astype(np.int64)
    return words[:, 0] | (words[:, 2] & 0xFFFF) << 32, words[:, 1] | (words[:, 2] >> 16) << 32


def encode(pairs: Iterable[tuple[int, int]]) -> bytes:
    """Packed records of ``(source, target)`` pairs."""
    ids = np.array(list(pairs), np.int64).reshape(-1, 2)
    words = np.empty((len(ids), 3), "<u4")
    words[:, 0], words[:, 1] = ids[:, 0] & 0xFFFFFFFF, ids[:, 1] & 0xFFFFFFFF
    words[:, 2] = (ids[:, 0] >> 32) | (ids[:, 1] >> 32) << 16
    return words.tobytes()


def _number(first: int, size: int) -> Column:
    """Little-endian bytes of the record, from the 1-based ``first``, as a long."""
    digits = [F.hex(F.substring("value", first + i, 1)) for i in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10).cast("long")


def read_graph500(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``(edges(src, dst), node_count)``; the count is a sixteenth of the edges'.

    Spark's reader of fixed-length records splits files anywhere; the records are decoded
    by built-in functions and never pass through Python.
    """
    context = spark.sparkContext
    records = context._jsc.binaryRecords(path, RECORD_BYTES).rdd()
    raw = DataFrame(spark._jsparkSession.createDataset(records, context._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    source = _number(1, 4).bitwiseOR(F.shiftleft(_number(9, 2), 32))
    target = _number(5, 4).bitwiseOR(F.shiftleft(_number(11, 2), 32))
    edges = computed_once(raw.select(source.alias("src"), target.alias("dst")))
    stats = edges.agg(F.count("*").alias("n"), F.max(F.greatest("src", "dst")).alias("top")).first()
    count = stats["n"] // EDGES_PER_NODE
    if stats["top"] is not None and stats["top"] >= count:
        raise InvalidIdType(f"node id {stats['top']} is not below the node count {count}")
    return edges, count
