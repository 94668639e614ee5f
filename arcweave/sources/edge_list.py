"""Edge lists as text: ``source target[ value]`` per line, LF or CRLF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, value_type: str = "float", comment: str | None = None) -> DataFrame:
    """``(src, dst[, value])``; a missing value is 0, an id that is no number an error."""
    line = F.trim(F.regexp_replace("value", r"[\t\r]+", " "))
    lines = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    if comment:
        lines = lines.where(~F.col("line").startswith(comment))
    parts = F.split("line", " +")
    columns = [F.get(parts, F.lit(i)).cast("long").alias(n) for i, n in enumerate(("src", "dst"))]
    if weighted:
        columns.append(F.coalesce(F.get(parts, F.lit(2)).cast(value_type), F.lit(0).cast(value_type)).alias("value"))
    return lines.select(*columns)


def write_edge_list(edges: DataFrame, path: str) -> None:
    columns = [F.col(c).cast("string") for c in ("src", "dst", "value") if c in edges.columns]
    edges.select(F.concat_ws(" ", *columns).alias("value")).write.mode("overwrite").text(path)
