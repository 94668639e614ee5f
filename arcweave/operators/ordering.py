"""Global orders without a single sorting task: ranks and running sums.

Rows are range-partitioned and sorted inside their partitions; each partition's
total is one row, so the bases of all partitions are a table as small as the
number of partitions, and every row's place follows inside its own partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arcweave.operators.storage import Scratch


def _ranged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their partition ``pid`` and their place ``at`` in it, kept as a table."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    placed = ranged.select("*", F.shiftright(number, 33).alias("pid"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    return Scratch(df.sparkSession, name).keep(placed, "ranged")


def _with_base(placed: DataFrame, amount: Column) -> DataFrame:
    """Adds ``base``: the sum of ``amount`` over all earlier partitions."""
    totals = placed.groupBy("pid").agg(F.sum(amount).alias("total"))
    # One row per partition: the window sees as many rows as there were tasks.
    bases = totals.select("pid", F.coalesce(F.sum("total").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(bases), "pid")


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """The rows with their 0-based place in the global order."""
    placed = _with_base(_ranged(df, order, "rank"), F.lit(1).cast("long"))
    return placed.withColumn(name, F.col("base") + F.col("at")).drop("pid", "at", "base")


def with_place(df: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """The rows with their 0-based place among those of equal ``by`` columns."""
    ranked = with_rank(df, [F.col(c) for c in (*by, *order)], "rank")
    first = ranked.groupBy(*by).agg(F.min("rank").alias("first"))
    return ranked.join(first, by).withColumn(name, F.col("rank") - F.col("first")).drop("rank", "first")


def with_previous(df: DataFrame, by: list[str], order: list[str], column: str, name: str = "previous") -> DataFrame:
    """The rows with ``column`` of the row before among those of equal ``by`` columns; null for the first.

    The last row of each range partition goes on to the next one, so a single value of
    ``by`` may hold any share of the rows.
    """
    placed = _ranged(df, [F.col(c) for c in (*by, *order)], "previous")
    carried = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), F.col(column).alias("v"))
    inside = F.lag(carried).over(Window.partitionBy("pid").orderBy("at"))
    ends = placed.groupBy("pid").agg(F.max_by(carried, "at").alias("last"))
    # One row per partition: the window sees as many rows as there were tasks.
    borders = ends.select("pid", F.lag("last").over(Window.orderBy("pid")).alias("border"))
    found = placed.withColumn("inside", inside).join(F.broadcast(borders), "pid")
    before = F.when(F.col("at") == 0, F.col("border")).otherwise(F.col("inside"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & before[f"k{i}"].eqNullSafe(F.col(c))
    return found.withColumn(name, F.when(before.isNotNull() & same, before["v"])).drop("pid", "at", "inside", "border")


def with_running_sum(df: DataFrame, key: str, amount: str, name: str = "before") -> DataFrame:
    """The rows with the sum of ``amount`` over all rows of smaller ``key``."""
    placed = _with_base(_ranged(df, [F.col(key)], "running"), F.col(amount))
    inside = F.sum(amount).over(Window.partitionBy("pid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn(name, (F.col("base") + F.coalesce(inside, F.lit(0))).cast("long")).drop("pid", "at", "base")
