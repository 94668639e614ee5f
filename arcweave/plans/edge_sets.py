"""Edge and label tables over the star schema, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from arcweave.operators.ordering import with_previous


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's part to the next one of its order, valued by the quantity."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    linked = lines.select(F.lag("l_partkey").over(order).alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("value"))
    return linked.where("src is not null")


CHAIN = """chain AS MATERIALIZED (SELECT src, dst, value FROM (
  SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS src,
         l_partkey AS dst, l_quantity AS value FROM lineitem) WHERE src IS NOT NULL)"""
CHAIN_NODES = "n AS MATERIALIZED (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) + 1 FROM chain))) AS id)"


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to the suppliers of their orders; suppliers follow the customers' ids."""
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # One row with the number of customers.
    return joined.crossJoin(F.broadcast(customers)).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + F.col("n")).alias("dst"), F.col("l_quantity").alias("value"))


CUSTOMER_SUPPLIER = """cs AS MATERIALIZED (SELECT o_custkey AS src, l_suppkey + (SELECT count(*) FROM customer) AS dst, l_quantity AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CS_NODES = "n AS MATERIALIZED (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) + 1 FROM cs))) AS id)"


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to their orders; orders follow the customers' ids."""
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.crossJoin(F.broadcast(customers)).select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + F.col("n")).alias("dst"))


CUSTOMER_ORDERS = "co AS MATERIALIZED (SELECT o_custkey AS src, o_orderkey + (SELECT count(*) FROM customer) AS dst FROM orders)"


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts of one order, the smaller first."""
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = parts.withColumnRenamed("l_partkey", "src"), parts.withColumnRenamed("l_partkey", "dst")
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst")


COPURCHASE = """parts AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
co AS MATERIALIZED (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM parts a JOIN parts b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"""


def nation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return nations.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 25).cast("long").alias("dst"))


def party_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation of each customer and supplier node."""
    customers = table(spark, sf_dir, "customer")
    count = customers.agg(F.count("*").alias("n"))
    suppliers = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(count))
    return customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("value")).unionByName(
        suppliers.select((F.col("s_suppkey") + F.col("n")).alias("id"), F.col("s_nationkey").cast("long").alias("value"))
    )


PARTY_LABELS = """labels_of AS MATERIALIZED (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS label FROM customer
  UNION ALL SELECT s_suppkey + (SELECT count(*) FROM customer), CAST(s_nationkey AS BIGINT) FROM supplier)"""


def handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's user to the next event's user, within an event type."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id")
    linked = with_previous(events, ["event_type"], ["ts", "event_id"], "user_id", "src")
    return linked.select("src", F.col("user_id").alias("dst")).where("src is not null")


HANDOVER = """hand AS MATERIALIZED (SELECT src, dst FROM (SELECT lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS src,
  user_id AS dst FROM events) WHERE src IS NOT NULL)"""
