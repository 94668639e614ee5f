"""Registered queries of the network engine and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcweave.functions import labels as label_functions
from arcweave.operators import mutation, partition, relabel, triangles, wcc as components
from arcweave.operators.model import DiGraph, Graph, Layout, max_node_id
from arcweave.operators.pagerank import PageRankConfig, fixed_rounds, page_rank
from arcweave.operators.paths import UNREACHABLE, DeltaSteppingConfig, delta_stepping
from arcweave.operators.storage import Scratch
from arcweave.plans import edge_sets as sets
from arcweave.plans.edge_sets import CHAIN, CHAIN_NODES, COPURCHASE, CS_NODES, CUSTOMER_ORDERS, CUSTOMER_SUPPLIER, HANDOVER, PARTY_LABELS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PARTS = 8


def _query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _chain(spark: SparkSession, sf_dir: str, layout: Layout = Layout.UNSORTED, cls=DiGraph):
    return cls.from_edges(sets.part_chain(spark, sf_dir), layout=layout)


def _parties(spark: SparkSession, sf_dir: str, cls=DiGraph):
    return cls.from_edges(sets.customer_supplier(spark, sf_dir).select("src", "dst"), nodes=sets.party_labels(spark, sf_dir))


# ---- degrees, counts, lists ---------------------------------------------


@_query(f"WITH {CUSTOMER_SUPPLIER}, {CS_NODES} SELECT id, count(cs.src) AS degree FROM n LEFT JOIN cs ON cs.src = id GROUP BY id")
def out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DiGraph.from_edges(sets.customer_supplier(spark, sf_dir)).out_degrees()


@_query(f"WITH {CUSTOMER_SUPPLIER}, {CS_NODES} SELECT id, count(cs.src) AS degree FROM n LEFT JOIN cs ON cs.dst = id GROUP BY id")
def in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DiGraph.from_edges(sets.customer_supplier(spark, sf_dir)).in_degrees()


@_query(f"""WITH {CHAIN}, {CHAIN_NODES}, b AS (SELECT src FROM chain UNION ALL SELECT dst FROM chain)
SELECT id, count(b.src) AS degree FROM n LEFT JOIN b ON b.src = id GROUP BY id""")
def degrees_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir, cls=Graph).degrees()


@_query(f"""WITH {CHAIN}, d AS (SELECT DISTINCT src, dst FROM chain WHERE src <> dst)
SELECT max(greatest(src, dst)) AS max_node, max(greatest(src, dst)) + 1 AS node_count, count(*) AS edge_count,
       (SELECT count(*) FROM d) AS distinct_edges FROM chain""")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = _chain(spark, sf_dir)
    row = (max_node_id(network.edges), network.node_count, network.edge_count, network.with_layout(Layout.DEDUPLICATED).edge_count)
    return spark.createDataFrame([row], "max_node long, node_count long, edge_count long, distinct_edges long")


@_query(f"""WITH {CHAIN}, {CHAIN_NODES}, d AS (SELECT id, count(src) AS degree FROM n LEFT JOIN chain ON src = id GROUP BY id)
SELECT id, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM d""")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabel.offsets(_chain(spark, sf_dir).out_degrees())


@_query(f"WITH {CHAIN} SELECT src AS id, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, dst AS neighbor FROM chain")
def sorted_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir, Layout.SORTED).out_neighbor_rows()


@_query(f"WITH {CHAIN} SELECT dst AS id, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS pos, src AS neighbor FROM chain")
def sorted_in_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir, Layout.SORTED).in_neighbor_rows()


@_query(f"""WITH {CHAIN} SELECT src AS id, row_number() OVER (PARTITION BY src ORDER BY dst, value) - 1 AS pos, dst AS target, value FROM chain""")
def neighbors_with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir, Layout.SORTED).out_neighbor_rows(values=True).withColumnRenamed("neighbor", "target")


# ---- layouts and direction ----------------------------------------------


@_query(f"WITH {CHAIN} SELECT src, dst, min(value) AS value FROM chain WHERE src <> dst GROUP BY src, dst")
def dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir, Layout.DEDUPLICATED).edges


@_query(f"WITH {CHAIN} SELECT src, dst, min(value) AS value FROM chain GROUP BY src, dst")
def adjacency_dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DiGraph.from_edges(sets.part_chain(spark, sf_dir), layout=Layout.DEDUPLICATED, adjacency_list=True).edges


@_query(f"""WITH {CHAIN}, b AS (SELECT src, dst FROM chain UNION ALL SELECT dst, src FROM chain)
SELECT src, dst, count(*) AS copies FROM b GROUP BY src, dst""")
def to_undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _chain(spark, sf_dir).to_undirected(Layout.SORTED).stored_edges()
    return stored.groupBy("src", "dst").agg(F.count("*").alias("copies"))


@_query(f"""WITH {CHAIN} SELECT DISTINCT src, dst FROM (SELECT src, dst FROM chain UNION ALL SELECT dst, src FROM chain) WHERE src <> dst""")
def to_undirected_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).to_undirected(Layout.DEDUPLICATED).stored_edges().select("src", "dst")


_ORDER = f"""{CHAIN}, {CHAIN_NODES}, b AS (SELECT src, dst FROM chain UNION ALL SELECT dst, src FROM chain),
d AS (SELECT id, count(b.src) AS degree FROM n LEFT JOIN b ON b.src = id GROUP BY id),
m AS MATERIALIZED (SELECT id AS old_id, degree, row_number() OVER (ORDER BY degree DESC, id DESC) - 1 AS new_id FROM d)"""


@_query(f"WITH {_ORDER} SELECT old_id, degree, new_id FROM m")
def relabel_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabel.degree_order(_chain(spark, sf_dir, cls=Graph))


@_query(f"""WITH {_ORDER} SELECT s.new_id AS src, t.new_id AS dst, count(*) AS copies
FROM b JOIN m s ON s.old_id = b.src JOIN m t ON t.old_id = b.dst GROUP BY 1, 2""")
def relabelled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = Graph.from_edges(sets.part_chain(spark, sf_dir).select("src", "dst")).make_degree_ordered()
    return network.stored_edges().groupBy("src", "dst").agg(F.count("*").alias("copies"))


@_query("""WITH e AS (SELECT c_name AS a, n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM (SELECT a AS key FROM e UNION SELECT b FROM e))
SELECT s.id AS src, t.id AS dst FROM e JOIN k s ON s.key = a JOIN k t ON t.key = b""")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, nations = sets.table(spark, sf_dir, "customer"), sets.table(spark, sf_dir, "nation")
    edges = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("a"), F.col("n_name").alias("b"))
    return relabel.dense_ids(edges, "a", "b")[0]


# ---- node values, mutation ----------------------------------------------


@_query(f"WITH {PARTY_LABELS} SELECT id, label AS value FROM labels_of")
def node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parties(spark, sf_dir).node_values()


@_query(f"""WITH {CHAIN}, old AS (SELECT src, dst, min(value) AS value FROM chain WHERE src <> dst GROUP BY src, dst),
new AS (SELECT dst AS src, src AS dst, min(value) + 100 AS value FROM chain WHERE value >= 25 GROUP BY 1, 2)
SELECT src, dst, value FROM old UNION ALL
SELECT src, dst, value FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.src = new.src AND old.dst = new.dst)""")
def add_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversed heavy edges join the de-duplicated chain; edges that exist keep their values."""
    network = _chain(spark, sf_dir, Layout.DEDUPLICATED)
    new = sets.part_chain(spark, sf_dir).where("value >= 25").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("value") + 100).alias("value"))
    return mutation.add_edges(network, new).edges


@_query(f"""WITH {CHAIN}, w AS (SELECT max(greatest(src, dst)) + 1 AS n FROM chain),
e AS (SELECT unnest([o_custkey, o_orderkey]) AS node FROM orders)
SELECT DISTINCT node FROM e, w WHERE node >= n OR node < 0""")
def missing_node_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = sets.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return mutation.missing_nodes(_chain(spark, sf_dir), new)


@_query(f"""WITH {CHAIN}, {CHAIN_NODES}, o AS (SELECT src AS id, count(*) AS d FROM chain GROUP BY 1), i AS (SELECT dst AS id, count(*) AS d FROM chain GROUP BY 1)
SELECT n.id, coalesce(o.d, 0) - coalesce(i.d, 0) AS state FROM n LEFT JOIN o ON o.id = n.id LEFT JOIN i ON i.id = n.id""")
def for_each_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's state from its degrees."""
    network = _chain(spark, sf_dir)
    both = network.out_degrees().join(network.in_degrees().withColumnRenamed("degree", "arriving"), "id")
    return partition.for_each_node(both, lambda t: t["degree"] - t["arriving"]).select("id", "state")


# ---- ranges -------------------------------------------------------------


def _cuts(total: str, degrees: str) -> str:
    return f"""WITH RECURSIVE {CHAIN}, {CHAIN_NODES}, deg AS ({degrees}),
run AS MATERIALIZED (SELECT id, CAST(sum(degree) OVER (ORDER BY id) AS BIGINT) AS upto FROM deg),
size AS (SELECT CAST(ceil({total} / {PARTS}.0) AS BIGINT) AS batch, (SELECT max(id) FROM n) AS last FROM chain),
cut(part, first, stop, reached) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT part + 1, stop, coalesce(CASE WHEN part + 1 < {PARTS} - 1 THEN (SELECT min(id) FROM run WHERE id >= stop AND upto >= reached + batch) END, last) + 1,
         coalesce(CASE WHEN part + 1 < {PARTS} - 1 THEN (SELECT min(upto) FROM run WHERE id >= stop AND upto >= reached + batch) END, 0)
  FROM cut, size WHERE stop <= last)
SELECT part, first, stop AS "end" FROM cut WHERE part >= 0"""


_OUT = "SELECT id, count(src) AS degree FROM n LEFT JOIN chain ON src = id GROUP BY id"
_IN = "SELECT id, count(src) AS degree FROM n LEFT JOIN chain ON dst = id GROUP BY id"
_BOTH = "SELECT id, count(b.src) AS degree FROM n LEFT JOIN (SELECT src FROM chain UNION ALL SELECT dst FROM chain) b ON b.src = id GROUP BY id"


@_query(_cuts("2 * count(*)", _BOTH))
def degree_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.ranges_table(spark, partition.degree_partition(_chain(spark, sf_dir, cls=Graph), PARTS))


@_query(_cuts("count(*)", _OUT))
def out_degree_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.ranges_table(spark, partition.out_degree_partition(_chain(spark, sf_dir), PARTS))


@_query(_cuts("count(*)", _IN))
def in_degree_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.ranges_table(spark, partition.in_degree_partition(_chain(spark, sf_dir), PARTS))


@_query(f"""WITH cuts AS ({_cuts("count(*)", _OUT)}), {CHAIN}, {CHAIN_NODES}, deg AS ({_OUT})
SELECT part, count(*) AS nodes, CAST(sum(degree) AS BIGINT) AS degrees FROM deg JOIN cuts ON id >= first AND id < "end" GROUP BY part""")
def for_each_node_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = _chain(spark, sf_dir)
    ranges = partition.out_degree_partition(network, PARTS)

    def total(frame):
        import pandas as pd

        return pd.DataFrame({"part": frame["part"][:1].astype("int64"), "nodes": len(frame), "degrees": frame["degree"].sum()})

    return partition.for_each_node_by_partition(network, network.out_degrees(), ranges, total, "part long, nodes long, degrees long")


# ---- labels -------------------------------------------------------------


@_query(f"""WITH {CUSTOMER_SUPPLIER}, {PARTY_LABELS}, b AS (SELECT src FROM cs UNION ALL SELECT dst FROM cs),
f AS (SELECT label, count(*) AS c FROM labels_of GROUP BY label)
SELECT (SELECT max(c) FROM (SELECT count(*) AS c FROM b GROUP BY src)) AS max_degree, count(*) AS label_count, max(label) AS max_label,
       max(c) AS max_label_frequency FROM f""")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_functions.label_stats(_parties(spark, sf_dir, Graph))


@_query(f"WITH {PARTY_LABELS} SELECT label, count(*) AS frequency FROM labels_of GROUP BY label")
def label_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_functions.label_frequencies(_parties(spark, sf_dir))


@_query(f"""WITH {CUSTOMER_SUPPLIER}, {PARTY_LABELS}, b AS (SELECT src, dst FROM cs UNION ALL SELECT dst, src FROM cs)
SELECT src AS id, label, count(*) AS frequency FROM b JOIN labels_of l ON l.id = b.dst GROUP BY src, label""")
def neighbor_label_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = label_functions.neighbor_label_frequency(_parties(spark, sf_dir, Graph))
    return maps.select("id", F.explode("frequencies").alias("label", "frequency"))


@_query(f"WITH {PARTY_LABELS} SELECT label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS pos, id FROM labels_of")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_functions.label_index(_parties(spark, sf_dir))


# ---- algorithms ---------------------------------------------------------


def _rank_rounds(rounds: int) -> str:
    steps = [f"""{CHAIN}, {CHAIN_NODES}, size AS (SELECT count(*) AS n FROM n), deg AS (SELECT src, count(*) AS d FROM chain GROUP BY src),
moves AS MATERIALIZED (SELECT c.src, c.dst, count(*) / any_value(d) AS w FROM chain c JOIN deg ON deg.src = c.src GROUP BY c.src, c.dst),
r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS score FROM n, size)"""]
    for k in range(1, rounds + 1):
        steps.append(f"""r{k} AS MATERIALIZED (SELECT n.id, (0.15::DOUBLE / any_value(size.n)) + 0.85 * coalesce(sum(r.score * w), 0) AS score
  FROM n CROSS JOIN size LEFT JOIN moves ON moves.dst = n.id LEFT JOIN r{k - 1} r ON r.id = moves.src GROUP BY n.id)""")
    return "WITH " + ",\n".join(steps)


@_query(_rank_rounds(5) + " SELECT id, round(score, 8) AS score FROM r5")
def pagerank_5_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_rounds(_chain(spark, sf_dir), 5).select("id", F.round("score", 8).alias("score"))


@_query(_rank_rounds(5) + """ SELECT round(min(score), 8) AS lowest, round(max(score), 8) AS highest, round(avg(score), 8) AS mean, round(median(score), 8) AS median FROM r5""")
def pagerank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    scores = fixed_rounds(_chain(spark, sf_dir), 5)
    return scores.agg(F.round(F.min(s), 8).alias("lowest"), F.round(F.max(s), 8).alias("highest"), F.round(F.avg(s), 8).alias("mean"), F.round(F.median(s), 8).alias("median"))


@_query(_rank_rounds(5) + " SELECT arg_max(id, score) AS id, round(max(score), 8) AS score FROM r5")
def pagerank_top_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_rounds(_chain(spark, sf_dir), 5).agg(F.max_by("id", "score").alias("id"), F.round(F.max("score"), 8).alias("score"))


@_query(_rank_rounds(40) + " SELECT id, round(score, 6) AS score FROM r40")
def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank run to a tolerance; the SQL unrolls more rounds than that takes."""
    result = page_rank(_chain(spark, sf_dir), PageRankConfig(max_iterations=60, tolerance=1e-9))
    return result.scores.select("id", F.round("score", 6).alias("score"))


_REGIONS = """e AS (SELECT n_nationkey AS a, n_regionkey + 25 AS b FROM nation)"""


@_query(f"""WITH {_REGIONS}, low AS (SELECT b, min(a) AS m FROM e GROUP BY b)
SELECT CAST(e.a AS BIGINT) AS id, CAST(m AS BIGINT) AS component FROM e JOIN low ON low.b = e.b
UNION ALL SELECT CAST(b AS BIGINT), CAST(m AS BIGINT) FROM low""")
def wcc_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.component_ids(DiGraph.from_edges(sets.nation_tree(spark, sf_dir)))


def _labels_sql(edges: str, tail: str, rounds: int = 24) -> str:
    """Minimum labels spread over both directions, with pointer jumps each round."""
    steps = [f"{CHAIN}, e AS MATERIALIZED ({edges}), b AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)",
             "n AS MATERIALIZED (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) + 1 FROM e))) AS id)",
             "f0 AS MATERIALIZED (SELECT id, id AS label FROM n)"]
    for k in range(1, rounds + 1):
        steps.append(f"""g{k} AS MATERIALIZED (SELECT f.id, least(f.label, coalesce(min(o.label), f.label)) AS label
  FROM f{k - 1} f LEFT JOIN b ON b.src = f.id LEFT JOIN f{k - 1} o ON o.id = b.dst GROUP BY f.id, f.label)""")
        steps.append(f"f{k} AS MATERIALIZED (SELECT g.id, least(g.label, h.label) AS label FROM g{k} g JOIN g{k} h ON h.id = g.label)")
    return "WITH " + ",\n".join(steps) + f"\n, comp AS (SELECT id, label AS component FROM f{rounds}) {tail}"


#: Whole edge sets of large tables, without any filter, and their SQL.
WHOLE = {
    "part_chain": (sets.part_chain, "SELECT src, dst FROM chain"),
    "customer_supplier": (sets.customer_supplier, f"WITH {CUSTOMER_SUPPLIER} SELECT src, dst FROM cs"),
    "customer_orders": (sets.customer_orders, f"WITH {CUSTOMER_ORDERS} SELECT src, dst FROM co"),
    "handover": (sets.handover, f"WITH {HANDOVER} SELECT src, dst FROM hand"),
}


def _register_whole(name: str, edges_of, sql: str) -> None:
    """The four component queries over one whole edge set."""

    def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
        return edges_of(spark, sf_dir).select("src", "dst")

    def wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
        return components.component_ids(DiGraph.from_edges(edges(spark, sf_dir)))

    def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
        return wcc(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size"))

    def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
        return components.largest_component(wcc(spark, sf_dir))

    def remaining_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Scratch(spark, "remaining").keep(wcc(spark, sf_dir), "components")
        top = components.largest_component(found).first()
        return components.remaining_edges(edges(spark, sf_dir), found, top["component"])

    tails = {
        wcc: "SELECT id, component FROM comp",
        component_sizes: "SELECT component, count(*) AS size FROM comp GROUP BY component",
        largest_component: "SELECT component, count(*) AS size FROM comp GROUP BY component ORDER BY size DESC, component LIMIT 1",
        remaining_edges: """, top AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
SELECT e.src, e.dst FROM e JOIN comp ON comp.id = e.src WHERE comp.component <> (SELECT component FROM top)""",
    }
    for query, tail in tails.items():
        query.__name__ = f"{query.__name__}_{name}"
        _query(_labels_sql(sql, tail))(query)


for _name, (_edges_of, _sql) in WHOLE.items():
    _register_whole(_name, _edges_of, _sql)


@_query(f"""WITH {HANDOVER}, d AS (SELECT src, count(*) AS c FROM hand GROUP BY src), r AS (
SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM (SELECT DISTINCT src, dst FROM hand))
SELECT src, dst, pos FROM r WHERE pos <= 2""")
def first_k_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two distinct successors of each user; the limit is the operator's."""
    edges = sets.handover(spark, sf_dir).distinct()
    return components.first_neighbors(edges, 2).withColumn("pos", F.col("pos").cast("long"))


def _distance_sql(edges: str, tail: str, rounds: int = 60) -> str:
    steps = [f"{CHAIN}, e AS MATERIALIZED ({edges})", "n AS MATERIALIZED (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) + 1 FROM e))) AS id)",
             "d0 AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS FLOAT) AS dist)"]
    for k in range(1, rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT id, min(dist) AS dist FROM (SELECT id, dist FROM d{k - 1} UNION ALL
  SELECT e.dst, CAST(d.dist + e.w AS FLOAT) FROM d{k - 1} d JOIN e ON e.src = d.id) GROUP BY id)""")
    return "WITH " + ",\n".join(steps) + f"\n, far AS (SELECT n.id, coalesce(dist, CAST({UNREACHABLE!r} AS FLOAT)) AS distance FROM n LEFT JOIN d{rounds} d ON d.id = n.id) {tail}"


_ALL_WEIGHTS = "SELECT src, dst, CAST(min(value) AS FLOAT) AS w FROM chain GROUP BY src, dst"


@_query(_distance_sql(_ALL_WEIGHTS, "SELECT id, distance FROM far", 40))
def sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_stepping(_chain(spark, sf_dir), DeltaSteppingConfig(0, 16.0)).distances


@_query(_distance_sql(_ALL_WEIGHTS, "SELECT id, distance FROM far", 40))
def sssp_small_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets far below the distances: most rounds open another one."""
    return delta_stepping(_chain(spark, sf_dir), DeltaSteppingConfig(0, 3.0)).distances


@_query(_distance_sql(f"WITH {CUSTOMER_SUPPLIER} SELECT src, dst, CAST(min(value) AS FLOAT) AS w FROM cs GROUP BY src, dst", "SELECT id, distance FROM far", 2))
def sssp_customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the suppliers of customer 0 can be reached; suppliers have no way on."""
    return delta_stepping(DiGraph.from_edges(sets.customer_supplier(spark, sf_dir)), DeltaSteppingConfig(0, 16.0)).distances


@_query(_distance_sql(_ALL_WEIGHTS, "SELECT count(*) AS reached, CAST(sum(distance) AS DOUBLE) AS total, max(distance) AS farthest FROM far WHERE distance < 20000", 40))
def sssp_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = delta_stepping(_chain(spark, sf_dir), DeltaSteppingConfig(0, 16.0)).distances.where("distance < 20000")
    return near.agg(F.count("*").alias("reached"), F.sum(F.col("distance").cast("double")).alias("total"), F.max("distance").alias("farthest"))


@_query(f"""WITH {COPURCHASE}, u AS MATERIALIZED (SELECT DISTINCT src, dst FROM co)
SELECT count(*) AS triangles FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst""")
def triangles_copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sets.table(spark, sf_dir, "part").count()
    return triangles.triangle_total(Graph.from_edges(sets.copurchase(spark, sf_dir), node_count=parts, layout=Layout.DEDUPLICATED))


@_query(f"""WITH {CHAIN}, b AS (SELECT src, dst FROM chain UNION ALL SELECT dst, src FROM chain),
m AS MATERIALIZED (SELECT src, dst, count(*) AS c FROM b GROUP BY src, dst)
SELECT CAST(coalesce(sum(x.c * y.c), 0) AS BIGINT) AS triangles FROM m x JOIN m y ON y.src = x.dst AND y.dst <= y.src
JOIN m z ON z.src = x.src AND z.dst = y.dst WHERE x.dst <= x.src""")
def triangles_multigraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles.multigraph_total(_chain(spark, sf_dir, Layout.SORTED, Graph))


# ---- formats ------------------------------------------------------------


@_query(f"WITH {CHAIN} SELECT src, dst, CAST(value AS FLOAT) AS value FROM chain")
def edge_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain written as edge-list text and read again."""
    from arcweave.sources.edge_list import read_edge_list, write_edge_list

    path = Scratch(spark, "edge-list").path("text")
    write_edge_list(sets.part_chain(spark, sf_dir), path)
    return read_edge_list(spark, path, weighted=True)


@_query(f"WITH {CHAIN} SELECT src, dst, min(value) AS value FROM chain WHERE src <> dst GROUP BY src, dst")
def saved_graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The de-duplicated chain saved and restored."""
    from arcweave.sources.saved import restore, save

    path = Scratch(spark, "saved").path("network")
    save(_chain(spark, sf_dir, Layout.DEDUPLICATED), path)
    return restore(spark, path).edges


@_query(f"""WITH {CHAIN}, w AS (SELECT max(greatest(src, dst)) + 1 AS n FROM chain),
old AS MATERIALIZED (SELECT src, dst, min(value) AS value FROM (SELECT src, dst, value FROM chain UNION ALL SELECT dst, src, value FROM chain) WHERE src <> dst GROUP BY 1, 2),
new AS (SELECT least(src, t) AS a, greatest(src, t) AS b, min(value) + 100 AS value FROM (SELECT src, (dst + 7) % n AS t, value FROM chain, w WHERE value >= 45) GROUP BY 1, 2),
added AS MATERIALIZED (SELECT a, b, value FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.src = a AND old.dst = b))
SELECT src, dst, value FROM old UNION ALL SELECT a, b, value FROM added UNION ALL SELECT b, a, value FROM added WHERE a <> b""")
def saved_after_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An undirected de-duplicated network that got edges, some known and some self-loops, saved and restored."""
    from arcweave.sources.saved import restore, save

    network = _chain(spark, sf_dir, Layout.DEDUPLICATED, Graph)
    moved = F.pmod(F.col("dst") + 7, F.lit(network.node_count))
    new = sets.part_chain(spark, sf_dir).where("value >= 45").select("src", moved.alias("dst"), (F.col("value") + 100).alias("value"))
    path = Scratch(spark, "saved").path("network")
    save(mutation.add_edges(network, new), path)
    return restore(spark, path).stored_edges()


@_query(f"""WITH {CUSTOMER_SUPPLIER}, {PARTY_LABELS}, b AS (SELECT src FROM cs UNION ALL SELECT dst FROM cs)
SELECT id, label, count(b.src) AS declared_degree FROM labels_of LEFT JOIN b ON b.src = id GROUP BY id, label""")
def labelled_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of customers and suppliers, written as labelled text and read again."""
    return _labelled_text(spark, sf_dir).nodes


@_query(f"WITH {CUSTOMER_SUPPLIER} SELECT src, dst FROM cs")
def labelled_text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their edges, from the same text."""
    return _labelled_text(spark, sf_dir).edges


def _labelled_text(spark: SparkSession, sf_dir: str):
    from arcweave.sources.labelled import read_labelled, write_labelled

    path = Scratch(spark, "labelled").path("text")
    write_labelled(_parties(spark, sf_dir, Graph), path)
    return read_labelled(spark, path)


@_query("""SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey + 25 AS BIGINT) AS dst,
CAST(n_regionkey AS BIGINT) AS src_label, CAST(n_regionkey + 10 AS BIGINT) AS dst_label FROM nation""")
def gdl_labelled_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and their regions written as a pattern, read as a labelled network."""
    from arcweave.sources.gdl import labelled_from_gdl

    nations = sorted((r["n_nationkey"], r["n_regionkey"]) for r in sets.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect())
    nodes = [f"(n{n}:L{r})" for n, r in nations] + [f"(r{r}:L{r + 10})" for r in sorted({r for _, r in nations})]
    network = labelled_from_gdl(spark, ", ".join(nodes + [f"(n{n})-->(r{r})" for n, r in nations]))
    labels = network.nodes
    found = network.edges.join(labels.select(F.col("id").alias("src"), F.col("value").alias("src_label")), "src")
    return found.join(labels.select(F.col("id").alias("dst"), F.col("value").alias("dst_label")), "dst").select("src", "dst", "src_label", "dst_label")


@_query(_labels_sql(WHOLE["customer_orders"][1], "SELECT id, component FROM comp"))
def registry_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components computed by the registry on a named network, from an action with a JSON body."""
    from arcweave.plans.registry import GraphRegistry

    registry = GraphRegistry(spark)
    registry.put("orders", DiGraph.from_edges(sets.customer_orders(spark, sf_dir)))
    said = registry.action("compute", '{"graph_name": "orders", "algorithm": {"Wcc": {"chunk_size": 16384}}, "property_key": "island"}')
    return registry.ticket(said["property_id"])
