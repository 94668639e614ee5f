"""The component queries see every edge of their tables; brute force in plain Python."""

import os
from collections import Counter, defaultdict

import pytest
import pyarrow.parquet as pq

from arcweave.operators.paths import UNREACHABLE
from arcweave.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def read(name, *columns):
    return list(zip(*(pq.read_table(f"{SF}/{name}.parquet", columns=[c])[c].to_pylist() for c in columns)))


def chained(rows):
    """Each row's last field to that of the next row of its group (the first field)."""
    out, before = [], {}
    for group, *_, node in sorted(rows):
        if group in before:
            out.append((before[group], node))
        before[group] = node
    return out


def edge_set(name):
    n = len(read("customer", "c_custkey"))
    buyer = dict(read("orders", "o_orderkey", "o_custkey"))
    return {
        "part_chain": lambda: chained([(o, line, p, s, x, p) for o, line, p, s, x in read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]),
        "customer_supplier": lambda: [(buyer[o], s + n) for o, s in read("lineitem", "l_orderkey", "l_suppkey")],
        "customer_orders": lambda: [(c, o + n) for o, c in buyer.items()],
        "handover": lambda: chained(read("events", "event_type", "ts", "event_id", "user_id")),
    }[name]()


@pytest.mark.parametrize("name", ["part_chain", "customer_supplier", "customer_orders", "handover"])
def test_components_of_the_whole_set(spark, name):
    edges = edge_set(name)
    parent = list(range(max(map(max, edges)) + 1))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    label = {i: find(i) for i in range(len(parent))}
    sizes = Counter(label.values())
    top = min(sizes, key=lambda c: (-sizes[c], c))

    def got(query):
        return sorted(tuple(r) for r in catalogue.QUERIES[f"{query}_{name}"](spark, SF).collect())

    assert got("wcc") == sorted(label.items())
    assert got("component_sizes") == sorted(sizes.items())
    assert got("largest_component") == [(top, sizes[top])]
    assert got("remaining_edges") == sorted(e for e in edges if label[e[0]] != top)


def test_unreachable_nodes_of_a_whole_table(spark):
    edges = edge_set("customer_supplier")
    near = defaultdict(lambda: UNREACHABLE, {0: 0.0})
    for (src, dst), (value,) in zip(edges, read("lineitem", "l_quantity"), strict=True):
        if src == 0:
            near[dst] = min(near[dst], value)
    found = {r["id"]: r["distance"] for r in catalogue.QUERIES["sssp_customer_supplier"](spark, SF).collect()}
    assert found == {i: near[i] for i in range(max(map(max, edges)) + 1)}
    assert UNREACHABLE in found.values() and len(set(found.values())) > 2
