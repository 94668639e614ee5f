"""Command line: time loading, algorithms and saving on a network file.

    python -m arcweave page-rank --path network.el --format edge-list --runs 3
"""

from __future__ import annotations

import argparse
import logging
import time

from arcweave.operators.model import DiGraph, FileFormat, Graph, InvalidIdType, Layout
from arcweave.operators.pagerank import PageRankConfig, page_rank
from arcweave.operators.paths import DeltaSteppingConfig, delta_stepping
from arcweave.operators.triangles import triangle_total
from arcweave.operators.wcc import component_ids
from arcweave.sources.saved import restore, save

log = logging.getLogger("arcweave")
_FORMATS = {"edge-list": FileFormat.EDGE_LIST, "graph500": FileFormat.GRAPH500}


def timed(what: str, runs: int, warmup: int, action) -> float:
    """Mean seconds of ``runs`` calls after ``warmup`` calls that do not count."""
    seconds = []
    for at in range(warmup + runs):
        began = time.perf_counter()
        action()
        took = time.perf_counter() - began
        log.info("%s %s %d took %.3f s", what, "run" if at >= warmup else "warm-up", at, took)
        if at >= warmup:
            seconds.append(took)
    mean = sum(seconds) / len(seconds)
    print(f"{what}: mean of {runs} runs {mean:.3f} s")
    return mean


def _all(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="arcweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("page-rank", "wcc", "sssp", "triangle-count", "loading", "serialize"):
        c = commands.add_parser(name)
        c.add_argument("-p", "--path", required=True)
        c.add_argument("-f", "--format", choices=_FORMATS, default="edge-list")
        c.add_argument("-g", "--network", choices=("csr", "adjacency-list"), default="csr")
        c.add_argument("--use-32-bit", action="store_true", help="fail where an id does not fit into 32 bits")
        c.add_argument("-r", "--runs", type=int, default=1)
        c.add_argument("-w", "--warmup-runs", type=int, default=5)
        if name == "page-rank":
            c.add_argument("--max-iterations", type=int, default=20)
            c.add_argument("--tolerance", type=float, default=1e-4)
            c.add_argument("--damping-factor", type=float, default=0.85)
        elif name == "sssp":
            c.add_argument("--start-node", type=int, required=True)
            c.add_argument("--delta", type=float, required=True)
        elif name == "triangle-count":
            c.add_argument("--relabel", action="store_true")
        elif name == "loading":
            c.add_argument("--undirected", action="store_true")
            c.add_argument("--weighted", action="store_true")
        elif name == "serialize":
            c.add_argument("-o", "--output", required=True)
            c.add_argument("--undirected", action="store_true")
    a = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO)

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("arcweave").getOrCreate()
    undirected = a.command == "triangle-count" or getattr(a, "undirected", False)
    weighted = a.command == "sssp" or getattr(a, "weighted", False)
    file_format = FileFormat.EDGE_LIST_WEIGHTED if weighted else _FORMATS[a.format]
    layout = Layout.DEDUPLICATED if a.command == "triangle-count" else Layout.SORTED

    def load():
        network = (Graph if undirected else DiGraph).load(spark, a.path, Layout.UNSORTED, file_format)
        if a.network == "adjacency-list":
            network = type(network)(network.edges, network.node_count, Layout.UNSORTED, network.nodes, True)
        if a.use_32_bit and network.node_count > 2**32:
            raise InvalidIdType(f"{network.node_count} nodes need ids of more than 32 bits")
        return network.with_layout(layout)

    if a.command == "loading":
        timed("loading", a.runs, a.warmup_runs, lambda: _all(load().stored_edges()))
        return
    network = load()
    if a.command == "page-rank":
        config = PageRankConfig(a.max_iterations, a.tolerance, a.damping_factor)
        timed("page-rank", a.runs, a.warmup_runs, lambda: _all(page_rank(network, config).scores))
    elif a.command == "wcc":
        timed("wcc", a.runs, a.warmup_runs, lambda: _all(component_ids(network)))
    elif a.command == "sssp":
        timed("sssp", a.runs, a.warmup_runs, lambda: _all(delta_stepping(network, DeltaSteppingConfig(a.start_node, a.delta)).distances))
    elif a.command == "triangle-count":
        network = network.make_degree_ordered() if a.relabel else network
        timed("triangle-count", a.runs, a.warmup_runs, lambda: triangle_total(network).first())
        print(f"triangles: {triangle_total(network).first()['triangles']}")
    else:
        save(network, a.output)
        back = restore(spark, a.output)
        if (back.node_count, back.edge_count) != (network.node_count, network.edge_count):
            raise SystemExit("the restored network differs")
        print(f"saved {back!r}")


if __name__ == "__main__":
    main()
