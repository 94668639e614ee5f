"""The store of line runs: its invariant, its plan, and opening it again."""

import random

import pytest
from pyspark.sql import functions as F

from arcweave.llm.line_dedup import LineDedup, LineRuns
from arcweave.operators.storage import Scratch


def batches_of(seed, n):
    rng = random.Random(seed)
    return [[(100 * b + d, 0, key) for d in range(30) for key in rng.sample(range(60), 5)] for b in range(n)]


def expected_totals(batches):
    found = {}
    for doc, _, key in (x for batch in batches for x in batch):
        docs = found.setdefault(key, set())
        docs.add(doc)
    return {k: (len(d), max(d)) for k, d in found.items()}


def totals(runs):
    rows = runs.totals().collect()
    assert len({r["h2"] for r in rows}) == len(rows)
    return {r["h2"]: (r["n_docs"], r["last_doc"]) for r in rows}


@pytest.fixture
def path(spark):
    return Scratch(spark, "runs").path("store")


def test_runs_hold_each_key_once_and_open_again(spark, path):
    batches = batches_of(5, 6)
    runs = LineRuns(spark, path, fanout=2)
    for at, batch in enumerate(batches):
        runs.add(spark.createDataFrame(batch, "doc long, h1 long, h2 long"))
        assert totals(runs) == expected_totals(batches[: at + 1])
        held = [r["h2"] for run in runs.runs("keys") for r in runs.table(run).collect()]
        assert len(held) == len(set(held))
        assert all(len(level) < 2 for kind in runs.levels for level in runs.levels[kind])
        for run in runs.runs("keys") + runs.runs("updates"):
            spark.sql(f"DROP TABLE {runs._name(run)}")
        runs = LineRuns.open(spark, path)
    assert totals(runs) == expected_totals(batches)


def test_the_anti_join_decides(spark, path):
    class Blind(LineRuns):
        def fresh(self, batch):
            return batch

    batches = batches_of(6, 2)
    runs = Blind(spark, path, fanout=9)
    for batch in batches:
        runs.add(spark.createDataFrame(batch, "doc long, h1 long, h2 long"))
    assert runs.totals().count() > len(expected_totals(batches))


def test_a_batch_shuffles_no_run(spark, path):
    runs = LineRuns(spark, path, fanout=9)
    for batch in batches_of(7, 2):
        runs.add(spark.createDataFrame(batch, "doc long, h1 long, h2 long"))
    batch = runs.table(runs.runs("keys")[0])
    plan = runs.fresh(batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    assert "Exchange" not in runs._merged(runs.runs("keys"))._jdf.queryExecution().executedPlan().toString()


def test_rows_without_id_gather_only_their_own_lines(spark):
    line = "a line of more than forty code points, number {} of them all"
    rows = [(None, "\n".join(line.format(j) for j in (i, i + 1))) for i in range(40)] + [(i, "\n".join(line.format(j) for j in range(41))) for i in range(5)]
    rows.append((9, " " + "x" * 300_000 + "\n" + line.format(0)))
    found = LineDedup().apply(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["row"]["doc_id"], r["row"]["text"]): (r["n_dropped"], r["kept"]) for r in found.collect()}
    for doc, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if x[0] == " " or doc == 9 or (doc == 4 and x != line.format(0))]
        assert got[doc, text] == (len(lines) - len(kept), "\n".join(kept))
    assert found.select(F.sum("n_lines")).first()[0] == sum(t.count("\n") + 1 for _, t in rows)
