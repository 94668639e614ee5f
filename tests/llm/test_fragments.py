"""Fragments are ranges of the global order; their partial overlaps add up."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from arcweave.llm import jaccard_join
from arcweave.llm.jaccard_join import FRAGMENTS, JaccardJoin, cuts_of, partial_overlaps
from arcweave.operators.storage import Scratch


def test_cuts():
    assert cuts_of([(0, 10), (1, 10), (2, 10), (3, 10)], 4) == [1, 2, 3]
    assert cuts_of([(5, 100)], 4) == [] and cuts_of([], 4) == []
    cuts = cuts_of([(c, 1 + c % 3) for c in range(200)], 4)
    assert len(cuts) == 3 and cuts == sorted(cuts)


def test_partial_overlaps_of_ranges(spark):
    rng = random.Random(8)
    held = {c: sorted({rng.randrange(-(2**63), 2**63) for _ in range(30)} | {rng.choice(range(-40, 40)) * 2**57 for _ in range(40)}) for c in range(25)}
    tokens = spark.createDataFrame([(c, t) for c, toks in held.items() for t in toks], "cls long, tok long")
    sizes = spark.createDataFrame([(c, len(t)) for c, t in held.items()], "cls long, n long")
    ordered, segments = JaccardJoin()._segments(tokens, sizes, Scratch(spark, "test"))
    order = {t: (g["level"], i) for r in ordered.collect() for i, g in enumerate(r["grams"]) for t in [g["tok"]]}
    spans = defaultdict(list)
    for r in segments.collect():
        spans[r["frag"]] += [(order[t][0], t) for t in r["toks"]]
    assert 1 < len(spans) <= FRAGMENTS
    for f in sorted(spans)[1:]:
        assert max(spans[f - 1]) < min(spans[f])
    pairs = [(a, b) for a in held for b in held if a < b]
    found = partial_overlaps(spark.createDataFrame([(a, b, 1, 1) for a, b in pairs], "a long, b long, na long, nb long"), segments)
    assert found.groupBy("a", "b", "frag").count().where("count > 1").count() == 0
    summed = {(r["a"], r["b"]): r["s"] for r in found.groupBy("a", "b").agg(F.sum("partial").alias("s")).collect()}
    assert {p: summed.get(p, 0) for p in pairs} == {(a, b): len(set(held[a]) & set(held[b])) for a, b in pairs}


def test_classes_that_collide_are_hashed_anew(spark, monkeypatch):
    true = jaccard_join._class_of

    def narrow(k, seed):
        def run(batches):
            for batch in jaccard_join_rows(k, seed)(batches):
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                if seed == 7:
                    columns["cls"] = pa.array([1] * len(batch), pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

        return run

    import pyarrow as pa

    jaccard_join_rows = jaccard_join._class_rows
    monkeypatch.setattr(jaccard_join, "_class_rows", narrow)
    rows = [(1, "a b c d e f g h"), (2, "q w e r t y u i"), (3, "a b c d e f g h")]
    found = JaccardJoin().components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["id"], r["component"]) for r in found.collect()) == [(1, 1), (2, 2), (3, 1)] and true is jaccard_join._class_of


def test_a_very_long_text(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(90_000)}" for _ in range(120_000)]
    near = list(words)
    near[500] = "changed"
    rows = [(2, " ".join(words)), (1, " ".join(near)), (3, " ".join(words[:60_000]))]
    found = JaccardJoin().components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["id"], r["component"]) for r in found.collect()) == [(1, 1), (2, 1), (3, 3)]
