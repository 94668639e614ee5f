"""Buckets of the Jaccard join that are cut into cells lose no link between groups."""

import random

from pyspark.sql import functions as F

from arcweave.llm import jaccard_join
from arcweave.llm.jaccard_join import JaccardJoin
from test_all_links import shingle_set


def drifting(rng, length, steps):
    """Texts of which each differs a little from the one before, so that only near ones are linked."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    for _ in range(steps):
        yield " ".join(words)
        words = list(words)
        words[rng.randrange(length - 12)] = f"new{rng.randrange(10**6)}"


def test_chains_in_cut_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SALTS", 8)
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 2)
    rng = random.Random(3)
    texts = [t for _ in range(3) for t in drifting(rng, 70, 25)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    sets = [shingle_set(t, 5) for t in texts]
    low = list(range(len(texts)))
    links = [(a, b) for a in low for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["id"]: r["component"] for r in JaccardJoin().components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(low))
    assert len(set(low)) < len(texts) / 5


def test_a_large_group_beside_few_others(spark):
    """Pairs between groups are all there, and come from about as many rows as there are members."""
    rows = [(1, c % 64, c, 100, 1, 0) for c in range(5000)] + [(1, c % 64, c, 100, 1, c) for c in range(5000, 5003)]
    placed = spark.createDataFrame(rows, "tok long, salt int, cls long, n long, pos long, grp long")
    pairs = JaccardJoin()._pairs(placed, cross=True)
    assert pairs.count() == pairs.distinct().count() == 3 * 5000 + 3
    assert pairs.where("a >= b").count() == 0 and pairs.agg(F.count_distinct("a")).first()[0] == 5002
