"""Every link of the Jaccard join, counted for each row."""

import random
import re
from collections import Counter

from arcweave.llm import jaccard_join
from arcweave.llm.jaccard_join import JaccardJoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_links_inside_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SALTS", 3)
    rng = random.Random(8)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(100, 140))]
        for i in range(8):
            copy = list(base)
            for _ in range(rng.randrange(2)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((g * 10 + i, " ".join(copy)))
    rows += [(900, rows[0][1].upper()), (901, rows[0][1]), (902, None), (903, ""), (904, "alone here"), (None, rows[9][1])]
    texts = {t: shingle_set(t, 4) for _, t in rows if t}
    expected = Counter()
    for a, x in texts.items():
        for b, y in texts.items():
            if a != b and 100 * len(x & y) >= 85 * len(x | y):
                expected[a] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = JaccardJoin(4, 85, 100).n_links(docs)
    got = sorted(((r["id"], r["n"], r["n_links"]) for r in found.collect()), key=str)
    assert got == sorted(((i, len(shingle_set(t, 4)), expected[t] if t else 0) for i, t in rows), key=str)
    assert max(expected.values()) > 4
    assert JaccardJoin().n_links(docs.limit(0)).count() == 0
