"""Decontamination of documents shorter than an item, and of items shorter than a shingle."""

import pickle
import random
import re
from collections import Counter

import numpy as np

from arcweave.llm import decontaminate
from arcweave.llm.decontaminate import Decontaminator, ItemIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(w, k):
    return Counter([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])


def brute(rows, items, k, least):
    """{(document, item): (best similarity, its first window, words)} over all windows."""
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        for item, text in items:
            v = WORD.findall((text or "").lower())
            n = min(len(v), len(w))
            want = grams(v, k)
            for s in range(len(w) - n + 1) if n else []:
                have = grams(w[s : s + n], k)
                shared = sum((want & have).values())
                similarity = shared / (sum(want.values()) + sum(have.values()) - shared)
                if similarity >= max(least, out.get((i, item), (0,))[0] + 1e-12):
                    out[i, item] = (similarity, s, n)
    return out


def test_short_documents_and_short_items(spark):
    rng = random.Random(5)
    text = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    words = [text(rng.randrange(20, 60)) for _ in range(30)]
    items = [(i, " ".join(w)) for i, w in enumerate(words)]
    items += [(50, "three short words"), (51, "Three Short WORDS"), (52, "lone"), (53, "four words of text"), (54, "two words"), (55, " "), (None, "lone")]
    rows = [(i, " ".join(w[: len(w) - i % 6])) for i, w in enumerate(words)]
    rows += [(100 + i, " ".join(w[i % 4 :])) for i, w in enumerate(words)]
    rows += [(200, " ".join(words[0][:10])), (201, "not three short words"), (202, "three short words and three short words"), (203, "three short"), (204, "LONE"), (205, "a lone b lone c " + " ".join(words[3])), (206, None), (207, "two words four words of text"), (208, "three short x words"), (209, "lone\ntwo\nwords")]
    expected = brute(rows, items, 5, 0.8)
    assert len({d for d, i in expected if i is not None and i < 30 and d < 200}) == 60 and (201, 50) in expected
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 9):
        found = Decontaminator(block_items=block).match(docs, table).collect()
        got = [((r["row"]["doc_id"], m["item_id"]), (m["similarity"], m["start_word"], m["n_words"])) for r in found for m in r["matches"]]
        assert len(got) == len(dict(got)) == len(expected) and dict(got) == expected
        assert len(found) == len(rows)


def test_the_queries_look_into_short_windows(spark, tmp_path):
    import corpus_pipeline
    from arcweave.llm import queries

    items = [(1, "two words"), (2, " ".join(f"w{i}" for i in range(40)))]
    rows = [(1, "these two words count"), (2, " ".join(f"w{i}" for i in range(37))), (3, "clean")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op7_decontamination(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"]) for r in found} == {(1, 1): (1, 2), (2, 2): (0, 37)}
    left = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r["doc_id"] for r in left.collect()] == [3]


def test_index_takes_less_than_a_kilobyte_an_item():
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(rng.randrange(15, 60)))) for i in range(5000)]
    index = ItemIndex(items, 5, 19)
    assert (index.nbytes - index.coarse.nbytes) / len(items) < 1024
    assert len(pickle.dumps(index)) < 1.2 * index.nbytes


def test_both_ways_of_looking_up_block_values_agree(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(4))
    index = ItemIndex([(0, "a b c d e f")], 5, 11)
    values = np.unique(rng.integers(0, 2**16, 3000).astype(np.uint16))
    probes = np.unique(rng.integers(0, 2**16, 50).astype(np.uint16))
    expected = {(i, j) for i, p in enumerate(probes.tolist()) for j, v in enumerate(values.tolist()) if (p ^ v).bit_count() <= 2}
    for pairs in (1 << 21, 500):
        monkeypatch.setattr(decontaminate, "_PAIRS", pairs)
        for size in (3000, 100):
            found = set(zip(*(x.tolist() for x in index._near_values(probes, values[:size])), strict=True))
            assert found == {(i, j) for i, j in expected if j < size}


def test_both_ways_of_finding_candidates_agree(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(6))
    index = ItemIndex([(i, " ".join(f"t{i % 50}_{j}" for j in range(20))) for i in range(200)], 5, 19)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64)
    prints[:200] = index.prints ^ np.uint64(0x8100000000400101)
    found = []
    for few in (1 << 20, 0):
        monkeypatch.setattr(decontaminate, "_FEW_PAIRS", few)
        found.append(set(zip(*(x.tolist() for x in index.candidates(20, prints)), strict=True)))
    exact = {(w, i) for w in range(300) for i in range(200) if (int(prints[w]) ^ int(index.prints[i])).bit_count() <= 19}
    assert found[0] == found[1] == exact
