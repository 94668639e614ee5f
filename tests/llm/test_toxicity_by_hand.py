"""Scores computed again from a model's dictionaries, and what learning does at its edges."""

import logging
import math
import random

import numpy as np
import pytest
import zstandard

from arcweave.llm import toxicity
from arcweave.llm.toxicity import ToxicityClassifier, train

INSULTS = ["idiotic", "worthless", "pathetic", "disgusting"]


def labelled(seed, n, share=0.25):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(40, 120))]
        bad = rng.random() < share
        for _ in range(rng.randrange(3, 7) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((" ".join(words), int(bad)))
    return rows


def size_of(content, window):
    """Compressed bytes of one window by a dictionary, with compressors of its own."""
    dictionary = zstandard.ZstdCompressionDict(content + toxicity._ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    return len(zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary).compress(toxicity._ANCHOR + window))


def by_hand(model, text):
    data = (text or "").encode().lower()
    gains, at = [], 0
    while True:
        window = data[at : at + 64]
        gains.append(size_of(model.ordinary, window) - size_of(model.ordinary + model.toxic, window))
        at += 48
        if at >= len(data) - 16:
            break
    z = model.weights[0]
    for weight, level, share in zip(model.weights[1:], (2, 4, 6), model.usual):
        seen, expected = len([g for g in gains if g >= level]), share * len(gains)
        surprise = (seen * math.log(seen / expected) if seen else 0.0) + expected - seen
        z += weight * math.sqrt(max(surprise, 0.0)) * (1 if seen >= expected else -1)
    return 1 / (1 + math.exp(-z))


def test_scores_by_hand(spark):
    model = train(labelled(1, 400))
    classifier = ToxicityClassifier()
    classifier.model = model
    texts = [t for t, _ in labelled(2, 40)] + [None, "", "x", "short text", "y" * 64, "y" * 65, "z" * 200, " ".join(INSULTS * 5), "prose without end " * 20_000 + "idiotic"]
    found = classifier.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    scores = {r["row"]["doc_id"]: r["score"] for r in found.collect()}
    for i, text in enumerate(texts):
        assert scores[i] == pytest.approx(by_hand(model, text), abs=1e-9)
    assert scores[len(texts) - 2] > 0.9 > 0.3 > scores[40]


def test_calibration_is_the_most_likely_one():
    rng = np.random.Generator(np.random.PCG64(5))
    x = np.column_stack([np.ones(500), rng.normal(size=(500, 3))])
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ np.array([-1, 1.5, 0.7, 0.2]))))).astype(float)
    w = toxicity._logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.abs(x.T @ (y - p) - 0.1 * w * np.array([1e-5, 1, 1, 1])).max() < 1e-4


def test_long_labelled_texts_are_learnt_from(spark):
    rows = [(i, t + (" filler words of a long text" * 3000 if y else ""), y) for i, (t, y) in enumerate(labelled(3, 900))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert ToxicityClassifier().fit(docs, labels).model.toxic
    part = docs.select(ToxicityClassifier(max_chunks=4)._learnt_part(docs["text"]).alias("p"), "text").where("length(text) > 2048").first()
    assert len(part["p"]) == 4 * 512 + 3 and part["text"].startswith(part["p"][:512]) and part["text"].endswith(part["p"][-512:])


def test_nothing_to_learn(caplog):
    with caplog.at_level(logging.WARNING):
        for rows, share in (([], 0.0), ([("a", 0)] * 9, 0.0), ([("same words here", 1), ("same words here", 0)] * 30, 0.5)):
            model = train(rows)
            assert not model.toxic and model.scorer()(b"anything") == share
    assert caplog.text.count("every text gets that share") == 3
