"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained on ordinary text.  The other is trained on those spans
of toxic text that toxic documents hold significantly more often, and is laid
over the ordinary one, so that both know the language equally well.  A window
that compresses shorter with the toxic dictionary than with the ordinary one
speaks toxic text; a document's window gains are turned into a probability by a
logistic calibration, fitted on the gains that each third of the labelled
documents has by dictionaries of the other two.

Learning uses at most ``max_rows`` labelled documents of each class (those with
the smallest hash of their id), and of a text longer than ``max_chunks`` chunks of
512 characters as many chunks, evenly spread over the whole of it, so it is bounded
at any corpus size and no labelled text is passed over.  Scoring reads every text
whole, window by window.

Defined results: null and empty texts get the score of a text without any gain;
rows repeat with equal scores; an empty table gives an empty result; labels that
are null are ignored; only the two named columns are read.  Without labels of both
classes, or without words that tell them apart, every text gets the share of toxic
labels (0 if none), and a warning is logged.  Where zstandard finds too few samples
to train on, the samples' last bytes are the dictionary, and a warning is logged.
"""

from __future__ import annotations

import logging
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from arcweave.llm.text import bounded_batches

log = logging.getLogger(__name__)
_TRIM = b".,;:!?\"'()[]{}|%*#&$<>"
WINDOW, STRIDE = 64, 48
_CHUNK = 512
#: Stands at the end of both dictionaries and before every window, so that each
#: frame holds a compressed block: zstandard stores tiny blocks that hardly shrink
#: as they are, which would hide what the window itself gains.
_ANCHOR = bytes(range(128, 192))
_ORDINARY_BYTES, _TOXIC_BYTES = 32_768, 2_048
#: Bytes saved that a window must reach to be counted, from likely noise to plain.
GAIN_LEVELS = (2, 4, 6)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3; the remainder 1 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def _lower(text: str | None) -> bytes:
    return (text or "").encode().lower()


def _words(data: bytes) -> list[bytes]:
    return [w for x in data.split() if (w := x.strip(_TRIM))]


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionary contents and calibration; small and independent of the corpus."""

    ordinary: bytes
    toxic: bytes
    usual: tuple[float, ...]
    weights: tuple[float, ...]
    base: float

    def scorer(self):
        """A function from lower-cased bytes to a probability."""
        if not self.toxic:
            return lambda data: self.base
        packers = [_packer(self.ordinary), _packer(self.ordinary + self.toxic)]
        weights = np.array(self.weights)

        def score(data: bytes) -> float:
            z = float(weights @ _features(_gains(data, *packers), self.usual))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _packer(content: bytes):
    params = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    shared = zstandard.ZstdCompressionDict(content + _ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=shared).compress


def _gains(data: bytes, ordinary, toxic) -> list[int]:
    """Bytes that the toxic dictionary saves in each overlapping window."""
    windows = [_ANCHOR + data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE)]
    return [len(ordinary(w)) - len(toxic(w)) for w in windows]


def _features(gains: list[int], usual: tuple[float, ...]) -> np.ndarray:
    """Intercept, and for each gain level how surprisingly many windows reach it.

    ``usual`` has the share of ordinary windows at each level.  The surprise is the
    signed root of the Poisson log-likelihood ratio of the count against it.
    """
    out = [1.0]
    for level, share in zip(GAIN_LEVELS, usual, strict=True):
        count, expected = sum(g >= level for g in gains), len(gains) * share
        ratio = (count * math.log(count / expected) if count else 0.0) - (count - expected)
        out.append(math.copysign(math.sqrt(max(ratio, 0.0)), count - expected))
    return np.array(out)


def _beginnings(word: bytes) -> set[bytes]:
    """The word's first 4 to 12 bytes: what an inflected or compound word starts with."""
    return {word[:k] for k in range(4, min(len(word), 12) + 1)}


def _telling_words(texts: list[tuple[bytes, int]], least: int, margin: float, z_least: float) -> set[bytes]:
    """Words of toxic texts with a beginning whose log-odds of standing in a toxic text exceed ``margin`` significantly."""
    counts = {0: Counter(), 1: Counter()}
    sizes = Counter()
    for data, label in texts:
        counts[label].update(set().union(*map(_beginnings, set(_words(data)))))
        sizes[label] += 1
    found = set()
    for start, a in counts[1].items():
        c = counts[0][start]
        cells = (a + 0.5, sizes[1] - a + 0.5, c + 0.5, sizes[0] - c + 0.5)
        log_odds = math.log(cells[0] / cells[1]) - math.log(cells[2] / cells[3])
        if a >= least and (log_odds - margin) / math.sqrt(sum(1 / x for x in cells)) > z_least:
            found.add(start)
    return {w for data, label in texts if label for w in set(_words(data)) if _beginnings(w) & found}


def _dictionary(size: int, samples: list[bytes], **options) -> bytes:
    """Content of a trained dictionary; where zstandard finds the samples too few, their last ``size`` bytes."""
    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except zstandard.ZstdError as refused:
        log.warning("a dictionary is %d bytes of %d samples as they are: %s", size, len(samples), refused)
        return b"".join(samples)[-size:]


def _dictionaries(rows: list[tuple[bytes, int]], least: int, margin: float, z_least: float) -> tuple[bytes, bytes] | None:
    """Ordinary and toxic dictionary contents; none where a class or telling words are missing."""
    telling = _telling_words(rows, least, margin, z_least) if {y for _, y in rows} == {0, 1} else set()
    if not telling:
        return None
    plain = [data[i : i + _CHUNK] for data, y in rows if not y for i in range(0, len(data), _CHUNK)]
    spans = [b" " + b" ".join(hit) + b" " for data, y in rows if y and (hit := [w for w in _words(data) if w in telling])]
    # The most frequent telling words also stand once at the end, nearest to the window.
    common = [w for w, _ in sorted(Counter(w for x in spans for w in set(x.split())).items(), key=lambda x: (x[1], x[0]))[-256:]]
    return _dictionary(_ORDINARY_BYTES, plain), _dictionary(_TOXIC_BYTES, spans, k=32, d=6) + b" " + b" ".join(common) + b" "


def train(texts: list[tuple[str | None, int]], least: int = 5, margin: float = 2.0, z_least: float = 2.5) -> ToxicityModel:
    """Fit the dictionaries on all labelled texts, and the calibration on gains that each third has by dictionaries of the others."""
    rows = [(_lower(t), y) for t, y in texts]
    share = sum(y for _, y in rows) / len(rows) if rows else 0.0
    gains: list[tuple[list[int], int]] = []
    learnt = _dictionaries(rows, least, margin, z_least)
    for third in range(3):
        others = learnt and _dictionaries([r for i, r in enumerate(rows) if i % 3 != third], least, margin, z_least)
        if not others:
            log.warning("no telling words among %d texts (%.3f toxic): every text gets that share as its score", len(rows), share)
            return ToxicityModel(b"", b"", (), (), share)
        packers = [_packer(others[0]), _packer(others[0] + others[1])]
        gains += [(_gains(data, *packers), y) for i, (data, y) in enumerate(rows) if i % 3 == third]
    plain_gains = np.concatenate([g for g, label in gains if not label])
    usual = tuple(float(((plain_gains >= level).sum() + 0.5) / (len(plain_gains) + 1)) for level in GAIN_LEVELS)
    x, y = np.array([_features(g, usual) for g, _ in gains]), np.array([label for _, label in gains], float)
    return ToxicityModel(*learnt, usual, tuple(_logistic(x, y)), share)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge on all weights but the intercept; no gain weight below 0."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    negative = (w < 0) & (np.arange(len(w)) > 0)
    if negative.any():
        kept = np.flatnonzero(~negative)
        w = np.zeros(len(w))
        w[kept] = _logistic(x[:, kept], y, ridge, rounds)
    return w


class ToxicityClassifier:
    """Fit on labelled documents, then score any table of texts."""

    def __init__(self, max_rows: int = 3000, max_chunks: int = 256):
        self.max_rows, self.max_chunks = max_rows, max_chunks
        self.model: ToxicityModel | None = None

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityClassifier:
        """Learn from labelled rows outside the held-out fold."""
        usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
        usable = usable.where(fold("id") != 1).groupBy("id").agg(F.max("label").alias("label"))
        picked = None
        for label in (0, 1):
            part = usable.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(self.max_rows)
            picked = part if picked is None else picked.unionByName(part)
        # At most 2 * max_rows small rows, whatever the size of the labels: they may be broadcast.
        texts = docs.select(F.col(id_col).cast("long").alias("id"), self._learnt_part(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
        texts = texts.join(F.broadcast(picked), "id")
        rows = texts.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").toArrow()
        self.model = train(list(zip(rows["text"].to_pylist(), rows["label"].to_pylist(), strict=True)))
        return self

    def _learnt_part(self, text: Column) -> Column:
        """The text, or evenly spread chunks of one that is too long to learn from whole."""
        starts = F.sequence(F.lit(0), F.lit(self.max_chunks - 1))
        at = lambda i: F.floor(i * (F.length(text) - _CHUNK) / (self.max_chunks - 1)).cast("int") + 1
        spread = F.array_join(F.transform(starts, lambda i: F.substring(text, at(i), F.lit(_CHUNK))), "\n")
        return F.when(F.length(text) <= self.max_chunks * _CHUNK, text).otherwise(spread)

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``(row, score)``; ``row`` holds every input column."""
        bounded_batches(docs.sparkSession)
        model = self.model

        def run(batches):
            score = model.scorer()
            for batch in batches:
                scores = [score(_lower(text.as_py())) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

        packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
        return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, score double")
