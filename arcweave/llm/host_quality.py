"""Host-level quality rules with an empirical beta prior.

Each document is measured once.  Rule failures are summed per host (partial
aggregates, so a host may hold any share of the rows), each host's failure rate
is shrunk towards the corpus by a beta prior fitted to the hosts by the moments
of the beta-binomial distribution (what hosts vary beyond the chance of their
own numbers of documents), and a host whose shrunk rate of any rule exceeds ``reject_above``
rejects its documents.  Verdicts are joined back to the measured rows, not to
the texts.

Defined results: null, empty and blank texts have no words and fail the base
rule; a text of any length is measured whole; a rate of exactly ``reject_above``
does not reject; a null host is one host of its own; repeated rows count and come back as
often as they stand; an empty table gives an empty result; input columns travel
in the struct ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcweave.llm.text import WHITE, Words, bounded_batches, mix, text_bytes
from arcweave.operators.storage import Scratch

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
#: Rule name and the condition under which a document fails it.
HOST_RULES = {
    "base": BASE_FAILED,
    "symbols": "(10 * n_symbols > n_words)",
    "dup_lines": "(10 * n_dup_lines > 3 * n_lines)",
    "word_length": "(word_chars < 2 * n_words OR word_chars > 14 * n_words)",
}


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Per row, the words covered by 3-word windows that stand in the row at least twice."""
    rows = len(words.offsets) - 1
    if len(hashes) < 3:
        return np.zeros(rows, np.int64)
    at = np.flatnonzero(words.doc[:-2] == words.doc[2:])
    window = mix(hashes[at] + mix(hashes[at + 1] + mix(hashes[at + 2] + words.doc[at].astype(np.uint64))))
    _, which, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = at[counts[which] >= 2]
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[twice + j] = True
    return _per_row(covered, words.bounds)


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches):
    for batch in batches:
        out = {name: np.zeros(len(batch), np.int64) for name in MEASURES}
        for first, end, data, offsets in text_bytes(batch.column(1)):
            words = Words(data, offsets)
            part = slice(first, end)
            out["n_words"][part] = np.diff(words.bounds)
            out["word_chars"][part] = _per_row(((data & 0xC0) != 0x80) & ~WHITE[data], offsets)
            out["n_symbols"][part] = _per_row(_SYMBOL[data], offsets)
            out["n_repeat_words"][part] = _repeated_words(words, words.hashes(lower=False))
            raw = data.tobytes()
            for i in range(end - first):
                out["n_lines"][first + i], out["n_dup_lines"][first + i] = _line_counts(raw[offsets[i] : offsets[i + 1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(out[m]) for m in MEASURES)], ["row", "host", *MEASURES])


class HostQuality:
    """Measure documents, judge hosts, and give each document its verdict."""

    def __init__(self, reject_above: float = 0.5):
        self.reject_above = reject_above

    def measure(self, docs: DataFrame, text_col: str, host_col: str, carry: list[str]) -> DataFrame:
        bounded_batches(docs.sparkSession)
        packed = docs.select(F.struct(*(docs[c] for c in carry)).alias("row"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"))
        kind = packed.schema["row"].dataType.simpleString()
        return packed.mapInArrow(_measure, f"row {kind}, host string, " + ", ".join(f"{m} long" for m in MEASURES))

    def judge(self, measured: DataFrame) -> DataFrame:
        """``(host, host_docs, rate_<rule>..., host_ok)`` per host."""
        fails = [F.sum(F.expr(f"CAST({rule} AS LONG)")).alias(f"fails_{name}") for name, rule in HOST_RULES.items()]
        hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"), *fails)
        sums = [F.count("*").alias("hosts"), F.sum("host_docs").alias("docs"), F.sum(F.col("host_docs").cast("double") ** 2).alias("squares")]
        for name in HOST_RULES:
            x = F.col(f"fails_{name}")
            sums += [F.sum(x).alias(f"x_{name}"), F.sum(x * x / F.col("host_docs")).alias(f"q_{name}")]
        fitted = hosts.agg(*sums).first()
        ok = F.lit(True)
        rates = []
        for name in HOST_RULES:
            mean, weight = beta_prior(fitted["hosts"], fitted["docs"], fitted["squares"], fitted[f"x_{name}"], fitted[f"q_{name}"])
            rate = F.lit(mean) if weight is None else (F.col(f"fails_{name}") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
            rates.append(rate.alias(f"rate_{name}"))
            ok = ok & (rate <= self.reject_above)
        return hosts.select("host", "host_docs", *rates, ok.alias("host_ok"))

    def verdicts(self, docs: DataFrame, text_col: str = "text", host_col: str = "source", carry: list[str] | None = None) -> DataFrame:
        """``row``, the measures, the host's rates, ``base_failed`` and ``kept`` of every document.

        ``row`` holds the columns named by ``carry``, by default all but the text.
        """
        scratch = Scratch(docs.sparkSession, "quality")
        carry = [c for c in docs.columns if c != text_col] if carry is None else carry
        measured = scratch.keep(self.measure(docs, text_col, host_col, carry), "measured")
        hosts = scratch.keep(self.judge(measured), "hosts")
        joined = measured.alias("m").join(hosts.alias("h"), F.expr("m.host <=> h.host")).drop(hosts["host"])
        return joined.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def beta_prior(hosts: int, docs: int | None, squares: float | None, fails: int | None, scaled: float | None) -> tuple[float, float | None]:
    """Mean and weight (in documents) of the beta prior of a rule, from sums over hosts.

    ``squares`` is the sum of squared numbers of documents and ``scaled`` that of squared
    failures over documents.  The hosts' spread around the mean, weighted by documents,
    less what chance alone gives, is the correlation within hosts; the prior weighs as
    much as ``1 / correlation - 1`` documents.  Where hosts vary no more than by chance,
    or nothing can be said of it (one host, one document for each, all or none failing),
    the weight is None: every host has the mean.
    """
    if not docs:
        return 0.0, None
    mean = fails / docs
    free = docs - squares / docs - (hosts - 1)
    if mean in (0.0, 1.0) or free <= 0:
        return mean, None
    spread = scaled - fails * fails / docs
    correlation = (spread - mean * (1 - mean) * (hosts - 1)) / (mean * (1 - mean) * free)
    if correlation <= 0:
        return mean, None
    return mean, max(1 / correlation - 1, 0.0)
