"""Benchmark decontamination by SimHash windows and exact verification.

A document window has as many words as a benchmark item; a document with fewer
words than an item is one window, compared with each longer item that could
still reach the threshold.  Windows that hold a
shingle of any item are fingerprinted with a 64-bit SimHash over weighted
shingles (the weight is the shingle's count; a window that shares no shingle
with any item has similarity 0).  Fingerprints of items of the same length are
found by multi-index hashing: both are cut into four blocks of 16 bits, and two
fingerprints within ``radius`` differ by at most ``radius // 4`` bits in some
block, so looking up every block value within that distance misses none.  The
index holds each item once per block, in the order of its block value; the
values near a window's are found on the window's side.  Candidates within the
radius are verified by the exact weighted Jaccard similarity of their shingle
counts.

Items come to the tasks in blocks of at most ``block_items``, one pass each.  An
item of 50 words takes less than 1 KB (about 20 MB for a full block, whatever the
number of items); the size of each block is logged.

Defined results: words are Unicode lower-cased; an item or window of fewer than
``k`` words is one shingle, so an item of fewer words is found wherever its words
stand in a row; null and blank items and texts match nothing; of equally similar
windows the first counts; a similarity of exactly ``least`` is a match; repeated
items match each under its own id (a null id stays null); repeated rows repeat
their matches; texts of any length are read whole, ``_SPAN`` windows at a time;
empty tables give empty results; input columns travel in ``row``.
"""

from __future__ import annotations

import logging
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcweave.llm.text import Words, bounded_batches, mix, shingles, text_bytes

log = logging.getLogger(__name__)
BLOCKS, BLOCK_BITS = 4, 16
_MATCH = "array<struct<item_id:long,similarity:double,start_word:long,n_words:long>>"
_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())]))
_SPAN = 4096
#: Pairs of a window (or block value) and an item (or mask) that are looked at together.
_PAIRS = 1 << 21
#: Pairs of windows and items of one length that are looked at as one matrix.
_FEW_PAIRS = 1 << 16


def simhash(columns: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 signed bit sums; a tie counts as a set bit."""
    return np.packbits(columns >= 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _signs(grams: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    bits = np.unpackbits(mix(grams + np.uint64(0x51ED270B7F4A7C15)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def near_masks(distance: int) -> np.ndarray:
    """All block differences of at most ``distance`` bits."""
    return np.array([sum(1 << b for b in bits) for d in range(distance + 1) for bits in combinations(range(BLOCK_BITS), d)], np.uint16)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts over the sum of the larger."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    shared = sum((x & y).values())
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 0.0


class ItemIndex:
    """Multi-index of the items of one block, by their number of words."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int, radius: int):
        self.k, self.radius = k, radius
        self.masks = near_masks(radius // BLOCKS)
        self.ids = [i for i, _ in items]
        texts = pa.array([(t or "").lower() for _, t in items], pa.large_string())
        grams: list[np.ndarray] = [np.zeros(0, np.uint64)]
        sizes, lengths = [], []
        #: Number of words to {window's shingle: items}, for items of fewer than k words.
        self.short: dict[int, dict[int, list[int]]] = {}
        for first, _, data, offsets in text_bytes(texts):
            words = Words(data, offsets)
            hashes = words.hashes()
            found, bounds = shingles(words, hashes, k)
            counts = np.diff(words.bounds)
            grams.append(found)
            sizes += np.diff(bounds).tolist()
            lengths += counts.tolist()
            for n in set(counts[(counts > 0) & (counts < k)].tolist()):
                whole, at = shingles(words, hashes, n)
                for i in np.flatnonzero(counts == n):
                    self.short.setdefault(n, {}).setdefault(int(whole[at[i]]), []).append(first + int(i))
        self.short_keys = {n: np.sort(np.array(list(held), np.uint64)) for n, held in self.short.items()}
        self.grams = np.concatenate(grams)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        lengths = np.array(lengths, np.int64)
        long = np.flatnonzero(lengths >= k)
        self.known = np.unique(np.concatenate([self.grams_of(i) for i in long])) if len(long) else np.zeros(0, np.uint64)
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.prints = np.zeros(len(lengths), np.uint64)
        for i in long:
            self.prints[i] = simhash(_signs(self.grams_of(i)).sum(0, dtype=np.int64)[None])[0]
        #: Number of words to, per block: distinct block values, where the items of each begin, these items, and
        #: the value of each item in the order of ``members``.
        self.by_length: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.members: dict[int, np.ndarray] = {}
        for length in np.unique(lengths[long]).tolist():
            members = np.flatnonzero(lengths == length).astype(np.int32)
            tables = []
            for block in range(BLOCKS):
                values = _block(self.prints[members], block)
                order = np.argsort(values, kind="stable")
                distinct, which, counts = np.unique(values, return_inverse=True, return_counts=True)
                starts = np.append(0, np.cumsum(counts)).astype(np.int32)
                tables.append((distinct, starts, members[order], which.astype(np.int32)))
            self.by_length[length] = tables
            self.members[length] = members

    def grams_of(self, item: int) -> np.ndarray:
        return self.grams[self.bounds[item] : self.bounds[item + 1]]

    @property
    def nbytes(self) -> int:
        """Bytes of the arrays, which is nearly all that is sent to the tasks."""
        tables = [a.nbytes for blocks in self.by_length.values() for table in blocks for a in table]
        short = sum(100 * len(held) for held in self.short.values())
        return sum(tables) + short + self.grams.nbytes + self.bounds.nbytes + self.known.nbytes + self.coarse.nbytes + self.prints.nbytes

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Which shingles stand in any item."""
        found = np.zeros(len(grams), bool)
        if len(self.known):
            maybe = np.flatnonzero(self.coarse[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
            found[maybe[self.known[at] == grams[maybe]]] = True
        return found

    def _near_values(self, probes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, value) pairs of sorted distinct block values within the block's distance."""
        distance = self.radius // BLOCKS
        masks = self.masks
        step = max(1, _PAIRS // max(1, min(len(values), len(masks))))
        rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first in range(0, len(probes), step):
            some = probes[first : first + step]
            if len(values) <= len(masks):
                row, column = np.nonzero(np.bitwise_count(some[:, None] ^ values[None]) <= distance)
            else:
                wanted = some[:, None] ^ masks[None]
                at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                row, mask = np.nonzero(values[at] == wanted)
                column = at[row, mask]
            rows.append(row + first)
            columns.append(column)
        return np.concatenate(rows), np.concatenate(columns)

    def candidates(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, each once."""
        tables = self.by_length[length]
        if len(prints) * len(tables[0][2]) <= _FEW_PAIRS:
            return self._few_candidates(length, prints)
        step = max(1, _PAIRS // len(tables[0][2]))
        pairs = [np.zeros(0, np.int64)]
        for first in range(0, len(prints), step):
            some = prints[first : first + step]
            for block, (values, starts, members, _) in enumerate(tables):
                probes, which = np.unique(_block(some, block), return_inverse=True)
                probe, value = self._near_values(probes, values)
                # From each probe to its items, then from each window to those of its probe.
                at = _spread(starts[value], starts[value + 1] - starts[value])
                listed = members[at]
                per_probe = np.bincount(np.repeat(probe, starts[value + 1] - starts[value]), minlength=len(probes))
                begin = np.cumsum(per_probe) - per_probe
                window = np.repeat(np.arange(len(some)), per_probe[which])
                item = listed[_spread(begin[which], per_probe[which])]
                near = np.bitwise_count(some[window] ^ self.prints[item]) <= self.radius
                pairs.append((window[near] + first) * len(self.ids) + item[near])
        found = np.unique(np.concatenate(pairs))
        return found // len(self.ids), found % len(self.ids)

    def _few_candidates(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for few windows and items: block values against block values at once."""
        members = self.members[length]
        met = np.zeros((len(prints), len(members)), bool)
        for block, (values, _, _, which) in enumerate(self.by_length[length]):
            met |= (np.bitwise_count(_block(prints, block)[:, None] ^ values[None]) <= self.radius // BLOCKS)[:, which]
        window, place = np.nonzero(met)
        item = members[place]
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
        return window[near], item[near]

    def matches(self, grams: np.ndarray, n_words: int, found: np.ndarray, least: float) -> list[dict]:
        """Best window of each item that a document (its shingles and their hits) contains."""
        best: dict[int, tuple[float, int, int]] = {}
        for length in self.by_length:
            width = length - self.k + 1
            if length > n_words:
                # The document is one window; at most all its shingles are shared.
                if n_words < self.k or len(grams) / width < least:
                    continue
                width = len(grams)
            edge = np.zeros(len(grams) + 1, np.int64)
            np.add.at(edge, np.maximum(found - width + 1, 0), 1)
            np.add.at(edge, found + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1])[: len(grams) - width + 1] > 0)
            for part in np.split(starts, np.flatnonzero(np.diff(starts // _SPAN)) + 1):
                if not len(part):
                    continue
                base = part[0]
                sums = np.zeros((part[-1] - base + width + 1, 64), np.int32)
                np.cumsum(_signs(grams[base : part[-1] + width]), axis=0, out=sums[1:])
                prints = simhash(sums[part - base + width] - sums[part - base])
                for w, item in zip(*self.candidates(length, prints), strict=True):
                    start = int(part[w])
                    similarity = weighted_jaccard(grams[start : start + width], self.grams_of(item))
                    if similarity >= least and (item not in best or similarity > best[item][0]):
                        best[item] = (similarity, start, min(length, n_words))
        return [{"item_id": self.ids[i], "similarity": s, "start_word": a, "n_words": n} for i, (s, a, n) in sorted(best.items())]

    def short_matches(self, words: Words, hashes: np.ndarray) -> list[tuple[int, dict]]:
        """(row, match) of items of fewer than k words: their first window."""
        out = []
        for n, keys in self.short_keys.items():
            grams, bounds = shingles(words, hashes, n)
            places = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)] == grams)
            rows = np.searchsorted(bounds, places, "right") - 1
            # A row of fewer words has one shingle, which says so and equals none of these.
            _, firsts = np.unique(np.stack([rows.astype(np.uint64), grams[places]]), axis=1, return_index=True)
            for row, place in zip(rows[firsts].tolist(), places[firsts].tolist(), strict=True):
                for item in self.short[n][int(grams[place])]:
                    out.append((row, {"item_id": self.ids[item], "similarity": 1.0, "start_word": place - int(bounds[row]), "n_words": n}))
        return out


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...``: ``counts[i]`` places from each start."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _block(prints: np.ndarray, block: int) -> np.ndarray:
    return ((prints >> np.uint64(BLOCK_BITS * block)) & np.uint64(0xFFFF)).astype(np.uint16)


class Decontaminator:
    """Find benchmark items in documents at weighted shingle similarity ``least``."""

    def __init__(self, k: int = 5, least: float = 0.8, radius: int = 19, block_items: int = 20_000):
        self.k, self.least, self.radius, self.block_items = k, least, radius, block_items

    def match(self, docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
        """``(row, matches)`` for every document; ``row`` holds every input column."""
        bounded_batches(docs.sparkSession)
        items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
        blocks = max(1, -(-items.count() // self.block_items))
        kind = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).schema["row"].dataType.simpleString()
        out = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.expr(f"CAST(array() AS {_MATCH})").alias("matches"))
        for block in range(blocks):
            rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").toArrow()
            index = ItemIndex(list(zip(rows["id"].to_pylist(), rows["text"].to_pylist(), strict=True)), self.k, self.radius)
            log.info("block %d of %d: %d items, %d bytes", block, blocks, len(index.ids), index.nbytes)
            shared = docs.sparkSession.sparkContext.broadcast(index)
            # The text goes to the workers beside its row, and does not come back.
            texts = out.select("row", F.col(f"row.{text_col}").cast("string").alias("text"), "matches")
            out = texts.mapInArrow(_match_rows(shared, self.k, self.least), f"row {kind}, matches {_MATCH}")
        return out


def _match_rows(shared, k: int, least: float):
    def run(batches):
        index = shared.value
        for batch in batches:
            before = batch.column(2).to_pylist()
            lowered = pa.array([(t.as_py() or "").lower() for t in batch.column(1)], pa.large_string())
            for first, _, data, offsets in text_bytes(lowered):
                words = Words(data, offsets)
                hashes = words.hashes()
                grams, bounds = shingles(words, hashes, k)
                found = np.flatnonzero(index.hits(grams))
                for i in np.unique(np.searchsorted(bounds, found, "right") - 1):
                    lo, hi = bounds[i], bounds[i + 1]
                    inside = found[(found >= lo) & (found < hi)] - lo
                    before[first + i] = (before[first + i] or []) + index.matches(grams[lo:hi], int(words.bounds[i + 1] - words.bounds[i]), inside, least)
                for i, match in index.short_matches(words, hashes):
                    before[first + i] = (before[first + i] or []) + [match]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, _MATCH_TYPE)], ["row", "matches"])

    return run
