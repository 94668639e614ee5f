"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no vocabulary piece can cross, the distinct words of a
chunk are merged together as flat numpy symbol arrays, and ids are gathered back
per text.  One round finds the lowest pair rank of every word, merges all its
leftmost non-overlapping occurrences at once and compacts; it ends when no pair
is left.  Where a merge forms a pair that the library would take first (a rank
not above the one being merged), that word merges one occurrence in the round.

A word of more than ``LONG_WORD`` characters is cut further: no merge crosses a
place over which no vocabulary piece that stands in the word reaches, so the parts
on both sides are words of their own.  Text without spaces, however long, becomes
short words that are merged together.

Defined results: null or empty text encodes to no ids and decodes to the empty
string; any other white space, control strings such as ``<s>`` and unknown
characters are ordinary text (byte pieces where the vocabulary lacks them).  As
in the library, U+2581 in a text decodes to a space.  Rows are independent:
repeated rows repeat, an empty table stays empty, other columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcweave.llm.text import bounded_batches, mix

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NO_PAIR = np.iinfo(np.int64).max
_CODE_POINTS = 0x110000
#: Distinct words kept between chunks of one task.
CACHE_WORDS = 250_000
_CHUNK_CHARS = 1 << 19
#: Characters from which a word is searched for places that no piece crosses.
LONG_WORD = 48
_BASE = np.uint64(0xD1342543DE82EF95)
_BLOCK_CHARS = 1 << 18


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class SentencePieceCodec:
    """Encoder and decoder for a BPE model file with byte fallback."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _fields(model):
            if number == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry.get(1, b"").decode())
                scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
                kinds.append(entry.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("a BPE model with byte fallback is needed")
        if normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only identity normalisation that keeps and escapes white space is supported")
        if {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.size = len(self.pieces)
        self._prepare(np.array(scores), kinds, trainer.get(44, " ⁇ ".encode()))

    @classmethod
    def from_file(cls, path: str) -> SentencePieceCodec:
        with open(path, "rb") as f:
            return cls(f.read())

    def _prepare(self, scores: np.ndarray, kinds: list[int], unknown_surface: bytes) -> None:
        normal = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        #: Symbol of each code point: its piece id, or a number above all ids.
        self.first_symbol = np.arange(_CODE_POINTS, dtype=np.int64) + self.size
        for piece, i in normal.items():
            if len(piece) == 1:
                self.first_symbol[ord(piece)] = i
        self.radix = self.size + _CODE_POINTS
        _, rank = np.unique(-scores, return_inverse=True)
        keys, made, ranks = [], [], []
        symbol = lambda s: int(self.first_symbol[ord(s)]) if len(s) == 1 else normal.get(s)
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.radix + right)
                    made.append(i)
                    ranks.append(rank[i])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.made, self.ranks = np.array(made, np.int64)[order], np.array(ranks, np.int64)[order]
        byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        self.byte_ids = np.array([byte_id[b] for b in range(256)], np.int64)
        surface = {UNKNOWN: lambda p: unknown_surface, CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        shown = [surface.get(k, lambda p: p.replace(SPACE, " ").encode())(p) for p, k in zip(self.pieces, kinds, strict=True)]
        self.shown_size = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.leads_space = np.array([p.startswith(SPACE) for p in self.pieces])
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.is_control = np.array([k == CONTROL for k in kinds])
        joined = [p for p in normal if len(p) > 1]
        if any(b == SPACE and a != SPACE for p in joined for a, b in zip(p, p[1:], strict=False)):
            self.cut = re.compile(r"(?s).+")
        else:
            # No piece holds a space mark behind another character, so a word ends there.
            alone = "".join(c for c in "\n\r\t" if not any(c in p for p in joined))
            rest = rf"[^{SPACE}{re.escape(alone)}]"
            self.cut = re.compile(rf"(?s){SPACE}*{rest}+|{SPACE}+|[{re.escape(alone)}]+" if alone else rf"(?s){SPACE}*{rest}+|{SPACE}+")
        by_size: dict[int, list[str]] = {}
        for piece in joined:
            by_size.setdefault(len(piece), []).append(piece)
        self.reach = max(by_size, default=1)
        self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(_BLOCK_CHARS + 2 * self.reach, _BASE))])
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        self.inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(self.powers) - 1, inverse))])
        #: Number of characters to the sorted hashes of the pieces that have as many.
        self.piece_hashes = {n: np.unique(self._hash_rows("".join(pieces), n)) for n, pieces in by_size.items()}
        self.cache: dict[str, int] = {}
        self._forget()

    def _hash_rows(self, text: str, size: int) -> np.ndarray:
        """Hashes of the consecutive runs of ``size`` characters."""
        values = mix(_points(text).astype(np.uint64) + np.uint64(1)).reshape(-1, size)
        return mix((values * self.powers[:size]).sum(1, dtype=np.uint64))

    def _hashes(self, points: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` characters from each place; equal characters have equal hashes."""
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * self.powers[: len(points)], out=total[1:])
        return mix((total[size:] - total[:-size]) * self.inverses[: len(total) - size])

    def _forget(self) -> None:
        """Start an empty cache: each word's place in flat arrays of ids."""
        self.cache.clear()
        self.cached_ids = np.zeros(0, np.int32)
        self.cached_bounds = np.zeros(1, np.int64)

    # ---- encoding -------------------------------------------------------

    def parts_of(self, word: str) -> list[str]:
        """The word cut where no piece that stands in it crosses."""
        points, cuts = _points(word), [np.zeros(1, np.int64)]
        for first in range(0, len(points), _BLOCK_CHARS):
            # Pieces that cross a place of this block begin and end within reach of it.
            low, high = max(0, first - self.reach), min(len(points), first + _BLOCK_CHARS + self.reach)
            some = points[low:high]
            crossed = np.zeros(len(some) + 1, np.int64)
            for size, keys in self.piece_hashes.items():
                if size > len(some):
                    continue
                found = self._hashes(some, size)
                begin = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found)
                crossed[begin + 1] += 1
                crossed[begin + size] -= 1
            free = np.flatnonzero(np.cumsum(crossed) == 0) + low
            cuts.append(free[(free > first) & (free <= min(first + _BLOCK_CHARS, len(points) - 1))])
        bounds = np.append(np.concatenate(cuts), len(points)).tolist()
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _pair_ranks(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and table index of the pair starting at each symbol."""
        rank, index = np.full(len(symbols), _NO_PAIR), np.zeros(len(symbols), np.int64)
        if len(symbols) < 2:
            return rank, index
        inside = np.flatnonzero((word[:-1] == word[1:]) & (symbols[:-1] < self.radix) & (symbols[1:] < self.radix))
        key = symbols[inside] * self.radix + symbols[inside + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        rank[inside[hit]], index[inside[hit]] = self.ranks[at[hit]], at[hit]
        return rank, index

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and each word's bounds among them."""
        symbols = self.first_symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank, index = self._pair_ranks(symbols, word)
        done_symbols, done_words = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            best_of = np.minimum.reduceat(rank, starts)
            best = np.repeat(best_of, sizes)
            over = best == _NO_PAIR
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                symbols, word, rank, index = symbols[~over], word[~over], rank[~over], index[~over]
                continue
            wanted = np.flatnonzero(rank == best)
            # Overlapping occurrences are neighbours: every second one from the left stays.
            head = np.concatenate([[True], (wanted[1:] != wanted[:-1] + 1) | (word[wanted[1:]] != word[wanted[:-1]])])
            run_start = np.maximum.accumulate(np.where(head, np.arange(len(wanted)), 0))
            taken = wanted[(np.arange(len(wanted)) - run_start) % 2 == 0]
            merged = self._merged(symbols, word, index, taken)
            first = np.concatenate([[True], word[taken[1:]] != word[taken[:-1]]])
            if not first.all():
                limit = np.zeros(word[-1] + 1, np.int64)
                limit[word[starts]] = best_of
                # Merging from the left, a new symbol meets its left neighbour as merged
                # and its right neighbour as it was; both pairs must rank behind.
                touched = np.flatnonzero(merged[4] | np.append(merged[4][1:], False))
                early = merged[1][touched[merged[2][touched] <= limit[merged[1][touched]]]]
                inner = taken[taken + 2 < len(symbols)]
                inner = inner[word[inner + 2] == word[inner]]
                right = np.stack([self.made[index[inner]], symbols[inner + 2]], 1).ravel()
                right_rank = self._pair_ranks(right, np.repeat(np.arange(len(inner)), 2))[0][::2]
                early = np.concatenate([early, word[inner[right_rank <= limit[word[inner]]]]])
                if len(early):
                    single = np.zeros(len(limit), bool)
                    single[early] = True
                    taken = taken[first | ~single[word[taken]]]
                    merged = self._merged(symbols, word, index, taken)
            symbols, word, rank, index, _ = merged
        if not done_words:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return self._with_bytes(symbols[order], word[order], len(words))

    def _merged(self, symbols, word, index, taken):
        """Arrays after merging at ``taken``, with a mask of the merged symbols."""
        symbols = symbols.copy()
        symbols[taken] = self.made[index[taken]]
        is_new = np.zeros(len(symbols), bool)
        is_new[taken] = True
        keep = np.ones(len(symbols), bool)
        keep[taken + 1] = False
        symbols, word, is_new = symbols[keep], word[keep], is_new[keep]
        return (symbols, word, *self._pair_ranks(symbols, word), is_new)

    def _with_bytes(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters that are no piece by their byte pieces."""
        unknown = symbols >= self.size
        if unknown.any():
            point = symbols - self.size
            width = np.where(unknown, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
            raw = np.frombuffer("".join(map(chr, point[unknown])).encode(), np.uint8)
            out = np.repeat(symbols, width)
            out[np.repeat(unknown, width)] = self.byte_ids[raw]
            symbols, word = out, np.repeat(word, width)
        return symbols, np.searchsorted(word, np.arange(n + 1))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's bounds among them."""
        flat, counts = [], []
        for text in texts:
            marked = (text or "").replace(" ", SPACE)
            words = self.cut.findall(SPACE + marked if self.dummy_prefix else marked) if marked else []
            if max(map(len, words), default=0) > LONG_WORD:
                words = [part for word in words for part in (self.parts_of(word) if len(word) > LONG_WORD else (word,))]
            flat += words
            counts.append(len(words))
        unseen = set(flat).difference(self.cache)
        if unseen and len(self.cache) + len(unseen) > CACHE_WORDS:
            self._forget()
            unseen = set(flat)
        if unseen:
            unseen = list(unseen)
            ids, bounds = self.merge_words(unseen)
            self.cache.update(zip(unseen, range(len(self.cache), len(self.cache) + len(unseen)), strict=True))
            self.cached_bounds = np.concatenate([self.cached_bounds, self.cached_bounds[-1] + bounds[1:]])
            self.cached_ids = np.concatenate([self.cached_ids, ids.astype(np.int32)])
        at = np.fromiter(map(self.cache.__getitem__, flat), np.int64, len(flat))
        start, size = self.cached_bounds[at], self.cached_bounds[at + 1] - self.cached_bounds[at]
        ends = np.cumsum(size)
        out = self.cached_ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
        return out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])]

    # ---- decoding -------------------------------------------------------

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        size = self.shown_size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.shown_at[ids] - (ends - size), size)
        raw = self.shown[at].tobytes()
        place = np.concatenate([[0], ends])[bounds]
        out = []
        for i in range(len(bounds) - 1):
            lo, hi = bounds[i], bounds[i + 1]
            while lo < hi and self.is_control[ids[lo]]:
                lo += 1
            skip = int(self.dummy_prefix and lo < hi and self.leads_space[ids[lo]])
            part = raw[place[i] + skip : place[i + 1]]
            try:
                if self.is_control[ids[lo:hi]].any():
                    out.append(self._decode_broken(ids[lo:hi], skip))
                else:
                    out.append(part.decode())
            except UnicodeDecodeError:
                out.append(self._decode_broken(ids[lo:hi], skip))
        return out

    def _decode_broken(self, ids: np.ndarray, skip: int) -> str:
        """Decode where byte pieces form no character: each such byte is U+FFFD."""
        out, at = [], 0
        show = lambda i: self.shown[self.shown_at[i] : self.shown_at[i] + self.shown_size[i]].tobytes()
        while at < len(ids):
            if not self.is_byte[ids[at]]:
                out.append(show(ids[at]).decode())
                at += 1
                continue
            end = at
            while end < len(ids) and self.is_byte[ids[end]]:
                end += 1
            run = b"".join(show(i) for i in ids[at:end])
            while run:
                for width in (1, 2, 3, 4):
                    try:
                        out.append(run[:width].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    width = 1
                run = run[width:]
            at = end
        return "".join(out)[skip:]


_codecs: dict[bytes, SentencePieceCodec] = {}


def _codec_of(model: bytes) -> SentencePieceCodec:
    """The codec of the model that this worker used last, or a new one."""
    if model not in _codecs:
        _codecs.clear()
        _codecs[model] = SentencePieceCodec(model)
    return _codecs[model]


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` for every row.

    The model file is read on the driver and travels with the task (its size is
    that of the vocabulary and does not depend on the data).
    """
    bounded_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        codec = _codec_of(model)
        for batch in batches:
            texts, held = [], 0
            done = 0
            column = batch.column(1)
            for i in range(len(batch)):
                texts.append(column[i].as_py())
                held += len(texts[-1] or "")
                if held >= _CHUNK_CHARS or i == len(batch) - 1:
                    ids, bounds = codec.encode_batch(texts)
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                    decoded = pa.array(codec.decode_batch(ids, bounds), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), lists, decoded], ["id", "ids", "decoded"])
                    done, texts, held = i + 1, [], 0

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string")
