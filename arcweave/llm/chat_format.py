"""Chat formatting into prefix trees of shared turns.

Conversations are sorted by the chain of hashes of their turns, which is a
depth-first order of the tree that merges equal initial turns.  Streaming over a
sorted range, each turn that the previous conversation does not share is written
once; a pack is cut when it reaches ``pack_chars`` and starts again with the whole
path, so a tree may span any number of packs and tasks.  Equal turns are merged
only when role and text are equal, not just their hashes.

A pack holds its text (a token is a code point unless a tokenizer maps it), and
for each node its span, the position id of its first token (tokens of its
ancestors in the pack count, those of siblings do not), the ancestors' spans as
merged attention intervals, the end of its subtree (up to which tokens may attend
to it), and the span of the text under the loss mask.

Template: ``<s>[INST]role[/INST]text</s>`` for each turn.  In roles and texts a
backslash is doubled and put after the first character of a control string, which
``unescape`` reverses.

Defined results: turns are ordered by (turn, role, text), repeated rows repeat a
turn; null roles and texts are empty; rows without a conversation id form one
conversation; an empty table gives no packs; other columns are not read.  One
conversation is the unit that a task holds.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from arcweave.llm.text import bounded_batches

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_ROLE_OPEN, _ROLE_CLOSE, _TURN_END = "<s>[INST]", "[/INST]", "</s>"
_ESCAPED = re.compile(r"(?s)\\(.)")
_TURN = re.compile(r"(?s)<s>\[INST\](.*?)\[/INST\](.*)</s>")
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct([
    ("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("attend_until", pa.int32()),
    ("ancestors", pa.list_(_SPAN)), ("loss_start", pa.int32()), ("loss_end", pa.int32()),
])
_LEAF = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])
_PACK = pa.schema([("pack_id", pa.int64()), ("text", pa.string()), ("nodes", pa.list_(_NODE)), ("leaves", pa.list_(_LEAF))])
_PACK_SQL = (
    "pack_id long, text string, nodes array<struct<parent:int,start:int,end:int,position:int,attend_until:int,"
    "ancestors:array<struct<start:int,end:int>>,loss_start:int,loss_end:int>>, leaves array<struct<conv_id:long,node:int>>"
)
_LEAF_COST = 16


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class _Pack:
    """One packed sequence under construction."""

    def __init__(self):
        self.parts: list[str] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[str, str, int]] = []
        self.size = 0

    def add(self, conv: int | None, turns: list[tuple[str, str]], masked: str) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][:2] == turns[shared]:
            shared += 1
        self._leave(shared)
        for role, text in turns[shared:]:
            head = _ROLE_OPEN + escape(role) + _ROLE_CLOSE
            body = escape(text)
            start, parent = self.size, self.path[-1][2] if self.path else -1
            above = self.nodes[parent] if self.path else None
            spans = []
            if above:
                spans = [dict(s) for s in above["ancestors"]]
                if spans and spans[-1]["end"] == above["start"]:
                    spans[-1]["end"] = above["end"]
                else:
                    spans.append({"start": above["start"], "end": above["end"]})
            end = start + len(head) + len(body) + len(_TURN_END)
            loss = (start + len(head), start + len(head) + len(body)) if role == masked else (start, start)
            position = above["position"] + above["end"] - above["start"] if above else 0
            self.nodes.append({"parent": parent, "start": start, "end": end, "position": position, "attend_until": end, "ancestors": spans, "loss_start": loss[0], "loss_end": loss[1]})
            self.path.append((role, text, len(self.nodes) - 1))
            self.parts += [head, body, _TURN_END]
            self.size = end
        self.leaves.append({"conv_id": conv, "node": self.path[-1][2] if self.path else -1})

    def _leave(self, depth: int) -> None:
        """Close the subtrees below ``depth``."""
        for *_, node in self.path[depth:]:
            self.nodes[node]["attend_until"] = self.size
        del self.path[depth:]

    def row(self) -> dict:
        self._leave(0)
        text = "".join(self.parts)
        number = xxhash.xxh3_64_intdigest(f"{self.leaves[0]['conv_id']}/{text}".encode()) >> 1
        return {"pack_id": number, "text": text, "nodes": self.nodes, "leaves": self.leaves}


class ChatFormatter:
    def __init__(self, pack_chars: int = 65_536, masked_role: str = "assistant"):
        self.pack_chars, self.masked_role = pack_chars, masked_role

    def pack(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
        """Packs of all conversations (see the module for their columns)."""
        bounded_batches(rows.sparkSession)
        turn = F.struct(
            F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
        )
        whole = rows.select(F.col(conv_col).cast("long").alias("conv"), turn.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
        start = F.struct(F.lit(0).cast("long").alias("h"), F.expr("CAST(array() AS array<bigint>)").alias("path"))

        def step(state, t):
            h = F.xxhash64(state["h"], t["role"], t["text"])
            return F.struct(h.alias("h"), F.concat(state["path"], F.array(h)).alias("path"))

        chained = whole.withColumn("path", F.aggregate("turns", start, step)["path"])
        # The id parts conversations with equal turns, so that no hot one fills a range.
        ordered = chained.repartitionByRange("path", "conv").sortWithinPartitions("path", "conv")
        pack_chars, masked = self.pack_chars, self.masked_role

        def run(batches):
            pack = _Pack()
            for batch in batches:
                full = []
                for conv, turns in zip(batch.column(0), batch.column(1), strict=True):
                    if pack.size + _LEAF_COST * len(pack.leaves) >= pack_chars:
                        full.append(pack.row())
                        pack = _Pack()
                    pack.add(conv.as_py(), [(t["role"], t["text"]) for t in turns.as_py()], masked)
                if full:
                    yield pa.RecordBatch.from_pylist(full, _PACK)
            if pack.leaves:
                yield pa.RecordBatch.from_pylist([pack.row()], _PACK)

        return ordered.select("conv", "turns").mapInArrow(run, _PACK_SQL)

    @staticmethod
    def unpack(packs: DataFrame) -> DataFrame:
        """``(conv_id, turns array<struct<role, text>>, masked array<string>, formatted_chars)``, read from the packs."""
        schema = pa.schema([
            ("conv_id", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
            ("masked", pa.list_(pa.string())), ("formatted_chars", pa.int64()),
        ])

        def run(batches):
            for batch in batches:
                for text, nodes, leaves in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                    text, nodes = text.as_py(), nodes.as_py()
                    out, last, read = [], None, None
                    for leaf in leaves.as_py():
                        if leaf["node"] != last:
                            last, read = leaf["node"], _read(text, nodes, leaf["node"])
                        out.append({"conv_id": leaf["conv_id"]} | read)
                        if len(out) == 256:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema)

        return packs.select("text", "nodes", "leaves").mapInArrow(run, "conv_id long, turns array<struct<role:string,text:string>>, masked array<string>, formatted_chars long")


def _read(text: str, nodes: list[dict], node: int) -> dict:
    """Turns, masked texts and length of the path that ends in ``node``."""
    path = []
    while node >= 0:
        path.append(nodes[node])
        node = nodes[node]["parent"]
    path.reverse()
    turns, masked = [], []
    for n in path:
        role, body = _TURN.fullmatch(text[n["start"] : n["end"]]).groups()
        turns.append({"role": unescape(role), "text": unescape(body)})
        if n["loss_end"] > n["loss_start"]:
            masked.append(unescape(text[n["loss_start"] : n["loss_end"]]))
    return {"turns": turns, "masked": masked, "formatted_chars": sum(n["end"] - n["start"] for n in path)}
