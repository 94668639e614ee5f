"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query.  The index has a
posting list for every trigram that some query names; intersecting the lists
gives each rule's candidate documents, and only these are matched.  A rule whose
query is empty (no mandatory trigram, as for hexadecimal runs) scans every text.

Positions come from splitting the text by the same expression: a match starts
after the pieces and matches before it.  Lengths count code points.

Defined results: null text is empty and has no spans; repeated rows repeat; a
null id is kept; matches of one rule never overlap, those of different rules
may; an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from arcweave.llm.trigram_query import All, EVERYTHING, trigram_query, trigrams
from arcweave.operators.storage import Scratch

_SPAN = "struct<start:int,kind:int,end:int>"


@dataclass(frozen=True)
class Rule:
    """A named expression; matches need ``least`` characters in ``group``."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)


class SecretScan:
    def __init__(self, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.watched = sorted(set().union(*map(trigrams, self.queries)))

    # ---- index ----------------------------------------------------------

    def postings(self, rows: DataFrame) -> DataFrame:
        """``(trigram, k1, k2)``: one row for each watched trigram that a text holds."""
        # As a lambda's argument the lower-cased text is made once, not for each trigram.
        held = F.get(F.transform(F.array(F.lower("text")), lambda low: F.filter(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in self.watched)), lambda x: x.isNotNull())), F.lit(0))
        return rows.select(F.explode(held).alias("trigram"), "k1", "k2")

    def candidates(self, postings: DataFrame) -> DataFrame:
        """``(k1, k2, rule<i>...)``: documents in the intersection of some rule's postings."""
        numbered = F.create_map(*(F.lit(x) for i, t in enumerate(self.watched) for x in (t, i)))[F.col("trigram")]
        words = -(-len(self.watched) // 62)
        masks = [
            F.bit_or(F.when(F.floor(numbered / 62) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (numbered % 62).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{w}")
            for w in range(words)
        ]
        found = postings.groupBy("k1", "k2").agg(*masks)
        hits = [self._satisfied(q).alias(f"rule{i}") for i, q in enumerate(self.queries) if q != EVERYTHING]
        names = [f"rule{i}" for i, q in enumerate(self.queries) if q != EVERYTHING]
        return found.select("k1", "k2", *hits).where(" OR ".join(names))

    def _satisfied(self, query) -> Column:
        if isinstance(query, str):
            at = self.watched.index(query)
            return F.col(f"m{at // 62}").bitwiseAND(F.lit(1 << (at % 62)).cast("long")) != 0
        out = self._satisfied(query.parts[0])
        for part in query.parts[1:]:
            out = out & self._satisfied(part) if isinstance(query, All) else out | self._satisfied(part)
        return out

    # ---- matching -------------------------------------------------------

    def _spans(self, number: int) -> Column:
        """All spans of one rule in ``text``."""
        rule = self.rules[number]
        pattern = F.lit(rule.pattern)
        matches = F.regexp_extract_all("text", pattern, F.lit(0))
        value = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else matches
        parts = F.arrays_zip(matches.alias("m"), value.alias("v"), F.split("text", rule.pattern, -1).alias("g"))
        empty = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS array<{_SPAN}>)").alias("out"))

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + F.length(x["g"])
            end = start + F.coalesce(F.length(x["m"]), F.lit(0))
            span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
            good = x["m"].isNotNull() & (F.length(x["v"]) >= rule.least)
            return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

        return F.aggregate(parts, empty, step)["out"]

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, spans array<struct<start, kind, end>>)`` per row, by start, then kind.

        ``kind`` is the rule's number; positions are code points, ends exclusive.
        """
        scratch = Scratch(docs.sparkSession, "secrets")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
        rows = rows.withColumn("k1", F.coalesce("id", F.lit(-(2**63)))).withColumn("k2", F.xxhash64("text"))
        none = F.expr(f"CAST(array() AS array<{_SPAN}>)")
        full = [i for i, q in enumerate(self.queries) if q == EVERYTHING]
        indexed = [i for i, q in enumerate(self.queries) if q != EVERYTHING]
        everywhere = F.concat(none, *(F.when(F.col("text").rlike(self.rules[i].pattern), self._spans(i)).otherwise(none) for i in full))
        out = rows.select("id", "k1", "k2", everywhere.alias("everywhere"))
        if indexed:
            postings = scratch.keep(self.postings(rows).sortWithinPartitions("trigram"), "postings")
            wanted = scratch.keep(self.candidates(postings), "candidates")
            checked = rows.join(wanted, ["k1", "k2"]).select("k1", "k2", F.concat(none, *(F.when(F.col(f"rule{i}"), self._spans(i)).otherwise(none) for i in indexed)).alias("verified"))
            checked = checked.where(F.size("verified") > 0).dropDuplicates(["k1", "k2"])
            out = out.join(checked, ["k1", "k2"], "left").withColumn("verified", F.coalesce("verified", none))
        else:
            out = out.withColumn("verified", none)
        return out.select("id", F.array_sort(F.concat("everywhere", "verified")).alias("spans"))

    def rendered(self, spans: Column) -> Column:
        """``kind:start:end`` of each span, comma-joined."""
        names = F.array(*(F.lit(r.name) for r in self.rules))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
