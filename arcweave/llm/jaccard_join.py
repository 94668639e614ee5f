"""N-gram Jaccard self-join by vertical partitioning, and its linked groups.

The n-gram universe has one global order, and is cut into fragments: ranges of it.
Each fragment is counted on its own and the partial counts are summed:

* Thinning, over ranges of the n-gram hash.  A document of n distinct n-grams can
  only be linked when at least ``ceil(t * n)`` of them occur elsewhere.  Fragment
  after fragment, the n-grams that only one live document holds are counted and
  added up; a document leaves as soon as its sum exceeds ``n - ceil(t * n)``.  Later
  fragments are read for the documents that are left, so the bulk of a corpus costs
  one fragment.
* Candidates.  What remains is ordered by (frequency level, n-gram), rare ones first;
  linked documents share an n-gram of their prefixes, with enough places behind it.
* Verification, over ranges of that order.  The cuts give fragments of about equal
  size; a document has one segment in each.  Fragment by fragment, the segments of a
  candidate pair meet and give a partial overlap; the partial overlaps are summed per
  pair and compared exactly, in integers.  No task holds a whole set.

Copies with equal n-gram sets form one class that is compared once.  Within a
bucket, all members are first compared with one leader; only members that end
in different groups then meet each other, so a group of mutual near copies
costs a number of pairs in proportion to its size.  The other links inside the
groups are found only on request (``links(every=True)``, ``n_links``).  Members of a
bucket are dealt over ``SALTS`` tasks, and large buckets are cut into cells; members
of a bucket's largest group stay in theirs, so that one large group beside a few
others is not copied.  Nothing is capped.

Classes are 64-bit hashes of the sets, checked against a second hash; where two
sets share one, all are hashed anew.

Defined results: null or blank text has an empty set and is linked with
nothing; repeated rows and repeated ids are separate rows of one class; a null
id never becomes a component id unless the whole component has none; an empty
table gives an empty result; columns other than the two named are not read; a
text of any length is one set, cut into ``FRAGMENTS`` segments; a pair exactly at the
threshold is linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from arcweave.llm.text import Words, bounded_batches, shingles, text_bytes
from arcweave.operators.components import star_labels
from arcweave.operators.storage import Scratch

FRAGMENTS = 4
#: Bits of the filter of live classes that goes to every task: 16 or more for each
#: class within these bounds (128 KB and 64 MB).  It only spares work; what it lets
#: through is joined exactly afterwards.
FILTER_BITS = (1 << 20, 1 << 29)
#: Tasks over which the members of one bucket are dealt; at most 64, the bits of a long.
SALTS = 64
#: Members of a bucket for which it has one more cell to compare them in, up to ``SALTS`` cells.
CELL_ROWS = 256
#: Cells in which n-grams are counted to place the cuts: 16 per frequency level.
_CELLS_PER_LEVEL = 16
_SETS_SCHEMA = "cls long, n long, " + ", ".join(f"t{f} array<long>" for f in range(FRAGMENTS))


def _distinct(batch: pa.RecordBatch, k: int):
    """(row, sorted distinct shingle hashes) of each row of (id, text)."""
    for first, _, data, offsets in text_bytes(batch.column(1)):
        words = Words(data, offsets)
        grams, bounds = shingles(words, words.hashes(), k)
        for i in range(len(offsets) - 1):
            yield first + i, np.unique(grams[bounds[i] : bounds[i + 1]])


def _class_of(grams: np.ndarray, seed: int) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), seed)).astype(np.int64))


def _ranges(grams: np.ndarray) -> list[np.ndarray]:
    """Sorted n-grams cut into ``FRAGMENTS`` equal ranges of the hash."""
    cuts = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64(2**64 // FRAGMENTS)
    return np.split(grams.view(np.int64), np.searchsorted(grams, cuts))


def _class_rows(k: int, seed: int):
    def run(batches):
        for batch in batches:
            sizes, classes, checks = (np.zeros(len(batch), np.int64) for _ in range(3))
            for row, grams in _distinct(batch, k):
                sizes[row], classes[row], checks[row] = len(grams), _class_of(grams, seed), _class_of(grams, ~seed & 0xFFFF)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.array(classes), pa.array(checks)], ["id", "text_key", "n", "cls", "checked"])

    return run


def _fragment_rows(k: int, fragment: int, seed: int):
    def run(batches):
        for batch in batches:
            held, owner, waiting = [], [], 0
            for _, grams in _distinct(batch, k):
                part = _ranges(grams)[fragment]
                if len(part):
                    held.append(part)
                    owner.append(np.full(len(part), _class_of(grams, seed)))
                    waiting += len(part)
                if waiting > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.concatenate(owner))], ["tok", "cls"])
                    held, owner, waiting = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.concatenate(owner))], ["tok", "cls"])

    return run


def _filter_places(column: str, bits: int) -> list[Column]:
    """Bit numbers of a class in the filter."""
    folded = F.col(column).bitwiseXOR(F.shiftrightunsigned(column, 29))
    return [F.pmod(folded, F.lit(bits)), F.pmod(F.shiftrightunsigned(column, 24), F.lit(bits))]


def _live_filter(live: DataFrame) -> np.ndarray:
    """Bit filter of the live classes, built by a distributed bitwise-or."""
    least, most = FILTER_BITS
    bits = min(max(least, 1 << (16 * live.count()).bit_length()), most)
    places = live.select(F.explode(F.array(*_filter_places("cls", bits))).alias("bit"))
    words = places.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    found = words.toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table


def _may_be_live(table: np.ndarray, cls: int) -> bool:
    value, bits = cls & (2**64 - 1), 64 * len(table)
    return all(table[bit >> 6] >> (bit & 63) & 1 for bit in ((value ^ value >> 29) % bits, (value >> 24) % bits))


def _set_rows(k: int, live_filter, seed: int):
    def run(batches):
        table = live_filter.value
        for batch in batches:
            rows = []
            for _, grams in _distinct(batch, k):
                if len(grams) and _may_be_live(table, cls := _class_of(grams, seed)):
                    rows.append((cls, len(grams), *_ranges(grams)))
                if len(rows) == 512:
                    yield _set_batch(rows)
                    rows = []
            if rows:
                yield _set_batch(rows)

    return run


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    lists = [pa.array(c, pa.list_(pa.int64())) for c in columns[2:]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *lists], ["cls", "n", *(f"t{f}" for f in range(FRAGMENTS))])


def text_key(column: str) -> Column:
    """Hash that tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def has_words(column: str) -> Column:
    """Whether a text has a word, and so a set that is not empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).rlike("[^ \\x09-\\x0D]")


def _place(tok) -> Column:
    """Which sixteenth of its level's order an n-gram is in; signed, as n-grams are ordered."""
    return F.shiftright(tok, 60).cast("int") + _CELLS_PER_LEVEL // 2


def cuts_of(counts: list[tuple[int, int]], parts: int) -> list[int]:
    """Cells at which the global order is cut so that ``parts`` ranges hold about as many n-grams each."""
    total, upto, cuts = sum(n for _, n in counts), 0, []
    for cell, n in counts:
        if upto * parts >= total * (len(cuts) + 1) and len(cuts) < parts - 1:
            cuts.append(cell)
        upto += n
    return cuts


def partial_overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``(a, b, na, nb, frag, partial)``: what each fragment alone gives a pair."""
    left = segments.select(F.col("cls").alias("a"), "frag", F.col("toks").alias("left_toks"))
    right = segments.select(F.col("cls").alias("b"), "frag", F.col("toks").alias("right_toks"))
    met = pairs.join(left, "a").join(right, ["b", "frag"])
    return met.select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("left_toks", "right_toks")).cast("long").alias("partial"))


def _smaller_first() -> list[Column]:
    """``(a, b, na, nb)`` of a pair of rows x and y, the smaller class first."""
    pick = lambda a, b: F.when(F.expr("x.cls < y.cls"), F.col(a)).otherwise(F.col(b))
    return [pick("x.cls", "y.cls").alias("a"), pick("y.cls", "x.cls").alias("b"), pick("x.n", "y.n").alias("na"), pick("y.n", "x.n").alias("nb")]


class JaccardJoin:
    """Link texts whose ``k``-word shingle sets have Jaccard ``>= num / den``."""

    def __init__(self, k: int = 5, num: int = 80, den: int = 100):
        self.k, self.num, self.den = k, num, den

    def _room(self, n: str = "n") -> Column:
        """How many n-grams of a set of size n may be missing elsewhere."""
        return F.expr(f"{n} - ({self.num} * {n} + {self.den - 1}) div {self.den}")

    def _needed(self, a: str, b: str) -> str:
        """Smallest overlap of two linked sets of sizes a and b."""
        return f"(({self.num} * ({a} + {b}) + {self.num + self.den - 1}) div {self.num + self.den})"

    def _alone(self, tokens: DataFrame) -> DataFrame:
        """(cls, s): n-grams of this fragment that no other class holds."""
        return (
            tokens.groupBy("tok").agg(F.min("cls").alias("cls"), F.max("cls").alias("last")).where("cls = last")
            .groupBy("cls").agg(F.count("*").alias("s"))
        )

    def _classes(self, source: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
        """``ids(id, text_key, n, cls)``, ``classes(cls, n)``, and the seed under which no two sets share a class."""
        keyed = source.withColumn("text_key", text_key("text"))
        for seed in range(7, 64):
            ids = scratch.keep(keyed.mapInArrow(_class_rows(self.k, seed), "id long, text_key long, n long, cls long, checked long"), "ids")
            seen = ids.where("n > 0").groupBy("cls").agg(F.max("n").alias("n"), F.min("checked").alias("low"), F.max("checked").alias("high"))
            seen = scratch.keep(seen, "classes")
            if seen.where("low <> high").head() is None:
                return ids.drop("checked"), seen.select("cls", "n"), seed
        raise RuntimeError("two sets share a class under every seed")

    def _segments(self, tokens: DataFrame, sizes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """``ordered(cls, n, grams array<struct<level, tok>>)`` of n-grams that several classes hold, and ``segments(cls, frag, toks)``."""
        common = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
        common = scratch.keep(common.select("tok", "df", F.floor(8 * F.log2("df")).cast("int").alias("level")), "common")
        # n-grams per cell of the order: at most 16 for each level, and no more levels than 8 per power of two.
        cell = F.col("level") * _CELLS_PER_LEVEL + _place("tok")
        counts = sorted(map(tuple, common.groupBy(cell.alias("cell")).agg(F.sum("df").alias("n")).collect()))
        cuts = cuts_of(counts, FRAGMENTS)
        shared = tokens.join(common.select("tok", "level"), "tok").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("level", "tok"))).alias("grams"))
        ordered = scratch.keep(shared.join(sizes, "cls"), "ordered")

        def piece(f: int) -> Column:
            inside = lambda g: sum((g["level"] * _CELLS_PER_LEVEL + _place(g["tok"]) >= F.lit(c)).cast("int") for c in cuts) + F.lit(0) == f
            return F.struct(F.lit(f).alias("frag"), F.transform(F.filter("grams", inside), lambda g: g["tok"]).alias("toks"))

        pieces = [piece(f) for f in range(len(cuts) + 1)]
        segments = ordered.select("cls", F.explode(F.array(*pieces)).alias("s")).select("cls", "s.frag", "s.toks").where("size(toks) > 0")
        return ordered, scratch.keep(segments, "segments")

    def _verified(self, pairs: DataFrame, segments: DataFrame) -> DataFrame:
        """Pairs ``(a, b, na, nb)`` whose summed partial overlaps reach the threshold, with ``shared``."""
        partial = partial_overlaps(pairs, segments)
        summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("shared"))
        return summed.where(f"{self.den} * shared >= {self.num} * (na + nb - shared)").select("a", "b", "shared", "na", "nb")

    def _pairs(self, placed: DataFrame, cross: bool) -> DataFrame:
        """Candidate pairs ``(a, b, na, nb)`` of a bucket that pass the size and position bounds.

        They are of different groups with ``cross``, else of one group.  A bucket has a cell
        for about ``CELL_ROWS`` members.  All members stay in their cell on one side; on the other
        they go to all cells of their bucket, with ``cross`` except those of its largest group,
        which need not meet each other.
        """
        held = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), "salt"))
        groups = placed.groupBy("tok", "grp").agg(F.count("*").alias("m"), held.alias("held"))
        buckets = groups.groupBy("tok").agg(F.sum("m").alias("m"), F.count("*").alias("groups"), F.max(F.struct("m", "grp")).alias("largest"), F.bit_or("held").alias("held"))
        salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("shiftright", F.col("held"), s).bitwiseAND(1) == 1)
        cells = F.least(F.lit(SALTS), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("m") / CELL_ROWS)))).cast("int"))
        live = buckets.where("groups > 1" if cross else "m > groups").select("tok", F.col("largest.grp").alias("most"), cells.alias("cells"), F.explode(salts).alias("salt"))
        members = placed.join(live, ["tok", "salt"]).withColumn("stays", F.expr("grp = most") if cross else F.lit(False))
        members = members.withColumn("cell", F.col("salt") % F.col("cells")).drop("salt", "most")
        one, other = members.drop("cells"), members.where("not stays").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells", "stays")
        meet = "x.grp <> y.grp" if cross else "x.grp = y.grp"
        found = one.alias("x").join(other.alias("y"), F.expr(f"x.tok = y.tok and x.cell = y.cell and (x.stays or x.cls < y.cls) and {meet} and {self._bounds()}"))
        return found.select(*_smaller_first()).distinct()

    def _bounds(self) -> str:
        size_ok = "{0} * least(x.n, y.n) >= {1} * greatest(x.n, y.n)".format(self.den, self.num)
        return f"{size_ok} and 1 + least(x.n - x.pos, y.n - y.pos) >= " + self._needed("x.n", "y.n")

    def links(self, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, every: bool = False) -> tuple[DataFrame, DataFrame]:
        """``(classes(id, text_key, n, cls), links(a, b))``: rows with their class, and class pairs.

        By default pairs inside a group that leader links already join are not
        listed: the links span each group exactly, which is all that components
        need.  With ``every`` all linked pairs are verified and listed, each once;
        texts of one class are linked without being listed.
        """
        bounded_batches(docs.sparkSession)
        source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        ids, classes, seed = self._classes(source, scratch)
        first = self._alone(source.mapInArrow(_fragment_rows(self.k, 0, seed), "tok long, cls long"))
        live = scratch.keep(
            classes.join(first, "cls", "left").withColumn("s", F.coalesce("s", F.lit(0))).where(F.col("s") <= self._room()).select("cls", "n", "s"),
            "live0",
        )
        live_filter = docs.sparkSession.sparkContext.broadcast(_live_filter(live))
        sets = source.select("id", "text").mapInArrow(_set_rows(self.k, live_filter, seed), _SETS_SCHEMA)
        sets = sets.groupBy("cls").agg(F.first("n").alias("n"), *(F.first(f"t{f}").alias(f"t{f}") for f in range(FRAGMENTS)))
        sets = scratch.keep(sets.join(live.select("cls", "s"), "cls"), "sets0")
        for f in range(1, FRAGMENTS):
            tokens = sets.select("cls", F.explode(f"t{f}").alias("tok"))
            more = self._alone(tokens).withColumnRenamed("s", "more")
            kept = live.join(more, "cls", "left").withColumn("s", F.col("s") + F.coalesce("more", F.lit(0))).where(F.col("s") <= self._room())
            live = scratch.keep(kept.select("cls", "n", "s"), f"live{f}")
            sets = scratch.keep(sets.drop("s").join(live.select("cls", "s"), "cls"), f"sets{f}")
            scratch.drop(f"live{f - 1}", f"sets{f - 1}")
        tokens = sets.select("cls", F.explode(F.concat(*(f"t{f}" for f in range(FRAGMENTS)))).alias("tok"))
        ordered, segments = self._segments(tokens, sets.select("cls", "n"), scratch)
        scratch.drop(f"sets{FRAGMENTS - 1}", f"live{FRAGMENTS - 1}", "classes", "common")
        prefix = ordered.withColumn("own", F.col("n") - F.size("grams")).withColumn("take", (self._room() + 1 - F.col("own")).cast("int")).where("take > 0")
        prefix = prefix.select("cls", "n", "own", F.posexplode(F.slice("grams", F.lit(1), F.col("take"))).alias("at", "gram"))
        salt = F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int").alias("salt")
        prefix = scratch.keep(prefix.select("cls", "n", (F.col("own") + F.col("at") + 1).alias("pos"), F.col("gram.tok").alias("tok"), salt), "prefix")
        scratch.drop("ordered")
        # The leader of a bucket is the member with most places behind the n-gram; it goes to each salt of the bucket.
        best = prefix.groupBy("tok", "salt").agg(F.max(F.struct(F.expr("(n - pos) / n").alias("rest"), "cls", "n", "pos")).alias("top"), F.count("*").alias("m"))
        leaders = best.groupBy("tok").agg(F.max("top").alias("top"), F.sum("m").alias("m"), F.collect_list("salt").alias("salts")).where("m > 1")
        leaders = leaders.select("tok", "top.cls", "top.n", "top.pos", F.explode("salts").alias("salt"))
        star = prefix.alias("x").join(leaders.alias("y"), F.expr(f"x.tok = y.tok and x.salt = y.salt and x.cls <> y.cls and {self._bounds()}"))
        star = star.select(*_smaller_first()).distinct()
        star_links = scratch.keep(self._verified(star, segments), "star_links")
        groups = star_labels(star_links, "a", "b", scratch=scratch)
        placed = prefix.join(groups.withColumnRenamed("id", "cls"), "cls", "left").withColumn("grp", F.coalesce("component", "cls"))
        placed = scratch.keep(placed.select("tok", "salt", "cls", "n", "pos", "grp"), "placed")
        cross_links = scratch.keep(self._verified(self._pairs(placed, cross=True), segments), "cross_links")
        if not every:
            return ids, star_links.unionByName(cross_links)
        inside_links = scratch.keep(self._verified(self._pairs(placed, cross=False), segments), "inside_links")
        return ids, inside_links.unionByName(cross_links)

    def n_links(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, text_key, n, n_links)`` per row: how many other texts it is linked with.

        Every link between two different texts counts, also those inside a group and
        those between texts with equal n-gram sets; rows that repeat a text do not.
        """
        scratch = Scratch(docs.sparkSession, "n-links")
        ids, links = self.links(docs, id_col, text_col, scratch, every=True)
        texts = ids.where("n > 0").groupBy("cls").agg(F.count_distinct("text_key").alias("texts"))
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(texts.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("texts").alias("near"))
        counted = texts.join(near, "cls", "left").select("cls", (F.col("texts") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
        out = ids.join(counted, "cls", "left")
        out = scratch.keep(out.select("id", "text_key", "n", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "counted")
        scratch.drop_all_but("counted")
        return out

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, text_key, n, grp, component)`` per row.

        ``n`` is the set size, ``grp`` a label of the linked group (null for an
        empty set) and ``component`` the smallest id of the group.
        """
        scratch = Scratch(docs.sparkSession, "jaccard")
        ids, links = self.links(docs, id_col, text_col, scratch)
        labels = star_labels(links, "a", "b", scratch=scratch).withColumnRenamed("id", "cls")
        classes = ids.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"))
        grouped = classes.join(labels, "cls", "left").withColumn("grp", F.coalesce("component", "cls")).select("cls", "rep", "grp")
        lowest = grouped.groupBy("grp").agg(F.min("rep").alias("low"))
        named = grouped.join(lowest, "grp").select("cls", "grp", "low")
        out = ids.join(named, "cls", "left")
        out = out.select("id", "text_key", "n", "grp", F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component"))
        out = scratch.keep(out, "components")
        scratch.drop_all_but("components")
        return out

    def one_per_group(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` with the smallest id of each linked group.

        Rows of a linked group that repeat an id and its text are one document; texts
        with an empty set are linked with nothing, so all their rows stay as they are.
        A null id counts as the largest.
        """
        scratch = Scratch(docs.sparkSession, "one-per-group")
        found = self.components(docs, id_col, text_col)
        order = F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("k1"), F.col("text_key").alias("k2"))
        first = found.where("grp is not null").groupBy("grp").agg(F.min(order).alias("w")).select("w.k1", "w.k2")
        stay = scratch.keep(first, "stay")
        packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("k1"), text_key(text_col).alias("k2"), has_words(text_col).alias("filled"))
        linked = packed.where("filled").join(stay, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        return linked.select("row.*").unionByName(packed.where("not filled").select("row.*"))
