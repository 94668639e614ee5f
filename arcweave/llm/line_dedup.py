"""Line de-duplication over levelled sorted runs of line hashes.

``LineRuns`` keeps what is known about lines in sorted runs, as a log-structured
store does: a batch is reduced to one row per line key and merge-anti-joined with
the keys of all runs; the keys that are left are added as a run of level 0, and
the counts of the others as a run of updates.  Whenever ``fanout`` runs share a
level they are merged into one run of the next level.  A key's totals are those
of its one run and of its updates, so batches must not share documents.

``LineDedup`` feeds a corpus through such a store batch by batch, then drops
frequent lines everywhere but in the document with the largest id.

Defined results: null or empty text is one empty line; a null id counts as one
document below all others; rows that repeat an id are one document for counting
and are all treated alike; a line that is short or too rare stays as it is; texts
of any length are read whole, one at a time; of documents that hold a line the
largest id wins, so there are no ties but between rows of that id, which all keep it; an empty table gives an empty result; further columns,
whatever their names, travel in the struct ``row``.
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arcweave.llm.text import bounded_batches
from arcweave.operators.storage import Scratch, delete_path, replace_file

_KEY = ["h1", "h2"]
_RUN = [*_KEY, "n_docs", "last_doc"]
_LINES = "doc long, txt long, h1 long, h2 long"


def _line_key(line: bytes) -> bytes:
    """The line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


def _hash(key: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _doc_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


class LineRuns:
    """A store of line keys in levelled sorted runs, below ``path``.

    Each key stands in exactly one run, with its counts in the batch that brought it:
    a batch is merge-anti-joined with the runs, and what is left becomes a run.  Counts
    of keys that a run has already go to levelled runs of updates.  Runs are tables
    bucketed and sorted by the key, so neither the joins of a batch nor a compaction
    shuffles them.  The manifest names the runs and is replaced in one rename after
    each batch, so the store can be opened again for the next one.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[str, list[list[str]]] = {"keys": [], "updates": []}
        self._count = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineRuns:
        """The store that an earlier session left below ``path``."""
        about = json.loads(spark.read.text(f"{path.rstrip('/')}/manifest.json", wholetext=True).first()[0])
        store = cls(spark, path, about["fanout"], about["buckets"])
        store.levels, store._count = about["levels"], about["count"]
        for run in store.runs("keys") + store.runs("updates"):
            columns = ", ".join(f"{c} BIGINT" for c in _RUN)
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {store._name(run)} ({columns}) USING parquet CLUSTERED BY ({', '.join(_KEY)}) "
                f"SORTED BY ({', '.join(_KEY)}) INTO {store.buckets} BUCKETS LOCATION '{store.path}/{run}'"
            )
        return store

    def _name(self, run: str) -> str:
        return "lines_" + xxhash.xxh3_128_hexdigest(f"{self.path}/{run}")

    def runs(self, kind: str) -> list[str]:
        return [run for level in self.levels[kind] for run in level]

    def table(self, run: str) -> DataFrame:
        return self.spark.table(self._name(run))

    def _write(self, rows: DataFrame, kind: str) -> str:
        """A new run; ``rows`` are hashed by key already wherever they come from runs."""
        run = f"{kind}-{self._count}"
        self._count += 1
        rows.select(*_RUN).write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.path}/{run}").saveAsTable(self._name(run))
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
        delete_path(self.spark, f"{self.path}/{run}")

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose key no run has."""
        for run in self.runs("keys"):
            batch = batch.join(self.table(run).select(*_KEY).hint("merge"), _KEY, "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """Add a batch ``(doc, h1, h2)`` that holds each line key of a document once."""
        counted = lines.groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            counted = counted.repartition(self.buckets, *_KEY)
        gone = []
        if not self.runs("keys"):
            self._add("keys", self._write(counted, "keys"))
        else:
            gone.append(self._write(counted, "batch"))
            batch = self.table(gone[0])
            known = [batch.join(self.table(run).select(*_KEY).hint("merge"), _KEY, "left_semi") for run in self.runs("keys")]
            new = self._write(self.fresh(batch), "keys")
            self._add("updates", self._write(reduce(DataFrame.unionByName, known), "updates"))
            self._add("keys", new)
        for kind in self.levels:
            gone += self._compact(kind)
        self._commit()
        for run in gone:
            self._drop(run)

    def _add(self, kind: str, run: str, level: int = 0) -> None:
        while len(self.levels[kind]) <= level:
            self.levels[kind].append([])
        self.levels[kind][level].append(run)

    def _compact(self, kind: str) -> list[str]:
        """Merge levels that have ``fanout`` runs; the names of the runs merged."""
        gone, level = [], 0
        while level < len(self.levels[kind]):
            if len(self.levels[kind][level]) >= self.fanout:
                runs, self.levels[kind][level] = self.levels[kind][level], []
                self._add(kind, self._write(self._merged(runs), kind), level + 1)
                gone += runs
            level += 1
        return gone

    def _merged(self, runs: list[str]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self.table(run) for run in runs])
        return rows.groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def _commit(self) -> None:
        about = json.dumps({"fanout": self.fanout, "buckets": self.buckets, "count": self._count, "levels": self.levels})
        replace_file(self.spark, f"{self.path}/manifest.json", about.encode())

    def totals(self) -> DataFrame:
        """``(h1, h2, n_docs, last_doc)`` per key over all batches."""
        keys = reduce(DataFrame.unionByName, [self.table(run) for run in self.runs("keys")])
        if not self.runs("updates"):
            return keys
        more = self._merged(self.runs("updates")).select(*_KEY, F.col("n_docs").alias("more"), F.col("last_doc").alias("later"))
        found = keys.join(more, _KEY, "left")
        return found.select(*_KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))

    def drop(self) -> None:
        """Remove the store."""
        for run in self.runs("keys") + self.runs("updates"):
            self._drop(run)
        delete_path(self.spark, self.path)


def _line_rows(min_chars: int):
    def run(batches):
        for batch in batches:
            docs, texts, high, low = [], [], [], []
            for doc, txt, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = {k for k in map(_line_key, (text or "").encode().split(b"\n")) if _long_enough(k, min_chars)}
                for a, b in map(_hash, keys):
                    docs.append(doc)
                    texts.append(txt)
                    high.append(a)
                    low.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, texts, high, low)], ["doc", "txt", "h1", "h2"])

    return run


def _apply_rows(min_chars: int):
    def run(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                left = lines
                if drops:
                    gone = {(d["h1"], d["h2"]) for d in drops}
                    left = [x for x in lines if not (_long_enough(k := _line_key(x), min_chars) and _hash(k) in gone)]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["row", "n_lines", "n_dropped", "kept"])

    return run


class LineDedup:
    """Drop lines of at least ``min_chars`` code points found in ``min_docs`` documents."""

    def __init__(self, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2):
        self.min_chars, self.min_docs, self.batches, self.fanout = min_chars, min_docs, batches, fanout

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(row, n_lines, n_dropped, kept)``; ``row`` holds every input column."""
        bounded_batches(docs.sparkSession)
        scratch = Scratch(docs.sparkSession, "lines")
        doc, text = _doc_key(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")
        # Rows of one id are told apart by their text: a list of lines to drop is never longer than one text's.
        txt = F.xxhash64(F.col(text_col).cast("string")).alias("txt")
        lines = docs.select(doc, txt, text).mapInArrow(_line_rows(self.min_chars), _LINES)
        # Documents, not lines, are dealt to batches; rows of one id meet in one batch.
        lines = lines.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(self.batches)).cast("int"))
        path = scratch.path("lines")
        lines.write.partitionBy("batch").parquet(path)
        lines = docs.sparkSession.read.schema(f"{_LINES}, batch int").parquet(path)
        runs = LineRuns(docs.sparkSession, scratch.path("runs"), self.fanout)
        for b in range(self.batches):
            runs.add(lines.where(F.col("batch") == b).select("doc", *_KEY).distinct())
        # Kept as a table, so that the join below has two plain inputs: a small one is
        # broadcast, and otherwise the partitions of a hot line can be split.
        frequent = scratch.keep(runs.totals().where(F.col("n_docs") >= self.min_docs).select(*_KEY, "last_doc"), "frequent")
        runs.drop()
        drops = lines.join(frequent, _KEY).where("doc < last_doc").groupBy("doc", "txt").agg(F.collect_set(F.struct(*_KEY)).alias("drops"))
        packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), doc, txt, text)
        joined = packed.join(drops, ["doc", "txt"], "left").select("row", "text", "drops")
        kind = packed.schema["row"].dataType.simpleString()
        return joined.mapInArrow(_apply_rows(self.min_chars), f"row {kind}, n_lines long, n_dropped long, kept string")
