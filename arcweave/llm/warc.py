"""Deterministic sharded WARC writer and reader.

Records are range-sorted by payload digest, so equal payloads are neighbours and
the newest capture (largest id) comes first: it is the ``response``, the others are
``revisit`` records that name it.  Each task streams its sorted range into files
of at most ``roll_bytes`` compressed bytes, one gzip member per record, under a
temporary name; a finished file is renamed to its final name, and the driver then
writes a manifest of exactly the files that the job reported.  Content and names
follow from the rows alone, so a task that runs again writes the same bytes, and
readers that go by the manifest never see leftovers.

A payload so frequent that it may exceed a task's share is split over ranges by
id.  Such payloads number at most ``4 * shards`` (each has more than ``rows / (4 *
shards)`` rows), so their newest ids fit in a bounded table sent to every task;
all others keep their rows in one range.

Files are written and read through ``pyarrow.fs``, which takes ``file``, ``hdfs``,
``s3`` and ``gs`` paths.

Defined results: null payloads are empty; null and repeated ids are written as
they are (a null id is older than any other; its records are addressed by digest
alone); a null url is left out and line breaks in urls are percent-encoded; an
empty table writes a manifest of no files; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcweave.llm.text import bounded_batches

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "name string, records long, bytes long, sha1 string"
_RECORDS = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _file_system(path: str):
    from pyarrow import fs

    if "://" not in path:
        return (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)
    return fs.FileSystem.from_uri(path)


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}/{digest}')}>"


def format_record(page: int | None, url: str | None, payload: bytes, date: str, refers_to: tuple | None) -> bytes:
    """One WARC/1.1 record; ``refers_to`` is (id,) of the response for a revisit."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to[0], digest)}"]
        if refers_to[0] is not None:
            lines.append(f"WARC-X-Refers-To-Page: {refers_to[0]}")
    if page is not None:
        lines.append(f"WARC-X-Page: {page}")
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without name or time, so equal data give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Roller:
    """Writes gzip members into files of at most ``roll_bytes``, renaming each when it is complete."""

    def __init__(self, root: str, shard: int, attempt: int, roll_bytes: int):
        self.fs, self.root = _file_system(root)
        self.shard, self.attempt, self.roll_bytes = shard, attempt, roll_bytes
        self.number, self.out, self.done = 0, None, []

    def add(self, member: bytes) -> None:
        if self.out and self.size + len(member) > self.roll_bytes:
            self.close()
        if not self.out:
            self.name = f"shard-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{self.name}-{self.attempt}-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size = self.records = 0
            self.sha1 = hashlib.sha1()
        self.out.write(member)
        self.size += len(member)
        self.records += 1
        self.sha1.update(member)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha1.hexdigest()))
            self.number, self.out = self.number + 1, None


class WarcWriter:
    def __init__(self, shards: int = 0, roll_bytes: int = 64 << 20, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z"):
        self.shards, self.roll_bytes, self.revisit_from, self.date = shards, roll_bytes, revisit_from, date

    def write(self, pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> dict:
        """Write all pages below ``path``; returns the manifest that was committed there."""
        spark = pages.sparkSession
        bounded_batches(spark)
        shards = self.shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
        rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
        counted = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("newest"))
        total = pages.count()
        hot = {r["digest"]: r["newest"] for r in counted.where(F.col("n") > total // (4 * shards)).where("n > 1").limit(4 * shards).collect()}
        is_hot = F.col("digest").isin(list(hot)) if hot else F.lit(False)
        part = F.when(is_hot, -F.coalesce("id", F.lit(-(2**63) + 1))).otherwise(F.lit(0))
        dealt = rows.withColumn("part", part).repartitionByRange(shards, "digest", "part")
        dealt = dealt.sortWithinPartitions("digest", F.col("id").desc_nulls_last(), "url")
        fs, root = _file_system(path)
        fs.create_dir(root, recursive=True)
        files = dealt.select("id", "url", "payload", "digest").mapInArrow(self._shard_writer(path, hot), _FILES).collect()
        manifest = {"format": "WARC/1.1", "files": [r.asDict() for r in sorted(files, key=lambda r: r["name"])]}
        body = json.dumps(manifest, indent=1).encode()
        temporary = f"{root}/_temporary-manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary, compression=None) as out:
            out.write(body)
        fs.move(temporary, f"{root}/manifest.json")
        return manifest

    def _shard_writer(self, path: str, hot: dict):
        roll_bytes, revisit_from, date = self.roll_bytes, self.revisit_from, self.date

        def run(batches):
            context = TaskContext.get()
            roller = _Roller(path, context.partitionId(), context.attemptNumber(), roll_bytes)
            digest, newest, written = None, None, False
            for batch in batches:
                for page, url, text, key in zip(*(batch.column(i) for i in range(4)), strict=True):
                    page, key, payload = page.as_py(), key.as_py(), text.as_py().encode()
                    if key != digest:
                        digest, written = key, False
                        newest = hot.get(key, page)
                    # The newest capture is written whole, once; in a hot group another range may hold it.
                    whole = len(payload) < revisit_from or (page == newest and not written)
                    written = written or page == newest
                    roller.add(gzip_member(format_record(page, url.as_py(), payload, date, None if whole else (newest,))))
            roller.close()
            names = list(zip(*roller.done, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[0], pa.string()), pa.array(names[1], pa.int64()), pa.array(names[2], pa.int64()), pa.array(names[3], pa.string())],
                ["name", "records", "bytes", "sha1"],
            )

        return run


def read_members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one by one."""
    waiting = b""
    while True:
        waiting = waiting or stream.read(block)
        if not waiting:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpacker.decompress(waiting))
            if unpacker.eof:
                waiting = unpacker.unused_data
                break
            waiting = stream.read(block)
            if not waiting:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Headers and block of a record; raises ValueError if lengths or digests disagree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    number = lambda name: int(headers[name]) if name in headers else None
    return {
        "id": number("WARC-X-Page"), "url": headers.get("WARC-Target-URI"), "payload_bytes": int(fields["Content-Length"]), "payload_digest": digest,
        "record_type": headers["WARC-Type"], "refers_to": number("WARC-X-Refers-To-Page"), "payload": payload if headers["WARC-Type"] == "response" else None,
    }


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the files in the manifest below ``path``."""
    fs, root = _file_system(path)
    with fs.open_input_stream(f"{root}/manifest.json", compression=None) as f:
        files = json.loads(f.read())["files"]
    names = [(f["name"], f["records"]) for f in files]
    listed = spark.createDataFrame(names, "name string, records long").repartition(max(1, len(names)), "name")
    schema = _RECORDS if with_payload else _RECORDS.removesuffix(", payload binary")
    arrow = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    arrow = arrow if with_payload else arrow.remove(6)

    def run(batches):
        fs, root = _file_system(path)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    held, seen = [], 0
                    for member in read_members(stream):
                        record = parse_record(member)
                        held.append({k: record[k] for k in arrow.names})
                        seen += 1
                        if len(held) == 256:
                            yield pa.RecordBatch.from_pylist(held, arrow)
                            held = []
                    if seen != expected:
                        raise ValueError(f"{name} holds {seen} records, not {expected}")
                    if held:
                        yield pa.RecordBatch.from_pylist(held, arrow)

    return listed.mapInArrow(run, schema)
