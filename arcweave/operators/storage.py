"""Where loops and multi-pass operators keep tables between passes.

Everything is written below the folder that the cluster names in
``spark.checkpoint.dir`` (shared by driver and executors), or else below the
directory given to ``SparkContext.setCheckpointDir``, so a lost executor costs a
re-read and never a recomputation from a vanished block.  Only where neither is
set and the master is local, as in tests, a folder of this machine is chosen;
on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    chosen = context.getCheckpointDir()
    if chosen:
        return chosen.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="arcweave-"))
    return context.getCheckpointDir().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system layer (any scheme)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def replace_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file so that readers see the old content or the new, never a part."""
    jvm = spark.sparkContext._jvm
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(fresh, True)
    out.write(bytearray(content))
    out.close()
    if not system.rename(fresh, target):
        # Not every file system renames onto a file that exists.
        system.delete(target, False)
        system.rename(fresh, target)


class Scratch:
    """Tables of one operator run, kept as Parquet in the shared folder.

    ``keep`` writes a DataFrame and returns it re-read, which cuts its lineage.
    ``drop`` deletes tables that no later pass reads, ``drop_all_but`` all others.
    What the returned DataFrame of an operator still reads stays until the session
    ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/arcweave/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.tables: dict[str, str] = {}
        atexit.register(self._at_exit)

    def path(self, tag: str) -> str:
        self.paths[tag] = f"{self.root}/{tag}"
        return self.paths[tag]

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def keep_bucketed(self, df: DataFrame, tag: str, keys: list[str], buckets: int | None = None) -> DataFrame:
        """Like :meth:`keep`, hashed and sorted by ``keys``: joins and groups on them need no shuffle of it."""
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"arcweave_{uuid.uuid4().hex}"
        path, dealt = self.path(tag), df.repartition(buckets, *keys)
        dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
        self.tables[tag] = name
        return self.spark.table(name)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            if tag in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(tag)}")
            if tag in self.paths:
                delete_path(self.spark, self.paths.pop(tag))

    def drop_all_but(self, *tags: str) -> None:
        self.drop(*(t for t in list(self.paths) if t not in tags))

    def _at_exit(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete_path(self.spark, self.root)
        except Exception:
            # The JVM may be gone already when the interpreter ends.
            return
