"""What the corpus operators share: the folder all executors see, durable tables, files, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []
WORDS = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Lets rows travel to and from Python workers by 8 MB at most, where the session has Spark's default (64 MB).

    A batch is held several times over, by the JVM and by the worker; whole texts would fill the large ones.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "8388608b")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the one named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is set for a local master (one machine holds all tasks);
    on a cluster an unset folder is an error, since executors share no local folder.
    """
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wattloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    made = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _made.append(made)
    return made


@atexit.register
def clear() -> None:
    """Removes the folders that this driver has made; results that read them must have been used.

    Called at exit. On stores other than a mounted file system the folders stay.
    """
    while _made:
        parts = urlsplit(_made.pop())
        if parts.scheme == "file":
            shutil.rmtree(parts.path, ignore_errors=True)


def durable(df: DataFrame, name: str, where: str | None = None) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: lineage ends there."""
    path = where or shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, where: str) -> DataFrame:
    """``df`` if it is a plain scan, whose partitions are the same each time; else written once and read back.

    Operators that number rows or batches by task need it: a second attempt must see the rows of the first.
    """
    plan = str(df._jdf.queryExecution().optimizedPlan().toString())
    if all(line.lstrip(" +-:").startswith(("Project", "Filter", "Relation")) for line in plan.splitlines() if line.strip()):
        return df
    return durable(df, "settled", where)


def files_of(uri: str):
    """(file system, path) of a folder or file; works on executors, without the JVM."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path or uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write: Callable) -> None:
    """Writes a file under a name of its own and moves it to ``uri``: readers and other attempts of
    the same task never see half a file."""
    system, path = files_of(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        write(out)
    system.move(part, path)


def trim() -> None:
    """Gives freed memory back to the system; workers live on and would keep a task's peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
            ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that trims the worker's memory after each task."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return inner


def map_batches(df: DataFrame, per_task: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with state that begins anew in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = per_task()
        for batch in batches:
            yield from one(batch)

    return df.mapInArrow(tidy(run), schema)


def uniform(seed: int, *cols: str | Column) -> Column:
    """A repeatable number in [0, 1) from a seed and columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long, without nulls) as (node, component), the
    component being its smallest node.

    Alternates large-star and small-star steps: each node's larger, then smaller, neighbours move to
    its least neighbour.  Minima are partial aggregates and joins, so a hub is never gathered in a
    task; each round is a table in the shared folder.  An empty input has no rows.
    """
    spark = edges.sparkSession
    at = shared_dir(spark, name)

    def kept(df: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        df = durable(df, name, f"{at}/{k}")
        mark = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return df, tuple(mark)

    # in these edges a > b
    now, mark = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    for k in range(1, most_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(
            least.filter("m < a").select("a", F.col("m").alias("b"))
        ).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = large.join(small, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        now, new = kept(after, k)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class ShardWriter:
    """A file written piece by piece under a name of its own and moved to ``uri`` by ``close``."""

    def __init__(self, uri: str):
        self.system, self.path = files_of(uri)
        self.uri = uri
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{os.path.dirname(self.path)}/.{os.path.basename(self.path)}.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends and returns the offset at which ``data`` begins."""
        self.out.write(data)
        self.size += len(data)
        return self.size - len(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.part, self.path)


def bytes_of(df: DataFrame) -> int:
    """Spark's own estimate of the size of ``df``; for how finely to deal, never for what to compute."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, mb: int = 64) -> int:
    """Partitions so that each gets about ``mb`` MB: the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(200_000, bytes_of(df) // (mb << 20)))


def adding(df: DataFrame, new: list[str]) -> list[str]:
    """The columns of ``df`` that stay when an operator adds ``new``: a clashing one gives way."""
    return [c for c in df.columns if c not in new]


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
