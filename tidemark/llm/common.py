"""Helpers that several corpus operators share: row keys, shared scratch tables, hashing, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Null ids sort before every other id; inside an operator they carry this key.
NULL_KEY = -(2**63)
_own_dir: dict[str, str] = {}
#: Tables written by :func:`saved` that are still there, by path.
_TABLES: dict[str, SparkSession] = {}
#: What operators cache in a Python worker, by the operator's module; each fills its own again when it is empty.
WORKER_CACHES: dict[str, dict] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share (``spark.checkpoint.dir``).

    Where that is unset, a local session (all in one process) uses a folder of its own; on a cluster it is an error,
    as a folder of one machine would hold only its part of a table.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own_dir:
            _own_dir[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
        base = _own_dir[context.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages no longer depend on its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    _TABLES[path] = spark
    made = spark.read.schema(df.schema).parquet(path)
    made.saved_path = path
    return made


def discard(*tables: DataFrame | str) -> None:
    """Delete tables made by :func:`saved` whose last reader has written its own result."""
    for table in tables:
        path = table if isinstance(table, str) else table.saved_path
        spark = _TABLES.pop(path, None)
        if spark:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def discarding() -> Iterator[list[DataFrame]]:
    """Delete at the end all tables saved within, other than those put into the list it gives."""
    before, keep = set(_TABLES), []
    yield keep
    discard(*(set(_TABLES) - before - {k.saved_path for k in keep}))


def release(spark: SparkSession) -> None:
    """Collect garbage so that Spark's cleaner can drop shuffle files of finished, already saved stages."""
    spark.range(1).count()  # the last query is let go when another has run
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def begin_task(owner: str) -> None:
    """Start a task in a Python worker: caches of other operators go, and freed memory returns to the system.

    Spark uses workers again, so without this a pipeline would hold the caches of all its operators at once.
    """
    for name, cache in WORKER_CACHES.items():
        if name != owner:
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def key_of(column: str) -> Column:
    """The id as a non-null long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def id_of(key: Column) -> Column:
    """The id that :func:`key_of` was made from."""
    return F.when(key != NULL_KEY, key)


def learned_from(column: str) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array of unsigned longs."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """xxh3 of each word ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text."""
    from xxhash import xxh3_64_intdigest

    words = text.split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def arrow_of(**columns: pa.Array | np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of one partition's edges, as edges from each node to its component's smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] = parent.setdefault(p, p)
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    if nodes:
        yield arrow_of(a=pa.array(nodes, pa.int64()), b=pa.array([root(x) for x in nodes], pa.int64()))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``edges`` (longs ``a, b``).

    Partitions first shrink to forests; then large-star and small-star rounds run until nothing
    changes. Each round is a saved table. Nodes without an edge to another node are not returned.
    """

    def star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = saved(edges.mapInArrow(_forest, "a long, b long").distinct(), "components")
    seen = mark(now)
    while seen[0]:
        before, now = now, saved(star(now), "components")
        new = mark(now)
        discard(before)
        if new == seen:
            break
        seen = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
