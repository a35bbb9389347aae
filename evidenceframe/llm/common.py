"""Helpers that the corpus operators share: work folders, text batches, components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the controls 09 to 0D.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a local master, where there is one machine, may leave it unset; it then gets a temporary one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="evidenceframe-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


#: Paths of work tables, newest last; ``scratch`` deletes those made within it.
_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the work tables made inside the block at its end, when its results are written."""
    first = len(_made)
    try:
        yield
    finally:
        gone, _made[first:] = _made[first:], []
        for path in gone:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a work table that nothing reads any more."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, not decoded."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def column_of(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def text_of(raw: bytes | None) -> str:
    """The text of a cell; bytes that are not UTF-8 become U+FFFD, null the empty text."""
    return (raw or b"").decode(errors="replace")


def range_of(value: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below a value, 0 for null; cuts are sorted.

    A binary search over the array of cuts, eight bytes each, that goes to the tasks with the
    function; only the value's column leaves the JVM.
    """
    array = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def found(x: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(array, x.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return found(F.when(value.isNull(), F.lit(-(2**63)).cast("bigint")).otherwise(value)) if cuts else F.lit(0)


def released(run):
    """``run`` for the batches of a task; memory that Arrow and the allocator keep goes back at its end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            give_back()

    return task


def give_back() -> None:
    """Free pages that glibc keeps for reuse go back to the system; elsewhere nothing happens."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def pieces(batches, step: int):
    """Batches of at most ``step`` rows, so that few rows are Python objects at a time."""
    for batch in batches:
        yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def rows_of(batch: pa.RecordBatch, key: str = "doc_id", column: str = "text", step: int = 256):
    """(key, text as bytes) of each row; only ``step`` rows at a time become Python objects."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(column_of(part, key), texts_of(part, column), strict=True)


def semi_join_bounded(df: DataFrame, ids: DataFrame, key: str, limit: int = 400_000) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (one column, distinct).

    The id list is broadcast when a count shows that it is within ``limit`` rows; above it the
    join is shuffled.
    """
    if ids.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(ids), key, "left_semi")
    return df.join(ids.hint("shuffle_hash"), key, "left_semi")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links, as (node, root) with the smallest node as root.

    Each round sends a node to its smallest neighbour and on to that one's, and contracts the links:
    nodes that met are one node in the next round, and links within it are gone. The image of a
    connected graph is connected, and the smallest node stays where it is, so what is left of a
    component is its smallest node. The state of each round is written to the shared folder.
    Nodes without links are absent.
    """
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v")
    edges = written(edges.distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        both = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other"))))
        hooked = edges.select(both.alias("e")).groupBy("e.node").agg(F.min("e.other").alias("m")).select("node", F.least("node", "m").alias("up"))
        hooked = written(hooked, "hooked")
        onward = hooked.select(F.col("node").alias("up"), F.col("up").alias("far"))
        moved = written(hooked.join(onward, "up").select("node", F.col("far").alias("to")), "moved")
        if labels is None:
            labels = moved.select("node", F.col("to").alias("root"))
        else:
            labels = labels.join(moved.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = written(labels, "roots")
        first = moved.select(F.col("node").alias("u"), F.col("to").alias("x"))
        second = moved.select(F.col("node").alias("v"), F.col("to").alias("y"))
        now = edges.join(first, "u").join(second, "v").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u <> v")
        edges = written(now.distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after more links (a, b) between nodes that it holds.

    Links within a component are dropped first, the others join components, not nodes.
    """
    first = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    second = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = links.join(first, "a").join(second, "b").where("ra <> rb").select("ra", "rb")
    roots = connected_components(between, "ra", "rb")
    return written(labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
