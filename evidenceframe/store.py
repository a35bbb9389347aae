"""The folder that all executors share, and tables that are built once and kept there for the session."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folders of built tables by application and fingerprint.
_built: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master, where there is one machine, may leave it unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = (spark.sparkContext.applicationId, "shared")
    if key not in _built:
        _built[key] = tempfile.mkdtemp(prefix="evidenceframe-")
        atexit.register(shutil.rmtree, _built[key], ignore_errors=True)
    return _built[key]


def fingerprint(spark: SparkSession, paths: list[str], *settings: object) -> str:
    """A digest of files (names, lengths, times of change) and settings: what a built table depends on."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = [repr(settings)]
    for path in paths:
        there = jvm.org.apache.hadoop.fs.Path(path)
        fs = there.getFileSystem(conf)
        for status in fs.listStatus(there) if fs.exists(there) else ():
            seen.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:32]


def built(spark: SparkSession, name: str, mark: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` for a fingerprint: written on first use, read afterwards."""
    key = (spark.sparkContext.applicationId, f"{name}-{mark}")
    if key not in _built:
        path = f"{shared_dir(spark)}/{name}-{mark}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _built[key] = path
    return spark.read.parquet(_built[key])


def kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A small table written once, for a caller that reads it several times: what joins it knows its size, and it is not made again."""
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
