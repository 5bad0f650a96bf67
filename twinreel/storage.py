"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where a session names no shared folder and runs in one process.
FALLBACK_SHARED_DIR = "/tmp/twinreel-shared"
#: Has Spark remove the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Up to which size Spark sends one side of a join through the driver.
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
ADAPTIVE_BROADCAST = "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Compressed bytes that may go that way here; as a hashed table in the driver's
#: memory they are several times as many.
BROADCAST_BYTES = 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a final slash.

    Only a session within one process may do without ``spark.checkpoint.dir``:
    elsewhere a local folder would be another one on each machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or FALLBACK_SHARED_DIR).rstrip("/")


def _folder(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder of intermediate files removed when the application ends."""
    folder, fs = _folder(spark, path)
    fs.deleteOnExit(folder)


@contextmanager
def shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when their query ends, not when the driver
    happens to collect its garbage.  For queries that run once."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _bytes(spark: SparkSession, size: str) -> int:
    return -1 if size.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within, no join sends more than BROADCAST_BYTES through the driver, unless
    it asks to, whatever the session allows.  For tables that grow with the input:
    rounds of many joins would fill the driver's memory with hashed tables."""
    before = {key: spark.conf.get(key, None) for key in (BROADCAST, ADAPTIVE_BROADCAST)}  # none where not set
    allowed = {BROADCAST: spark.conf.get(BROADCAST), ADAPTIVE_BROADCAST: before[ADAPTIVE_BROADCAST]}
    for key, value in allowed.items():
        if value is not None:
            spark.conf.set(key, str(min(_bytes(spark, value), BROADCAST_BYTES)))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a reread of files, never a
    second run of the plan above.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/twinreel/{name}-{uuid.uuid4().hex}"
    with shuffles_end_with_query(spark):
        df.write.mode("overwrite").parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that no later query reads."""
    for table in tables:
        folder, fs = _folder(table.sparkSession, table.scratch_path)
        fs.delete(folder, True)
