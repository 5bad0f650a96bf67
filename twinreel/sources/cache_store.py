"""The hash cache on disk: versions of Parquet with a description."""

from __future__ import annotations

import json
import os
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bumped when a stored row's meaning changes.
VERSION = 1
SCHEMA = "path string, mtime bigint, duration int, hash array<bigint>, err_kind string, err_msg string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class CacheMismatch(Exception):
    """The cache was made with other settings."""


class CacheStore:
    """A folder with one sub-folder a version; the newest complete one counts,
    so a broken write is never read.  A version holds the whole cache, or only
    what a batch changed since the version before it."""

    def __init__(self, spark: SparkSession, folder: str, backend: str = "ffmpeg", crop: str = "letterbox", skip_forward: float = 15.0, duration: float = 10.0):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.settings = {"os": "unix" if os.name == "posix" else os.name, "backend": backend, "crop": crop, "skip_forward": skip_forward, "duration": duration, "version": VERSION}

    def _versions(self) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
        done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/about/_SUCCESS"))
        return [n for n in names if done(n)]

    def _about(self, version: str) -> dict:
        stored = json.loads(self.spark.read.text(f"{self.folder}/{version}/about").first()[0])
        if stored.get("settings") != self.settings:
            raise CacheMismatch(f"stored {stored.get('settings')}, wanted {self.settings}")
        return stored

    def load(self) -> DataFrame:
        """The newest whole version with the changes after it, of several rows of
        a path the newest; no rows without a version.  Other settings raise."""
        parts = []
        for version in reversed(self._versions()):
            parts.append(self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{version}/rows").withColumn("at", F.lit(len(parts))))
            if not self._about(version)["changes"]:
                break
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        if len(parts) == 1:
            return parts[0].drop("at")
        newest = F.min_by(F.struct(*COLUMNS), "at").alias("row")
        return reduce(DataFrame.unionByName, parts).groupBy("path").agg(newest).select("row.*")

    def save(self, cache: DataFrame) -> None:
        """Write the whole cache as a new version."""
        self._write(cache, False)

    def append(self, changed: DataFrame) -> None:
        """Write a new version of changed rows alone, so that a batch costs what it
        changes; now and then the whole is to be saved, which removes nothing."""
        self._write(changed, True)

    def _write(self, rows: DataFrame, changes: bool) -> None:
        """The description comes last and completes the version."""
        version = f"{self.folder}/v{time.time_ns():020d}"
        rows.select(COLUMNS).write.parquet(f"{version}/rows")
        about = json.dumps({"settings": self.settings, "changes": changes})
        self.spark.range(1).select(F.lit(about).alias("value")).write.text(f"{version}/about")
