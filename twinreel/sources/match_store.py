"""The match database on disk: confirmed groups, rejected pairs, content hashes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation
from . import sinks

TABLES = {
    "confirmed": "component_id bigint, path string",
    "rejected": "lo string, hi string",
    "contents": "path string, mtime bigint, content_hash string",
}


class MatchStore:
    """A folder of versions, each with a Parquet table of every kind and the
    confirmed groups as JSON; the newest complete version counts, and the older
    ones are its backups."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 10):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _path(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Names of the complete versions, oldest first."""
        folder, fs = self._path("")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())
        return [n for n in names if fs.exists(self._path(f"{n}/done/_SUCCESS")[0])]

    def load(self, version: str | None = None) -> dict[str, DataFrame]:
        """The tables of the newest version, or of another; empty without any."""
        versions = self.versions()
        if not versions:
            return {name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()}
        at = f"{self.folder}/{version or versions[-1]}"
        return {name: self.spark.read.schema(schema).parquet(f"{at}/{name}") for name, schema in TABLES.items()}

    def save(self, tables: dict[str, DataFrame]) -> str:
        """Write a version, whose last file completes it, and remove the oldest
        beyond ``keep``.  Tables that are not given stay as they are."""
        before = self.load()
        version = f"v{time.time_ns():020d}"
        for name, schema in TABLES.items():
            columns = [c.split()[0] for c in schema.split(", ")]
            tables.get(name, before[name]).select(columns).write.parquet(f"{self.folder}/{version}/{name}")
        named = self.spark.read.schema(TABLES["confirmed"]).parquet(f"{self.folder}/{version}/confirmed")
        listed = named.groupBy(F.col("component_id").alias("group_id")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
        listed.write.json(f"{self.folder}/{version}/json")
        self.spark.range(1).write.parquet(f"{self.folder}/{version}/done")
        for old in self.versions()[: -self.keep]:
            path, fs = self._path(old)
            fs.delete(path, True)
        return version

    def merge(self, verdicts: DataFrame) -> str:
        """Save what verdicts (verdict, set_id, path) make of the tables."""
        tables = self.load()
        confirmed, rejected = curation.merge_verdicts(tables["confirmed"], tables["rejected"], verdicts)
        return self.save({"confirmed": confirmed, "rejected": rejected})

    def merge_index(self, index_file: str, numbers: DataFrame) -> str:
        """As ``merge``, for sets named by verdict and place (verdict, number) in an
        index file."""
        return self.merge(sinks.read_verdicts(self.spark, index_file, numbers))

    def prune(self, listing: DataFrame) -> str:
        """Save the tables without what is no longer listed."""
        tables = self.load()
        gone = tables["confirmed"].select("path").unionByName(tables["contents"].select("path")).distinct().join(listing.select("path"), "path", "left_anti")
        return self.save({
            "confirmed": curation.drop_items(tables["confirmed"], gone),
            "rejected": curation.prune_pairs(tables["rejected"], listing),
            "contents": curation.prune(tables["contents"], listing),
        })

    def fix_moved(self, contents: DataFrame) -> str:
        """Save the confirmed groups with files (path, mtime, content_hash) that
        equal a member which is gone or not, under the group of its content."""
        tables = self.load()
        hashes = tables["contents"].select("path", "content_hash").unionByName(contents.select("path", "content_hash")).dropDuplicates(["path"])
        confirmed = tables["confirmed"].join(hashes, "path", "left")
        moved = curation.moved_files(confirmed, contents.select("path", "content_hash")).select("component_id", "path")
        there = contents.select("path")
        kept = tables["confirmed"].join(there, "path", "left_semi").select("component_id", "path").unionByName(moved).distinct()
        return self.save({"confirmed": kept, "contents": contents, "rejected": curation.prune_pairs(tables["rejected"], contents)})
