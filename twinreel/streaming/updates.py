"""The cache and the reference search as streams.

Groups of a self search are not incremental, since a new early item can change
every leader; they are recomputed from the cache.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cache as caches
from ..operators.search import search_with_references


def maintain(listing: DataFrame, load: Callable[[], DataFrame], append: Callable[[DataFrame], None], compute: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Upsert what a stream of (path, mtime) lists into the cache.  ``compute``
    makes cache rows of the paths that are new or changed, and only those are
    written; a batch that runs again finds them unchanged and writes none."""

    def batch(rows: DataFrame, _: int) -> None:
        latest = rows.groupBy("path").agg(F.max("mtime").alias("mtime"))
        known = load().join(latest.select("path"), "path", "left_semi")
        todo = caches.changes(latest, known).where("action = 'update'")
        append(compute(latest.join(todo, "path", "left_semi")))

    return listing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_stream(candidates: DataFrame, references: DataFrame, sink: Callable[[DataFrame], None], tolerance: float, checkpoint: str, words: Sequence[str] = ("w0",), scale: int = 1000) -> StreamingQuery:
    """Match a stream of items against fixed references, batch by batch."""

    def batch(rows: DataFrame, _: int) -> None:
        sink(search_with_references(references, rows, tolerance, words, scale))

    return candidates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
