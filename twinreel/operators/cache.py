"""The incremental cache: what changed, upserts, reload policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import ranked

#: Whole seconds by which a file may differ from its cache entry.
MTIME_SLACK = 2


def changes(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """``path, action``: remove if the file is gone, update if it is new or its
    time differs by more than the slack either way, else keep.  Both tables have
    ``path`` and ``mtime`` in whole seconds."""
    both = listing.select("path", F.col("mtime").alias("now")).join(cache.select("path", F.col("mtime").alias("then")), "path", "full")
    action = F.when(F.col("now").isNull(), "remove").when(F.col("then").isNull() | (F.abs(F.col("now") - F.col("then")) > MTIME_SLACK), "update").otherwise("keep")
    return both.select("path", action.alias("action"))


def upsert(cache: DataFrame, fresh: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The cache with ``fresh`` rows in place of older ones of the same path and
    without ``removed`` paths."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy("path").orderBy(F.desc("__new"), F.desc("mtime"))
    out = both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__new")
    return out if removed is None else out.join(removed.select("path"), "path", "left_anti")


def reload(cache: DataFrame, policy: str) -> DataFrame:
    """What of the cache stays: all but errors for ``errors``, nothing for ``all``."""
    if policy not in ("none", "errors", "all"):
        raise ValueError(policy)
    return {"none": cache, "errors": cache.where("err_kind is null"), "all": cache.limit(0)}[policy]


def force(cache: DataFrame, paths: DataFrame) -> DataFrame:
    """The cache without the given paths, which the next look at the listing then
    takes for new: a forced update."""
    return cache.join(paths.select("path"), "path", "left_anti")


def successes(cache: DataFrame) -> DataFrame:
    return cache.where("err_kind is null")


def failures(cache: DataFrame) -> DataFrame:
    return cache.where("err_kind is not null")


def lookup(paths: DataFrame, cache: DataFrame) -> DataFrame:
    """``paths`` with the cache's columns and ``found``: ``hit``, ``error`` where
    the cache holds a failure, or ``missing``."""
    rows = paths.join(cache.withColumn("__there", F.lit(True)), "path", "left")
    return rows.withColumn("found", F.when(F.col("__there").isNull(), "missing").when(F.col("err_kind").isNotNull(), "error").otherwise("hit")).drop("__there")


def hydrate(paths: DataFrame, cache: DataFrame) -> DataFrame:
    """``paths`` that the cache has a hash of, with its columns."""
    return paths.join(successes(cache), "path")


def save_points(todo: DataFrame, every: int, order: list) -> DataFrame:
    """``todo`` with ``save``: after how many earlier saves a row's change is
    saved, if one is made after every so many changes, taken in this order."""
    return ranked(todo, order).withColumn("save", F.floor(F.col("place") / every).cast("int")).drop("place")


def scoped(cache: DataFrame, scope: Column, policy: str) -> DataFrame:
    """``reload`` for the paths in scope only; others stay as they are."""
    return reload(cache.where(scope), policy).unionByName(cache.where(~scope))
