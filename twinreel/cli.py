"""A run from the command line: scan, hash what changed, search, curate, report."""

from __future__ import annotations

import logging
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, read
from .functions import paths
from .functions.hashing import HASH_BITS, HASH_WORDS
from .media.hashing import CreationOptions, hash_paths
from .operators import cache, curation, groups, search
from .sources import sinks
from .sources.cache_store import CacheStore
from .sources.frames import FfmpegFrames, FrameSource
from .sources.listing import walk
from .sources.match_store import MatchStore

log = logging.getLogger("twinreel")
LEVELS = {"quiet": logging.ERROR, "default": logging.WARNING, "verbose": logging.DEBUG}
WORDS = [f"w{i}" for i in range(HASH_WORDS)]


def scopes(config: Config) -> tuple:
    """(all, candidate, reference) predicates of the folders."""
    f = config.folders
    return paths.roles(F.col("path"), list(f.candidates), list(f.references), f.exclude, f.exclude_extensions)


def updated_cache(spark: SparkSession, config: Config, source: FrameSource) -> DataFrame:
    """The cache of hashes, after what changed on disk is hashed and saved; all
    paths in scope that are gone leave it."""
    options = CreationOptions(config.skip_forward, config.hash_duration, config.cropdetect)
    store = CacheStore(spark, config.cache, crop=options.cropdetect, skip_forward=options.skip_forward, duration=options.duration)
    known = store.load()
    if not config.update_cache:
        return known
    every, _, _ = scopes(config)
    f = config.folders
    listing = walk(spark, (*f.candidates, *f.references), f.exclude, f.exclude_extensions)
    known = cache.scoped(known, every, config.reload)
    todo = cache.changes(listing, known.where(every))
    fresh = listing.join(todo.where("action = 'update'"), "path", "left_semi")
    hashed = hash_paths(fresh, source, options).join(fresh.select("path", "mtime"), "path").withColumn("duration", F.col("duration").cast("int"))
    store.save(cache.upsert(known, hashed.select(known.columns), todo.where("action = 'remove'")))
    return store.load()


def items(cached: DataFrame) -> DataFrame:
    """Search items of the cache's successes."""
    rows = cache.successes(cached).select(F.xxhash64("path").alias("id"), "path", "duration", "hash")
    return rows.select("id", "path", "duration", *(F.get("hash", F.lit(i)).alias(w) for i, w in enumerate(WORDS)))


def found_groups(config: Config, every: DataFrame) -> DataFrame:
    """Members ``group_id, place, path, is_reference`` of the groups of a search."""
    _, candidate, reference = scopes(config)
    if config.folders.references:
        found = search.search_with_references(every.where(reference), every.where(candidate), config.tolerance, WORDS, HASH_BITS)
        dups = found.select(F.col("reference").alias("group_id"), F.col("candidate_path").alias("path"), F.lit(False).alias("is_reference"))
        refs = found.select(F.col("reference").alias("group_id"), F.col("reference_path").alias("path"), F.lit(True).alias("is_reference")).distinct()
        return dups.unionByName(refs).withColumn("place", F.lit(0).cast("bigint"))
    whole = groups.members(search.search(every.where(candidate), config.tolerance, WORDS, HASH_BITS))
    place = (F.col("last").cast("bigint") * (1 << 40) + F.col("duration")).alias("place")  # the leader last, ties by path
    return whole.select("group_id", "path", "is_reference", place)


def curated(config: Config, found: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Groups without what is known or rejected, where that is asked for; either
    filter gives up the reference's role."""
    if config.remove_known_matches:
        kept = groups.remove_known(found, tables["confirmed"]).select("group_id", "path")
        found = found.join(kept, ["group_id", "path"], "left_semi").withColumn("is_reference", F.lit(False))
    if config.remove_falsepos:
        kept = groups.remove_false_positives(found, tables["rejected"])
        found = found.join(kept, ["group_id", "path"], "left_semi").withColumn("is_reference", F.lit(False))
    return found


def run(spark: SparkSession, config: Config, source: FrameSource | None = None) -> DataFrame | None:
    """Do what a configuration asks for, and return the groups, paths or pairs that
    its output lists; None where only the cache is updated."""
    log.setLevel(LEVELS[config.output.verbosity])
    config.folders.check()
    every, candidate, reference = scopes(config)
    store = MatchStore(spark, config.match_db) if config.match_db else None
    if config.display:
        tables = store.load()
        refs = reference if config.folders.references else None
        if config.display == "matches":
            return groups.display_confirmed(tables["confirmed"], every if refs is not None else candidate, refs)
        if config.display == "falsepos":
            f = config.folders
            within = lambda p: paths.includes(p, [*f.candidates, *f.references], f.exclude, f.exclude_extensions)
            return groups.display_rejected(tables["rejected"], within, (lambda p: paths.under(p, f.references)) if refs is not None else None)
        return curation.validation_failures(tables["confirmed"], tables["rejected"])
    cached = updated_cache(spark, config, source or FfmpegFrames())
    if config.update_cache_only:
        return None
    known = items(cached).where(every)
    found = found_groups(config, known)
    if store:
        found = curated(config, found, store.load())
    if config.show_missed_matches:
        pairs = groups.pairs(found.withColumn("id", F.xxhash64("path")), ("path",)).select(*curation.canonical("a_path", "b_path"))
        return curation.missed_matches(store.load()["confirmed"].join(known.select("path"), "path", "left_semi"), pairs)
    if config.output.kind == "unique":
        return groups.unique_items(known.where(candidate), found).select("path")
    if config.output.cartesian:
        return groups.pairs(found.withColumn("id", F.xxhash64("path")), ("path",))
    return found


def main(arguments: Sequence[str] | None = None) -> int:
    logging.basicConfig(format="%(levelname)s %(message)s")
    try:
        config = read(sys.argv[1:] if arguments is None else arguments)
        spark = SparkSession.builder.appName("twinreel").getOrCreate()
        result = run(spark, config)
        if result is not None and config.output.kind != "none":
            if "is_reference" in result.columns:
                shown = sinks.json_objects(result).orderBy("group_id").select("json") if config.output.format == "json" else sinks.text_lines(result).orderBy("group_id").select("text")
            else:
                shown = result.select(F.to_json(F.struct("*"))) if config.output.format == "json" else result.select(F.concat_ws("\n", *result.columns))
            for row in shown.toLocalIterator():
                print(row[0])
    except (ValueError, OSError, RuntimeError) as error:
        while error is not None:
            log.error("%s", error)
            error = error.__cause__ if log.isEnabledFor(logging.DEBUG) else None
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
