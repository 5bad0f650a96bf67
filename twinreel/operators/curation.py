"""Confirmed matches, rejected pairs and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components


def canonical(a: str, b: str) -> tuple:
    return F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")


def confirmed_components(edges: DataFrame) -> DataFrame:
    """``component_id, id`` from confirmed pairs (u, v) of ids; a component is
    named by its smallest id."""
    return connected_components(edges.select("u", "v"), "confirmed").select(F.col("root").alias("component_id"), F.col("node").alias("id"))


def drop_component(confirmed: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the components that hold any of the given paths."""
    hit = confirmed.join(gone, "path", "left_semi").select("component_id").distinct()
    return confirmed.join(hit, "component_id", "left_anti")


def drop_items(confirmed: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the given paths; a component of fewer than two goes."""
    left = confirmed.join(gone, "path", "left_anti")
    return left.withColumn("n", F.count("*").over(Window.partitionBy("component_id"))).where("n > 1").drop("n")


def rejected_pairs(sets: DataFrame) -> DataFrame:
    """``lo, hi``: all pairs of each set (set_id, path), once."""
    a, b = sets.select("set_id", F.col("path").alias("lo")), sets.select("set_id", F.col("path").alias("hi"))
    return a.join(b, "set_id").where("lo < hi").select("lo", "hi").distinct()


def component_pairs(confirmed: DataFrame) -> DataFrame:
    return rejected_pairs(confirmed.withColumnRenamed("component_id", "set_id"))


def missed_matches(confirmed: DataFrame, found: DataFrame) -> DataFrame:
    """Confirmed pairs that a search did not find (lo, hi)."""
    return component_pairs(confirmed).join(found, ["lo", "hi"], "left_anti")


def validation_failures(confirmed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs that are confirmed and rejected at once: the rejected ones with both
    ends in one component, so that no component's pairs are listed."""
    ends = [confirmed.select(F.col("path").alias(e), F.col("component_id").alias(f"{e}_component")) for e in ("lo", "hi")]
    inside = rejected.join(ends[0], "lo").join(ends[1], "hi").where("lo_component = hi_component")
    return inside.select("lo", "hi").distinct()


def unmatch(confirmed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without the whole component of any pair (lo, hi) that is in one."""
    c = confirmed.select("component_id", "path")
    hit = pairs.join(c.select(F.col("path").alias("lo"), F.col("component_id").alias("a")), "lo").join(c.select(F.col("path").alias("hi"), F.col("component_id").alias("b")), "hi")
    return confirmed.join(hit.where("a = b").select(F.col("a").alias("component_id")).distinct(), "component_id", "left_anti")


def moved_files(confirmed: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of ``files`` (path, content_hash) that are in no component but equal
    a member's content: ``path, component_id, first_member``."""
    first = confirmed.groupBy("component_id", "content_hash").agg(F.min("path").alias("first_member"))
    return files.join(confirmed.select("path"), "path", "left_anti").join(first, "content_hash").select("path", "component_id", "first_member")


def prune(table: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose path is still listed."""
    return table.join(listing.select("path"), "path", "left_semi")


def prune_pairs(rejected: DataFrame, listing: DataFrame) -> DataFrame:
    """Pairs both of whose paths are still listed."""
    there = listing.select("path")
    return rejected.join(there.withColumnRenamed("path", "lo"), "lo", "left_semi").join(there.withColumnRenamed("path", "hi"), "hi", "left_semi")


def placed_pairs(pairs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Pairs (lo, hi) with the component of either end."""
    ends = [confirmed.select(F.col("path").alias(e), F.col("component_id").alias(f"{e}_component")) for e in ("lo", "hi")]
    return pairs.join(ends[0], "lo", "left").join(ends[1], "hi", "left")


def judged_pairs(pairs: DataFrame, confirmed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs (lo, hi) with ``confirmed`` and ``rejected``: whether both ends are in
    one component, and whether the pair was rejected either way round."""
    known = rejected.select(*canonical("lo", "hi")).distinct().withColumn("__no", F.lit(True))
    placed = placed_pairs(pairs, confirmed).withColumn("confirmed", F.coalesce(F.col("lo_component") == F.col("hi_component"), F.lit(False)))
    placed = placed.withColumn("a", F.least("lo", "hi")).withColumn("b", F.greatest("lo", "hi"))
    out = placed.join(known.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "__no"), ["a", "b"], "left")
    return out.select("lo", "hi", "confirmed", F.coalesce("__no", F.lit(False)).alias("rejected"))


def all_confirmed(groups: DataFrame, candidates: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``group_id, path, all_confirmed`` of candidates (group_id, path): whether
    every member of the group is confirmed with the candidate."""
    named = confirmed.select("path", "component_id")
    whole = groups.join(named, "path", "left").groupBy("group_id").agg(
        F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.max(F.col("component_id").isNull()).alias("loose")
    )
    rows = candidates.select("group_id", "path").join(named, "path", "left").join(whole, "group_id")
    same = (F.col("low") == F.col("high")) & (F.col("low") == F.col("component_id")) & ~F.col("loose")
    return rows.select("group_id", "path", F.coalesce(same, F.lit(False)).alias("all_confirmed"))


def merge_verdicts(confirmed: DataFrame, rejected: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (confirmed, rejected) tables: confirmed sets are inserted, rejected sets
    add all their pairs, and then every component that holds both ends of any
    pair of an unmatched set goes as a whole.

    ``confirmed`` has ``component_id, path``, ``rejected`` has ``lo, hi``, and
    ``verdicts`` has ``verdict`` (confirmed, falsepos or unmatch), ``set_id`` and
    ``path``.  Sets are linked by stars, so that no pairs of a set are listed but
    those of rejected ones.  Components are named by the hash of their least path.
    """
    sets = verdicts.where("verdict = 'confirmed'").select(F.concat(F.lit("v"), F.col("set_id").cast("string")).alias("s"), "path")
    stars = confirmed.select(F.concat(F.lit("c"), F.col("component_id").cast("string")).alias("s"), "path").unionByName(sets)
    hub = stars.groupBy("s").agg(F.min("path").alias("hub"))
    edges = stars.join(hub, "s").where("path <> hub").select(F.xxhash64("hub").alias("u"), F.xxhash64("path").alias("v"))
    linked = connected_components(edges, "verdicts")
    paths = stars.select("path").distinct().withColumn("node", F.xxhash64("path"))
    named = paths.join(linked, "node").select(F.col("root").alias("component_id"), "path")
    loose = verdicts.where("verdict = 'unmatch'").select("set_id", "path")
    hit = loose.join(named, "path").groupBy("set_id", "component_id").agg(F.countDistinct("path").alias("n")).where("n > 1").select("component_id").distinct()
    pairs = rejected_pairs(verdicts.where("verdict = 'falsepos'").select("set_id", "path"))
    return named.join(hit, "component_id", "left_anti"), rejected.select("lo", "hi").unionByName(pairs).distinct()
