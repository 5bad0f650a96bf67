"""What is done with groups: pairs, sizes, distances, order, filters, curation.

Groups are long tables of members: ``group_id, path, is_reference`` and more;
they become arrays only in sinks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS, hamming, normalised
from ..storage import materialize
from .search import leaders


def members(found: DataFrame) -> DataFrame:
    """The groups of a self search as members; a group is named by its leader,
    which comes last."""
    claimed = found.select(F.col("leader").alias("group_id"), F.col("member").alias("id"), F.col("member_path").alias("path"), F.col("member_duration").alias("duration"), F.lit(0).alias("last"))
    lead = found.select(F.col("leader").alias("group_id"), F.col("leader").alias("id"), F.col("leader_path").alias("path"), F.col("leader_duration").alias("duration"), F.lit(1).alias("last")).distinct()
    return claimed.unionByName(lead).withColumn("is_reference", F.lit(False))


def sizes(groups: DataFrame) -> DataFrame:
    """``group_id, size``; a reference is not counted."""
    return groups.groupBy("group_id").agg(F.count_if(~F.col("is_reference")).alias("size"))


def pairs(groups: DataFrame, columns: Sequence[str] = ("id", "path")) -> DataFrame:
    """Every two members of a group, in path order; with references only the
    pairs of a reference and another member."""
    def side(p: str) -> DataFrame:
        return groups.select("group_id", *(F.col(c).alias(f"{p}_{c}") for c in (*columns, "is_reference")))

    referred = groups.where("is_reference").select("group_id").distinct()
    a, b = side("a"), side("b")
    plain = a.join(referred, "group_id", "left_anti").join(b, "group_id").where("a_path < b_path")
    led = a.where("a_is_reference").join(b.where("not b_is_reference"), "group_id")
    return plain.unionByName(led).drop("a_is_reference", "b_is_reference")


#: The distance of a pair of which a hash is missing: beyond any other.
UNKNOWN = (1 << 32) - 1


def max_distance(groups: DataFrame, words: Sequence[str] = ("w0",)) -> DataFrame:
    """``group_id, max_distance``: largest distance of any two members; UNKNOWN
    where a member has no hash."""
    def side(p: str) -> DataFrame:
        return groups.select("group_id", F.col("path").alias(f"{p}_path"), *(F.col(w).alias(f"{p}_{w}") for w in words))

    far = hamming([F.col(f"a_{w}") for w in words], [F.col(f"b_{w}") for w in words])
    both = side("a").join(side("b"), "group_id").where(F.col("a_path") < F.col("b_path"))
    return both.groupBy("group_id").agg(F.max(F.coalesce(far.cast("bigint"), F.lit(UNKNOWN))).alias("max_distance"))


def spread(groups: DataFrame, words: Sequence[str] = ("w0",), scale: int = HASH_BITS) -> DataFrame:
    """``group_id, spread``: largest normalised distance of the members that have
    a hash; 0 where no two have."""
    known = max_distance(groups.dropna(subset=list(words)), words)
    return groups.select("group_id").distinct().join(known, "group_id", "left").select("group_id", F.coalesce(normalised(F.col("max_distance"), scale), F.lit(0.0)).alias("spread"))


def ranked(groups: DataFrame, order: Sequence[Column]) -> DataFrame:
    """With each row's ``place`` in an order, which has to settle all ties, since
    sorts are not stable.  Rows are sorted in ranges, in parallel; only the sizes
    of the ranges are summed in one task."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = groups.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = materialize(cut.select("*", F.spark_partition_id().alias("part"), within.alias("at")), "ranked")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return held.join(F.broadcast(offsets), "part").withColumn("place", F.col("before") + F.col("at")).drop("part", "at", "before")


def filter_members(groups: DataFrame, keep: Column) -> DataFrame:
    """Members that ``keep`` holds for, in groups that still have two of them, or
    one beside a reference; a group whose reference goes, goes."""
    by = Window.partitionBy("group_id")
    flagged = groups.withColumn("keep", F.coalesce(keep, F.lit(False)))
    flagged = flagged.withColumn("has_reference", F.max("is_reference").over(by))
    flagged = flagged.withColumn("lost", F.max(F.col("is_reference") & ~F.col("keep")).over(by))
    flagged = flagged.withColumn("left", F.sum((F.col("keep") & ~F.col("is_reference")).cast("int")).over(by))
    enough = F.col("left") >= F.when(F.col("has_reference"), 1).otherwise(2)
    return flagged.where(F.col("keep") & ~F.col("lost") & enough).drop("keep", "has_reference", "lost", "left")


def extract_references(groups: DataFrame, is_reference: Column) -> DataFrame:
    """In each group every pair of a member that is a reference and one that is
    not: ``group_id, reference_path, path``."""
    flagged = groups.select("group_id", "path", is_reference.alias("ref"))
    refs = flagged.where("ref").select("group_id", F.col("path").alias("reference_path"))
    return refs.join(flagged.where("not ref").select("group_id", "path"), "group_id")


def unique_items(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Items that are a duplicate in no group."""
    return items.join(groups.where("not is_reference").select("path"), "path", "left_anti")


def remove_known(groups: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``group_id, bucket, path``: each path, by its ``place`` in the group, goes
    to the first bucket with a member that it is not confirmed with; buckets of
    one go.  ``groups`` has ``group_id, place, path``, ``confirmed`` has
    ``component_id, path``.

    A bucket whose members are all of one component is closed to that component
    and open to every other path; a bucket of two components is open to all.  So
    the first path opens bucket 0, which takes everything up to and beyond the
    first path of another component, while the paths of its own component that
    come before that open a bucket each: bucket k holds the k-th of these and,
    as bucket 0 is open to the others, nothing else.  Buckets of one go, so what
    is left of a group is its first path and all paths from the first one on that
    is not confirmed with it, in bucket 0.
    """
    rows = groups.select("group_id", "place", "path").join(confirmed.select("path", "component_id"), "path", "left")
    first = rows.groupBy("group_id").agg(F.min(F.struct("place", "path", "component_id")).alias("f"))
    unlike = ~F.coalesce(F.col("component_id") == F.col("f.component_id"), F.lit(False))
    later = F.struct("place", "path") > F.struct("f.place", "f.path")
    judged = rows.join(first, "group_id").withColumn("unlike", unlike & later)
    opened = judged.where("unlike").groupBy("group_id").agg(F.min(F.struct("place", "path")).alias("o"))
    kept = judged.join(opened, "group_id").where(~later | (F.struct("place", "path") >= F.col("o")))
    return kept.select("group_id", F.lit(0).alias("bucket"), "path")


def remove_false_positives(groups: DataFrame, rejected: DataFrame) -> DataFrame:
    """``group_id, path``: by their ``place`` in the group, members that are
    rejected with none of those kept before; groups of one go.  ``groups`` has
    ``group_id, place, path``, ``rejected`` has ``lo, hi``.

    The members kept are the first maximal set, in this order, without a rejected
    pair in it, as the leaders of a search are, and are found by the same rounds:
    work follows the rejected pairs within groups, not the groups.
    """
    rows = groups.select("group_id", "place", "path")
    ends = [rows.select("group_id", F.col("place").alias(f"{e}_place"), F.col("path").alias(e)) for e in ("lo", "hi")]
    inside = ends[0].join(rejected.select("lo", "hi"), "lo").join(ends[1], ["group_id", "hi"])
    swap = F.col("lo_place") > F.col("hi_place")
    node = lambda end: F.xxhash64("group_id", end)
    edges = inside.select(
        F.when(swap, node("hi")).otherwise(node("lo")).alias("u"), F.when(swap, node("lo")).otherwise(node("hi")).alias("v"),
        F.least("lo_place", "hi_place").alias("u_duration"), F.when(swap, F.col("hi")).otherwise(F.col("lo")).alias("u_path"),
        F.greatest("lo_place", "hi_place").alias("v_duration"), F.when(swap, F.col("lo")).otherwise(F.col("hi")).alias("v_path"),
    )
    edges = materialize(edges.distinct(), "rejected-inside")
    lead = leaders(edges)
    gone = edges.join(lead.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("node")).distinct()
    kept = rows.withColumn("node", node("path")).join(gone, "node", "left_anti")
    return kept.withColumn("n", F.count("*").over(Window.partitionBy("group_id"))).where("n > 1").select("group_id", "path")


def quality_rank(value: Column, by: Sequence[str], nonzero: Column) -> Column:
    """Share of a group's values below this one: the place of the first equal
    value over the number of values; zero where all are zero."""
    order, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    share = (F.rank().over(order) - 1) / F.count(F.lit(1)).over(whole)
    return F.when(F.max(nonzero.cast("int")).over(whole) == 1, share).otherwise(F.lit(0.0))


def filter_statistics(before: DataFrame, after: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``metric, n``: groups before and after the filters, members that went, and
    pairs of the confirmed groups, which are counted and not listed."""
    def count(metric: str, rows: DataFrame, value: Column) -> DataFrame:
        return rows.agg(value.cast("bigint").alias("n")).select(F.lit(metric).alias("metric"), F.coalesce("n", F.lit(0)).alias("n"))

    held = confirmed.groupBy("component_id").agg(F.count("*").alias("c"))
    return (
        count("groups_before", before, F.countDistinct("group_id"))
        .unionByName(count("groups_after", after, F.countDistinct("group_id")))
        .unionByName(count("members_before", before, F.count("*")))
        .unionByName(count("members_after", after, F.count("*")))
        .unionByName(count("confirmed_pairs", held, F.sum(F.col("c") * (F.col("c") - 1) / 2)))
    )


def display_confirmed(confirmed: DataFrame, keep: Column, is_reference: Column | None = None) -> DataFrame:
    """``group_id, reference_path, path`` of the confirmed groups: without
    references the members that ``keep`` holds for, else a row for every reference
    and other member of what is kept."""
    whole = confirmed.select(F.col("component_id").alias("group_id"), "path", F.lit(False).alias("is_reference"))
    kept = filter_members(whole, keep)
    if is_reference is None:
        return kept.select("group_id", F.lit(None).cast("string").alias("reference_path"), "path")
    return extract_references(kept, is_reference).select("group_id", "reference_path", "path")


def display_rejected(rejected: DataFrame, keep: Callable[[Column], Column], is_reference: Callable[[Column], Column] | None = None) -> DataFrame:
    """``lo, hi`` of the rejected pairs both of whose ends are kept; with references
    those of a reference and another path, the reference first."""
    lo, hi = F.col("lo"), F.col("hi")
    kept = rejected.where(keep(lo) & keep(hi))
    if is_reference is None:
        return kept.select("lo", "hi")
    first = F.when(is_reference(lo), lo).otherwise(hi)
    other = F.when(is_reference(lo), hi).otherwise(lo)
    return kept.where(is_reference(lo) != is_reference(hi)).select(first.alias("lo"), other.alias("hi"))
