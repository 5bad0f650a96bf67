"""Similarity search over items of (id, path, duration, hash words).

Order is by duration, then by the bytes of the path.  In a self search an item
that no earlier leader claims is itself a leader and claims the later items in
its duration band within the tolerance; that is the first maximal independent
set in this order, and is found by rounds instead of a scan.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS, LIBRARY_TOLERANCE, band_bin, hamming, reference_band, self_band_end, tolerance_bits
from ..storage import materialize
from .components import connected_components

#: Items of one duration bin that a task compares with its share of probes.
BIN_ROWS = 20_000
#: Rounds before what is undecided is finished component by component.
ROUNDS = 20


def rank_key(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}duration").alias("duration"), F.col(f"{prefix}path").alias("path"))


def salts(items: DataFrame) -> int:
    """Parts into which the largest duration bin has to be divided."""
    largest = items.groupBy(band_bin(F.col("duration")).alias("b")).count().agg(F.max("count")).first()[0] or 0
    return -(-largest // BIN_ROWS) or 1


def band_join(probes: DataFrame, items: DataFrame, low: Column, high: Column, matches: Column, parts: int = 1) -> DataFrame:
    """Probes (columns ``p_*``) with the items (``i_*``) whose duration is from
    ``low`` to ``high``, where ``matches`` holds.

    An item has one bin and one part, so no pair occurs twice; a probe goes to
    every bin of its band and every part.
    """
    spread = probes.withColumn("bin", F.explode(F.sequence(band_bin(low), band_bin(high))))
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = items.withColumn("bin", band_bin(F.col("i_duration"))).withColumn("part", F.pmod(F.xxhash64("i_id"), F.lit(parts)).cast("int"))
    return spread.join(held, ["bin", "part"]).where((F.col("i_duration") >= low) & (F.col("i_duration") <= high) & matches).drop("bin", "part")


def prefixed(items: DataFrame, prefix: str, words: Sequence[str]) -> DataFrame:
    return items.select(*(F.col(c).alias(prefix + c) for c in ("id", "path", "duration", *words)))


def distance_of(words: Sequence[str]) -> Column:
    return hamming([F.col(f"p_{w}") for w in words], [F.col(f"i_{w}") for w in words])


def similar_pairs(items: DataFrame, tolerance: float = LIBRARY_TOLERANCE, words: Sequence[str] = ("w0",), scale: int = HASH_BITS) -> DataFrame:
    """``u, v, u_path, v_path, distance``: pairs in the self-search band within
    the tolerance, u first in order."""
    later = (F.col("i_duration") > F.col("p_duration")) | (F.col("i_duration") == F.col("p_duration")) & (F.col("i_path") > F.col("p_path"))
    near = distance_of(words) <= tolerance_bits(tolerance, scale)
    found = band_join(prefixed(items, "p_", words), prefixed(items, "i_", words), F.col("p_duration"), self_band_end(F.col("p_duration")), later & near, salts(items))
    return found.select(
        F.col("p_id").alias("u"), F.col("i_id").alias("v"), F.col("p_path").alias("u_path"), F.col("i_path").alias("v_path"),
        F.col("p_duration").alias("u_duration"), F.col("i_duration").alias("v_duration"), distance_of(words).alias("distance"),
    )


def leaders(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``id`` of the leaders among the items of ``pairs`` (u before v).

    In a round, items without an undecided earlier neighbour lead, and theirs
    are claimed; both leave the graph, and who is left without an undecided
    neighbour leads as well.  A round writes one table: its pairs, with what
    became of either end.  What ``rounds`` rounds leave, such as long chains, is
    scanned component by component.
    """
    open_pairs = pairs.select("u", "v", "u_duration", "u_path", "v_duration", "v_path")
    found = None
    for _ in range(rounds):
        judged = materialize(judge(open_pairs), "search-round")
        lead = materialize(decided(judged), "search-lead")
        found = lead if found is None else found.unionByName(lead)
        open_pairs = judged.where("open").drop("lead", "claimed", "other_claimed", "open")
        if open_pairs.isEmpty():
            return found
    return found.unionByName(scan_components(open_pairs))


def judge(open_pairs: DataFrame) -> DataFrame:
    """The pairs of a round with whether u leads, u or v is claimed, and the pair
    stays open."""
    blocked = open_pairs.select(F.col("v").alias("u")).distinct().withColumn("blocked", F.lit(True))
    led = open_pairs.join(blocked, "u", "left").withColumn("lead", F.col("blocked").isNull()).drop("blocked")
    gone = led.where("lead").select(F.col("v").alias("x")).distinct().withColumn("claimed", F.lit(True))
    tagged = led.join(gone.withColumnRenamed("x", "u"), "u", "left").join(gone.withColumnRenamed("x", "v").withColumnRenamed("claimed", "other_claimed"), "v", "left")
    tagged = tagged.fillna(False, ["claimed", "other_claimed"])
    return tagged.withColumn("open", ~F.col("lead") & ~F.col("claimed") & ~F.col("other_claimed"))


def decided(judged: DataFrame) -> DataFrame:
    """``id`` of the items of a round that lead: those no earlier one is open for,
    and those that neither lead nor are claimed but have no open pair left."""
    u = judged.select(F.col("u").alias("id"), "lead", "claimed", "open")
    v = judged.select(F.col("v").alias("id"), F.lit(False).alias("lead"), F.col("other_claimed").alias("claimed"), "open")
    ends = u.unionByName(v).groupBy("id").agg(*(F.max(c).alias(c) for c in ("lead", "claimed", "open")))
    return ends.where("lead or not (claimed or open)").select("id")


def scan_components(pairs: DataFrame) -> DataFrame:
    """Leaders by a scan of each connected component."""
    named = connected_components(pairs.select("u", "v"), "search-components")
    rows = pairs.join(named.withColumnRenamed("node", "u"), "u")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        order = {}
        for side in "uv":
            order |= {i: (d, p.encode()) for i, d, p in zip(pdf[side], pdf[f"{side}_duration"], pdf[f"{side}_path"], strict=True)}
        later: dict = {}
        for u, v in zip(pdf["u"], pdf["v"], strict=True):
            later.setdefault(u, []).append(v)
        claimed, out = set(), []
        for item in sorted(order, key=order.get):
            if item not in claimed:
                out.append(item)
                claimed.update(later.get(item, ()))
        return pd.DataFrame({"id": out})

    return rows.groupBy("root").applyInPandas(scan, "id bigint")


def search(items: DataFrame, tolerance: float = LIBRARY_TOLERANCE, words: Sequence[str] = ("w0",), scale: int = HASH_BITS) -> DataFrame:
    """Groups of a self search: ``leader, member, leader_path, member_path,
    leader_duration, member_duration, distance``, one row a claimed member;
    items that are alone are not listed."""
    pairs = materialize(similar_pairs(items, tolerance, words, scale), "search-pairs")
    lead = leaders(pairs)
    claims = pairs.join(lead.select(F.col("id").alias("u")), "u", "left_semi")
    first = F.min(F.struct(F.col("u_duration"), F.col("u_path"), F.col("u"), F.col("distance"))).alias("m")
    return claims.groupBy("v", "v_path", "v_duration").agg(first).select(
        F.col("m.u").alias("leader"), F.col("v").alias("member"), F.col("m.u_path").alias("leader_path"), F.col("v_path").alias("member_path"),
        F.col("m.u_duration").alias("leader_duration"), F.col("v_duration").alias("member_duration"), F.col("m.distance").alias("distance"),
    )


def search_with_references(references: DataFrame, candidates: DataFrame, tolerance: float = LIBRARY_TOLERANCE, words: Sequence[str] = ("w0",), scale: int = HASH_BITS, exclusive: bool = False) -> DataFrame:
    """``reference, candidate, reference_path, candidate_path, distance``: all
    candidates in the reference band within the tolerance.  A candidate may
    belong to several references, or, where ``exclusive``, to the first only.
    """
    low, high = reference_band(F.col("p_duration"))
    near = distance_of(words) <= tolerance_bits(tolerance, scale)
    found = band_join(prefixed(references, "p_", words), prefixed(candidates, "i_", words), low, high, near, salts(candidates))
    found = found.select(
        F.col("p_id").alias("reference"), F.col("i_id").alias("candidate"), F.col("p_path").alias("reference_path"), F.col("i_path").alias("candidate_path"),
        F.col("p_duration").alias("reference_duration"), distance_of(words).alias("distance"),
    )
    if exclusive:
        first = F.min(F.struct("reference_duration", "reference_path", "reference", "distance")).alias("m")
        found = found.groupBy("candidate", "candidate_path").agg(first).select("m.reference", "candidate", "m.reference_path", "candidate_path", "m.reference_duration", "m.distance")
    return found.drop("reference_duration")
