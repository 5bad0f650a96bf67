"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import discard, materialize, small_broadcasts


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint).

    Alternates large-star and small-star steps, whose number grows with the
    logarithm of the longest path; every round is written to the shared
    folder.  The root of a component is its smallest node.  Self loops vanish.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Hang what is above (large) or not above (small) each node on its
        smallest neighbour."""
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.where("v < u")
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = near.join(low, "u")
        if large:
            out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The pairs as a table, and a mark of them, which is made on the way."""
        seen = Observation()
        marks = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        with small_broadcasts(edges.sparkSession):
            out = materialize(df.observe(seen, *marks), name)
        return out, (seen.get["n"], seen.get["s"])

    pairs, before = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while before[0]:
        last = pairs
        pairs, after = written(star(star(pairs, True), False))
        discard(last)
        if after == before:
            break
        before = after
    roots = pairs.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
