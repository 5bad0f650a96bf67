"""Sharding by a k-d tree over document metadata.

The unit is a group of equal texts, which never straddles shards; its weight
is the bytes of all its rows, its place that of its row of smallest id.  The
tree starts with one node of all shards.  A node of several shards is split
along its widest dimension, extents being shares of the whole table's, at the
weighted median, or where it has an odd number of shards at the quantile that
gives each side bytes in proportion to its shards, until every leaf has one
shard, which is the target of total / shards bytes.

The medians are distributed.  Ties along a dimension are ordered by a hash of
the text, so that the order is total: a dimension's value and the hash make a
48-bit key.  For every node of a level one aggregation sums the weights in
``BINS`` equal intervals of the keys between the node's extremes, and further
ones refine the interval that holds the quantile.  The driver sees nodes times
bins numbers, whatever the table's size.

Null texts are empty.  Rows that repeat an id keep their own slots.  An empty
table gives an empty result.  Groups heavier than a shard's target, of which
there are fewer than shards, stay whole as well: each has a shard to itself,
and the tree divides the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

BINS = 4096
#: Rows that one window of slots should hold.
SLOT_ROWS = 50_000
#: Bits of a dimension's value and of the tie-breaking hash below it.
VALUE_BITS, HASH_BITS = 20, 28


def scaled(value: Column, low: float, high: float) -> Column:
    """The value as a number of VALUE_BITS bits, by its place in the range."""
    top = (1 << VALUE_BITS) - 1
    return F.least(F.lit(top), F.greatest(F.lit(0), ((value - low) * (top / (high - low) if high > low else 0.0)).cast("bigint"))).cast("bigint")


def key_of(dimension: Column, tie: Column) -> Column:
    return F.shiftleft(dimension, HASH_BITS).bitwiseOR(tie)


def units(docs: DataFrame, id_col: str, text_col: str, source_col: str | None, lang_col: str | None) -> DataFrame:
    """``row tables``: one row a distinct text with its weight and dimensions."""

    def code(name: str | None) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(1 << 20)) if name else F.lit(0).cast("bigint")

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"), code(source_col).alias("source"), code(lang_col).alias("lang"))
    rows = rows.select("id", F.octet_length("text").cast("bigint").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "source", "lang")
    first = F.min(F.struct(F.coalesce("id", F.lit(-1)).alias("id"), "source", "lang"))
    grouped = rows.groupBy("digest").agg(F.sum(F.col("n") + 8).alias("weight"), F.max("n").alias("n"), first.alias("at"))
    tie = F.conv(F.substring("digest", 1, HASH_BITS // 4), 16, 10).cast("bigint")
    return grouped.select("digest", "weight", tie.alias("tie"), F.log2(F.col("n") + 1.0).alias("length"), F.col("at.id").cast("double").alias("age"), F.col("at.source").cast("double").alias("source"), F.col("at.lang").cast("double").alias("lang"))


DIMENSIONS = ("length", "age", "source", "lang")


def aside(placed: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """``placed`` with what ``rows`` has for its node: one row for each of the
    nodes of a level, so no more than shards."""
    values = ", ".join(map(str, rows))
    return placed.join(F.broadcast(placed.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({names})")), "node")


def split_points(placed: DataFrame, nodes: dict[int, int]) -> dict[int, tuple[str, int]]:
    """For each node of several shards its dimension and the key from which on
    units go right.  ``nodes`` has the shards of every node to split."""
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    dimension, low, high, want, below = {}, {}, {}, {}, {}
    for r in placed.groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect():
        n = r["node"]
        dimension[n] = widest = max(DIMENSIONS, key=lambda d: r[f"max_{d}"] - r[f"min_{d}"])
        low[n], high[n] = r[f"min_{widest}"] << HASH_BITS, (r[f"max_{widest}"] + 1) << HASH_BITS
        want[n], below[n] = r["w"] * (nodes[n] // 2) / nodes[n], 0
    key = key_of(F.coalesce(*(F.when(F.col("d") == d, F.col(d)) for d in DIMENSIONS)), F.col("tie"))
    while open_nodes := [n for n in low if high[n] - low[n] > 1]:
        step = {n: -(-(high[n] - low[n]) // BINS) for n in open_nodes}
        rows = [(n, dimension[n], low[n], high[n], step[n]) for n in open_nodes]
        inside = aside(placed, rows, "node, d, low, high, step").withColumn("key", key).where("key >= low and key < high")
        sums: dict[int, dict[int, int]] = {n: {} for n in open_nodes}
        for r in inside.groupBy("node", F.expr("(key - low) div step").alias("bin")).agg(F.sum("weight").alias("w")).collect():
            sums[r["node"]][r["bin"]] = r["w"]
        for n, bins in sums.items():
            for b in sorted(bins):
                if below[n] + bins[b] > want[n]:
                    break
                below[n] += bins[b]
            low[n], high[n] = low[n] + b * step[n], min(high[n], low[n] + (b + 1) * step[n])
            if high[n] - low[n] == 1 and want[n] - below[n] > below[n] + bins[b] - want[n]:
                low[n] = high[n]  # most of the unit at the quantile lies on its left
    return {n: (dimension[n], low[n]) for n in low}


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", lang_col: str | None = "lang") -> DataFrame:
    """``digest, shard`` of every distinct text."""
    raw = materialize(units(docs, id_col, text_col, source_col, lang_col), "kd-units")
    edges = raw.agg(F.sum("weight").alias("w"), *(f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max))).first()
    known = {d: (edges[f"min_{d}"] or 0.0, edges[f"max_{d}"] or 0.0) for d in DIMENSIONS}
    rest, heavy = edges["w"] or 0, []
    for r in raw.orderBy(F.desc("weight"), "digest").limit(shards).select("digest", "weight").collect():
        if len(heavy) == shards - 1 or r["weight"] * (shards - len(heavy)) <= rest:
            break
        heavy.append(r["digest"])
        rest -= r["weight"]
    own = F.coalesce(*(F.when(F.col("digest") == d, F.lit(shards - 1 - i)) for i, d in enumerate(heavy)), F.lit(0))
    placed = raw.select("digest", "weight", (F.col("tie") % (1 << HASH_BITS)).alias("tie"), *(scaled(F.col(d), *known[d]).alias(d) for d in DIMENSIONS), own.alias("node"))
    # a node is named by its first shard
    sizes = {0: shards - len(heavy)}
    while open_nodes := {n: s for n, s in sizes.items() if s > 1}:
        placed = materialize(placed, "kd-level")
        points = split_points(placed.where(F.col("node").isin(*open_nodes)), open_nodes)
        rows = [(n, *points.get(n, (DIMENSIONS[0], 0)), open_nodes.get(n, 0) // 2) for n in [*sizes, *range(shards - len(heavy), shards)]]
        right = F.coalesce(*(F.when(F.col("d") == d, key_of(F.col(d), F.col("tie")) >= F.col("cut")) for d in DIMENSIONS))
        placed = aside(placed, rows, "node, d, cut, move").withColumn("node", F.when(right, F.col("node") + F.col("move")).otherwise(F.col("node"))).drop("d", "cut", "move")
        for n, s in open_nodes.items():
            sizes[n], sizes[n + s // 2] = s // 2, s - s // 2
    return placed.select("digest", F.col("node").alias("shard"))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", lang_col: str | None = "lang") -> DataFrame:
    """``id, size, text_crc32, shard, slot`` of every row; slots of a shard have
    no gaps.  They are numbered bucket by bucket, a bucket being a hash range
    of ids, so that no task sorts a whole shard."""
    where = assign(docs, shards, id_col, text_col, source_col, lang_col)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("digest"))
    rows = materialize(rows.join(where, "digest").select("id", "size", "text_crc32", "shard"), "kd-rows")
    buckets = max(1, rows.count() // shards // SLOT_ROWS * 2)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "bucket", before.alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(order) - 1).join(starts, ["shard", "bucket"])
    return numbered.select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("bigint").alias("slot"))
