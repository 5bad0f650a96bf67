"""Exact deduplication by an extendible-hash index on shared files.

A text's key is its 64-bit hash.  The directory starts with one bucket; an
overfull bucket is split by one more leading bit of the key, and the directory
doubles whenever a bucket as deep as itself is split.  What a split needs is a
histogram of leading key bits, which is bounded by MAX_DEPTH and not by the rows;
beyond 2 ** MAX_DEPTH full buckets they grow, which costs time and no memory, as
owners stream.  Copies share all their bits, so no split parts them; but each mapper
combines equal texts before the shuffle, and a bucket gets one entry a text and
mapper however many copies there are.

Each bucket has an owner task of its own, and their keys are ranges that follow
one another.  An owner walks its range in order, chains the texts that share a
key and tells them apart by their bytes.  The finished index (one row a
distinct text) is written to shared files and probed by key; a chain of
several texts, which 64 bits make rare, is probed by text as well.

Null and empty texts are equal.  Rows that repeat an id share its fate.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, map_arrow, materialize, text_or_empty

#: Bytes of text that a bucket holds before it is split.
BUCKET_BYTES = 32 << 20
#: Leading bits that the directory uses at first, and at most.
START_DEPTH, MAX_DEPTH = 14, 20

PARTIAL = "bucket int, key bigint, text string, keep_id bigint, n bigint"
INDEX = "key bigint, chain int, chains int, keep_id bigint, group_size bigint, text_sha256 string, text string"
PARTIAL_ARROW = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("text", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64())])
INDEX_ARROW = pa.schema(
    [("key", pa.int64()), ("chain", pa.int32()), ("chains", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string()), ("text", pa.string())]
)


def directory(histogram: dict[int, int], max_depth: int = MAX_DEPTH, capacity: int = BUCKET_BYTES) -> tuple[int, list[int]]:
    """(global depth, bucket of each slot) from bytes by leading bits.

    ``histogram`` has the bytes of each prefix of ``max_depth`` bits.
    """
    sums = np.zeros(1 << max_depth, np.int64)
    for prefix, size in histogram.items():
        sums[prefix] = size
    levels = [sums]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(1))
    levels.reverse()  # levels[d][prefix of d bits]
    depth, buckets, full = 0, [], [(0, 0)]
    while full:
        local, prefix = full.pop()
        if local < max_depth and levels[local][prefix] > capacity:
            depth = max(depth, local + 1)  # the directory doubles
            full += [(local + 1, 2 * prefix + 1), (local + 1, 2 * prefix)]
        else:
            buckets.append((local, prefix))
    slots: list[int] = []
    for number, (local, _) in enumerate(buckets):  # in the order of their keys
        slots += [number] * (1 << (depth - local))
    return depth, slots


def combine(batches: Iterator[pa.RecordBatch], depth: int = 0, slots: np.ndarray | None = None, limit: int = 8 * BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Merge equal texts of a mapper, ``limit`` bytes of distinct ones at once, and
    look up their bucket in the directory."""
    slots = np.zeros(1, np.int32) if slots is None else slots
    seen: dict[tuple[int, str], list[int]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        items, size, part = list(seen.items()), 0, []
        for item in items:
            part.append(item)
            size += len(item[0][1])
            if size > BATCH_BYTES:
                yield pack(part)
                size, part = 0, []
        if part:
            yield pack(part)

    def pack(part: list) -> pa.RecordBatch:
        keys = np.array([k for (k, _), _ in part], np.int64).view(np.uint64)
        buckets = slots[(keys >> np.uint64(64 - depth)).astype(np.int64)] if depth else np.zeros(len(part), np.int32)
        return pa.RecordBatch.from_pydict(
            {"bucket": pa.array(buckets), "key": [k for (k, _), _ in part], "text": [t for (_, t), _ in part], "keep_id": [v[0] for _, v in part], "n": [v[1] for _, v in part]},
            schema=PARTIAL_ARROW,
        )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, text, doc, n = row
            found = seen.get((key, text))
            if found is None:
                seen[key, text] = [doc, n]
                held += len(text)
                if held > limit:
                    yield from flush()
                    seen.clear()
                    held = 0
            else:
                found[1] += n
                if found[0] is None or doc is not None and doc > found[0]:
                    found[0] = doc
    yield from flush()


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the entries of each key, which come in key order."""
    import hashlib

    key, chain, out = None, {}, []

    def close() -> None:
        for place, (text, (keep, n)) in enumerate(chain.items()):
            digest = hashlib.sha256(text.encode()).hexdigest()
            out.append((key, place, len(chain), keep, n, digest, text if len(chain) > 1 else None))

    def pack() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(INDEX_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INDEX_ARROW, strict=True)], schema=INDEX_ARROW)

    for batch in batches:
        for k, text, doc, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                close()
                key, chain = k, {}
                if len(out) >= 4096:
                    yield pack()
                    out.clear()
            entry = chain.get(text)  # a dict finds its place by hash, then compares the texts
            if entry is None:
                chain[text] = [doc, n]
            else:
                entry[1] += n
                if entry[0] is None or doc is not None and doc > entry[0]:
                    entry[0] = doc
    close()
    yield pack()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, max_depth: int | None = None) -> DataFrame:
    """The index as shared files, one row a distinct text: ``key, chain,
    chains`` (place in the key's chain, its length), ``keep_id`` (largest id),
    ``group_size, text_sha256`` and, in chains of several, ``text``."""
    spark: SparkSession = docs.sparkSession
    keyed = docs.select(F.xxhash64(text_or_empty(text_col)).alias("key"), text_or_empty(text_col).alias("text"), F.col(id_col).cast("bigint").alias("keep_id"), F.lit(1).cast("bigint").alias("n"))
    # one entry a key: copies do not count again
    sizes = keyed.groupBy("key").agg(F.max(F.octet_length("text").cast("bigint") + 64).alias("size"))

    def histogram(bits: int) -> dict[int, int]:
        prefix = F.shiftrightunsigned("key", 64 - bits).alias("p")
        return {r[0]: r[1] for r in sizes.groupBy(prefix).agg(F.sum("size")).collect()}

    bits = max_depth or START_DEPTH
    counted = histogram(bits)
    if max_depth is None and sum(counted.values()) > bucket_bytes << (START_DEPTH - 3):  # the first bits would not part them
        bits = MAX_DEPTH
        counted = histogram(bits)
    depth, slots = directory(counted, bits, bucket_bytes)
    sent = spark.sparkContext.broadcast(np.array(slots, np.int32))
    routed = (
        map_arrow(keyed, lambda batches: combine(batches, depth, sent.value), PARTIAL)
        .repartitionById(max(slots, default=0) + 1, F.col("bucket"))
        .sortWithinPartitions("key")
        .select("key", "text", "keep_id", "n")
    )
    return materialize(map_arrow(routed, own, INDEX), "extendible-hash")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` of every row."""
    index = build_index(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("key"), text_or_empty(text_col).alias("text"))
    entry = ["keep_id", "group_size", "text_sha256"]
    found = rows.select("id", "key").join(index.where("chains = 1").select("key", *entry), "key").drop("key")
    chained = index.where("chains > 1")
    if not chained.isEmpty():  # keys that several texts share are told apart by the text
        found = found.unionByName(rows.join(chained.select("key", "text", *entry), ["key", "text"]).drop("key", "text"))
    return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, of equal texts the row of the largest id."""
    kept = groups(docs, id_col, text_col, **options).where("kept").select(F.col("id").alias(id_col)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[id_col]), "left_semi")
