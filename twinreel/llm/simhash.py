"""SimHash near-deduplication with Golay-code fuzzy hashing.

A fingerprint is cut into segments.  The perfect Golay code of length 23
decodes any segment to the codeword within three bits; a segment's keys are
that codeword's index (``near``) and, besides, the indices of the codewords at
four bits (five of them if the nearest is at three bits, else none).  If two
segments differ in one bit at most, ``near`` of either is among the keys of
the other.  So rows of two kinds meet: ``near`` on one side, all keys on the
other.

Up to three errors fall on the three segments of 64 bits either so that one
segment has none, and then another has one at most, or so that each has one.
Hence the keys join (exact segment, Golay segment) for every ordered pair, and
all three Golay segments; together they miss no pair within three bits, and
each key has 33 bits or more.  Candidates are verified on whole fingerprints.

Copies collapse to one row a fingerprint before any key is made.  Links of a
crowded key are found in two steps, lest a large group of near copies emit all
its pairs: first every fingerprint is compared with one pivot of each of its
keys, and then only pairs whose components still differ are joined, the largest
component of a key not with itself.  Where a key's components are so many that
this would take more than CROSSING pairs a row, its fingerprints meet by balls
instead: one side goes to all values within one bit, the other to all within two,
so that any two within three bits have a value in common.  That is a fixed number
of rows for each fingerprint, however many there are.

Empty and null texts have fingerprint zero and link like any other, very long
ones are taken whole.  Rows that repeat an id get the same component, named by
the smallest id, and rows without an id that are alone one without a name.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, permutations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, map_arrow, map_texts, materialize, small_broadcasts

#: x^11+x^10+x^6+x^5+x^4+x^2+1 generates the Golay code (fixed value).
GENERATOR = 0b110001110101
#: Segments of a 64-bit fingerprint: (lowest bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, the error pattern of up to
    three bits for each syndrome, and its five patterns of four bits (zero
    where the lighter pattern has fewer than three)."""
    powers = [1]
    for _ in range(22):
        x = powers[-1] << 1
        powers.append(x ^ GENERATOR if x >> 11 else x)
    single = np.array(powers, np.uint16)

    def span(bits: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.uint16)
        for s in bits:
            out = np.concatenate([out, out ^ s])
        return out

    error, fours = np.zeros(2048, np.uint32), [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome = int(np.bitwise_xor.reduce(single[list(places)])) if places else 0
            pattern = sum(1 << p for p in places)
            if weight < 4:
                error[syndrome] = pattern
            else:
                fours[syndrome].append(pattern)
    four = np.zeros((2048, 5), np.uint32)
    for s, patterns in enumerate(fours):
        four[s, : len(patterns)] = patterns
    return span(single[:12]), span(single[12:]), error, four


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n, 6) of the codewords within four bits of each segment, the
    nearest first, and which of the six there are."""
    low, high, error, four = tables()
    segment = segment.astype(np.uint32)
    syndrome = low[segment & 0xFFF] ^ high[segment >> 12]
    patterns = np.concatenate([error[syndrome][:, None], four[syndrome]], axis=1)
    there = patterns != 0
    there[:, 0] = True
    return (segment[:, None] ^ patterns) >> 11, there


#: Bits in which fingerprints that link may differ.
RADIUS = 3
NEAR_SIDE, ALL_SIDE = 1, 2
#: Nodes of which one task makes the keys.
TASK_NODES = 100_000
#: Pairs across components for each row of a key, beyond which its nodes meet by
#: balls, and nodes that are spread over their balls at once.
CROSSING, BALL_NODES = 1_000, 256


def rows_of(shape: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and packed keys of all combinations of the given columns."""
    n = len(shape[0][0])
    key, there = np.zeros((n, 1), np.int64), np.ones((n, 1), bool)
    for values, valid in shape:
        key = (key[:, :, None] << 12 | values[:, None, :].astype(np.int64)).reshape(n, -1)
        there = (there[:, :, None] & valid[:, None, :]).reshape(n, -1)
    row, place = np.nonzero(there)
    return row, key[row, place]


def complete_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) such that any two fingerprints within three bits share
    a key, once on the near side and once on the other."""
    word = words[:, 0]
    parts = [(word >> np.uint64(at)) & np.uint64((1 << bits) - 1) for at, bits in SEGMENTS]
    golay = [golay_keys(p) for p in parts]
    near = [(k[:, :1], t[:, :1]) for k, t in golay]
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    for table, (x, y) in enumerate(permutations(range(3), 2)):
        exact = parts[x].astype(np.int64) << 12 | table << 40
        for shape, side in ((near[y], NEAR_SIDE | ALL_SIDE), ((golay[y][0][:, 1:], golay[y][1][:, 1:]), ALL_SIDE)):
            row, key = rows_of([shape])
            out.append((row, exact[row] | key, side))
    row, key = rows_of([near[0], near[1], golay[2]])
    out.append((row, key | 6 << 40, NEAR_SIDE))
    row, key = rows_of([golay[0], golay[1], near[2]])
    out.append((row, key | 6 << 40, ALL_SIDE))
    return pack(out)


def pack(parts: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.concatenate([r for r, _, _ in parts]),
        np.concatenate([k for _, k, _ in parts]),
        np.concatenate([np.full(len(r), s, np.int8) for r, _, s in parts]),
    )


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; of all words if
    they are fewer, and none without words.  Only A-Z are lower-cased."""
    import xxhash

    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if len(words) >= width:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    else:
        shingles = iter([b" ".join(words)] if words else [])
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (64 bits in a bigint) of every row."""

    def make():
        return lambda ids, texts: [ids, [majority(shingle_hashes(t, width, seed)) for t in texts]]

    typed = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_texts(typed, make, "id bigint, fp bigint", pa.schema([("id", pa.int64()), ("fp", pa.int64())]), "id", "text")


def crowded_keys(nodes: DataFrame, keys: Callable, words: list[str], radius: int, name: str) -> DataFrame:
    """``key, side, node, check, pivot, pivot_check, crowd`` of the keys that
    several nodes share, with the node of least hash as the pivot of its key.  A
    key of two nodes has one pair, so it is listed only if the two are near.

    ``nodes`` has a bigint ``node``, a bigint ``check`` by which pairs are
    sieved, and the fingerprint in ``words``.
    """
    arrow = pa.schema([("key", pa.int64()), ("side", pa.int8()), ("node", pa.int64()), ("check", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                node, check, *rest = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                row, key, side = keys(np.stack(rest, axis=1).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(node[row]), pa.array(check[row])], schema=arrow)

    # a node becomes some sixty rows, so tasks are dealt by nodes and not by bytes
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // TASK_NODES + 1)
    made = map_arrow(nodes.select("node", "check", *words).repartition(tasks, "node"), emit, "key bigint, side tinyint, node bigint, check bigint")
    pivot = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "check")).alias("p")
    shared = made.groupBy("key").agg(pivot, F.max("node").alias("last"), F.min("node").alias("first"), F.bit_or("side").alias("sides"), F.count("*").alias("crowd"))
    shared = shared.where(f"first <> last and sides = {NEAR_SIDE | ALL_SIDE}").select("key", F.col("p.node").alias("pivot"), F.col("p.check").alias("pivot_check"), "crowd")
    with small_broadcasts(nodes.sparkSession):
        # Spark takes what is made of the nodes for as small as them, and would broadcast it
        return materialize(made.hint("merge").join(shared, "key").where(f"crowd > 2 or ({near_pivot(radius)})"), name)


def near_pivot(radius: int) -> str:
    """Whether a row of ``crowded_keys`` is near its key's pivot."""
    return f"node <> pivot and bit_count(check ^ pivot_check) <= {radius}"


def masks(radius: int) -> np.ndarray:
    """All words of 64 bits of which ``radius`` or fewer are set."""
    return np.array([sum(1 << b for b in places) for n in range(radius + 1) for places in combinations(range(64), n)], np.uint64)


def balls(nodes: DataFrame, radius: int) -> DataFrame:
    """``code, node, check, root`` for every value within ``radius`` bits of each
    node's check."""
    arrow = pa.schema([(n, pa.int64()) for n in ("code", "node", "check", "root")])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = masks(radius)
        for batch in batches:
            for at in range(0, batch.num_rows, BALL_NODES):
                node, check, root = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, BALL_NODES).columns)
                codes = (check.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes), *(pa.array(np.repeat(x, len(flips))) for x in (node, check, root))], schema=arrow)

    return map_arrow(nodes.select("node", "check", "root"), spread, "code bigint, node bigint, check bigint, root bigint")


def split_keys(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of keys that hold several components: ``main`` is that of most rows of
    the key, ``crowd`` its rows, and ``pairs`` how many pairs lie across."""
    placed = crowd.where("crowd > 2").select("key", "side", "node", "check").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = parts.groupBy("key").agg(F.sum("c").alias("crowd"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max_by("root", "c").alias("main"), F.count("*").alias("roots"))
    keys = keys.where("roots > 1").select("key", "crowd", "main", ((F.col("crowd") * F.col("crowd") - F.col("squares")) / 2).alias("pairs"))
    return placed.join(keys, "key")


def crossing_pairs(split: DataFrame, radius: int) -> DataFrame:
    """Pairs (u, v) across components of a key whose checks are within the radius."""
    few, many = split.where(f"pairs <= {CROSSING} * crowd"), split.where(f"pairs > {CROSSING} * crowd")
    near, every = few.where(f"(side & {NEAR_SIDE}) > 0"), few.where(f"(side & {ALL_SIDE}) > 0")
    link = f"a.node <> b.node and a.root <> b.root and bit_count(a.check ^ b.check) <= {radius}"
    ends = [F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")]

    def met(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
        return a.hint("merge").alias("a").join(b.alias("b"), F.expr(f"a.{on} = b.{on} and {link}")).select(*ends)

    out = met(near.where("root <> main"), every, "key").unionByName(met(near.where("root = main"), every.where("root <> main"), "key"))
    if not many.isEmpty():
        nodes = many.select("node", "check", "root").distinct()
        out = out.unionByName(met(balls(nodes, radius // 2), balls(nodes, radius - radius // 2), "code"))
    return out.distinct()


def components(nodes: DataFrame, keys: Callable, words: list[str], radius: int, name: str = "simhash") -> DataFrame:
    """``node, root`` of the nodes that link to any other: two nodes link if their
    ``check`` differs in ``radius`` bits at most."""
    crowd = crowded_keys(nodes, keys, words, radius, f"{name}-keys")
    near = crowd.where(near_pivot(radius)).select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v"))
    with small_broadcasts(nodes.sparkSession):
        spokes = materialize(near.distinct(), f"{name}-spokes")
        split = materialize(split_keys(crowd, connected_components(spokes, f"{name}-roots")), f"{name}-split")
        discard(crowd)
        linked = connected_components(spokes.unionByName(crossing_pairs(split, radius)), f"{name}-all")
    discard(spokes, split)
    return linked


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, fp, component_id`` of every row: fingerprints link at three bits or
    fewer, and a component is named by its smallest id."""
    rows = materialize(fingerprints(docs, width, 42, id_col, text_col), "simhash-rows")
    nodes = rows.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("first_id"))
    linked = components(nodes.select("node", F.col("node").alias("check"), F.col("node").alias("word")), complete_keys, ["word"], RADIUS)
    placed = nodes.join(linked, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    with small_broadcasts(docs.sparkSession):
        found = materialize(rows.join(named, "fp").select("id", "fp", "component_id"), "simhash-groups")
    discard(rows)
    return found
