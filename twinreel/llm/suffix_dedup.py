"""Removal of repeated byte strings by suffix arrays, and passages of words that
documents share.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere
else in the table, in the same document or another.  Besides, ``n_passages``
counts the maximal runs of words of a row that strings of PASSAGE words cover
which rows of other ids have as well, whatever their bytes, for a passage of few
letters a word is shorter than LENGTH.  Both are the same search over another
kind of symbol: bytes, or 64-bit hashes of the words that white space parts.

*Shards.*  Equal strings must meet, so a string is sent to the shard of its
anchor: of its k-grams the one of least hash, the leftmost of several; shorter
grams make fewer anchors, longer ones keep unlike strings apart.  Strings of one document that share an anchor follow one another and
make one context, the symbols from the first to the end of the last.  An anchor
whose hash occurs once cannot hold a repeated string; contexts that occur
several times are repeated as a whole.  Both are settled by counting hashes,
and only anchors with different contexts go on, with one copy of each context.

*Suffix arrays.*  A shard of contexts is one array of symbols with separators.
Larsson-Sadakane refinement sorts its suffixes in numpy, by as many symbols as
a string has: symbols are packed to begin with, and each round doubles the sorted
prefix by ranks, up to the length exactly, but moves only suffixes whose rank is
shared.  Suffixes that share theirs in the end begin with the same string.
Before, contexts leave that have no stretch around their anchor with another one
of it, which all strings of that place would cover.

*Merging.*  An anchor with more than SHARD_CONTEXTS contexts is divided over
several shards.  These hand on their distinct strings as sorted hashes, cut at
fixed bounds by binary search, and what lies between two bounds is looked up
in the other shards' runs, again by binary search.

Contexts are compared by polynomial hashes of 64 bits over mixed symbols, which
strings this short cannot defeat by their structure, and strings of divided
anchors by 64 bits of BLAKE2b; both within an anchor only, itself a hash of 64
bits over part of the string.  So two strings are taken for equal by 128 bits, and
within a shard by their symbols.
Null and empty texts have no bytes and lose none; texts shorter than LENGTH lose
none.  Rows that repeat an id and a text each count and get the same result.
Rows without an id count as one document's where passages are concerned.  Very
long texts are anchored piece by piece, each reaching into the next, so that no
string is cut.  Ties between equal grams go to the leftmost.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, map_arrow, materialize, row_slices, text_or_empty

LENGTH = 400
#: Words of the passages that are looked for across documents.
PASSAGE = 51
#: Contexts of one anchor that one shard holds at most.
SHARD_CONTEXTS = 512
#: Ranges of an anchor's offsets in which contexts are compared beforehand.
CUTS = 4
#: Symbols that one suffix array is built over, unless one context is longer.
BLOCK_SYMBOLS = 1 << 20
#: Bytes of a text that are anchored at once; a position takes 24 bits.
PIECE = 1 << 22
POSITION = (1 << 24) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Rolling:
    """Polynomial hashes of parts of a sequence of 64-bit values."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if len(self.up) < n:
            size = 1 << n.bit_length()
            step, back = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        out = np.zeros(n, np.uint64)
        np.cumsum(values * self.up[: n - 1], out=out[1:])
        return out

    def parts(self, sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts])


class Bytes:
    """A text as its bytes."""

    width, across = 1, False

    def __init__(self):
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

    def symbols(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8)

    def values(self, symbols: np.ndarray) -> np.ndarray:
        return self.table[symbols]


class Words:
    """A text as hashes of its words; only strings of other documents count."""

    width, across = 8, True

    def __init__(self):
        self.rolling, self.letters = Rolling(), Bytes()

    def symbols(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        letter = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        starts, ends = edges[::2], edges[1::2]
        out = [np.zeros(0, np.uint64)]
        at = 0
        while at < len(starts):  # words that start in one piece; the last may reach beyond
            low = int(starts[at])
            to = int(np.searchsorted(starts, low + PIECE))
            sums = self.rolling.sums(self.letters.values(data[low : int(ends[to - 1])]))
            out.append(self.rolling.parts(sums, starts[at:to] - low, ends[at:to] - low))
            at = to
        return np.concatenate(out)

    def values(self, symbols: np.ndarray) -> np.ndarray:
        return symbols


class Anchors:
    """Anchors of a text's strings."""

    def __init__(self, unit: Bytes | Words, length: int, gram: int):
        self.unit, self.length, self.gram, self.rolling = unit, length, gram, Rolling()

    def of(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor, context, place, first start, last start), as arrays, of the
        contexts of each piece."""
        for at in range(0, max(0, len(symbols) - self.length + 1), PIECE):
            hashes, contexts, places, first, last = self._piece(self.unit.values(symbols[at : at + PIECE + self.length - 1]))
            yield hashes, contexts, places + at, first + at, last + at

    def _piece(self, values: np.ndarray) -> tuple[np.ndarray, ...]:
        n, gram = len(values), self.gram
        sums = self.rolling.sums(values)
        grams = self.rolling.parts(sums, slice(0, n - gram + 1), slice(gram, n + 1))
        keys = (grams & np.uint64(~POSITION & (1 << 64) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width = self.length - gram + 1
        # sliding minimum from running minima of blocks, forwards and backwards
        pad = -len(keys) % width
        blocks = np.append(keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - self.length + 1
        least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
        places = (least & np.uint64(POSITION)).astype(np.int64)
        first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        last = np.append(first[1:], starts) - 1
        contexts = self.rolling.parts(sums, first, last + self.length)
        return grams[places[first]].view(np.int64), contexts.view(np.int64), places[first], first, last


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def suffix_ranks(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes by their first ``depth`` symbols, and which suffixes
    share theirs, those of one rank side by side; symbols are not negative, and
    the end sorts before them."""
    n = len(symbols)
    bits = int(symbols.max(initial=0) + 1).bit_length()
    packed = min(63 // bits, depth)
    padded = np.append(symbols.astype(np.int64) + 1, np.zeros(packed, np.int64))
    keys = np.zeros(n, np.int64)
    for i in range(packed):
        keys = keys << bits | padded[i : i + n]
    order = np.argsort(keys)
    rank, where = _groups(keys[order], np.zeros(n, np.int64), order, n)
    h = packed
    while len(where) and h < depth:
        step = min(h, depth - h)  # the last round ends at depth exactly
        follow = where + step
        inside = follow < n
        key = np.full(len(where), -1, np.int64)
        key[inside] = rank[follow[inside]]
        order = np.argsort(rank[where] * (n + 1) + key + 1)  # within groups, which keep their places
        where = where[order]
        rank, where = _refine(rank, where, key[order])
        h += step
    return rank, where


def _groups(keys: np.ndarray, base: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by the start of each run of equal keys, and who shares one."""
    new = np.append(True, keys[1:] != keys[:-1])
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    alone = new & np.append(new[1:], True)
    return rank, order[~alone]


def _refine(rank: np.ndarray, where: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divide groups, whose members stand together in ``where``, by ``key``."""
    group = rank[where]
    head = np.append(True, group[1:] != group[:-1])
    new = head | np.append(True, key[1:] != key[:-1])
    index = np.arange(len(where))
    group_start = np.maximum.accumulate(np.where(head, index, 0))
    part_start = np.maximum.accumulate(np.where(new, index, 0))
    rank[where] = group + part_start - group_start
    alone = new & np.append(new[1:], True)
    return rank, where[~alone]


def repeated_strings(contexts: list[np.ndarray], length: int, documents: list[int] | None = None) -> list[np.ndarray]:
    """For each context a flag for every string of ``length`` symbols in it:
    whether it starts anywhere else in these contexts, or, given the contexts'
    ``documents``, in one of another document."""
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    symbols = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    every = np.concatenate(contexts)
    numbers = every.astype(np.int32) if every.dtype == np.uint8 else np.unique(every, return_inverse=True)[1]
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = numbers + 1
    rank, shared = suffix_ranks(symbols, length)
    repeated = np.zeros(len(rank), bool)
    if documents is None:
        repeated[shared] = True
    elif len(shared):
        heads = np.flatnonzero(np.append(True, np.diff(rank[shared]) != 0))
        owner = np.repeat(np.array(documents, np.int64), sizes)[shared]
        several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
        repeated[shared] = np.repeat(several, np.diff(np.append(heads, len(shared))))
    return [repeated[end - size : max(end - size, end - length)] for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]


def promising(block: list[tuple], length: int, gram: int, width: int) -> list[tuple]:
    """Contexts that another one of their anchor and shard may share a string
    with.  Equal strings have the anchor at the same offset; so for offsets
    between two of CUTS both have the symbols that every string of such offsets
    covers, and a context that has them with no other one holds nothing to find.
    Divided anchors stay whole, as their other shards have to see all strings."""
    cuts = [(length - gram) * i // CUTS for i in range(CUTS + 1)]
    stretches: dict[tuple, list[int]] = {}
    for i, (anchor, shard, shards, _, _, _, _, place, data) in enumerate(block):
        if shards == 1:
            least = place + length - len(data) // width  # the anchor's offset in the last string; in the first it is place
            for low, high in zip(cuts, cuts[1:], strict=False):
                if least <= high and low <= place:
                    stretches.setdefault((anchor, shard, low, data[(place - low) * width : (place - high + length) * width]), []).append(i)
    # with no unsettled context there is no one to tell
    kept = {i for group in stretches.values() if len(group) > 1 and not all(block[i][3] for i in group) for i in group}
    return [b for i, b in enumerate(block) if b[2] > 1 or i in kept]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


ANCHOR = "id bigint, h bigint, anchor bigint, context bigint, place bigint, first bigint, last bigint"
ANCHOR_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in ANCHOR.split(", ")])
SPAN = "id bigint, h bigint, first bigint, last bigint"
#: Stands for "several documents" beside any document's number.
MANY = -(1 << 62)
CONTEXT_ARROW = pa.schema([("anchor", pa.int64()), ("shard", pa.int64()), ("shards", pa.int64()), ("settled", pa.bool_()), ("id", pa.int64()), ("h", pa.int64()), ("first", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
CONTEXT = "anchor bigint, shard bigint, shards bigint, settled boolean, id bigint, h bigint, first bigint, place bigint, bytes binary"
FOUND = "id bigint, h bigint, first bigint, last bigint, anchor bigint, part int, shard bigint, hashes binary, owners binary"
FOUND_ARROW = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("anchor", pa.int64()), ("part", pa.int32()), ("shard", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary())])
RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, n_passages bigint, kept binary"
RESULT_ARROW = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_passages", pa.int64()), ("kept", pa.binary())])


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def anchors(rows: DataFrame, unit: type, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = unit()
        find = Anchors(kind, length, gram)
        for batch in batches:
            for part in row_slices(batch, 2):
                found = [
                    (np.full(len(piece[0]), doc), np.full(len(piece[0]), h), *piece)
                    for doc, h, text in zip(*(c.to_pylist() for c in part.columns), strict=True)
                    for piece in find.of(kind.symbols(text.encode()))
                ]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=ANCHOR_ARROW)

    return map_arrow(rows, run, ANCHOR)


def packed(rows: DataFrame) -> DataFrame:
    """Rows with their text as compressed bytes, for the shuffles to come."""
    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def squeeze(texts: pd.Series) -> pd.Series:
        import zstandard

        return texts.map(lambda t, z=zstandard.ZstdCompressor(level=3): z.compress(t.encode()))

    return rows.select("id", "h", squeeze("text").alias("z"))


def context_rows(rows: DataFrame, needed: DataFrame, unit: type, length: int) -> DataFrame:
    """The symbols of the contexts that go into suffix arrays, as bytes."""
    wanted = needed.groupBy("id", "h").agg(F.collect_list(F.struct("anchor", "shard", "shards", "settled", "first", "last", "place")).alias("wanted"))
    # repeated rows ask once
    joined = packed(rows).join(wanted, ["id", "h"]).dropDuplicates(["id", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, kind = zstandard.ZstdDecompressor().decompress, unit()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for doc, h, z, wants in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    data = kind.symbols(unpack(z))
                    out += [(w["anchor"], w["shard"], w["shards"], w["settled"], doc, h, w["first"], w["place"] - w["first"], data[w["first"] : w["last"] + length].tobytes()) for w in wants]
                yield table_of(out, CONTEXT_ARROW)

    return map_arrow(joined.select("id", "h", "z", "wanted"), run, CONTEXT)


def search(contexts: DataFrame, unit: type, length: int, gram: int) -> DataFrame:
    """Spans that a shard finds by its suffix array, and the sorted strings of
    anchors that several shards divide."""
    width, across = unit.width, unit.across

    def solve(block: list[tuple]) -> list[tuple]:
        out, divided = [], {}
        block = promising(block, length, gram, width)
        if not block:
            return out
        symbols = [np.frombuffer(b[-1], np.uint64 if width == 8 else np.uint8) for b in block]
        owners = [MANY - i if b[3] else b[4] for i, b in enumerate(block)] if across else None
        for (anchor, shard, shards, settled, doc, h, first, _, data), flags in zip(block, repeated_strings(symbols, length, owners), strict=True):
            if not settled:
                out += [(doc, h, first + a, first + b, None, None, None, None, None) for a, b in runs(flags)]
            if shards > 1:
                group = divided.setdefault((anchor, shard, shards), set())
                for i, known in enumerate(flags.tolist()):
                    string = digest(data[i * width : (i + length) * width])
                    group.add((string, 0, 0, -1) if known or settled else (string, doc, h, first + i))
        for (anchor, shard, shards), group in divided.items():
            rows = np.array(sorted(group), np.int64).reshape(-1, 4)
            bounds = np.array([(i << 64) // shards - (1 << 63) for i in range(1, shards)], np.int64)
            cuts = [0, *np.searchsorted(rows[:, 0], bounds).tolist(), len(rows)]
            out += [(None, None, None, None, anchor, p, shard, rows[a:b, 0].tobytes(), rows[a:b, 1:].tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != last and size >= BLOCK_SYMBOLS * width:
                    yield table_of(solve(block), FOUND_ARROW)
                    block, size = [], 0
                last = row[:2]
                block.append(row)
                size += len(row[-1]) + width
        if block:
            yield table_of(solve(block), FOUND_ARROW)

    return map_arrow(contexts, run, FOUND)


def merge(found: DataFrame, unit: type) -> DataFrame:
    """Spans of strings that several shards of an anchor have, or, across
    documents, that have several documents: each sorted run is looked up in all
    of its part by binary search."""
    across = unit.across

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["hashes"]])
        owners = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in pdf["owners"]])
        known = owners[:, 2] < 0
        if across:  # what several documents have is no document's own
            owner = np.where(known, MANY - np.arange(len(owners)), owners[:, 0])
            order = np.lexsort((owner, hashes))
            heads = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
            counts = np.diff(np.append(heads, len(order)))
            several = np.empty(len(order), bool)
            several[order] = np.repeat(owner[order][heads] != owner[order][heads + counts - 1], counts)
        else:  # a string is once in each shard that has it
            whole = np.sort(hashes)
            several = np.searchsorted(whole, hashes, side="right") - np.searchsorted(whole, hashes, side="left") > 1
        out = owners[several & ~known]
        return pd.DataFrame({"id": out[:, 0], "h": out[:, 1], "first": out[:, 2], "last": out[:, 2]})

    runs_of = found.where("anchor is not null").select("anchor", "part", "hashes", "owners")
    return runs_of.groupBy("anchor", "part").applyInPandas(look, SPAN)


def repeated(rows: DataFrame, unit: type, length: int, gram: int) -> DataFrame:
    """``id, h, first, last``: runs of starts of repeated strings."""
    every = materialize(anchors(rows, unit, length, gram), "suffix-anchors")
    # what several rows have, or, across documents, rows of several ids
    several = (F.min("id") != F.max("id")) if unit.across else (F.count("*") > 1)
    one = F.min(F.struct("id", "h", "first", "last", "place")).alias("one")
    ids = [F.min("id").alias("low"), F.max("id").alias("high")] if unit.across else []
    contexts = every.groupBy("anchor", "context").agg(several.alias("settled"), F.count("*").alias("n"), one, *ids)
    shared = F.col("low") != F.col("high") if unit.across else F.col("total") > 1
    ids = [F.min("low").alias("low"), F.max("high").alias("high")] if unit.across else []
    totals = contexts.groupBy(F.col("anchor").alias("of")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), *ids).where(shared).select("of", "kinds")
    status = materialize(contexts.join(totals, F.col("anchor") == F.col("of")).select("anchor", "context", "settled", "kinds", "one.*"), "suffix-contexts")
    whole = every.join(status.where("settled").select("anchor", "context"), ["anchor", "context"]).select("id", "h", "first", "last")
    mixed = status.where("kinds > 1")
    if unit.across:  # a document may have a context several times over
        own = every.join(mixed.where("not settled").select("anchor", "context", "settled", "kinds"), ["anchor", "context"])
        columns = ["anchor", "context", "settled", "kinds", "id", "h", "first", "last", "place"]
        mixed = mixed.where("settled").select(columns).unionByName(own.select(columns))
    shards = F.ceil(F.col("kinds") / SHARD_CONTEXTS).cast("bigint")
    needed = mixed.select("anchor", F.pmod("context", shards).alias("shard"), shards.alias("shards"), "settled", "id", "h", "first", "last", "place")
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    contexts = context_rows(rows, needed, unit, length).repartition(spread, "anchor", "shard").sortWithinPartitions("anchor", "shard")
    found = materialize(search(contexts, unit, length, gram), "suffix-found")
    out = whole.unionByName(found.where("anchor is null").select("id", "h", "first", "last"))
    if not found.where("anchor is not null").isEmpty():
        out = out.unionByName(merge(found, unit))
    spans = materialize(out.distinct(), "suffix-spans")
    discard(every, status, found)
    return spans


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, passage: int = PASSAGE) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, n_passages, kept`` of every row: bytes
    before, bytes removed, maximal removed runs, passages that other documents
    have too, and the bytes that remain."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    keyed = rows.withColumn("id", F.coalesce("id", F.lit(-(1 << 63))))  # null ids find their spans as well
    strings = repeated(keyed, Bytes, length, gram or max(1, length // 4)).withColumn("words", F.lit(False))
    passages = repeated(keyed, Words, passage, passage // 4 + 1).withColumn("words", F.lit(True))
    spans = strings.unionByName(passages).groupBy("id", "h").agg(F.collect_list(F.struct("words", "first", "last")).alias("spans"))
    joined = packed(keyed).join(spans, ["id", "h"], "left").select("id", "z", "spans")

    def merged(found: list, size: int) -> list[tuple[int, int]]:
        """Maximal covered runs; runs that touch are one."""
        out: list[list[int]] = []
        for first, last in sorted(found):
            if out and first <= out[-1][1]:
                out[-1][1] = max(out[-1][1], last + size)
            else:
                out.append([first, last + size])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for doc, z, found in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    data, kept, end = unpack(z), [], 0
                    gone = merged([(s["first"], s["last"]) for s in found or () if not s["words"]], length)
                    for first, last in gone:
                        kept.append(data[end:first])
                        end = last
                    rest = b"".join([*kept, data[end:]])
                    shared = merged([(s["first"], s["last"]) for s in found or () if s["words"]], passage)
                    out.append((None if doc == -(1 << 63) else doc, len(data), len(data) - len(rest), len(gone), len(shared), rest))
                yield table_of(out, RESULT_ARROW)

    return map_arrow(joined, run, RESULT)
