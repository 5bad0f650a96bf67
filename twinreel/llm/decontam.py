"""Benchmark decontamination by SimHash windows.

A document's windows have the length of a benchmark item in words (the whole
document where it is shorter) and start at every word.  A window's SimHash is
looked up in the items of its length through multi-index Hamming blocks: of
eight blocks of a fingerprint within RADIUS bits, one is within RADIUS // 8
bits, and the index lists for each block and value the items that near, so no
item within the radius is missed.  What it yields is verified by the weighted
Jaccard similarity of five-word shingles, a shingle's weight being how often it
occurs.  At the similarity that is asked for, about a tenth of the weight may
differ on either side, which turns some 15 in a hundred bits, ten of 64, with a
deviation of three, so RADIUS bits are beyond four deviations.

Regions that have too few shingles of the benchmark, whichever item they belong
to, are not fingerprinted: a window of w shingles and an item of t have a
similarity of s only if they share s (w + t) / (1 + s), which running counts of
the places of known shingles rule out exactly.  Which items a window may have
is for the blocks to say.

Words are runs of letters, digits and underscores in lower case.  Items of
fewer than five words have one shingle, all their words.  Items and documents
without words match nothing; nulls are such.  The benchmark is a stated query
set: it is taken in blocks of at most BLOCK_ITEMS items, each of which reads
all documents.  Items that repeat an id are told apart; their rows are merged.
Each row of a document that is repeated gets its own rows.  Of windows of equal
similarity the leftmost is returned.  Very long texts are searched whole.  An
empty table of either kind gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, row_slices, text_or_empty

WIDTH = 5
THRESHOLD = 0.8
RADIUS = 23
BLOCKS = 8
#: Items of the benchmark that are looked for in one pass over the documents.
BLOCK_ITEMS = 20_000
#: Windows that are fingerprinted at once.
CHUNK = 4096

WORDS = re.compile(r"\w+").findall


def shingles(words: list) -> list[tuple]:
    """Runs of five words; all words if they are fewer."""
    if len(words) <= WIDTH:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(WIDTH)), strict=False))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity; 0 for two empty bags."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of SplitMix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_codes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of five word numbers (fewer: of all)."""
    width = min(WIDTH, len(ids))
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for i in range(width):
        out = mix(out + ids[i : len(ids) - width + 1 + i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


def bits_of(codes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each code."""
    return np.unpackbits(mix(codes).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def hamming_blocks(prints: np.ndarray) -> np.ndarray:
    """For each block and value which fingerprints are within RADIUS // BLOCKS
    bits of it there: (BLOCKS, 256, fingerprints)."""
    values = np.arange(256, dtype=np.uint8)
    return np.bitwise_count(values[None, :, None] ^ prints.T[:, None, :]) <= RADIUS // BLOCKS


class Index:
    """A block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.names, self.bags = [], []
        by_size: dict[int, list[int]] = defaultdict(list)
        prints, known = [], defaultdict(set)
        for name, text in items:
            words = WORDS((text or "").lower())
            if words:
                numbers = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                codes = shingle_codes(np.array(numbers, np.int64))
                by_size[len(words)].append(len(self.names))
                known[min(WIDTH, len(words))].update(codes.tolist())
                prints.append(np.packbits(bits_of(codes).sum(0) > 0))
                self.names.append(name)
                self.bags.append(Counter(shingles(numbers)))
        self.prints = np.array(prints, np.uint8).reshape(-1, 8)
        #: items, their fingerprints and their blocks for each length in words
        self.sizes = {n: (np.array(i), self.prints[i], hamming_blocks(self.prints[i])) for n, i in sorted(by_size.items())}
        self.codes = {w: np.array(sorted(c), np.uint64) for w, c in known.items()}

    def within(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of the items of a length whose fingerprint is within
        RADIUS bits of a window's, by the blocks."""
        items, own, blocks = self.sizes[size]
        listed = np.zeros((len(prints), len(items)), bool)
        for block in range(BLOCKS):
            listed |= blocks[block][prints[:, block]]
        window, item = np.nonzero(listed)
        near = np.bitwise_count(prints[window] ^ own[item]).sum(1) <= RADIUS
        return zip(window[near].tolist(), items[item[near]].tolist(), strict=True)

    def matches(self, text: str) -> list[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, windows) of the best window
        for each item that the text has, leftmost if several are."""
        words = WORDS(text.lower())
        n = len(words)
        if not n or not self.names:
            return []
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, n)
        known = ids >= 0
        found: dict[int, list] = {}
        for width, codes in self.codes.items():
            if n >= width and (total := self.running(ids, known, width, codes)) is not None:
                for size in self.sizes:
                    if min(WIDTH, size) == width:
                        self.windows(size, width, ids, total, found)
        return [(item, *best) for item, best in sorted(found.items())]

    def running(self, ids: np.ndarray, known: np.ndarray, width: int, codes: np.ndarray) -> np.ndarray | None:
        """Running counts of the places whose shingle is the benchmark's."""
        places = np.flatnonzero(np.convolve(known, np.ones(width, np.int64), "valid") == width)
        if not len(places):
            return None
        runs = np.lib.stride_tricks.sliding_window_view(ids, width)[places]
        made = np.zeros(len(places), np.uint64)
        for i in range(width):
            made = mix(made + runs[:, i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        at = np.minimum(np.searchsorted(codes, made), len(codes) - 1)
        marks = np.zeros(len(ids) - width + 2, np.int64)
        marks[places[codes[at] == made] + 1] = 1
        return np.cumsum(marks) if marks.any() else None

    def windows(self, size: int, width: int, ids: np.ndarray, total: np.ndarray, found: dict) -> None:
        """Windows of a length: fingerprinted where enough shingles are known,
        looked up in the blocks, verified."""
        length = min(size, len(ids))
        span = length - width + 1  # shingles of a window
        need = math.ceil(THRESHOLD * (span + size - width + 1) / (1 + THRESHOLD) - 1e-9)
        if need > span or total[-1] < need:
            return
        starts = np.flatnonzero(total[span:] - total[:-span] >= need)
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else ():
            for at in range(0, len(run), CHUNK):
                part = run[at : at + CHUNK]
                codes = shingle_codes(ids[part[0] : part[-1] + length])
                sums = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits_of(codes), axis=0)])
                prints = np.packbits(sums[span : span + len(part)] - sums[: len(part)] > 0, axis=1)
                for window, item in self.within(size, prints):
                    start = int(part[window])
                    score = similarity(Counter(shingles(ids[start : start + length].tolist())), self.bags[item])
                    if score >= THRESHOLD:
                        best = found.setdefault(item, [start, length, score, 0])
                        best[3] += 1
                        if score > best[2]:
                            best[:3] = start, length, score


SCHEMA = "id bigint, item_id bigint, first_word bigint, n_words bigint, similarity double, n_windows bigint"
ARROW = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64()), ("n_windows", pa.int64())])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``id, item_id, first_word, n_words, similarity, n_windows``: for each
    document and item, the most similar window and how many are similar."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text_or_empty("text").alias("text")).distinct()
    blocks = -(-items.count() // (block_items // 2)) or 1
    out = None
    for block in range(blocks):  # a block has block_items at most, as its number follows a hash: check
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        listed = [(r["item_id"], r["text"]) for r in part.toLocalIterator()]
        for at in range(0, max(1, len(listed)), block_items):
            found = _search(rows, listed[at : at + block_items])
            out = found if out is None else out.unionByName(found)
    return out


def _search(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for batch in batches:
            for part in row_slices(batch, 1):
                out: dict[tuple, list] = {}
                for place, (doc, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    for item, start, size, score, n in index.matches(text):
                        key, new = (place, doc, index.names[item]), [start, size, score, n]
                        if key not in out or score > out[key][2]:
                            out[key] = new
                columns = zip(*((k[1], k[2], *v) for k, v in out.items()), strict=True) if out else [[]] * len(ARROW)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    return map_arrow(rows, search, SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without documents that have a leak."""
    leaky = leaks(docs, benchmark, id_col, text_col).select(F.col("id").alias("leaky")).distinct()
    return docs.join(leaky, docs[id_col].cast("bigint").eqNullSafe(leaky["leaky"]), "left_anti")
