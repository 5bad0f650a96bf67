"""Token counts that follow edits.

A document keeps its pre-tokens in chunks, and over the chunks a segment tree
of sums of characters and tokens.  An edit goes down the tree to the chunk at
its first character, encodes anew from a boundary that it cannot have moved,
and stops where the new boundaries meet an old one behind the edit; then it
replaces the chunks in between and updates the sums above them.  The text
outside this region is neither cut nor encoded again.

The splitting pattern looks at most two characters past the end of a pre-token
(white space that gives its last character to the next word; contractions), so
a pre-token that ends two characters or more before the edit stays.

Null and empty texts have no tokens.  Edits of a document are applied in their
order, each to the text that the one before it left; their ranges are clipped
to it.  A document without edits keeps its count, and a null edit changes
nothing.  Rows keep their multiplicity, very long texts are counted whole, and an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BITS, Memo, merge, tokenizer_file
from .common import map_arrow, text_or_empty

#: Pre-tokens of a chunk when it is made; one of twice as many is divided.
CHUNK = 128
#: Characters past a pre-token's end on which that end may depend.
LOOKAHEAD = 2


class ByteBpe:
    """Token counts of pre-tokens under a byte-level vocabulary of ranks."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: A merge's rank is that of the token it makes.
        self.merges: dict[int, int] = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    self.merges[left << BITS | right] = rank << BITS | rank
        self.cut = regex.compile(pattern or public_tokenizers.PATTERN)
        self.memo = Memo(self.count)

    def count(self, word: str) -> int:
        return len(merge([self.single[b] for b in word.encode()], self.merges))

    def counts(self, words: list[str]) -> list[int]:
        return self.memo.all(words)


@lru_cache(maxsize=4)
def load(name: str) -> ByteBpe:
    return ByteBpe(tokenizer_file(name))


class CountTree:
    """The pre-tokens of one text with sums of characters and tokens."""

    def __init__(self, text: str, bpe: ByteBpe):
        self.bpe, self.text = bpe, text
        words = bpe.cut.findall(text)
        self.encoded = len(words)  # pre-tokens encoded so far
        self.chunks = self._chunks(words, bpe.counts(words))
        self._build()

    @staticmethod
    def _chunks(words: list[str], counts: list[int]) -> list[tuple[list[int], list[int]]]:
        lengths = list(map(len, words))
        return [(lengths[i : i + CHUNK], counts[i : i + CHUNK]) for i in range(0, len(words), CHUNK)]

    def _build(self) -> None:
        self.size = size = 1 << max(0, (len(self.chunks) - 1).bit_length())
        pad = [0] * (size - len(self.chunks))
        self.chars = [0] * size + [sum(c) for c, _ in self.chunks] + pad
        self.tokens = [0] * size + [sum(t) for _, t in self.chunks] + pad
        for i in range(size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def pretokens(self) -> int:
        return sum(len(c) for c, _ in self.chunks)

    def chunk_at(self, place: int) -> tuple[int, int]:
        """The chunk that holds a character, and where the chunk begins."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        last = max(0, len(self.chunks) - 1)  # where the text's end falls to
        return (node - self.size, start) if node - self.size <= last else (last, self._start_of(last))

    def _put(self, chunk: int) -> None:
        node = self.size + chunk
        self.chars[node], self.tokens[node] = map(sum, self.chunks[chunk])
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, insert: str) -> None:
        """Replace the characters from ``start`` to ``end`` by ``insert``."""
        n = len(self.text)
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        text = self.text[:start] + insert + self.text[end:]
        shift = len(insert) - (end - start)
        # the chunk of the first pre-token that may change, and that pre-token
        first, begin = self.chunk_at(max(0, start - LOOKAHEAD))
        keep = 0
        if self.chunks:
            for length in self.chunks[first][0]:
                if begin + length + LOOKAHEAD > start:
                    break
                begin, keep = begin + length, keep + 1
        words, last, tail = self._rescan(text, begin, end, shift, first)
        self.encoded += len(words)
        counts = self.bpe.counts(words)
        old = self.chunks[first] if self.chunks else ([], [])
        lengths = old[0][:keep] + list(map(len, words))
        tokens = old[1][:keep] + counts
        if last is not None:
            lengths += self.chunks[last][0][tail:]
            tokens += self.chunks[last][1][tail:]
        behind = len(self.chunks) if last is None else last + 1
        self.text = text
        if behind - first == 1 and 0 < len(lengths) <= 2 * CHUNK:
            self.chunks[first] = (lengths, tokens)
            self._put(first)
        else:  # chunks come or go: the tree over them, not over pre-tokens, is built anew
            made = [(lengths[i : i + CHUNK], tokens[i : i + CHUNK]) for i in range(0, len(lengths), CHUNK)]
            self.chunks[first:behind] = made
            self._build()

    def _rescan(self, text: str, begin: int, end: int, shift: int, chunk: int) -> tuple[list[str], int | None, int]:
        """Pre-tokens of ``text`` from ``begin`` until they meet an old boundary
        at or behind ``end``; the chunk and place in it of the pre-token behind
        that boundary, or None at the text's end."""
        words: list[str] = []
        at_chunk, at, old = chunk, 0, self._start_of(chunk)
        for match in self.bpe.cut.finditer(text, begin):
            words.append(match.group())
            goal = match.end() - shift  # this boundary in the old text
            if goal < end:
                continue
            while at_chunk < len(self.chunks) and old < goal:
                if at == 0 and old + (whole := self.chars[self.size + at_chunk]) <= goal:
                    old, at_chunk = old + whole, at_chunk + 1
                    continue
                old, at = old + self.chunks[at_chunk][0][at], at + 1
                if at == len(self.chunks[at_chunk][0]):
                    at_chunk, at = at_chunk + 1, 0
            if old == goal and at_chunk < len(self.chunks):
                return words, at_chunk, at
        return words, None, 0

    def _start_of(self, chunk: int) -> int:
        """Characters before a chunk, by the sums of left siblings."""
        node, before = self.size + chunk, 0
        while node > 1:
            if node % 2:
                before += self.chars[node - 1]
            node //= 2
        return before


COUNTS = pa.schema(
    [("id", pa.int64()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens_edited", pa.int64()), ("n_pretokens_edited", pa.int64()), ("n_reencoded", pa.int64()), ("n_edits", pa.int64())]
)
SCHEMA = "id bigint, n_tokens bigint, n_pretokens bigint, n_tokens_edited bigint, n_pretokens_edited bigint, n_reencoded bigint, n_edits bigint"


def counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """Counts of every row before and after its edits, and how many pre-tokens
    the edits had encoded anew.

    ``edits_col`` is an array of structs of ``start`` and ``end`` (characters)
    and ``insert``; without it the counts are those of the text.
    """
    empty = "cast(array() as array<struct<start:bigint,end:bigint,insert:string>>)"
    edits = F.coalesce(F.col(edits_col), F.expr(empty)) if edits_col else F.expr(empty)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"), edits.alias("edits"))

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc, text, changes in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    tree = CountTree(text, bpe)
                    tokens, pretokens, cut = tree.total(), tree.pretokens(), tree.encoded
                    for change in changes:
                        if change is not None:
                            tree.edit(change["start"] or 0, change["end"] or 0, change["insert"] or "")
                    out.append((doc, tokens, pretokens, tree.total(), tree.pretokens(), tree.encoded - cut, len(changes)))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=COUNTS)
        bpe.memo.shrink()

    return map_arrow(rows, run, SCHEMA)


def apply_edits(text: str, changes: list[tuple[int, int, str]]) -> str:
    """The edited text, for tests."""
    for start, end, insert in changes:
        start = max(0, min(start, len(text)))
        end = max(start, min(end, len(text)))
        text = text[:start] + insert + text[end:]
    return text
