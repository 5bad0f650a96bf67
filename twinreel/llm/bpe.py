"""BPE encoding and decoding.

Texts are cut at white space, each piece is normalised and cut into
pre-tokens, and the merges of a pre-token are driven by a segment tree over
the ranks of its adjacent pairs: the root yields the leftmost pair of lowest
rank, a merge updates three leaves, and it ends when the root holds no
mergeable pair.  Its nodes have WIDE children, so that few of them are renewed.
That is n log n for a pre-token of n bytes, so very long junk
words are no trouble.  A bounded memo keeps the ids of frequent pieces.

Characters are composed and lower-cased, and letters told from others, by the
tables of the tokenizers library, which are those that a vocabulary was made for;
everything else is done here.

Null and empty texts have no ids and decode to the empty string.  Rows keep
their multiplicity; a null id is passed on.  Very long texts are encoded whole.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from ..shipping import ship
from .common import map_texts

#: Pieces in one of the two generations of a worker's memo.
MEMO_PIECES = 400_000
#: Pieces that a worker keeps from one task to the next.
KEPT_PIECES = 100_000

#: Characters of the basic plane, and the first beyond.
PLANE = 0x10000
BEYOND = chr(PLANE)

#: White space as Unicode has it; str.split() also cuts at the four separators
#: below, which here belong to words.
SPACE = r"\t-\r \x85\xa0  -     　"
NOT_SPACE_BUT_SPLIT = ("\x1c", "\x1d", "\x1e", "\x1f")


def tokenizer_file(name: str) -> str:
    """A path as it is; any other name is one of the public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: A pair of symbols and a rank with its merged symbol are packed into one
#: number each; a symbol takes so many bits.
BITS = 20


#: Larger than any key.
NONE = 1 << 62


#: Children of a node of the segment tree.
WIDE = 32


def merge(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Apply ``merges``, packed (left, right) to packed (rank, merged), until
    none applies: always the leftmost pair of the lowest rank.

    The leaves of a minimum segment tree hold what ``merges`` has for every
    adjacent pair, by its left position, and a node has WIDE children: the way
    from the root's minimum down to the first child that has it ends at that pair.
    A merge ends the right symbol's pair and renews those at its left end and
    before it: three point updates, each of which climbs only as far as minima
    change.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get, mask = merges.get, (1 << BITS) - 1
    symbols = symbols[:]
    leaves = [get(a << BITS | b, NONE) for a, b in zip(symbols, symbols[1:])]
    levels = [leaves]
    while len(levels[-1]) > WIDE:
        under = levels[-1]
        levels.append([min(under[i : i + WIDE]) for i in range(0, len(under), WIDE)])
    root, lower, deep = levels[-1], levels[-2::-1], len(levels) > 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (low := min(root)) < NONE:
        left = root.index(low)
        for level in lower:
            left = level.index(low, left * WIDE)
        right = after[left]
        symbols[left] = merged = low & mask
        symbols[right] = -1
        after[left] = following = after[right]
        if following < n:
            leaves[right] = NONE
            before[following] = left
            leaves[left] = get(merged << BITS | symbols[following], NONE)
        else:
            leaves[left] = NONE
        previous = before[left]
        if previous >= 0:
            leaves[previous] = get(symbols[previous] << BITS | merged, NONE)
        if deep:
            changed = [left]
            if following < n:
                changed.append(right)
            if previous >= 0:
                changed.append(previous)
            for i in changed:
                for under, over in zip(levels, levels[1:], strict=False):
                    i //= WIDE
                    key = min(under[i * WIDE : i * WIDE + WIDE])
                    if over[i] == key:
                        break
                    over[i] = key
    return [s for s in symbols if s >= 0]


class Memo:
    """Bounded memo of two generations: what is in use outlives the rest."""

    def __init__(self, make, limit: int = MEMO_PIECES):
        self.make, self.limit = make, limit
        self.young: dict = {}
        self.old: dict = {}

    def miss(self, key):
        value = self.young.get(key) or self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value

    def shrink(self, keep: int = KEPT_PIECES) -> None:
        """Forget all but what came first, as frequent pieces do."""
        self.old, self.young = {}, dict(islice(self.young.items(), keep))

    def all(self, keys: list) -> list:
        get, miss = self.young.get, self.miss  # a generation that ends meanwhile still answers
        return [get(k) or miss(k) for k in keys]


@lru_cache(maxsize=2)
def letter_table(kind: str) -> list[bool]:
    """Which characters are of a class of letters, by the tokenizers' own tables: the
    interpreter's are older, so that what it does not know is asked for there, and
    those of ``regex`` are of another age again."""
    kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
    inside = [k[0] == kind for k in kinds]
    unknown = " ".join(chr(c) for c in range(0x40000) if kinds[c] == "Cn")  # beyond, no letter is planned
    for found, _ in Split(Regex(rf"[^\p{{{kind}}}]+"), "removed").pre_tokenize_str(unknown):
        for c in found:
            inside[ord(c)] = True
    return inside


def letters_of(kind: str, top: int = 0x110000) -> str:
    """Ranges of a class of letters below ``top``."""
    inside = [*letter_table(kind)[:top], False]
    edges = [c for c in range(top + 1) if inside[c] != (c > 0 and inside[c - 1])]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself
    where it is printable, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer with word ends, read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.merges = {
            self.vocab[a] << BITS | self.vocab[b]: rank << BITS | self.vocab[a + b]
            for rank, (a, b) in enumerate(model["merges"])
        }
        letters = byte_letters()
        self.inner = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.end) for c in letters]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", SPACE)
        self.words = regex.compile(pattern.replace(r"\p{L}", letters_of("L")).replace(r"\p{N}", letters_of("N")))
        # of the basic plane, which the interpreter's own module keeps as bit maps
        self.plain_words = re.compile(pattern.replace(r"\p{L}", letters_of("L", PLANE)).replace(r"\p{N}", letters_of("N", PLANE)))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.has_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.cut = regex.compile(f"[^{SPACE}]+")
        self.tokens = [""] * (1 + max(chain(self.vocab.values(), self.special.values())))
        for token, i in chain(self.vocab.items(), self.special.items()):
            self.tokens[i] = token
        self.memo = Memo(self.piece)
        # the library's own tables, which are not those of the interpreter
        self.normalise = Sequence([NFC(), Lowercase()]).normalize_str

    def pieces(self, text: str) -> list[str]:
        """Runs without white space: no token, merge or composition of
        characters reaches across it."""
        if any(c in text for c in NOT_SPACE_BUT_SPLIT):
            return self.cut.findall(text)
        return text.split()

    def word(self, word: str) -> bytes:
        """Ids of one pre-token; a byte that the vocabulary lacks is left out."""
        data = word.encode("utf-8")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        return array("I", merge(symbols, self.merges)).tobytes()

    def piece(self, piece: str) -> bytes:
        if piece.isascii():
            plain = piece.lower()
            if plain.isalpha():
                return self.word(piece) if plain == piece else self.memo.miss(plain)
        out: list[bytes] = []
        for part in self.has_special.split(piece) if "<|" in piece else (piece,):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                # lower case letter by letter: no rule looks at a letter's neighbours
                plain = part.lower() if part.isascii() else self.normalise(part)
                words = [plain] if plain.isalpha() else (self.plain_words if max(plain) < BEYOND else self.words).findall(plain)
                out += [self.memo.miss(w) if w.isascii() and w.isalpha() else self.word(w) for w in words]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.memo.all(self.pieces(text)))

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between; the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def load(name: str) -> WordBpe:
    return WordBpe(tokenizer_file(name))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, decoded`` of every text: ids as little-endian unsigned 32-bit
    integers, and the text that these ids decode to."""
    id_type = docs.schema[id_col].dataType.simpleString()
    arrow = pa.schema([("id", pa.from_numpy_dtype("i8") if id_type == "bigint" else pa.string()), ("ids", pa.binary()), ("decoded", pa.string())])

    def make():
        bpe = load(tokenizer)

        def step(ids: list, texts: list) -> list:
            encoded = [bpe.encode(t) for t in texts]
            return [ids, encoded, [bpe.decode(e) for e in encoded]]

        step.close = bpe.memo.shrink
        return step

    typed = docs.select(F.col(id_col).cast("bigint" if id_type == "bigint" else "string").alias("id"), F.col(text_col).alias("text"))
    return map_texts(typed, make, f"id {'bigint' if id_type == 'bigint' else 'string'}, ids binary, decoded string", arrow, "id", "text")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, decoded`` of rows of packed ids; null ids decode to the empty string."""
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        bpe = load(tokenizer)
        return ids.map(lambda x: bpe.decode(x or b""))

    return encoded.select(F.col(id_col).alias("id"), text(ids_col).alias("decoded"))


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of :func:`encode`."""
    return encoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
