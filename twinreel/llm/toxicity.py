"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; the other side is text whose labels
are not looked at, drawn from the rows that have one, as those are of the same
make as the positives (drawn from all documents, precision on further labels of
check_s was 0.95 and recall 0.98, against 1.00 and 0.99).  With class prior p the
risk is

    p R(positives as 1) + max(0, R(unlabelled as 1-class 0) - p R(positives as 0))

whose second term, the risk on negatives, cannot be less than zero; where a
batch drives it below, the step goes the other way.  The classifier is linear
over the presence of words and word beginnings, so that it knows inflected
forms, at four levels: there at all, there twice, one word in a hundred, and
twice with one word in two hundred.  It is fitted in numpy on the driver from
a bounded sample.

Only the texts decide a score.  Null and empty texts, and any text without a
known feature, score what the intercept says.  Without positives all scores
are 0.  Labels that repeat a document count once, the larger one; labels without
an id or a value teach nothing.  Rows keep their multiplicity, ties in the order
of the sample go by the id, and very long texts are scored whole.  An empty table
gives an empty result, and empty labels a model that scores 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_texts, row_slices

#: Most confirmed examples and most unlabelled texts that a model is fitted on.
MAX_POSITIVE = 3_000
MAX_UNLABELLED = 8_000
#: Hashed feature space, and features that a model keeps.
SPACE = 1 << 19
MAX_FEATURES = 2_048
#: Standard deviations by which a feature must be likelier in positives.
MIN_GAIN = 5.0
#: Lengths of word beginnings that are features.
STEMS = (4, 5, 6)

WORDS = re.compile(r"[^\W\d_]{2,}").findall


def features_of(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    parts = [f"={word}"] + [word[:n] for n in STEMS if len(word) > n]
    return tuple(zlib.crc32(p.encode()) % SPACE for p in parts)


def levels(count: int, words: int) -> list[int]:
    """The levels at which a feature is there."""
    return [level for level, on in enumerate((True, count > 1, count * 100 >= words, count > 1 and count * 200 >= words)) if on]


class Extractor:
    """Features of a text as ``4 * hash + level``, or as columns of ``known``
    where that is given; words are memoised up to a bound."""

    LIMIT = 100_000

    def __init__(self, known: np.ndarray | None = None):
        self.columns = None if known is None else {int(f): i for i, f in enumerate(known)}
        self.hashes = None if known is None else {int(f) // 4 for f in known}
        self.memo: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = features_of(word)
        if self.hashes is not None:
            found = tuple(f for f in found if f in self.hashes)
        if len(self.memo) >= self.LIMIT:
            self.memo.clear()
        self.memo[word] = found
        return found

    def __call__(self, text: str) -> list[int]:
        memo, make = self.memo, self.of_word
        words = WORDS(text.lower())
        counts: dict[int, int] = {}
        for word, n in Counter(words).items():
            found = memo.get(word)
            for f in make(word) if found is None else found:
                counts[f] = counts.get(f, 0) + n
        out = [4 * f + level for f, n in counts.items() for level in levels(n, len(words))]
        return sorted(out if self.columns is None else (self.columns[f] for f in out if f in self.columns))


@dataclass
class Model:
    features: np.ndarray  # hashed features, ascending
    weights: np.ndarray
    bias: float

    def scores(self, rows: list[list[int]]) -> list[float]:
        raw = np.array([self.bias + float(self.weights[r].sum()) for r in rows], np.float64)
        return np.where(np.isneginf(raw), 0.0, _sigmoid(raw)).tolist()


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """``id, positive, text`` of at most MAX_POSITIVE + MAX_UNLABELLED rows,
    chosen by a hash of their ids, and the share of toxic rows among those that
    may be learned from."""
    known = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out())
        .groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") == 1).alias("toxic"))
    )
    total, toxic = known.agg(F.count("*"), F.count_if("toxic")).first()
    order = F.xxhash64("id")
    positives = known.where("toxic").orderBy(order, "id").limit(MAX_POSITIVE).select("id", F.lit(True).alias("positive"))
    rest = known.orderBy(F.xxhash64(order), "id").limit(MAX_UNLABELLED).select("id", F.lit(False).alias("positive"))
    chosen = positives.unionByName(rest)  # bounded by the two limits
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    return texts, (toxic / total if total else 0.0)


def gather(texts: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and positive flags of the sample, in a fixed order."""

    def make():
        extract = Extractor()
        return lambda ids, rows: [ids, [np.array(extract(t), np.int32).tobytes() for t in rows]]

    flagged = texts.select((F.col("id") * 2 + F.col("positive").cast("long")).alias("id"), "text")
    found = map_texts(flagged, make, "id bigint, f binary", pa.schema([("id", pa.int64()), ("f", pa.binary())]), "id", "text")
    rows = sorted((r["id"], bytes(r["f"])) for r in found.toLocalIterator())
    return [np.frombuffer(f, np.int32) for _, f in rows], np.array([i % 2 for i, _ in rows], bool)


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, epochs: int = 20, batch: int = 512, rate: float = 0.02, decay: float = 3e-4, seed: int = 0) -> Model:
    """Minimise the non-negative risk with the logistic loss by Adam."""
    n_pos, n_rest = int(positive.sum()), int((~positive).sum())
    if not n_pos or not n_rest:
        return Model(np.zeros(0, np.int32), np.zeros(0), -np.inf if not n_pos else 0.0)
    counts = np.zeros((2, 4 * SPACE), np.int32)
    for r, p in zip(rows, positive, strict=True):
        counts[int(p), r] += 1
    seen = np.flatnonzero(counts[1] >= 3)
    share_p, share_u = counts[1, seen] / n_pos, (counts[0, seen] + 0.5) / (n_rest + 0.5)
    gain = (share_p - share_u) / np.sqrt(share_u / n_pos)  # in standard deviations
    order = np.argsort(-gain, kind="stable")[:MAX_FEATURES]
    chosen = np.sort(seen[order[gain[order] >= MIN_GAIN]]).astype(np.int32)
    del counts
    x = np.zeros((len(rows), len(chosen)), np.uint8)
    for i, r in enumerate(rows):
        at = np.searchsorted(chosen, r)
        inside = at < len(chosen)
        at = at[inside]
        x[i, at[chosen[at] == r[inside]]] = 1
    rng = np.random.default_rng(seed)
    pos, rest = np.flatnonzero(positive), np.flatnonzero(~positive)
    w, m, v = (np.zeros(len(chosen) + 1) for _ in range(3))
    step = 0
    share = max(1, min(batch, n_pos) // 2)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rest), max(1, n_rest // batch)):
            p_rows = rng.choice(pos, share)
            xp, xu = x[p_rows].astype(np.float64), x[part].astype(np.float64)
            sp, su = _sigmoid(xp @ w[:-1] + w[-1]), _sigmoid(xu @ w[:-1] + w[-1])
            # logistic loss: log(1 + e^-x) as class 1 and log(1 + e^x) as class 0
            as_zero = (np.logaddexp(0, xu @ w[:-1] + w[-1]).mean(), np.logaddexp(0, xp @ w[:-1] + w[-1]).mean())
            down_p, down_u = -prior * sp / len(sp), su / len(su)
            if as_zero[0] - prior * as_zero[1] >= 0:
                p_slope, u_slope = -prior * (1 - sp) / len(sp) + down_p, down_u
            else:
                p_slope, u_slope = -down_p, -down_u
            grad = np.append(p_slope @ xp + u_slope @ xu, p_slope.sum() + u_slope.sum())
            grad[:-1] += decay * w[:-1]
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(chosen, w[:-1], float(w[-1]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text)."""
    texts, prior = sample(docs, labels)
    rows, positive = gather(texts)
    return fit(rows, positive, prior, **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row."""

    def make():
        extract = Extractor(model.features)
        return lambda ids, texts: [ids, model.scores([extract(t) for t in texts])]

    typed = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_texts(typed, make, "id bigint, score double", pa.schema([("id", pa.int64()), ("score", pa.float64())]), "id", "text")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that score ``threshold``
    or more."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(model.features)
        for batch in batches:
            for part in row_slices(batch, at):
                scores = model.scores([extract(t or "") for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
