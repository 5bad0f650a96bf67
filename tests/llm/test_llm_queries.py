"""The registered queries on the smallest tables, against plain versions."""

import hashlib
import json
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from twinreel.llm import bpe, decontam, queries, simhash, token_counts

from test_operators import passages, removal, simhash_plain

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_file("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op1_bpe(spark, DATA).collect()} == want


def test_op3(spark, texts):
    rows = queries.op3_toxicity(spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_op4(spark, texts):
    rows = queries.op4_simhash(spark, DATA).collect()
    prints = {i: simhash_plain(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, p in prints.items():
            low = min(root[j] for j, q in prints.items() if (p ^ q).bit_count() <= simhash.RADIUS)
            changed |= low != root[i]
            root[i] = low
    assert {r["doc_id"]: r["component_id"] for r in rows} == root


def test_op5(spark, texts):
    bpe_ = token_counts.load(queries.BYTE_TOKENIZER)
    rows = queries.op5_token_counts(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t, n = texts[r["doc_id"]], len(texts[r["doc_id"]])
        after = token_counts.apply_edits(t, [(n // 2, n // 2, " [an edit, made later] "), (n // 3, n // 3 + 40, ""), (0, 5, "It's ")])
        whole = [token_counts.CountTree(x, bpe_) for x in (t, after)]
        assert (r["n_tokens"], r["n_tokens_edited"], r["n_pretokens_edited"]) == (whole[0].total(), whole[1].total(), whole[1].pretokens())
        assert r["n_edits"] == 3 and r["n_reencoded"] <= 120


def test_op7(spark, texts):
    rows = queries.op7_sharding(spark, DATA).collect()
    size = {i: len(t.encode()) + 8 for i, t in texts.items()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (size[i], zlib.crc32(t.encode())) for i, t in texts.items()}
    slots, shards = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
        shards[texts[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())


def test_op9(spark, texts):
    rows = queries.op9_suffix_dedup(spark, DATA).collect()
    kept = Counter({(i, n, gone, spans, hashlib.sha256(rest).hexdigest()): c for (i, n, gone, spans, rest), c in removal(list(texts.items()), 400).items()})
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == kept
    assert Counter((r["doc_id"], r["n_passages"]) for r in rows) == passages(list(texts.items()), 51)


def test_op10(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bags = {i: (Counter(decontam.shingles(w)), len(w)) for i, w in ((i, decontam.WORDS(t.lower())) for i, t in items)}
    want = set()
    for doc, t in texts.items():
        words = decontam.WORDS(t.lower())
        windows = {}  # all windows of each length, whatever they hold
        for item, (bag, n) in bags.items():
            if n not in windows:
                windows[n] = [Counter(decontam.shingles(words[s : s + n])) for s in range(max(1, len(words) - n + 1))] if set(words) & {w for b, _ in bags.values() for s in b for w in s} else []
            if any(decontam.similarity(w, bag) >= decontam.THRESHOLD for w in windows[n] if any(s in bag for s in w)):
                want.add((doc, item))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, DATA).collect()}
    assert got == want and want


def test_recall_of_the_radius():
    """Windows at the similarity lie within the radius, by far."""
    import random

    r, apart = random.Random(4), []
    for _ in range(400):
        words = [str(r.random()) for _ in range(r.randint(12, 120))]
        other = list(words)
        while decontam.similarity(Counter(decontam.shingles(words)), Counter(decontam.shingles(other))) >= decontam.THRESHOLD:
            last = list(other)
            other[r.randrange(len(other))] = str(r.random())
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words + last))}
        codes = [decontam.shingle_codes(np.array([numbers[w] for w in t])) for t in (words, last)]
        prints = [np.packbits(decontam.bits_of(c).sum(0) > 0) for c in codes]
        apart.append(int(np.bitwise_count(prints[0] ^ prints[1]).sum()))
    assert np.mean([a <= decontam.RADIUS for a in apart]) >= 0.99, json.dumps(apart)
