"""Operators against brute force, and on tables with everything odd in them."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinreel import storage
from twinreel.llm import bpe, decontam, exact_dedup, licenses, near_dedup, sharding, simhash, suffix_dedup, token_counts, toxicity, warc

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
rng = random.Random(7)
LEXICON = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(LEXICON) for _ in range(n))


BASE = prose(300, 1)
PASSAGE = prose(90, 2)
#: Null and empty texts and ids, repeated rows, ties, copies, a very long text,
#: odd characters; columns whose names operators use themselves.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, BASE), (5, BASE), (6, BASE + " one more"), (6, BASE + " one more"), (None, "an id is missing"), (None, None),
    (7, prose(60, 3) + " " + PASSAGE + " " + prose(40, 4)), (8, PASSAGE + " " + prose(80, 5)), (9, "Σίσυφος İstanbul é́ \x1c\x85  <|endoftext|> don't 'RE x²"),
    (10, "z" * 30_000), (11, prose(9_000, 6)), (12, "Released under the MIT License. Apache-License mit license"), (13, "a"), (14, "\x00\x01 \x7f"),
]
SCHEMA = "doc_id bigint, text string, id bigint, key string, fp string, kept string, node bigint, shard int, z string, h bigint, label string, source string, lang string"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, 5, "k", None, "x", None, 1, "z", 0, None, None, "en") for i, t in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, toxic int, quality int")


@pytest.fixture(scope="module")
def docs(spark):
    return odd(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return odd(spark, [])


def by_id(rows, name="id"):
    out = defaultdict(list)
    for r in rows:
        out[r[name]].append(r)
    return out


def texts():
    out = defaultdict(list)
    for i, t in ODD:
        out[i].append(t or "")
    return out


def test_bpe_equals_the_tokenizers_library(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_file(WORD))
    rows = bpe.encode(docs, WORD).collect()
    assert len(rows) == len(ODD)
    expected = Counter()
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["id"], bytes(r["ids"]), r["decoded"]) for r in rows) == expected
    assert bpe.encode(empty, WORD).count() == 0
    again = bpe.decode(bpe.encode(docs, WORD), WORD).collect()
    assert Counter(r["decoded"] for r in again) == Counter(r["decoded"] for r in rows)


def test_odd_letters_and_marks_equal_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.tokenizer_file(WORD)), bpe.load(WORD)
    r = random.Random(11)
    pool = [chr(c) for c in (*range(0x20, 0x250), *range(0x300, 0x3D0), *range(0x590, 0x650), *range(0x89D, 0x900), *range(0x1AB0, 0x1AE0), *range(0x1C80, 0x1CE0), *range(0x1DC0, 0x2010), 0x10D50, 0x1E5D0)]
    texts = ["\u1dfa\u05bf", "\u1ac1\u1cdc", "\u089d\u0353", "\u1c89x", "\ua7cb\u0301", "\u0130\u0049 \u03a3\u03c2"]
    texts += ["".join(r.choice(pool) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text.encode("unicode_escape")


def test_merges_against_a_plain_loop():
    r = random.Random(3)
    merges = {}
    for rank in range(60):
        merges.setdefault(r.randrange(12) << bpe.BITS | r.randrange(12), rank << bpe.BITS | r.randrange(12))

    def plain(s):
        s = s[:]
        while True:
            best = min(((merges[a << bpe.BITS | b] >> bpe.BITS, i) for i, (a, b) in enumerate(zip(s, s[1:])) if a << bpe.BITS | b in merges), default=None)
            if best is None:
                return s
            i = best[1]
            s[i : i + 2] = [merges[s[i] << bpe.BITS | s[i + 1]] & (1 << bpe.BITS) - 1]

    for _ in range(400):
        s = [r.randrange(12) for _ in range(r.randrange(0, 40))]
        assert bpe.merge(s, merges) == plain(s)


@pytest.mark.parametrize("wide", [2, 3, 32])
def test_merges_through_several_levels(monkeypatch, wide):
    monkeypatch.setattr(bpe, "WIDE", wide)
    r = random.Random(wide)
    for kinds in (4, 12, 40):
        merges = {}
        for rank in range(60):
            merges.setdefault(r.randrange(kinds) << bpe.BITS | r.randrange(kinds), rank << bpe.BITS | r.randrange(kinds))
        for n in (2, wide, wide + 1, wide + 2, wide * wide + 1, wide * wide + 2, 300):
            want = s = [r.randrange(kinds) for _ in range(n)]
            while True:
                pairs = [merges.get(a << bpe.BITS | b, bpe.NONE) for a, b in zip(want, want[1:])]
                if not pairs or (low := min(pairs)) == bpe.NONE:
                    break
                i = pairs.index(low)
                want = [*want[:i], low & (1 << bpe.BITS) - 1, *want[i + 2 :]]
            assert bpe.merge(s, merges) == want


def test_words_of_the_basic_plane_are_cut_alike():
    own, r = bpe.load(WORD), random.Random(12)
    pool = [chr(c) for c in range(1, bpe.PLANE) if not 0xD800 <= c < 0xE000]
    texts = ["don't", "it's'", "x\uffff1", "'re'", "\U0001e900a", "a\U00010000"] + ["".join(r.choice(pool[: r.choice([127, 800, 70_000])]) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        assert max(text) >= bpe.BEYOND or own.plain_words.findall(text) == own.words.findall(text), text.encode("unicode_escape")
    every = "".join(pool)
    assert own.plain_words.findall(every) == own.words.findall(every)


def test_licenses(docs, empty):
    rows = by_id(licenses.scan(docs).collect())
    assert sum(map(len, rows.values())) == len(ODD) and licenses.scan(empty).count() == 0
    r = rows[12][0]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == (9, 3, 3, 7, "apache,mit", "apache,mit")
    for i, t in ((1, ""), (2, ""), (14, "")):
        assert (rows[i][0]["n_words"], rows[i][0]["labels"], rows[i][0]["score"]) == (0, "", 0.0)
    assert rows[10][0]["n_words"] == 1 and rows[11][0]["n_words"] == 9000


def test_a_contained_match_is_suppressed(spark):
    docs = odd(spark, [(1, "under the terms of the GNU General Public License version 3"), (2, "the GPL license and the BSD license")])
    rows = by_id(licenses.scan(docs).collect())
    assert rows[1][0]["labels"] == "gpl,gpl-3.0" and rows[2][0]["labels"] == "bsd,gpl"
    found = licenses.detections(docs.where("doc_id = 1")).where("place is not null").collect()
    assert any(not r["kept"] for r in found) and all(r["kept"] for r in found if r["base"])
    assert len(licenses.rules()) >= 200


def test_toxicity(spark, docs, empty):
    r = random.Random(1)
    rows, marks = [], []
    for i in range(600):
        toxic = i % 8 == 0
        words = prose(r.randint(20, 80), 1000 + i).split()
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["vilestem", "vilestuff", "grimword"]) + r.choice(["", "er", "ing"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic), 1))
    table, known = odd(spark, rows), labels(spark, [*marks, *marks[:50], (None, 1, 1), (7, None, 1)])
    model = toxicity.learn(table, known)
    scores = {x["id"]: x["score"] for x in toxicity.score(table, model).collect()}
    held = {x["doc_id"] for x in table.where(toxicity.held_out()).collect()}
    right = [(scores[i] >= 0.5) == bool(t) for i, t, _ in marks if i in held]
    assert len(right) > 80 and np.mean(right) > 0.95
    kept = toxicity.keep_clean(table, model)
    assert kept.columns == table.columns and {x["doc_id"] for x in kept.collect()} == {i for i, s in scores.items() if s < 0.5}
    odd_scores = toxicity.score(docs, model).collect()
    assert len(odd_scores) == len(ODD) and all(0 <= x["score"] <= 1 for x in odd_scores)
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.learn(empty, labels(spark, []))
    assert {x["score"] for x in toxicity.score(docs, nothing).collect()} == {0.0}


def test_labels_of_held_out_rows_teach_nothing(spark):
    table = odd(spark, [(i, prose(30, i)) for i in range(200)])
    one = labels(spark, [(i, int(i % 5 == 0), 1) for i in range(200)])
    other = one.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(table, one), toxicity.learn(table, other)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_golay_keys_find_every_pair_within_three_bits():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 64, 500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in r.choice(64, r.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)

    def keys(x):
        row, key, side = simhash.complete_keys(x[:, None])
        return [[{k for k in key[(row == i) & (side & s > 0)].tolist()} for s in (1, 2)] for i in range(len(x))]

    for (na, ka), (nb, kb) in zip(keys(a), keys(b), strict=True):
        assert na & kb and nb & ka


def simhash_plain(text):
    import xxhash

    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ODD) and simhash.near_duplicates(empty).count() == 0
    prints = [(r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows]
    plain = {i: simhash_plain(t or "") for i, t in ODD if i not in (None, 9, 14)}
    assert all(plain[i] == f for i, f, _ in prints if i in plain)
    assert {c for i, f, c in prints if f == 0} == {1}
    r = random.Random(5)
    base, rows = prose(400, 50), []
    for i in range(300):  # near copies in a crowd, and texts of their own
        words = (base if i % 2 else prose(400, 5000 + i)).split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(400)] = r.choice(LEXICON)
        rows.append((i, " ".join(words)))
    got = simhash.near_duplicates(odd(spark, rows)).collect()
    fp = {x["id"]: x["fp"] % (1 << 64) for x in got}
    root = {i: i for i in fp}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 3 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {x["id"]: x["component_id"] for x in got} == {i: find(i) for i in fp}


def crowd_of(n, seed):
    """Fingerprints a few bits from one, as a group of near copies has them."""
    r = np.random.default_rng(seed)
    flips = (r.random((n, 64)) < 0.05) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    return np.sort(np.unique(np.uint64(0x123456789ABCDEF) ^ flips.astype(np.uint64)).view(np.int64))


@pytest.mark.parametrize("crossing", [simhash.CROSSING, 0])
def test_a_crowd_against_all_pairs(spark, monkeypatch, crossing):
    monkeypatch.setattr(simhash, "CROSSING", crossing)  # none: all of the crowd meets by balls
    prints = crowd_of(400, 1)
    nodes = spark.createDataFrame([(int(x), int(x), int(x)) for x in prints], "node bigint, check bigint, word bigint")
    got = {r["node"]: r["root"] for r in simhash.components(nodes, simhash.complete_keys, ["word"], 3, name="crowd").collect()}
    near = np.bitwise_count(prints.view(np.uint64)[:, None] ^ prints.view(np.uint64)[None, :]) <= 3
    label = np.arange(len(prints))
    for _ in range(len(prints)):
        fresh = np.where(near, label[None, :], len(prints)).min(1)
        if (fresh == label).all():
            break
        label = fresh
    linked = near.sum(1) > 1
    assert {int(prints[i]): int(prints[label[i]]) for i in np.flatnonzero(linked)} == {n: int(prints[label[np.searchsorted(prints, r)]]) for n, r in got.items()}


def test_work_for_a_crowd_is_linear(spark):
    rows = []
    for n in (500, 2000):
        nodes = spark.createDataFrame([(int(x), int(x), 0) for x in crowd_of(n, 2)], "node bigint, check bigint, root bigint")
        rows.append(simhash.balls(nodes, 1).count() + simhash.balls(nodes, 2).count())
    assert rows[1] <= 4.2 * rows[0]


def test_a_shared_key_links_in_either_direction(spark):
    """Keys of three nodes each: one that has the key on its near side only,
    one within the radius on the other side, and one far from both."""

    def keys(words):
        word = words[:, 0].astype(np.int64)
        return np.arange(len(word)), word // 3, np.where(word % 3 == 0, simhash.NEAR_SIDE, simhash.ALL_SIDE).astype(np.int8)

    r = random.Random(4)
    rows = [(node, (0, 1, (1 << 62) - 1)[word % 3], word) for word, node in enumerate(r.sample(range(10_000), 120))]
    nodes = spark.createDataFrame(rows, "node bigint, check bigint, word bigint")
    linked = {x["node"]: x["root"] for x in simhash.components(nodes, keys, ["word"], 1, name="either").collect()}
    for at in range(0, 120, 3):
        a, b, far = (node for node, _, _ in rows[at : at + 3])
        assert far not in linked and linked[a] == linked[b]


def test_near_dedup(spark, docs, empty):
    assert near_dedup.groups(docs).count() == len(ODD) and near_dedup.groups(empty).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 4, 7, 8, 10, 11, 12}
    assert {5, 6} & {r["doc_id"] for r in kept.collect()} == set()
    rows = [(i, prose(200, 100 + i)) for i in range(20)]
    for i in range(20):
        words = rows[i][1].split()
        words[i * 7 % 200] = "edited"
        rows.append((100 + i, " ".join(words)))
    got = {r["id"]: r["group_id"] for r in near_dedup.groups(odd(spark, rows)).collect()}
    assert got == {i: i % 100 for i in got}


def test_near_dedup_against_all_pairs(spark):
    """Pairs of all similarities from 0.7 to 0.95, and a crowd of copies that
    are similar to some of each other only."""
    r = random.Random(11)
    rows, crowd = [], prose(150, 9)
    for i in range(300):
        words = (prose(r.randint(40, 200), 2000 + i) if i < 200 else crowd).split()
        rows.append((2 * i, " ".join(words)))
        for _ in range(max(1, round(len(words) * r.uniform(0.005, 0.035)))):
            words[r.randrange(len(words))] = r.choice(LEXICON)
        rows.append((2 * i + 1, " ".join(words)))
    sets = {i: set(near_dedup.shingle_set(t).tolist()) for i, t in rows}
    root, close = {i: i for i in sets}, 0

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in sets:
        for j in sets:
            if i < j and (both := len(sets[i] & sets[j])) and 5 * both >= 4 * len(sets[i] | sets[j]):
                close += i < 400 and 10 * both < 9 * len(sets[i] | sets[j])
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert close > 50
    got = {x["id"]: x["group_id"] for x in near_dedup.groups(odd(spark, rows)).collect()}
    assert got == {i: find(i) for i in got}


def test_token_counts(spark, docs, empty):
    import tiktoken

    counter = token_counts.load(BYTE)
    import base64

    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.tokenizer_file(BYTE), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    inserts = ["", " ", "\n\n", "'s", "re", "é", "12 ", "more words here " * 9]
    for text in [t or "" for _, t in ODD if t is None or len(t) < 20_000]:
        tree = token_counts.CountTree(text, counter)
        for _ in range(12):
            start = r.randint(0, len(text))
            change = (start, start + r.choice([0, 1, 3, 60]), r.choice(inserts))
            tree.edit(*change)
            text = token_counts.apply_edits(text, [change])
            assert tree.text == text and tree.total() == len(library.encode_ordinary(text))
            assert tree.pretokens() == len(counter.cut.findall(text))
    edited = docs.withColumn("edits", F.expr("array(named_struct('start', 3L, 'end', 9L, 'insert', 'new'), null)"))
    rows = token_counts.counts(edited, BYTE, edits_col="edits").collect()
    expected = Counter((i, len(library.encode_ordinary(t or "")), len(library.encode_ordinary(token_counts.apply_edits(t or "", [(3, 9, "new")])))) for i, t in ODD)
    assert Counter((x["id"], x["n_tokens"], x["n_tokens_edited"]) for x in rows) == expected
    assert token_counts.counts(empty, BYTE).count() == 0


def test_exact_dedup(docs, empty):
    rows = exact_dedup.groups(docs).collect()
    same = defaultdict(list)
    for i, t in ODD:
        same[t or ""].append(i)
    expected = Counter()
    for t, ids in same.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows) == expected
    assert exact_dedup.groups(empty).count() == 0
    assert exact_dedup.keep_one(docs).columns == docs.columns


def test_directory_doubles_and_keeps_order():
    depth, slots = exact_dedup.directory({0: 10, 1: 10, 7: 3, 15: 90}, 4, 20)
    assert depth == 4 and len(slots) == 16 and slots == sorted(slots) and slots[0] == slots[1] and slots[14] != slots[15]
    assert exact_dedup.directory({}, 4, 20) == (0, [0])


def test_texts_of_one_key_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.length(c[0]).cast("bigint") % 2)
    rows = exact_dedup.groups(docs).collect()
    same = Counter(t or "" for _, t in ODD)
    assert Counter((r["text_sha256"], r["group_size"]) for r in rows) == Counter((hashlib.sha256((t or "").encode()).hexdigest(), same[t or ""]) for _, t in ODD)


def test_sharding(spark, docs, empty):
    for table, n in ((docs, len(ODD)), (odd(spark, [(i, prose(5 + i % 90, i // 2)) for i in range(600)]), 600)):
        rows = sharding.shard(table, 5).collect()
        assert len(rows) == n
        slots, at = defaultdict(list), defaultdict(set)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            at[r["text_crc32"], r["size"]].add(r["shard"])
        assert set(slots) <= set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(s) == 1 for s in at.values())
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    assert sharding.shard(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é" + "x" * 700_000
    pages = [(3, "http://a/b c", BASE), (1, None, BASE), (2, "u", "short"), (5, "u", "short"), (4, "u", None), (6, "u", long), (None, "u", BASE), (2, "u", "short")]
    table = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id bigint, url string, html string, digest string, first string")
    bundles = warc.write(table)
    rows = warc.read(bundles).collect()
    got = Counter((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in rows)
    expected = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = len(data) >= 100 and html == BASE and i not in (1, None)
        expected[i, "revisit" if revisit else "response", len(data), hashlib.sha256(data).hexdigest(), 1 if revisit else None] += 1
    assert got == expected
    names = warc.export(bundles, str(tmp_path))
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().stream_reader((tmp_path / n).open("rb"), read_across_frames=True).read() for n in names)
    assert whole.count(b"WARC/1.1\r\n") == len(pages)
    reader = warc.BundleReader(next((tmp_path / n).read_bytes() for n in names if any(e[0] == 6 for e in warc.BundleReader((tmp_path / n).read_bytes()).index)))
    assert next(reader.find(6))[1].decode() == long
    assert warc.read(warc.write(table.limit(0))).count() == 0


def removal(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = Counter()
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out[i, len(d), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept] += 1
    return out


@pytest.mark.parametrize("contexts", [2, 4096])
def test_suffix_dedup(spark, docs, empty, monkeypatch, contexts):
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", contexts)
    r = random.Random(contexts)
    crowd = [(i, prose(30, i) + " " + " ".join(PASSAGE.split()[r.randint(0, 30) : 40 + r.randint(0, 50)]) + " " + prose(20, 900 + i)) for i in range(60)]
    for rows, table in ((ODD, docs), (crowd, odd(spark, crowd))):
        length, passage = (400, 51) if rows is ODD else (60, 9)
        got = suffix_dedup.remove(table, length=length, passage=passage).collect()
        assert Counter((x["id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got) == removal(rows, length)
        assert Counter((x["id"], x["n_passages"]) for x in got) == passages(rows, passage)
    assert suffix_dedup.remove(empty).count() == 0


def passages(rows, size):
    """Maximal runs of words that windows which other ids have too cover."""
    ids = defaultdict(set)
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - size + 1):
            ids[tuple(words[k : k + size])].add(i)
    out = Counter()
    for i, t in rows:
        words, covered = (t or "").encode().split(), set()
        for k in range(len(words) - size + 1):
            if len(ids[tuple(words[k : k + size])]) > 1:
                covered |= set(range(k, k + size))
        out[i, sum(k - 1 not in covered for k in covered)] += 1
    return out


def test_repeated_strings_against_counting():
    r = random.Random(0)
    for _ in range(40):
        contexts = [bytes(r.choice(b"ab\0\xff") for _ in range(r.randint(4, 60))) for _ in range(r.randint(1, 6))]
        length = r.randint(1, 4)
        seen = Counter(c[i : i + length] for c in contexts for i in range(len(c) - length + 1))
        arrays = [np.frombuffer(c, np.uint8) for c in contexts]
        for c, flags in zip(contexts, suffix_dedup.repeated_strings(arrays, length), strict=True):
            assert flags.tolist() == [seen[c[i : i + length]] > 1 for i in range(len(c) - length + 1)]
        owners, where = [r.randint(0, 2) for _ in contexts], defaultdict(set)
        for c, owner in zip(contexts, owners, strict=True):
            for i in range(len(c) - length + 1):
                where[c[i : i + length]].add(owner)
        wide = [a.astype(np.uint64) << np.uint64(40) for a in arrays]
        for c, flags in zip(contexts, suffix_dedup.repeated_strings(wide, length, owners), strict=True):
            assert flags.tolist() == [len(where[c[i : i + length]]) > 1 for i in range(len(c) - length + 1)]


def test_suffixes_are_sorted_to_the_length_only():
    r = random.Random(5)
    for alphabet in (b"ab", bytes(range(256))):
        symbols = np.array([r.choice(alphabet) for _ in range(300)] * 2, np.int32)
        for depth in (1, 2, 6, 23, 64, 100):
            rank, shared = suffix_dedup.suffix_ranks(symbols, depth)
            prefixes = [symbols[i : i + depth].tolist() for i in range(len(symbols))]
            counts = Counter(map(tuple, prefixes))
            assert sorted(shared.tolist()) == [i for i, p in enumerate(prefixes) if counts[tuple(p)] > 1]
            order = sorted(prefixes)
            assert rank.tolist() == [order.index(p) for p in prefixes]


@pytest.mark.parametrize("unit", [suffix_dedup.Bytes, suffix_dedup.Words])
def test_contexts_left_out_beforehand_hold_nothing(unit):
    r, length, gram, left_out = random.Random(9), 24, 6, 0
    kind = unit()
    shared = [bytes(r.choice(b"abc") for _ in range(r.randint(18, 60))) for _ in range(6)]
    block = []
    for doc in range(60):
        text = b"".join(r.choice([*shared, bytes(r.choice(b"abc") for _ in range(20))]) for _ in range(8))
        symbols = kind.symbols(text if unit is suffix_dedup.Bytes else b" ".join(bytes([c]) for c in text))
        for piece in suffix_dedup.Anchors(kind, length, gram).of(symbols):
            for anchor, _, place, first, last in zip(*(x.tolist() for x in piece), strict=True):
                block.append((anchor, 0, 1 + (anchor % 7 == 0), r.random() < 0.2, doc, 0, first, place - first, symbols[first : last + length].tobytes()))
    block.sort(key=lambda b: b[:2])
    kept = suffix_dedup.promising(block, length, gram, kind.width)
    assert len(kept) < len(block) and [b for b in block if b[2] > 1] == [b for b in kept if b[2] > 1]

    def found(rows):
        seen = defaultdict(set)
        strings = [(i, b, k, b[-1][k * kind.width : (k + length) * kind.width]) for i, b in enumerate(rows) for k in range(len(b[-1]) // kind.width - length + 1)]
        for i, *_, s in strings:
            seen[s].add(i)
        return {(b[4], b[6] + k) for _, b, k, s in strings if len(seen[s]) > 1 and not b[3]}

    assert found(kept) == found(block) != set()


def test_words_as_symbols(monkeypatch):
    text = " \n".join(LEXICON[:300]).encode() + b"\t"
    whole = suffix_dedup.Words().symbols(text)
    assert len(whole) == 300 and len(set(whole.tolist())) == len(set(LEXICON[:300]))
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)  # words that reach beyond a piece
    assert suffix_dedup.Words().symbols(text).tolist() == whole.tolist()
    assert len(suffix_dedup.Words().symbols(b" \n ")) == len(suffix_dedup.Words().symbols(b"")) == 0


def test_decontamination(spark, docs, empty):
    item = PASSAGE.split()
    near = item[:40]
    near[3] = "other"
    items = [(1, " ".join(item[:40])), (2, None), (3, ""), (4, "two words"), (5, " ".join(item[50:])), (1, " ".join(item[:40])), (None, " ".join(item[:40]))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    rows = decontam.leaks(docs, bench).collect()
    assert {(r["id"], r["item_id"]) for r in rows} == {(i, j) for i in (7, 8) for j in (1, 5, None)}
    assert {(r["id"], r["first_word"]) for r in rows if r["item_id"] == 1} == {(7, 60), (8, 0)}
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 2
    extra = odd(spark, [(1, prose(30, 70) + " " + " ".join(near) + " " + prose(30, 71)), (2, "just two words"), (3, prose(50, 72)), (4, " ".join(item[:20]))])
    assert {(r["id"], r["item_id"]) for r in decontam.leaks(extra, bench).collect()} == {(1, 1), (1, None), (2, 4)}


def test_decontamination_against_all_windows():
    r = random.Random(3)
    items = [(i, prose(r.randint(6, 40), 300 + i)) for i in range(8)]
    index = decontam.Index(items)
    for k in range(60):
        words = prose(r.randint(0, 120), 400 + k).split()
        for _ in range(2):
            piece = items[r.randrange(8)][1].split()
            if r.random() < 0.7:
                piece[r.randrange(len(piece))] = "x"
            at = r.randint(0, len(words))
            words[at:at] = piece[r.choice([0, 0, 1]) :]
        expected = {}
        for place, (_, text) in enumerate(items):
            want, n = Counter(decontam.shingles(text.split())), len(text.split())
            scores = [decontam.similarity(Counter(decontam.shingles(words[s : s + n])), want) for s in range(max(1, len(words) - n + 1))]
            if max(scores) >= 0.8:
                expected[place] = (scores.index(max(scores)), max(scores), sum(s >= 0.8 for s in scores))
        assert {m[0]: (m[1], m[3], m[4]) for m in index.matches(" ".join(words))} == expected


def test_signatures_of_license_bodies(spark):
    bodies = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        (2, "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "apache-2.0"),
        (3, "The Software shall be used for Good, not Evil.", "json"),
        (4, "This is free and unencumbered software released into the public domain.", "unlicense"),
        (5, "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "agpl,gpl"),
        (6, "nothing of the kind, though its permission and notice are words of rules", ""),
    ]
    rows = by_id(licenses.scan(odd(spark, [b[:2] for b in bodies])).collect())
    assert {i: rows[i][0]["labels"] for i, _, _ in bodies} == {i: want for i, _, want in bodies}


def test_every_signature_is_gated_by_a_word_of_its_own():
    from twinreel.llm.license_signatures import SIGNATURES

    assert len(SIGNATURES) > 200
    for _, keyword, expression in SIGNATURES:
        assert keyword in expression


def plain_fit(rows, positive, prior, epochs=40, batch=512, rate=0.02, decay=1e-3, seed=0):
    """The same learner, example by example: features, risk, its slope, Adam."""
    pos, rest = [i for i, p in enumerate(positive) if p], [i for i, p in enumerate(positive) if not p]
    counts = [Counter(), Counter()]
    for r, p in zip(rows, positive):
        counts[int(p)].update(r.tolist())
    gain = {}
    for f, n in counts[1].items():
        if n >= 3:
            u = (counts[0][f] + 0.5) / (len(rest) + 0.5)
            gain[f] = (n / len(pos) - u) / (u / len(pos)) ** 0.5
    chosen = sorted(sorted((f for f in gain if gain[f] >= toxicity.MIN_GAIN), key=lambda f: (-gain[f], f))[: toxicity.MAX_FEATURES])
    where = {f: i for i, f in enumerate(chosen)}
    held = [[where[f] for f in set(r.tolist()) if f in where] for r in rows]
    w, m, v, step = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0
    rng, share = np.random.default_rng(seed), max(1, min(batch, len(pos)) // 2)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(np.array(rest)), max(1, len(rest) // batch)):
            drawn = rng.choice(np.array(pos), share)
            raw = lambda i: w[-1] + sum(w[k] for k in held[i])
            risk_u = sum(np.log1p(np.exp(raw(i))) for i in part) / len(part)
            risk_p = sum(np.log1p(np.exp(raw(i))) for i in drawn) / len(drawn)
            fine = risk_u - prior * risk_p >= 0  # else the negative part alone is climbed down
            grad = np.zeros(len(w))
            for i in drawn:
                s = 1 / (1 + np.exp(-raw(i)))
                slope = (-prior * (1 - s) - prior * s if fine else prior * s) / len(drawn)
                grad[[*held[i], -1]] += slope
            for i in part:
                s = 1 / (1 + np.exp(-raw(i)))
                grad[[*held[i], -1]] += (s if fine else -s) / len(part)
            grad[:-1] += decay * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return chosen, w


def test_the_learner_against_a_plain_one():
    r = np.random.default_rng(3)
    rows, positive = [], []
    for i in range(300):
        toxic = i % 4 == 0
        features = set(r.integers(0, 400, 12).tolist()) | (set(r.integers(400, 430, 5).tolist()) if toxic else set())
        rows.append(np.array(sorted(features), np.int32))
        positive.append(bool(toxic and i % 8 == 0))
    for prior in (0.25, 0.9):  # the larger one makes the risk negative
        model = toxicity.fit(rows, np.array(positive), prior, epochs=6, batch=64)
        chosen, w = plain_fit(rows, positive, prior, epochs=6, batch=64)
        assert model.features.tolist() == chosen and chosen and np.allclose([*model.weights, model.bias], w, atol=1e-8)


def plain_tree(units, shards):
    """Shards of units (digest, weight, tie, values by dimension) by sorting."""
    total, heavy, rest = sum(u[1] for u in units), [], sum(u[1] for u in units)
    for digest, weight, *_ in sorted(units, key=lambda u: (-u[1], u[0]))[:shards]:
        if len(heavy) == shards - 1 or weight * (shards - len(heavy)) <= rest:
            break
        heavy.append(digest)
        rest -= weight
    out = {d: shards - 1 - i for i, d in enumerate(heavy)}

    def divide(part, first, n):
        if n == 1 or not part:
            out.update({u[0]: first for u in part})
            return
        widest = max(range(4), key=lambda d: (max(u[3][d] for u in part) - min(u[3][d] for u in part), -d))
        ordered = sorted(part, key=lambda u: (u[3][widest], u[2]))
        want, below, cut = sum(u[1] for u in part) * (n // 2) / n, 0, 0
        for cut, u in enumerate(ordered):
            if below + u[1] > want:
                if want - below > below + u[1] - want:
                    cut += 1
                break
            below += u[1]
        divide(ordered[:cut], first, n // 2)
        divide(ordered[cut:], first + n // 2, n - n // 2)

    divide([u for u in units if u[0] not in out], 0, shards - len(heavy))
    return out if total else {}


@pytest.mark.parametrize("shards", [5, 8])
def test_the_tree_against_a_plain_one(spark, shards):
    r = random.Random(9)
    rows = [(i, prose(r.randint(1, 120), i // 2)) for i in range(500)] + [(900, prose(4000, 1))]
    table = odd(spark, rows)
    raw = sharding.units(table, "doc_id", "text", "source", "lang").collect()
    low = {d: min(u[d] for u in raw) for d in sharding.DIMENSIONS}
    high = {d: max(u[d] for u in raw) for d in sharding.DIMENSIONS}
    top = (1 << sharding.VALUE_BITS) - 1
    place = lambda u, d: min(top, max(0, int((u[d] - low[d]) * (top / (high[d] - low[d]) if high[d] > low[d] else 0.0))))
    units = [(u["digest"], u["weight"], u["tie"] % (1 << sharding.HASH_BITS), [place(u, d) for d in sharding.DIMENSIONS]) for u in raw]
    assert {x["digest"]: x["shard"] for x in sharding.assign(table, shards).collect()} == plain_tree(units, shards)


def test_an_edit_encodes_a_few_pretokens_only():
    tree = token_counts.CountTree(prose(20_000, 8), token_counts.load(BYTE))
    for place in (0, 50_000, 100_000):
        before = tree.encoded
        tree.edit(place, place + 3, "word ")
        assert tree.encoded - before <= 40


def jaccard(a, b):
    x, y = set(near_dedup.shingle_set(a).tolist()), set(near_dedup.shingle_set(b).tolist())
    return len(x & y) / len(x | y)


def near_groups(texts):
    """Smallest id of each component of pairs of 0.8 or more, by all pairs."""
    sets = {i: set(near_dedup.shingle_set(t or "").tolist()) for i, t in texts.items()}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            like = [j for j, b in sets.items() if 9 * len(a & b) >= 4 * (len(a) + len(b))]
            low = min([root[i], *(root[j] for j in like)])
            changed |= low != root[i]
            root[i] = low
    return root


@pytest.mark.parametrize("crossing", [near_dedup.CROSSING, 0])
def test_near_copies_against_all_pairs(spark, monkeypatch, crossing):
    monkeypatch.setattr(near_dedup, "CROSSING", crossing)  # none: all that the pivots leave is refined
    r, texts = random.Random(21), {}
    for i in range(60):  # pairs just at the similarity, and the same with one more edit, just below it
        words = prose(r.randint(30, 260), 7000 + i).split()
        other = list(words)
        while jaccard(" ".join(words), " ".join(other)) >= 0.8:
            last = list(other)
            other[r.randrange(len(other))] = "edited" + str(r.random())
        texts |= {i: " ".join(words), 1000 + i: " ".join(last if i % 2 else other)}
    common = prose(40, 99)
    for i in range(60):  # a passage that unlike documents share, and near copies that differ from each other
        texts[2000 + i] = common + " " + prose(60, 8000 + i)
        words = prose(100, 55).split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(100)] = "edit" + str(r.random())
        texts[3000 + i] = " ".join(words)
    got = {x["id"]: x["group_id"] for x in near_dedup.groups(odd(spark, list(texts.items()))).collect()}
    assert got == near_groups(texts)


def test_near_dedup_without_ids(spark):
    words = prose(80, 31).split()
    rows = [(None, " ".join(words)), (None, " ".join([*words, "more"])), (3, " ".join([*words, "less"])), (4, prose(50, 32)), (None, prose(50, 33))]
    got = Counter((r["id"], r["group_id"]) for r in near_dedup.groups(odd(spark, rows)).collect())
    assert got == Counter({(None, 3): 2, (3, 3): 1, (4, 4): 1, (None, None): 1})


def test_broadcasts_are_bounded_whatever_the_session_allows(spark):
    before = spark.conf.get(storage.BROADCAST)
    with storage.small_broadcasts(spark):
        assert int(spark.conf.get(storage.BROADCAST)) == storage.BROADCAST_BYTES < int(before.rstrip("b"))
    assert spark.conf.get(storage.BROADCAST) == before


def test_rows_made_of_nodes_are_not_broadcast(spark, monkeypatch):
    """Spark takes them for as few bytes as the nodes, of which each makes some sixty."""
    plan, seen = lambda df: df._jdf.queryExecution().executedPlan().toString(), []
    monkeypatch.setattr(simhash, "materialize", lambda df, name: seen.append(plan(df)))
    node = spark.range(50).select(F.xxhash64("id").alias("node"))
    simhash.crowded_keys(node.select("node", F.col("node").alias("check"), F.col("node").alias("word")), simhash.complete_keys, ["word"], simhash.RADIUS, "keys")
    split = node.selectExpr("1L key", "3Y side", "node", "node check", "node root", "0L main", "50L crowd", f"{simhash.CROSSING + 1} * 50 pairs")
    seen.append(plan(simhash.crossing_pairs(split, simhash.RADIUS)))
    seen.append(plan(near_dedup.shared_keys(node.selectExpr("explode(array(node, 1L)) key", "node"))))
    assert len(seen) == 3 and "mapinarrow" in seen[1].lower()
    assert "Broadcast" not in seen[0] and "Broadcast" not in seen[2]
    assert "code" not in "".join(line for line in seen[1].splitlines() if "BroadcastHashJoin" in line)
