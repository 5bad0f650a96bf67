import random

import pytest

from twinreel.operators import search as S

WORDS = [f"w{i}" for i in range(2)]
SCHEMA = "id bigint, path string, duration int, w0 bigint, w1 bigint"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def item(i, duration, value, path=None):
    return i, path or f"/v/{i:04}", duration, signed(value & (1 << 64) - 1), signed(value >> 64)


def cluster(rng, first, size, start, flips, duration=0):
    rows = []
    for i in range(size):
        value = start
        for b in rng.sample(range(128), rng.randint(0, flips)):
            value ^= 1 << b
        rows.append(item(first + i, duration, value))
    return rows


def scan(rows, bits):
    """The search as a scan in order."""
    order = sorted(rows, key=lambda r: (r[2], r[1].encode()))
    value = {r[0]: (r[3] % (1 << 64)) | (r[4] % (1 << 64)) << 64 for r in rows}
    claimed, out = {}, {}
    for i, lead in enumerate(order):
        if lead[0] in claimed:
            continue
        for r in order[i + 1 :]:
            if r[0] not in claimed and r[2] <= int(1.1 * lead[2]) and (value[r[0]] ^ value[lead[0]]).bit_count() <= bits:
                claimed[r[0]] = lead[0]
                out[r[0]] = lead[0]
    return out


def found(spark, rows, bits):
    got = S.search(spark.createDataFrame(rows, SCHEMA), bits / 128, WORDS, 128)
    return {r["member"]: r["leader"] for r in got.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_a_scan(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(6):
        rows += cluster(rng, 100 * k, 12, rng.getrandbits(128), 14, rng.choice([0, 1, 5, 10, 11, 50]))
    assert found(spark, rows, 16) == scan(rows, 16)


def test_chain_longer_than_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(S.leaders, "__defaults__", (2,))
    value, rows = 0, []
    for i in range(12):  # neighbours are similar, others are not
        rows.append(item(i, 7, value))
        value ^= 0b1111 << (4 * i)
    assert found(spark, rows, 4) == scan(rows, 4) == {1: 0, 3: 2, 5: 4, 7: 6, 9: 8, 11: 10}


def test_empty(spark):
    assert found(spark, [], 128) == {}


def test_durations_part_clones(spark):
    rng = random.Random(2)
    rows = cluster(rng, 0, 8, 0, 2, 50)
    rows += [(r[0] + 100, r[1] + "x", 250, *r[3:]) for r in rows[:4]]
    got = found(spark, rows, 8)
    assert sorted({sum(v == lead for v in got.values()) + 1 for lead in got.values()}) == [4, 8]


def test_references(spark):
    rng = random.Random(4)
    starts = [rng.getrandbits(128) for _ in range(3)]
    rows = [r for k, s in enumerate(starts) for r in cluster(rng, 100 * k, 4 + k, s, 3)]
    refs = [item(1000 + k, 0, s) for k, s in enumerate(starts)]
    make = lambda x: spark.createDataFrame(x, SCHEMA)
    got = S.search_with_references(make(refs), make(rows), 3 / 128, WORDS, 128)
    assert {r["reference"]: r["count"] for r in got.groupBy("reference").count().collect()} == {1000: 4, 1001: 5, 1002: 6}
    twice = make([refs[0], item(2000, 0, starts[0])])
    assert S.search_with_references(twice, make(rows), 3 / 128, WORDS, 128).count() == 8
    only = S.search_with_references(twice, make(rows), 3 / 128, WORDS, 128, exclusive=True).collect()
    assert len(only) == 4 and {r["reference"] for r in only} == {1000}


def test_the_join_divides_a_crowded_bin(spark, monkeypatch):
    monkeypatch.setattr(S, "BIN_ROWS", 10)
    rng = random.Random(5)
    rows = cluster(rng, 0, 45, 0, 6, 30)
    assert found(spark, rows, 6) == scan(rows, 6)
