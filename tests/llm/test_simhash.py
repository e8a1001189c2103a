import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.data import frame, rows
from visitstat.llm.simhash import SEGMENTS, WIDTH, finer, fingerprint, forest, free_bits, keep_one, linked, links, near_groups, quarters


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def classes(fps):
    """Smallest index reachable over at most 3 differing bits, by brute force."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_equal_brute_force(spark):
    data = [(i, *r[1:]) for i, r in enumerate(rows())]
    got = sorted(near_groups(frame(spark, data), F.col("doc_id")).collect())
    fps = [plain(r[1]) for r in data]
    assert [g.fp % (1 << 64) for g in got] == fps
    assert [g.component for g in got] == classes(fps)


def test_long_text_in_blocks_equals_one_pass():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(400_000))
    words = text.split()
    codes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    bits = np.unpackbits(np.array(codes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=int)
    assert fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * int(bits[b]) > len(codes))


def test_every_near_pair_has_a_chain():
    """The pigeonring condition: for any difference of at most 3 bits some start passes."""
    rng = random.Random(2)
    for _ in range(3000):
        x = 0
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x |= 1 << b
        starts = []
        for i in range(SEGMENTS):
            seg = lambda k: x >> (64 - WIDTH * (k % SEGMENTS + 1)) & 0xFFFF  # noqa: E731, B023
            key = seg(i) == 0 and bin(seg(i + 1)).count("1") <= 1
            starts.append(key and bool(linked(np.array([x], np.uint64), i * WIDTH)[0]))
        assert any(starts)


def test_forest_connects_like_all_pairs():
    rng = random.Random(3)
    base = rng.getrandbits(64)
    members = sorted({base ^ sum(1 << b for b in rng.sample(range(16), rng.randint(0, 4))) for _ in range(300)})
    x = np.array(members, np.uint64)
    left, right = forest(x, 0)
    edges = list(zip(np.concatenate(left).tolist(), np.concatenate(right).tolist()))
    assert len(edges) < len(members)
    for a, b in edges:
        assert bin(a ^ b).count("1") <= 3


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(4)
    fps = sorted({sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(600)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links(df).collect()]
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in edges:
        root[find(a)] = find(b)
    assert len({find(f) for f in fps}) == 1


def test_keep_one_keeps_the_smallest_id_and_all_columns(spark):
    docs = frame(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    data = rows()
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0, i))
    cls = classes([plain(data[i][1]) for i in order])
    want = sorted((data[order[c]][0] is None, data[order[c]][0] or 0) for c in set(cls))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == want


def test_empty_table(spark):
    assert near_groups(frame(spark, []), F.col("doc_id")).collect() == []


def test_finer_keys_miss_no_pair():
    """Two members within the distance share one of the four finer keys, at every step."""
    rng = random.Random(8)
    for _ in range(300):
        slot = rng.randrange(64)
        bits, a = free_bits(slot), rng.getrandbits(64)
        assert bits.bit_count() == 32
        b = a
        for p in rng.sample([p for p in range(64) if bits >> p & 1], rng.randint(0, 3)):
            b ^= 1 << p
        key = rng.getrandbits(62)
        while bits.bit_count() > 3:
            assert sum(quarters(bits)) == bits
            keys, members, free = finer(key, np.array([a, b], np.uint64), bits)
            shared = [(int(k), int(f)) for k, f in zip(keys[::2], free[::2]) if k in keys[1::2]]
            assert shared and members.tolist() == [a, b] * 4
            key, bits = rng.choice(shared)


def families(seed, n, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(5):
        base = rng.getrandbits(64)
        while len(out) % n or not out:
            x = base
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.add(x)
        base = rng.getrandbits(64)
        out.add(base)
    return sorted(out)


@pytest.mark.parametrize("split", [3, 30])
def test_split_keys_connect_like_all_pairs(spark, split):
    fps = families(split, 60, 5)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links(df, split).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in edges:
        x, y = sorted((find(a), find(b)), key=fps.index)
        root[y] = x
    assert [fps.index(find(f)) for f in fps] == classes(fps)


def test_a_large_family_is_spread_over_keys(spark):
    """Many different near copies of one text: no key holds more than the bound when it is compared."""
    rng = np.random.default_rng(5)
    flips = rng.random((4_000, 64)) < 0.03
    fps = np.unique((flips * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=1, dtype=np.uint64))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    whole, cut = (sorted((r.a, r.b) for r in links(df, n).collect()) for n in (1 << 15, 300))
    index = {int(f): i for i, f in enumerate(fps.view(np.int64))}

    def roots(edges):
        root = list(range(len(fps)))
        for a, b in edges:
            i, j = index[a], index[b]
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            while root[j] != j:
                root[j] = root[root[j]]
                j = root[j]
            root[max(i, j)] = min(i, j)
        def top(i):
            while root[i] != i:
                i = root[i]
            return i
        return [top(i) for i in range(len(fps))]
    assert len(fps) > 1_500 and roots(whole) == roots(cut)
