"""The prefix trie against plain dictionaries."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import types as T

from visitstat.llm.prefix_trie import common, conversations, ending_digests, forest, trie, with_shared_heads
from visitstat.llm.queries import op12

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("conv", "seq", "depth", "n", "part")])


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def ordered(data):
    convs = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    return {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]        # SQL's remainder
    return out


def brute(convs):
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        cost = (len(m) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += cost
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def generated(seed, n):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for turn in range(rng.choice([1, 2, 2, 3, 5, 8])):
            out.append((c * rng.choice([1, 1, 7]), turn, rng.choice("ua"), rng.choice(["x", "yy", "é🙂", None, ""])))
    return out


ODD = [(None, 1, "user", "nowhere"), (5, None, "user", "first"), (5, 0, None, None), (5, 0, None, None), (5, 0, "a", "b"), (900, 3, "a", "tie"),
       (900, 3, "a", "tie"), (900, 3, "u", "tie"), (7, 1, "u", "x" * 300_000), (-3, 1, "u", "below"), (3 << 40, 1, "u", "x")]


def frame(spark, data):
    return spark.createDataFrame([(*r, *["z"] * 5) for r in data], TURNS)


@pytest.mark.parametrize("seed,parts", [(0, 1), (1, 3), (2, 24)])
def test_trie_equals_plain_dictionaries(spark, seed, parts):
    data = generated(seed, 200) + ODD
    rng = random.Random(seed)
    data += [(10_000 + i, d, "u", t) for i in range(60) for d, t in enumerate(["same", "talk", "here"])]         # copies
    data += [(20_000, d, "u", rng.choice("ab")) for d in range(400)] + [(20_001, d, "u", "a") for d in range(400)]  # long ones
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        convs = conversations(frame(spark, data))
        for made, want in ((convs, ordered(data)), (with_shared_heads(convs), rebuilt(ordered(data)))):
            got = [tuple(r) for r in trie(made).collect()]
            assert len(got) == len(set(got)) and set(got) == brute(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_turnless(spark):
    assert trie(with_shared_heads(conversations(frame(spark, [])))).collect() == []
    assert trie(conversations(frame(spark, [(None, 1, "u", "x")]))).collect() == []
    c = next(i for i in range(101, 200) if zlib.crc32(str(i).encode()) % 6 > 1)       # its only turn is dropped, its group has no first
    (root,) = trie(with_shared_heads(conversations(frame(spark, [(c, 1, "u", "x")])))).collect()
    assert tuple(root) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


def test_forest_has_every_branch():
    rng = random.Random(1)
    for _ in range(200):
        seqs = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 12))})
        wide = [b"".join(bytes([x]) * 16 for x in s) for s in seqs]
        lcp = [common(a, b) for a, b in zip(wide, wide[1:])]
        depth, parent = forest([len(s) for s in seqs], lcp)
        want = {s for s in seqs} | {a[:n] for a, n in zip(seqs, lcp)}
        assert len(depth) == len(want)
        for i, s in enumerate(seqs):
            path, v = [], i
            while v >= 0:
                path.append(depth[v])
                v = parent[v]
            assert path == [d for d in range(len(s), -1, -1) if s[:d] in want]


def test_ending_digests_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr("visitstat.llm.prefix_trie.PIECE_IDS", 7)
    rows = [(1, i * 3 - 50) for i in range(500)] + [(2, 9)]
    got = dict(tuple(r) for r in ending_digests(spark.createDataFrame(rows, "ending bigint, conv bigint").repartition(5)).collect())
    assert got == {1: hashlib.sha256(",".join(str(c) for _, c in rows[:-1]).encode()).hexdigest(), 2: hashlib.sha256(b"9").hexdigest()}


def test_query_equals_its_sql_and_plain_dictionaries(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    got = {tuple(r) for r in op12.query(spark, "/root/testdata/sf0.01").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    assert got == set(con.execute(op12.ORACLE_SQL).fetchall())
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert got == brute(rebuilt(ordered(rows)))
