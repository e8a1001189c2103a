"""SimHash near-duplicates found by pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints
differ in at most 3 bits, some chain of consecutive segments keeps its
cumulative differences within the proportional budgets 3/4, 6/4, 9/4 and 3:
the first segment is equal, the first two differ in at most 1 bit, the first
three in at most 2. The first two conditions are the key of the candidate
index: the first segment as it is and the second with one bit masked (16
keys for each of the 4 starts, linear in the number of fingerprints). Inside a
key the third condition is checked, then the full Hamming distance.

Equal fingerprints are one vertex. Within a key only the edges of a spanning
forest are returned: members already reached are not compared again, so a
large group of near copies costs about one pass over it, and no set of all
pairs is made. Components follow from these edges.

A key with more than ``SPLIT`` members is not compared by one task. Its members go on, as they
stream by, to four finer keys each: the bits that the key does not fix are cut in four parts, and
two fingerprints within the distance agree in one of them. Finer keys are split again while they are too
large; each step fixes a quarter of what is left, and with ``FLOOR`` free bits (and the masked one) a key has
no more than ``SPLIT`` different members. That is three steps: 64 rows for a member of the largest keys.

Defined results: null and empty texts have no words and fingerprint zero,
linked like any other. Repeated rows have equal fingerprints. A null id is
ignored when a component's smallest id is taken (null if it has no other). An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.llm.common import batches, fresh, text_bytes, word_blocks
from visitstat.llm.components import components
from visitstat.session import write_table

SHINGLE = 3          # words per shingle
DISTANCE = 3         # links at this many differing bits or fewer
SEED = 42            # seed of XXH64
SEGMENTS, WIDTH = 4, 16
FLOOR = 14           # free bits from which on a key is not split
SPLIT = 2 << FLOOR   # most members of a key that are compared with each other in one place


def fingerprint(data: bytes, words: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text given as UTF-8 bytes."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for block in word_blocks(data.lower()):
        block = tail + block
        if len(block) >= words:
            joined = b" ".join(block)
            size = np.fromiter(map(len, block), np.int64, len(block))
            end = np.cumsum(size + 1) - 1
            start = (end - size)[:len(block) - words + 1].tolist()
            codes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start, end[words - 1:].tolist())]
            ones += bit_counts(np.array(codes, "<u8"))
            n += len(codes)
            block = block[len(block) - words + 1:]
        tail = block
    if n == 0 and tail:
        ones, n = bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], "<u8")), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def bit_counts(codes: np.ndarray) -> np.ndarray:
    """How many of the codes have each of the 64 bits set."""
    out = np.zeros(64, np.int64)
    for i in range(0, len(codes), 1 << 14):
        bits = np.unpackbits(codes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits.sum(axis=0, dtype=np.uint16)
    return out


def fingerprints(docs: DataFrame, doc_id: Column, text: str = "text", words: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed bigint."""
    src = docs.select(doc_id.alias("id"), text_bytes(text).alias("t"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            fp = np.array([fingerprint(t.as_py(), words) for t in b["t"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(fp)], ["id", "fp"])

    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("fp", T.LongType())]))


def ring_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): 64 index keys per fingerprint, for each start of a chain the
    first segment and the second with one of its bits masked."""
    fp = F.col("fp")
    heads = []
    for i in range(SEGMENTS):
        turned = fp if i == 0 else F.shiftleft(fp, WIDTH * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - WIDTH * i))
        heads.append(F.struct(F.lit(i * WIDTH).alias("slot"), F.shiftrightunsigned(turned, 32).alias("head")))
    chains = fps.select("fp", F.explode(F.array(*heads)).alias("c"))
    masked = [F.struct((F.col("c.slot") + j).cast("bigint").alias("slot"),
                       F.col("c.head").bitwiseAND(F.lit(~(1 << j))).alias("head")) for j in range(WIDTH)]
    keys = chains.select("fp", F.explode(F.array(*masked)).alias("k"))
    return keys.select(F.shiftleft(F.col("k.slot"), 32).bitwiseOR(F.col("k.head")).alias("key"), "fp")


def linked(x: np.ndarray, slot: int, distance: int = DISTANCE) -> np.ndarray:
    """Which differences satisfy the third budget of the chain that starts at
    ``slot``'s segment, then the full distance (the key holds the first two)."""
    total = np.bitwise_count(x)
    last = (slot // WIDTH + SEGMENTS - 1) % SEGMENTS      # the ring's remaining segment
    outside = np.bitwise_count((x >> np.uint64(64 - WIDTH * (last + 1))) & np.uint64((1 << WIDTH) - 1))
    return (total <= distance) & (total - outside <= 3 * distance // SEGMENTS)


def forest(members: np.ndarray, slot: int | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the linked members of one key; under a finer key (no
    ``slot``) the full distance alone decides.

    Each reached member is compared once with the members not reached yet.
    """
    left, right = [], []
    rest = members
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            u = front.pop()
            hit = np.bitwise_count(rest ^ u) <= DISTANCE if slot is None else linked(rest ^ u, slot)
            if hit.any():
                found = rest[hit]
                left.append(np.full(len(found), u, np.uint64))
                right.append(found)
                rest = rest[~hit]
                front.extend(found)
    return left, right


def free_bits(slot: int) -> int:
    """The bits that an index key does not fix: those of the ring's two other segments."""
    out = 0
    for k in (2, 3):
        out |= ((1 << WIDTH) - 1) << (64 - WIDTH * ((slot // WIDTH + k) % SEGMENTS + 1))
    return out


def quarters(bits: int) -> list[int]:
    """The set bits cut in four parts of nearly equal number."""
    places = [b for b in range(64) if bits >> b & 1]
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(places, np.int64), DISTANCE + 1)]


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def finer(key: int, members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, member, free bits) of the members under four finer keys each."""
    keys, free = [], []
    seed = mixed_bits(np.array([key & (1 << 64) - 1], np.uint64))
    for i, part in enumerate(quarters(bits)):
        keys.append(mixed_bits(mixed_bits(members & np.uint64(part)) ^ seed ^ np.uint64(i + 1)))
        free.append(np.full(len(members), bits & ~part, np.uint64))
    return np.concatenate(keys), np.tile(members, len(keys)), np.concatenate(free)


def _compared(keyed: DataFrame, split: int) -> tuple[DataFrame, int]:
    """(a, b, key, free) and the number of rows with a key: edges have none, members of keys that are too
    large come back under finer keys. ``free`` is null for the first index."""
    rows = keyed.repartition("key").sortWithinPartitions("key", "fp")
    names = ["a", "b", "key", "free"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, key, free) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if x is None else pa.array(x.view(np.int64))
                                               for x in (a, b, key, free)], names)

        def close(key: np.ndarray, fp: np.ndarray, free: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            """Runs of equal keys, all of them whole."""
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.r_[start, len(key)])
            left, right = [], []
            for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist()):
                if n > split and divisible(key[s], free, s):
                    yield move_on(key[s], fp[s:s + n], free, s)
                    continue
                a, b = forest(fp[s:s + n], int(key[s]) >> 32 if free is None else None)
                left += a
                right += b
            if left:
                yield out(np.concatenate(left), np.concatenate(right), None, None)

        def bits_of(key, free, s) -> int:
            return free_bits(int(key) >> 32) if free is None else int(free[s])

        def divisible(key, free, s) -> bool:
            return bits_of(key, free, s).bit_count() > FLOOR

        def move_on(key, members, free, s) -> pa.RecordBatch:
            k, m, f = finer(int(key), members, bits_of(key, free, s))
            return out(m, None, k, f)

        parts, last, held, moving = [], None, 0, False      # rows of the key that may go on
        for b in it:
            key = b["key"].to_numpy(zero_copy_only=False)
            fp = b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            free = None if b["free"].null_count else b["free"].to_numpy(zero_copy_only=False).view(np.uint64)
            if len(key) == 0:
                continue
            if moving:                                       # the rest of a key that is too large
                n = int(np.searchsorted(key, last, "right"))
                if n:
                    yield move_on(last, fp[:n], free, 0)
                key, fp, free = key[n:], fp[n:], None if free is None else free[n:]
                if len(key) == 0:
                    continue
                moving = False
            cut = int(np.searchsorted(key, key[-1]))
            piece = lambda a, z: (key[a:z], fp[a:z], None if free is None else free[a:z])  # noqa: E731, B023
            if cut == 0 and last == key[0]:
                parts.append(piece(0, len(key)))
                held += len(key)
            else:
                yield from close(*joined([*parts, piece(0, cut)]))
                parts, last, held = [piece(cut, len(key))], key[-1], len(key) - cut
            if held > split and divisible(last, free, len(key) - 1 if free is not None else 0):
                k, m, f = joined(parts)
                yield move_on(last, m, f, 0)
                parts, held, moving = [], 0, True
        if parts:
            yield from close(*joined(parts))

    def joined(parts: list) -> tuple:
        key, fp, free = zip(*parts)
        return np.concatenate(key), np.concatenate(fp), None if free[0] is None else np.concatenate(free)

    table, seen = write_table(rows.mapInArrow(run, "a bigint, b bigint, key bigint, free bigint"), "compared",
                              observe={"more": F.count("key")})
    return table, seen["more"] or 0


def links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b): edges that connect the given distinct fingerprints exactly as all
    pairs within the distance do."""
    # spread first: few bytes become 64 rows per fingerprint
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = ring_keys(fps.repartition(parts, "fp")).withColumn("free", F.lit(None).cast("bigint"))
    table, more = _compared(keyed, split)
    edges = table.filter("key IS NULL").select("a", "b")
    while more:
        table, more = _compared(table.filter("key IS NOT NULL").select("key", F.col("a").alias("fp"), "free"), split)
        edges = edges.union(table.filter("key IS NULL").select("a", "b"))
    return edges.distinct()


def near_groups(docs: DataFrame, doc_id: Column, text: str = "text", words: int = SHINGLE) -> DataFrame:
    """(id, fp, component): the smallest id reachable over links of at most
    ``DISTANCE`` differing bits, for every row. Ids may be of any type that has an order."""
    rows = write_table(fingerprints(docs, doc_id, text, words), "fingerprints")
    first = write_table(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(write_table(links(first.select("fp")), "links"))
    member = write_table(roots.withColumnRenamed("v", "fp").join(first, "fp"), "members")
    least = write_table(member.groupBy("root").agg(F.min("first").alias("least")), "least")
    moved = member.join(least, "root").select("fp", "least")
    named = write_table(first.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component")),
                        "components")
    return rows.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """One row (all columns) of each near-duplicate group: that with the smallest id."""
    (row,) = fresh(docs.columns, "row")
    tagged = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "tagged")
    order = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"),
                     F.col(row).alias("row"))
    groups = near_groups(tagged, order, text, words)
    kept = groups.filter(F.col("id") == F.col("component")).select(F.col("id.row").alias(row))
    # the kept rows grow with the documents: a shuffle join at every size
    return tagged.join(kept.hint("merge"), row, "left_semi").drop(row)
