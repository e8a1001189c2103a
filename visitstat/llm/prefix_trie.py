"""The prefix trie of conversations, by union-find over the edges of sorted neighbours.

A conversation is the sequence of its turns' digests (128 bits of SHA-256 over
role and text). Equal sequences are one, with their number. Sequences are
range-partitioned and sorted, so those with a common prefix are neighbours, and
two neighbours share as many turns as their longest common prefix (LCP) has.

Inside a partition the edges between neighbours are taken in descending LCP.
Each joins two components of a union-find; a merge at depth d creates the
branching node of that depth, or the right component comes below the left
one's top if that has the depth already. What lies between a node and the one
above it is a chain of nodes with the same members.

Only nodes on the path of a partition's first or last sequence can go on in a
neighbouring partition. So a partition's forest is contracted to these two paths,
with what hangs below them summed up, and the contracted forests are merged
by the same union-find over the first and last sequences of all partitions: two rows per
partition, in one task. Nodes below a path learn their parent's smallest
member from that merge.

Defined results: rows without a conversation id belong to no conversation; null
roles and texts are empty; turns are ordered by turn (null first), then by digest; repeated
rows are turns of their own; a negative id's group follows SQL's remainder (-3 is in group 0); an empty table has no nodes. Extra columns are ignored. A conversation's
digests travel in one row (32 bytes a turn); its texts are never gathered.
The members that end in a node are hashed in order from pieces that many tasks write.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitstat.session import write_table

GROUP = 100                  # conversations that share the head of the group's first
HEADS = 6                    # lengths of shared heads: 0 to 5 turns
DIGEST = 16                  # bytes of a turn's digest
PIECE_IDS = 1 << 16          # ids in a piece of a node's ending members
NONE = 1 << 62
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = [("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"),
        ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ending", "bigint"), ("n_ending", "bigint")]
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
# what a partition says about the nodes of a path, by depth
PATH = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ending", "n_ending"]


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv, turns): every conversation's turns in order, as (turn, digest, chars)."""
    said, who = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (text, role))
    digest = F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * DIGEST)
    return turns.select(F.col(f"`{conv_id}`").cast("bigint").alias("conv"), F.struct(
        F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.char_length(said).cast("bigint").alias("chars")).alias("t")
    ).filter("conv IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """(conv, turns): conversation c starts with the first crc32(c) % ``HEADS`` turns of its group's first one."""
    base = (F.col("conv") - F.col("conv") % GROUP)
    heads = convs.filter(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    joined = convs.withColumn("base", base).withColumn("h", h).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return joined.select("conv", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def sequences(convs: DataFrame) -> DataFrame:
    """(conv, seq, chars): the digests as one binary value, and the code points of each turn's text."""
    return convs.select("conv", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("seq"),
                        F.transform("turns", lambda t: t["chars"]).alias("chars"))


def common(a: bytes, b: bytes) -> int:
    """How many turns two sequences have in common from the start."""
    n = min(len(a), len(b)) // DIGEST
    if a[:n * DIGEST] == b[:n * DIGEST]:
        return n
    low = 0                      # the first low turns are equal, the first n are not
    while n - low > 1:
        mid = (low + n) // 2
        if a[low * DIGEST:mid * DIGEST] == b[low * DIGEST:mid * DIGEST]:
            low = mid
        else:
            n = mid
    return low


def forest(depth: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """(depth, parent) of the branching and ending nodes of sorted different sequences.

    Node i is the end of sequence i; further nodes follow as merges create them. ``lcp[i]``
    belongs to the edge between sequences i and i + 1. The top's parent is -1.
    """
    depth, parent = list(depth), [-1] * len(depth)
    up, top = list(range(len(depth))), list(range(len(depth)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for e in np.argsort(-np.array(lcp, np.int64), kind="stable").tolist():
        a, b = find(e), find(e + 1)
        node = top[a]
        if depth[node] != lcp[e]:
            depth.append(lcp[e])
            parent.append(-1)
            parent[node] = node = len(depth) - 1
        parent[top[b]] = node
        up[b], top[a] = a, node
    return depth, parent


class Forest:
    """The nodes over sorted sequences, ready to be summed up from the deepest."""

    def __init__(self, seqs: list[bytes]):
        size = len(seqs)
        self.depth, self.parent = forest([len(s) // DIGEST for s in seqs], [common(a, b) for a, b in zip(seqs, seqs[1:])])
        self.order = np.argsort(-np.array(self.depth, np.int64), kind="stable").tolist()
        self.children = [0] * len(self.depth)
        self.example = [*range(size), *[-1] * (len(self.depth) - size)]     # a sequence below each node
        for v in self.order:
            p = self.parent[v]
            if p >= 0:
                self.children[p] += 1
                self.example[p] = self.example[v] if self.example[p] < 0 else self.example[p]

    def path(self, i: int) -> list[int]:
        """The nodes from the end of sequence i up to the top."""
        out = []
        while i >= 0:
            out.append(i)
            i = self.parent[i]
        return out

    def above(self, v: int) -> int:
        """The depth of the node above v; the top's chain goes down to the root, depth 0."""
        return self.depth[self.parent[v]] if self.parent[v] >= 0 else -1


def local_nodes(part: int, seqs: list[bytes], chars: list[list[int]], n: list[int], conv: list[int]):
    """A partition's share: (closed nodes, paths). A closed node is a row of ``NODE`` and, where its parent lies
    on a path, that path's side and the parent's depth. A path is (part, side, seq, chars, first depth, columns of ``PATH``)."""
    f = Forest(seqs)
    size = len(seqs)
    first, last = f.path(0), f.path(size - 1)
    side = dict.fromkeys(last, 1) | dict.fromkeys(first, 0)
    extra = len(f.depth) - size
    members, least = [*n, *[0] * extra], [*conv, *[NONE] * extra]
    leaves, saved, kids = [0] * len(f.depth), [0] * len(f.depth), [0] * len(f.depth)
    closed, waiting = [], []
    for v in f.order:
        p = f.parent[v]
        if v not in side:
            leaves[v] = leaves[v] or 1
            said, at, children = chars[f.example[v]], saved[v], f.children[v]
            for d in range(f.depth[v], f.above(v), -1):
                at += (members[v] - 1) * said[d - 1]
                ends = v < size and d == f.depth[v]
                row = [least[v], d, least[v], members[v], children, leaves[v], at, conv[v] if ends else None, n[v] if ends else 0]
                children = 1
                closed.append((*row, None, None, None))
            waiting.append((len(closed) - 1, p))        # the chain's top: its parent is v's parent
            leaves[p] += leaves[v]
            saved[p] += at
            kids[p] += 1
        if p >= 0:
            members[p] += members[v]
            least[p] = min(least[p], least[v])
    for i, p in waiting:
        row = list(closed[i])
        row[2] = None if p in side else least[p]
        closed[i] = (*row[:9], *((part, side[p], f.depth[p]) if p in side else (None, None, None)))
    paths = []
    for s, nodes in ((0, first), (1, [v for v in last if side[v] == 1])):
        columns, low = {c: [] for c in PATH}, 0
        for v in reversed(nodes):
            low = low if columns["conv_id"] else f.above(v) + 1
            for d in range(f.above(v) + 1, f.depth[v] + 1):
                end = d == f.depth[v]
                ends = end and v < size
                for c, x in zip(PATH, (least[v], members[v], kids[v] if end else 0, leaves[v] if end else 0, saved[v] if end else 0,
                                       conv[v] if ends else NONE, n[v] if ends else 0)):
                    columns[c].append(x)
        if nodes:
            i = 0 if s == 0 else size - 1
            paths.append((part, s, seqs[i], chars[i], low, *columns.values()))
    return closed, paths


def merged_nodes(paths: list[tuple]):
    """The nodes on the paths of all partitions: (rows of ``NODE``, (part, side, depth, conv_id) of every path's nodes)."""
    f = Forest([p[2] for p in paths])
    # per node, by depth from the one below its parent: sums and minima over the paths through it
    sums = {}
    for v, d in enumerate(f.depth):
        sums[v] = np.zeros((len(PATH), d - f.above(v)), np.int64)
        sums[v][[0, 5]] = NONE
    for i, (*_, low, conv, n, kids, leaves, saved, ending, n_ending) in enumerate(paths):
        own = np.array([conv, n, kids, leaves, saved, ending, n_ending], np.int64)
        for v in f.path(i):
            a = max(f.above(v) + 1, low)
            if a > f.depth[v]:
                break
            mine, to = own[:, a - low:f.depth[v] + 1 - low], sums[v][:, a - f.above(v) - 1:]
            to[[0, 5]] = np.minimum(to[[0, 5]], mine[[0, 5]])
            to[[1, 2, 3, 4, 6]] += mine[[1, 2, 3, 4, 6]]
    leaves, saved = [0] * len(f.depth), [0] * len(f.depth)
    rows = []
    for v in f.order:
        p, low, said = f.parent[v], f.above(v) + 1, paths[f.example[v]][3]
        below, at, children = leaves[v], saved[v], f.children[v]
        conv, n, kids, more, cost, ending, n_ending = sums[v].tolist()
        for d in range(f.depth[v], low - 1, -1):
            k = d - low
            below += more[k]
            children += kids[k]
            below = below or 1
            at += cost[k] + ((n[k] - 1) * said[d - 1] if d else 0)
            parent = conv[k - 1] if k else int(sums[p][0, -1]) if p >= 0 else None
            rows.append((conv[k], d, parent, n[k], children, below, at, ending[k] if n_ending[k] else None, n_ending[k]))
            children = 1
        if p >= 0:
            leaves[p] += below
            saved[p] += at
    refs = []
    for i, (part, side, _, _, low, *_) in enumerate(paths):
        for v in f.path(i):
            for d in range(max(f.above(v) + 1, low), f.depth[v] + 1):
                refs.append((part, side, d, int(sums[v][0, d - f.above(v) - 1])))
    return rows, refs


def nodes(distinct: DataFrame) -> DataFrame:
    """Rows of ``NODE`` for the different sequences (seq, chars, n, conv)."""
    up = [("up_part", "int"), ("up_side", "int"), ("up_depth", "bigint")]
    path = [("part", "int"), ("side", "int"), ("seq", "binary"), ("chars", "array<bigint>"), ("low", "bigint")] + [
        (c, "array<bigint>") for c in PATH]
    ddl = ", ".join(f"{c} {t}" for c, t in (*NODE, *up))
    # closed nodes and paths come from the same pass: a row has either
    out = f"{ddl}, path struct<{', '.join(f'{c}: {t}' for c, t in path)}>"
    arrow = pa.schema([*[(c, ARROW[t]) for c, t in (*NODE, *up)], ("path", pa.struct([(c, ARROW[t]) for c, t in path]))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.to_pydict() for b in it if b.num_rows]
        if not got:
            return
        seqs, chars, n, conv = ([x for g in got for x in g[c]] for c in ("seq", "chars", "n", "conv"))
        closed, paths = local_nodes(TaskContext.get().partitionId(), seqs, chars, n, conv)
        for i in range(0, len(closed), 10_000):
            some = list(zip(*closed[i:i + 10_000]))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, arrow.field(k).type) for k, c in enumerate(some)],
                                              pa.nulls(len(some[0]), arrow.field("path").type)], schema=arrow)
        rows = [dict(zip([c for c, _ in path], p)) for p in paths]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(rows), f.type) for f in arrow][:-1],
                                          pa.array(rows, arrow.field("path").type)], schema=arrow)

    table = write_table(distinct.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(run, out), "forest")

    def join_paths(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for b in it for r in b.to_pylist()]
        if not rows:
            return
        found, refs = merged_nodes(rows)
        for kind, some in ((0, [(*r, None, None, None) for r in found]), (1, [(c, None, *[None] * 7, p, s, d) for p, s, d, c in refs])):
            for i in range(0, len(some), 10_000):
                x = list(zip(*some[i:i + 10_000]))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, arrow.field(k).type) for k, c in enumerate(x)],
                                                  pa.array([kind] * len(x[0]), pa.int32())], [*names, "kind"])

    names = [c for c, _ in (*NODE, *up)]
    contracted = table.filter("path IS NOT NULL").select("path.*").repartition(1).sortWithinPartitions("part", "side")
    merged = write_table(contracted.mapInArrow(join_paths, f"{ddl}, kind int"), "merged")
    refs = merged.filter("kind = 1").select("up_part", "up_side", "up_depth", F.col("conv_id").alias("up"))
    closed, columns = table.filter("path IS NULL"), [c for c, _ in NODE]
    below = closed.filter("up_part IS NOT NULL").join(refs, ["up_part", "up_side", "up_depth"]).withColumn("parent_conv_id", F.col("up"))
    return closed.filter("up_part IS NULL").select(columns).union(below.select(columns)).union(
        merged.filter("kind = 0").select(columns))


def ending_digests(members: DataFrame) -> DataFrame:
    """(ending, sha): for every group ``ending`` the SHA-256 of its ids (``conv``) in ascending order, joined by commas."""
    pieces = members.repartitionByRange("ending", "conv").sortWithinPartitions("ending", "conv")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            group, conv = b["ending"].to_numpy(), b["conv"].to_numpy()
            starts = np.unique(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), np.arange(0, len(group), PIECE_IDS)])
            starts = starts[starts < len(group)]
            ends = np.r_[starts[1:], len(group)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[starts]), pa.array(conv[starts]), pa.array([",".join(map(str, conv[a:z].tolist())) for a, z in zip(starts, ends)], pa.string())],
                ["ending", "first", "piece"])

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for b in it:
            done = []
            for e, piece in zip(b["ending"].to_pylist(), b["piece"]):
                if e != last:
                    if h is not None:
                        done.append((last, h.hexdigest()))
                    last, h = e, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(piece.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in done], pa.int64()), pa.array([s for _, s in done], pa.string())],
                                             ["ending", "sha"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([h.hexdigest()])], ["ending", "sha"])

    cut_up = pieces.mapInArrow(cut, "ending bigint, first bigint, piece string")
    return cut_up.repartition("ending").sortWithinPartitions("ending", "first").mapInArrow(digest, "ending bigint, sha string")


def trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv, turns), the textless root included: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    each = write_table(sequences(convs), "sequences")
    distinct = write_table(each.groupBy("seq").agg(F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"),
                                                   F.min("conv").alias("conv")), "distinct")
    found = nodes(distinct)
    shared = distinct.filter("n > 1").select("seq", F.col("conv").alias("ending"))
    digests = ending_digests(each.select("conv", "seq").join(shared, "seq").select("ending", "conv"))
    columns = [c for c, _ in NODE][:-2]
    one: Column = F.sha2(F.col("ending").cast("string"), 256)
    alone = found.filter("n_ending < 2").select(*columns, F.coalesce(one, F.lit(NOTHING)).alias("ends_sha256"))
    many = found.filter("n_ending > 1").join(digests, "ending").select(*columns, F.col("sha").alias("ends_sha256"))
    return alone.union(many)
