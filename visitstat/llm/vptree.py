"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

Vectors of a shard are scaled by the shard's largest norm and get one more
coordinate that makes all of them unit vectors; a query is scaled to norm one
and gets a zero there. Then the angle between a query and a vector falls as
their inner product grows, and angles satisfy the triangle inequality.

A node of a shard's tree holds a vantage point and the interval of angles from
it for each of its two halves. For a query at angle t from the vantage point no
vector of a half [low, high] is nearer than max(low - t, t - high). A half is left out if
``factor`` times that bound exceeds the angle of the k-th best so far: factor one is the
triangle inequality itself and gives exact results, a larger one prunes more and may
miss neighbours (``recall`` measures how many).

Queries of a group go through a tree together. Each first descends to the
nearest leaf, which gives its threshold; then the tree is walked once with the
queries that still need each half. In a leaf one matrix product finds what reaches a
query's threshold (with a slack for rounding), and only that is computed exactly, as a sum in
the order of the components, and ranked. Equal vectors are one point of the tree with all
their rows; of its ascending rows a query takes the first k + 1.

A few shards are searched first; their k-th best are the thresholds that all the others
start with. The best of all shards are merged.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no
part; only vectors of equal length are compared; a query's own row is no
candidate, another row with the same id is; equal scores are ordered by id (null last) and then
by row; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.llm.arrays import pack, unpack
from visitstat.llm.common import filesystem
from visitstat.session import scratch_path, write_table

TOP = 20
LEAF = 64                    # points of a leaf
SHARD_BYTES = 16 << 20       # vectors of a shard, as doubles
GROUP_QUERIES = 200_000      # queries a task runs against its shard
BATCH_QUERIES = 2_048        # queries that go through a tree together
PILOT = 16                   # one shard in so many is searched first
SCORE_SLACK, ANGLE_SLACK = 1e-9, 1e-6   # rounding of the matrix product and of angles
PAIRS = 1 << 16              # exact products at once


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed in the order of the components."""
    return np.concatenate([np.zeros(0), *[np.cumsum(a[i:i + PAIRS] * b[i:i + PAIRS], axis=1)[:, -1] for i in range(0, len(a), PAIRS)]])


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of norm one, norms); scaled first, so that no square overflows."""
    top = np.abs(vectors).max(axis=1)
    v = vectors / top[:, None]
    norm = np.sqrt((v * v).sum(axis=1))
    return v / norm[:, None], top * norm


class Tree:
    """A vantage-point tree over the different vectors of a shard.

    ``vectors`` are in the order of their rows (ascending id). Points lie in ``order`` so
    that every node is a slice of it; the arrays ``low`` and ``high`` have the angles of both halves.
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        distinct, of = np.unique(vectors, axis=0, return_inverse=True)
        of = of.reshape(-1)
        self.rows = np.argsort(of, kind="stable")                   # of each point, ascending
        count = np.bincount(of, minlength=len(distinct))
        direction, norm = unit(distinct)
        self.scale = float(norm.max())
        short = norm / self.scale
        self.short = direction * short[:, None]
        rest = np.sqrt(np.maximum(0.0, 1.0 - short * short))
        self._grow(np.hstack([self.short, rest[:, None]]), leaf)
        # everything in the order of the tree
        first = np.r_[0, count.cumsum()]
        self.count, self.first = count[self.order], first[:-1][self.order]
        self.exact, self.short = distinct[self.order], np.ascontiguousarray(self.short[self.order])

    def _grow(self, x: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(x))
        self.slices, self.vantage, self.low, self.high, self.child = [(0, len(x))], [None], [None], [None], [None]
        todo = [0]
        while todo:
            node = todo.pop()
            a, z = self.slices[node]
            if z - a <= leaf:
                continue
            own = x[self.order[a:z]]
            far = own[np.argmin(own @ own[0])]                       # a point at the rim
            angle = np.arccos(np.clip(own @ far, -1.0, 1.0))
            half = (z - a) // 2
            place = np.argsort(angle, kind="stable")                  # a partition's order depends on the processor
            self.order[a:z], angle = self.order[a:z][place], angle[place]
            self.vantage[node] = far
            self.low[node] = np.array([angle[:half].min(), angle[half:].min()])
            self.high[node] = np.array([angle[:half].max(), angle[half:].max()])
            self.child[node] = (len(self.slices), len(self.slices) + 1)
            for s in ((a, a + half), (a + half, z)):
                todo.append(len(self.slices))
                self.slices.append(s)
                for column in (self.vantage, self.low, self.high, self.child):
                    column.append(None)


class Search:
    """The k best rows of one tree for a batch of queries."""

    def __init__(self, tree: Tree, queries: np.ndarray, level: np.ndarray, k: int, factor: float):
        self.tree, self.queries, self.k, self.factor = tree, queries, k, factor
        self.direction, norm = unit(queries)
        self.scale = norm * tree.scale
        self.level = level                                           # scores below it are not wanted
        self.score = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), -1, np.int64)
        self.least, self.angle = np.empty(len(queries)), np.empty(len(queries))
        self.compared = 0                                            # pairs met in leaves
        self._tell(np.arange(len(queries)))

    def _tell(self, q: np.ndarray) -> None:
        """Thresholds of the queries ``q``, as scaled product and as angle."""
        self.least[q] = np.maximum(self.score[q, -1], self.level[q]) / self.scale[q]
        self.angle[q] = np.arccos(np.clip(self.least[q], -1.0, 1.0))

    def _bounds(self, node: int, q: np.ndarray) -> np.ndarray:
        """(two halves, queries): the least angle a vector of the half can have."""
        t = self.tree
        angle = np.arccos(np.clip(self.direction[q] @ t.vantage[node][:-1], -1.0, 1.0))
        return np.maximum(np.maximum(t.low[node][:, None] - angle, angle - t.high[node][:, None]), 0.0)

    def _leaf(self, node: int, q: np.ndarray) -> None:
        t = self.tree
        a, z = t.slices[node]
        self.compared += len(q) * (z - a)
        near = self.direction[q] @ t.short[a:z].T >= self.least[q][:, None] - SCORE_SLACK
        i, j = np.nonzero(near)
        if not len(i):
            return
        exact = inner_products(self.queries[q[i]], t.exact[a + j])
        times = np.minimum(t.count[a + j], self.k)
        who, score = np.repeat(i, times), np.repeat(exact, times)
        row = t.rows[np.repeat(t.first[a + j] - (times.cumsum() - times), times) + np.arange(times.sum())]
        some = np.unique(i)
        keep = self.row[q[some]] >= 0
        who = np.concatenate([who, np.repeat(some, keep.sum(axis=1))])
        score = np.concatenate([score, self.score[q[some]][keep]])
        row = np.concatenate([row, self.row[q[some]][keep]])
        order = np.lexsort((row, -score, who))
        who, score, row = who[order], score[order], row[order]
        start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        rank = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)]))
        best = rank < self.k
        self.score[q[who[best]], rank[best]], self.row[q[who[best]], rank[best]] = score[best], row[best]
        self._tell(q[some])

    def run(self) -> None:
        t = self.tree
        home = np.zeros(len(self.queries), np.int64)
        todo = [(0, np.arange(len(self.queries)))]
        while todo:                                                  # each query to its nearest leaf
            node, q = todo.pop()
            if t.child[node] is None:
                home[q] = node
                self._leaf(node, q)
                continue
            bound = self._bounds(node, q)
            right = bound[1] < bound[0]
            todo += [(c, q[x]) for c, x in zip(t.child[node], (~right, right)) if x.any()]
        todo = [(0, np.arange(len(self.queries)))]
        while todo:
            node, q = todo.pop()
            if t.child[node] is None:
                q = q[home[q] != node]
                if len(q):
                    self._leaf(node, q)
                continue
            bound = self._bounds(node, q)
            need = self.factor * (bound - ANGLE_SLACK) <= self.angle[q]
            todo += [(c, q[x]) for c, x in zip(t.child[node], need) if x.any()]


def shards(table: DataFrame, is_query: Column, vec_id: str, embedding: str, shard_bytes: int) -> DataFrame:
    """(shard, dim, ids, rows, asked, vectors, n, n_asked): blocks of vectors of equal length, ordered by id."""
    e = F.col(f"`{embedding}`").cast("array<double>")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    src = table.select(F.col(f"`{vec_id}`").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), e.alias("e")).filter(
        ~odd & F.exists(e, lambda x: x != 0))
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("dim", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(src.schema["id"].dataType))] + [
        T.StructField(c, T.BinaryType()) for c in ("rows", "vectors")] + [T.StructField(c, T.LongType()) for c in ("n", "n_asked")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, at = TaskContext.get().partitionId(), 0, 0
        open_: dict[int, list] = {}                                  # by length

        def row(dim: int) -> pa.RecordBatch:
            nonlocal seq
            parts = open_.pop(dim)
            ids, asked = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            rows, vectors = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
            order = pc.sort_indices(ids, null_placement="at_end").to_numpy()       # stable: equal ids by row
            seq += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + seq - 1]), pa.array([dim], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids.take(pa.array(order))),
                 pa.array([pack(rows[order], asked[order].astype(np.int64))]), pa.array([pack(vectors[order].reshape(-1))]),
                 pa.array([len(ids)]), pa.array([int(asked.sum())])], [f.name for f in schema])

        for b in it:
            size = pc.list_value_length(b["e"]).to_numpy()
            flat, ends = pc.list_flatten(b["e"]).to_numpy(), size.cumsum()
            for dim in np.unique(size).tolist():
                has = np.flatnonzero(size == dim)
                vectors = flat[(ends[has] - dim)[:, None] + np.arange(dim)]
                open_.setdefault(dim, []).append((b["id"].take(pa.array(has)), b["q"].take(pa.array(has)).to_numpy(zero_copy_only=False),
                                                  (part << 40) + at + has, vectors))
            at += b.num_rows
            for dim in [d for d, parts in open_.items() if sum(p[3].nbytes for p in parts) >= shard_bytes]:
                yield row(dim)
        for dim in list(open_):
            yield row(dim)

    return src.mapInArrow(run, schema)


def asked_vectors(table: DataFrame) -> DataFrame:
    """(home, dim, ids, rows, vectors): the queries, one part per shard."""
    schema = T.StructType([T.StructField("home", T.LongType()), table.schema["dim"], table.schema["ids"],
                           T.StructField("rows", T.BinaryType()), T.StructField("vectors", T.BinaryType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                rows, asked = unpack(b["rows"][r].as_py())
                has = np.flatnonzero(asked)
                vectors = unpack(b["vectors"][r].as_py())[0].reshape(len(rows), -1)[has]
                ids = b["ids"][r].values.take(pa.array(has))
                yield pa.RecordBatch.from_arrays(
                    [b["shard"].slice(r, 1), b["dim"].slice(r, 1), pa.ListArray.from_arrays([0, len(has)], ids), pa.array([pack(rows[has])]),
                     pa.array([pack(vectors.reshape(-1))])], [f.name for f in schema])

    return table.filter("n_asked > 0").select("shard", "dim", "ids", "rows", "vectors").mapInArrow(run, schema)


def with_levels(parts: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
    """The query parts with the k-th best scores found so far, (row, score) in ``levels``; they
    bound the k-th best of all from below."""
    if best is None:
        return parts.withColumn("levels", F.lit(None).cast("array<struct<row: bigint, score: double>>"))
    kth = best.filter(F.col("rank") == k).groupBy("home").agg(F.collect_list(F.struct(F.col("query_row").alias("row"), "score")).alias("levels"))
    return parts.join(kth, "home", "left")


def read_queries(path: str, group: int, groups: int, dim: int, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, home, rows, vectors, levels) of the queries in ``group`` with the given length, about ``size`` at a time."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector
    fs, place = filesystem(path)
    files = sorted(f.path for f in fs.get_file_info(FileSelector(place)) if f.path.endswith(".parquet"))
    some, n = [], 0
    for f in files[group::groups]:
        with fs.open_input_file(f) as source:
            for b in pq.ParquetFile(source).iter_batches(batch_size=1):
                if b["dim"][0].as_py() != dim:
                    continue
                rows = unpack(b["rows"][0].as_py())[0].astype(np.int64)
                level = np.full(len(rows), -np.inf)
                if b["levels"][0].is_valid:
                    known = b["levels"][0].values
                    order = np.argsort(rows)
                    level[order[np.searchsorted(rows, known.field("row").to_numpy(), sorter=order)]] = known.field("score").to_numpy()
                some.append((b["ids"][0].values, np.full(len(rows), b["home"][0].as_py()), rows,
                             unpack(b["vectors"][0].as_py())[0].reshape(-1, dim), level))
                n += len(rows)
                if n >= size:
                    yield pa.concat_arrays([x[0] for x in some]), *(np.concatenate(c) for c in list(zip(*some))[1:])
                    some, n = [], 0
    if some:
        yield pa.concat_arrays([x[0] for x in some]), *(np.concatenate(c) for c in list(zip(*some))[1:])


def search(table: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = TOP, factor: float = 1.0,
           leaf: int = LEAF, shard_bytes: int = SHARD_BYTES, group: int = GROUP_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest rows of each row where ``is_query`` holds, its own left out."""
    blocks, seen = write_table(shards(table, is_query, vec_id, embedding, shard_bytes), "vectors", observe={
        "asked": F.sum("n_asked"), "shards": F.count(F.lit(1))})
    parts = write_table(asked_vectors(blocks), "queries")
    groups = max(1, -(-(seen["asked"] or 0) // group))
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("home", T.LongType()), T.StructField("query_row", T.LongType()),
                           T.StructField("vec_id", kind), T.StructField("row", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch], queries: str) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                dim, ids = b["dim"][r].as_py(), b["ids"][r].values
                own = unpack(b["rows"][r].as_py())[0].astype(np.int64)
                tree = Tree(unpack(b["vectors"][r].as_py())[0].reshape(-1, dim), leaf)
                for names, home, rows, vectors, level in read_queries(queries, b["g"][r].as_py(), groups, dim, BATCH_QUERIES):
                    for i in range(0, len(rows), BATCH_QUERIES):
                        # one more than asked for: the query's own row may be among them
                        s = Search(tree, vectors[i:i + BATCH_QUERIES], level[i:i + BATCH_QUERIES], k + 1, factor)
                        s.run()
                        q, place = np.nonzero(s.row >= 0)
                        at, who = s.row[q, place], i + q
                        keep = own[at] != rows[who]
                        at, who, score = at[keep], who[keep], s.score[q, place][keep]
                        yield pa.RecordBatch.from_arrays(
                            [names.take(pa.array(who)), pa.array(home[who]), pa.array(rows[who]), ids.take(pa.array(at)),
                             pa.array(own[at]), pa.array(score)], [f.name for f in schema])

    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")

    def best_of(chosen: DataFrame, before: DataFrame | None) -> DataFrame:
        queries = scratch_path(table.sparkSession, "queries")
        with_levels(parts, before, k).write.parquet(queries)
        work = chosen.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        found = work.mapInArrow(lambda it: run(it, queries), schema)
        found = found if before is None else before.drop("rank").union(found)
        return write_table(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "nearest")

    if (seen["shards"] or 0) < 2 * PILOT:
        best = best_of(blocks, None)
    else:
        pilot = F.pmod(F.xxhash64("shard"), F.lit(PILOT)) == 0
        best = best_of(blocks.filter(~pilot), best_of(blocks.filter(pilot), None))
    return best.select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): the share of the exact pairs (query_id, vec_id) that were found."""
    hit = exact.join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
