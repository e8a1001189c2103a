"""Katz backoff: a bigram model with Good-Turing discounts and exactly
normalised backoff weights, over words and one end token per document.

For a word w after context v (the word before it, or the start), with c counts
over the training documents, N and n_r the number of training tokens and of
unigrams (bigrams) seen r times:

    P(w | v) = d(c(v,w)) * c(v,w) / c(v)   if c(v,w) > 0,
               a(v) * P(w)                 if not,
    a(v)     = (1 - sum of the first line over seen w) / (1 - sum of P(w) over the same w),
    P(w)     = d(c(w)) * c(w) / N          if c(w) > 0, the rest of the mass if not,

d being the Good-Turing discount for counts up to ``CUTOFF`` and 1 above. The
rest of the unigram mass belongs to all unknown words as one event. Where every
count of a context is above the cutoff, one is added to its total, so a(v) is
never zero; a context never seen has a(v) = 1. Probabilities after any context
sum to exactly 1.

How it runs. Documents are read once into blocks (one row per million
tokens, words numbered within the block). Blocks and the model meet in buckets,
through compact messages that hold each distinct word or bigram of a block
once, however often it occurs:

1. words go to buckets by hash; a bucket adds up the counts and numbers its
   words; each block gets numbers and counts back;
2. bigrams go to buckets by context (those of a context that alone would fill
   a bucket by context and word); a bucket adds up the counts and writes the
   model's rows and the counts each block asked for;
3. with n_r known, each bucket computes its backoff weights (contexts spread
   over several buckets get theirs from their partial sums, at most one per
   bucket), and each block gets its counts and weights back;
4. each block looks up every token, bigram first, then backed off, and adds up.

All tables (blocks, unigrams, bigrams, weights) are written to the shared
checkpoint folder; replies are partitioned by block, so a block reads only its
own. Words are compared by 64-bit XXH64.

Defined results: a null or empty text is the end token alone; repeated rows
count and are scored each; without training text every token is unknown
(score 0, log10 of the single unknown event); an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.llm.arrays import pack, unpack
from visitstat.llm.common import batches, filesystem, text_bytes, word_blocks
from visitstat.session import scratch_path, write_table

CUTOFF = 5                   # counts above it are not discounted
BLOCK_TOKENS = 1_000_000     # a block ends with the document that passes this
BUCKET_TOKENS = 400_000      # tokens per bucket, on average
START, END = 0, 1            # numbers of the start (a context only) and the end in every block
MESSAGE = "bucket int, block bigint, data binary"


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit word hashes; 0 and 1 are kept for the start and the end."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h[h < 2] += np.uint64(2)
    return h


def read_blocks(docs: DataFrame, doc_id: str, text: str, held: Column, block_tokens: int) -> DataFrame:
    """(block, ids, tokens, words): one row per block; ``tokens`` packs document sizes,
    held-out marks and word numbers, ``words`` the words' hashes and training counts."""
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), held.alias("held"), text_bytes(text).alias("t"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(src.schema["id"].dataType)),
                           T.StructField("tokens", T.BinaryType()), T.StructField("words", T.BinaryType()),
                           T.StructField("n", T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0

        class Words(dict):
            def __missing__(self, word):
                self[word] = n = len(self) + 2
                return n

        def row(words, parts, held, ids):
            size = np.array([len(p) for p in parts], np.int64)
            flat, out = np.concatenate(parts), np.array(held, np.int64)
            train = np.bincount(flat[np.repeat(out == 0, size)], minlength=len(words) + 2)
            train[START] = int((out == 0).sum())
            h = np.r_[np.array([START, END], np.uint64), hashes(list(words))]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + seq], pa.int64()), pa.ListArray.from_arrays([0, len(size)], pa.concat_arrays(ids)),
                 pa.array([pack(size, out, flat)]), pa.array([pack(h, train)]), pa.array([len(flat)], pa.int64())],
                [f.name for f in schema])

        words, parts, held, ids, n = Words(), [], [], [], 0
        for b in batches(it):
            ids.append(b["id"])
            held += b["held"].to_pylist()
            for t in b["t"]:
                doc = [np.fromiter(map(words.__getitem__, w), np.int32, len(w)) for w in word_blocks(t.as_py().lower())]
                parts.append(np.concatenate([*doc, np.array([END], np.int32)]))
                n += len(parts[-1])
            if n >= block_tokens:
                yield row(words, parts, held, ids)
                words, parts, held, ids, n, seq = Words(), [], [], [], 0, seq + 1
        if parts:
            yield row(words, parts, held, ids)

    return src.mapInArrow(run, schema)


def spread(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit key."""
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of each run of a sorted array."""
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, z in zip(start, [*start[1:], len(bucket)]):
        yield int(bucket[a]), slice(int(a), int(z))


def word_order(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in the order of the messages, and their buckets in that order."""
    b = spread(h, buckets)
    order = np.lexsort((h, b))
    return order, b[order]


def messages(df: DataFrame, make, buckets: int) -> DataFrame:
    """Rows (bucket, block, data) made by ``make`` from each row, gathered by bucket."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                row = {c: b[c][r].as_py() for c in b.schema.names}
                got = list(make(row))
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g[0] for g in got], pa.int32()), pa.array([row["block"]] * len(got), pa.int64()),
                         pa.array([g[1] for g in got], pa.binary())], ["bucket", "block", "data"])
    return df.mapInArrow(run, MESSAGE).repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")


def gathered(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(bucket, blocks, data) of each run of rows with one bucket."""
    bucket, blocks, data = None, [], []
    for b in it:
        for k, block, d in zip(b["bucket"].to_pylist(), b["block"].to_pylist(), b["data"].to_pylist()):
            if k != bucket and blocks:
                yield bucket, blocks, data
                blocks, data = [], []
            bucket = k
            blocks.append(block)
            data.append(d)
    if blocks:
        yield bucket, blocks, data


def replies(df: DataFrame, name: str) -> str:
    """Write rows (block, bucket, data), partitioned by block; returns the path."""
    path = scratch_path(df.sparkSession, name)
    df.repartition("block").sortWithinPartitions("block").write.partitionBy("block").parquet(path)
    return path


def read_part(folder: str, columns: list[str]) -> Iterator[pa.Table]:
    """The Parquet files of one partition folder; none if it does not exist."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector
    fs, place = filesystem(folder)
    for f in fs.get_file_info(FileSelector(place, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                yield pq.ParquetFile(source).read(columns=columns)


def reply(path: str, block: int) -> dict[int, list[np.ndarray]]:
    """The replies to one block, by bucket."""
    return {b: unpack(d) for t in read_part(f"{path}/block={block}", ["bucket", "data"])
            for b, d in zip(t["bucket"].to_pylist(), t["data"].to_pylist())}


def discounts(n: dict[int, int], cutoff: int = CUTOFF) -> np.ndarray:
    """d(0..cutoff) from the counts of counts. Katz's formula for the largest usable
    cutoff; where the counts of counts allow none, half an occurrence is taken off."""
    for k in range(cutoff, 1, -1):
        if all(n.get(r, 0) > 0 for r in range(1, k + 2)):
            common = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if common < 1 else 0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([1.0, *d, *[1.0] * (cutoff - k)])
    return np.array([1.0, *[1 - 0.5 / r for r in range(1, cutoff + 1)]])


@dataclass
class Model:
    """What every task needs to know; the tables themselves stay where they are."""

    tokens: int = 0                                   # N
    types: int = 0                                    # V
    d1: np.ndarray = field(default_factory=lambda: np.ones(CUTOFF + 1))
    d2: np.ndarray = field(default_factory=lambda: np.ones(CUTOFF + 1))
    rest: float = 1.0                                 # unigram mass of unknown words
    more: int = 0                                     # added to N where no unigram is discounted
    buckets: int = 1
    hot: int = 1 << 62                                # contexts above it are spread by word too
    spread_sums: dict = field(default_factory=dict)   # partial sums of those contexts

    def unigram(self, c: np.ndarray) -> np.ndarray:
        d = self.d1[np.minimum(c, CUTOFF)] * (c <= CUTOFF) + (c > CUTOFF)
        return np.where(c > 0, d * c / max(self.tokens + self.more, 1), self.rest)

    def bigram(self, c: np.ndarray, cv: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Discounted probability of counts ``c`` after contexts seen ``cv`` times; ``low``
        tells whether the context has a count that is discounted."""
        d = self.d2[np.minimum(c, CUTOFF)] * (c <= CUTOFF) + (c > CUTOFF)
        return d * c / np.maximum(cv + ~low, 1)


def fit_words(blocks: DataFrame, buckets: int) -> tuple[DataFrame, str, Model]:
    """Step 1: the unigram table (bucket, word, number, count), the replies' path, N, V and d1."""
    def ask(row):
        h, c = unpack(row["words"])
        order, bucket = word_order(h.astype(np.uint64), buckets)
        for b, s in slices(bucket):
            yield b, pack(h[order[s]], c[order[s]])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks_, data in gathered(it):
            got = [unpack(d) for d in data]
            words, at = np.unique(np.concatenate([g[0].astype(np.uint64) for g in got]), return_inverse=True)
            count = np.bincount(at, np.concatenate([g[1] for g in got]), len(words)).astype(np.int64)
            seen = count[words != START]
            first = np.cumsum([0, *[len(g[0]) for g in got]])
            nr = np.bincount(np.minimum(seen, CUTOFF + 2), minlength=CUTOFF + 3)[1:CUTOFF + 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket] * (len(got) + 1), pa.int32()), pa.array([-1, *blocks_], pa.int64()),
                 pa.array([pack(words, count)] + [pack(at[a:z], count[at[a:z]]) for a, z in zip(first, first[1:])]),
                 pa.array([[int(seen.sum()), int((seen > 0).sum()), *map(int, nr)]] + [None] * len(got),
                          pa.list_(pa.int64()))], ["bucket", "block", "data", "stats"])

    got = messages(blocks.select("block", "words"), ask, buckets).mapInArrow(add, f"{MESSAGE}, stats array<bigint>")
    table = write_table(got, "unigrams")
    sums = table.filter("block < 0").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(CUTOFF + 3)])
    s = [x or 0 for x in sums.first()]
    n = {r: s[r + 1] for r in range(1, CUTOFF + 2)}
    m = Model(tokens=s[0], types=s[1], d1=discounts(n), buckets=buckets)
    gone = float(sum((1 - m.d1[r]) * r * n[r] for r in range(1, CUTOFF + 1)))
    m.more = int(m.tokens > 0 and gone <= 0)          # nothing is discounted: one more in the total
    m.rest = (gone + m.more) / (m.tokens + m.more) if m.tokens else 1.0
    return table.filter("block < 0"), replies(table.filter("block >= 0").drop("stats"), "unigram_replies"), m


def look_up(words: np.ndarray, path: str, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Global number and training count of each word of a block."""
    order, bucket = word_order(words, buckets)
    got = reply(path, block)
    number, count = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
    for b, s in slices(bucket):
        at, c = got[b]
        number[order[s]] = at.astype(np.uint64) * np.uint64(buckets) + np.uint64(b)
        count[order[s]] = c
    return number, count


class Pairs:
    """The distinct bigrams of a block, in the order of its messages."""

    def __init__(self, row: dict, path: str, m: Model):
        self.size, held, self.flat = unpack(row["tokens"])
        self.number, self.count = look_up(unpack(row["words"])[0].astype(np.uint64), path, row["block"], m.buckets)
        self.held = held.astype(bool)
        self.first = np.cumsum(self.size) - self.size
        before = np.r_[START, self.flat[:-1]]
        before[self.first] = START
        key, self.at = np.unique(before.astype(np.uint64) << np.uint64(32) | self.flat.astype(np.uint64), return_inverse=True)
        self.v, self.w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.train = np.bincount(self.at[np.repeat(~self.held, self.size)], minlength=len(key))
        hot = self.count[self.v] > m.hot
        gv, gw = self.number[self.v], self.number[self.w]
        bucket = spread(np.where(hot, gv * np.uint64(0x100000001B3) ^ gw, gv), m.buckets)
        self.order = np.lexsort((gw, gv, bucket))
        self.bucket = bucket[self.order]

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, its bigrams, where each context's run starts) in message order."""
        for b, s in slices(self.bucket):
            i = self.order[s]
            yield b, i, np.flatnonzero(np.r_[True, self.v[i[1:]] != self.v[i[:-1]]])


def fit_bigrams(blocks: DataFrame, path: str, m: Model) -> DataFrame:
    """Step 2: one row per bucket: its bigrams (contexts with counts and runs, words with
    counts), and for every block the counts and contexts it asked for. Sets d2."""
    def ask(row):
        p = Pairs(row, path, m)
        for b, i, run in p.parts():
            v = p.v[i[run]]
            yield b, pack(p.number[v], p.count[v], np.diff(np.r_[run, len(i)]), p.number[p.w[i]], p.count[p.w[i]], p.train[i])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks_, data in gathered(it):
            got = [unpack(d) for d in data]
            v, head = np.unique(np.concatenate([g[0] for g in got]).astype(np.uint64), return_inverse=True)
            w, tail = np.unique(np.concatenate([g[3] for g in got]).astype(np.uint64), return_inverse=True)
            cv, cw = np.zeros(len(v), np.int64), np.zeros(len(w), np.int64)
            cv[head] = np.concatenate([g[1] for g in got])
            cw[tail] = np.concatenate([g[4] for g in got])
            runs = np.concatenate([g[2] for g in got])
            key, at = np.unique(np.repeat(head, runs).astype(np.uint64) << np.uint64(32) | tail.astype(np.uint64),
                                return_inverse=True)
            c = np.bincount(at, np.concatenate([g[5] for g in got]), len(key)).astype(np.int64)
            seen = np.flatnonzero(c > 0)
            kv, kw = (key[seen] >> np.uint64(32)).astype(np.int64), (key[seen] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            pair, ctx = np.cumsum([0, *[len(g[3]) for g in got]]), np.cumsum([0, *[len(g[0]) for g in got]])
            back = [pack(c[at[a:z]], head[x:y], g[2]) for g, a, z, x, y in zip(got, pair, pair[1:], ctx, ctx[1:])]
            nr = np.bincount(np.minimum(c, CUTOFF + 2), minlength=CUTOFF + 3)[1:CUTOFF + 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()),
                 pa.array([pack(v, cv, np.bincount(kv, minlength=len(v)), w[kw], cw[kw], c[seen])]),
                 pa.array([list(map(int, nr))], pa.list_(pa.int64())),
                 pa.array([blocks_], pa.list_(pa.int64())), pa.array([back], pa.list_(pa.binary()))],
                ["bucket", "bigrams", "nr", "blocks", "back"])

    got = messages(blocks.select("block", "tokens", "words"), ask, m.buckets).mapInArrow(
        add, "bucket int, bigrams binary, nr array<bigint>, blocks array<bigint>, back array<binary>")
    table = write_table(got, "bigrams")
    sums = table.agg(*[F.sum(F.get("nr", F.lit(i))).alias(f"n{i + 1}") for i in range(CUTOFF + 1)]).first()
    m.d2 = discounts({r: x or 0 for r, x in enumerate(sums, 1)})
    return table


def context_sums(data: bytes, m: Model) -> tuple[np.ndarray, ...]:
    """Per context of a bucket: number, count, discounted mass with and without one more
    in the total, unigram mass of its seen words, and whether a count is discounted."""
    v, cv, runs, _, cw, c = unpack(data)
    row = np.repeat(np.arange(len(v)), runs)
    low = np.bincount(row, (c <= CUTOFF) & (m.d2[np.minimum(c, CUTOFF)] < 1), len(v)) > 0
    yes = np.ones(len(c), bool)
    add = lambda x: np.bincount(row, x, len(v)).astype(np.float64)
    return v, cv, add(m.bigram(c, cv[row], yes)), add(m.bigram(c, cv[row], ~yes)), add(m.unigram(cw)), low


def spread_contexts(table: DataFrame, m: Model) -> dict[int, tuple[float, float, float, bool]]:
    """Sums of the contexts that are spread over buckets. There are at most
    N / hot of them, which the bucket size makes no more than the buckets."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for data in b["bigrams"].to_pylist():
                v, cv, mass, more, uni, low = context_sums(data, m)
                k = cv > m.hot
                yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (v.astype(np.int64), mass, more, uni, low)],
                                                 ["v", "mass", "more", "uni", "low"])
    sums = table.select("bigrams").mapInArrow(run, "v bigint, mass double, more double, uni double, low boolean")
    sums = sums.groupBy("v").agg(F.sum("mass"), F.sum("more"), F.sum("uni"), F.max("low"))
    return {r[0]: tuple(r[1:]) for r in sums.collect()}


def weights(data: bytes, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context numbers, counts, backoff weights, whether a count is discounted) of a bucket."""
    v, cv, mass, more, uni, low = context_sums(data, m)
    for i in np.flatnonzero(cv > m.hot):
        mass[i], more[i], uni[i], low[i] = m.spread_sums[int(v[i])]
    left = np.where(low, 1 - mass, 1 - more)
    a = np.where(cv > 0, np.maximum(left, 1e-300) / np.maximum(1 - uni, 1e-300), 1.0)
    return v, cv, a, low


def send_weights(table: DataFrame, m: Model) -> tuple[str, str]:
    """Step 3: the table of backoff weights, and the replies to the blocks; returns both paths."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for bucket, data, blocks, back in zip(*(b[c].to_pylist() for c in ("bucket", "bigrams", "blocks", "back"))):
                _, cv, a, low = weights(data, m)
                out = []
                for d in back:
                    c, ctx, runs = unpack(d)
                    out.append(pack(c, cv[ctx], a[ctx], low[ctx].astype(np.int64), runs))
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()),
                                                  pa.array(out, pa.binary())], ["bucket", "block", "data"])

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for bucket, data in zip(b["bucket"].to_pylist(), b["bigrams"].to_pylist()):
                v, cv, a, _ = weights(data, m)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(v), pa.int32()), pa.array(v.astype(np.int64)),
                                                  pa.array(cv), pa.array(a)], ["bucket", "context", "n", "weight"])

    path = scratch_path(table.sparkSession, "weights")
    table.select("bucket", "bigrams").mapInArrow(own, "bucket int, context bigint, n bigint, weight double") \
        .write.parquet(path)
    return path, replies(table.mapInArrow(run, MESSAGE), "bigram_replies")


def evaluate(blocks: DataFrame, words: str, pairs: str, m: Model) -> DataFrame:
    """Step 4: id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    schema = T.StructType([T.StructField("id", blocks.schema["ids"].dataType.elementType)] + [
        T.StructField(c, t) for c, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()),
                                         ("train_tokens", T.LongType()), ("base_score", T.DoubleType()),
                                         ("score", T.DoubleType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                row = {c: b[c][r].as_py() for c in ("block", "tokens", "words")}
                p = Pairs(row, words, m)
                got, logp = reply(pairs, row["block"]), np.zeros(len(p.v))
                for bucket, i, _ in p.parts():
                    c, cv, a, low, runs = got[bucket]
                    k = np.repeat(np.arange(len(runs)), runs)
                    back = a[k] * m.unigram(p.count[p.w[i]])
                    logp[i] = np.log10(np.where(c > 0, m.bigram(c, cv[k], low[k].astype(bool)), back))
                count = p.count[p.flat]
                base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.types + 1)))
                yield pa.RecordBatch.from_arrays(
                    [b["ids"][r].values, pa.array(p.held), pa.array(p.size), pa.array(np.add.reduceat((count > 0).astype(np.int64), p.first)),
                     pa.array(np.full(len(p.size), m.tokens)), pa.array(np.add.reduceat(base, p.first)),
                     pa.array(np.add.reduceat(logp[p.at], p.first))], [f.name for f in schema])

    return blocks.mapInArrow(run, schema)


def score(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text",
          block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Learn from the documents that are not ``held`` and score all of them."""
    blocks, seen = write_table(read_blocks(docs, doc_id, text, held, block_tokens), "blocks", observe={"n": F.sum("n")})
    buckets = max(1, -(-(seen["n"] or 0) // bucket_tokens))
    _, words, m = fit_words(blocks, buckets)
    m.hot = bucket_tokens
    table = fit_bigrams(blocks, words, m)
    m.spread_sums = spread_contexts(table, m)
    _, pairs = send_weights(table, m)
    return evaluate(blocks.drop("n"), words, pairs, m)
