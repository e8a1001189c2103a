"""Exact BM25 top-k search: an inverted index with block-max pruning, run per
unit of shards and merged with global statistics.

Index: documents are read once into shards; a shard has its words' hashes and its postings. Document
frequencies, the number of documents and their mean length are global: frequencies go through
buckets of word hashes and come back to the shards that have the word. Shards are searched in units of
about ``SHARD_WORDS`` words, however small the parts of the input are.

In memory the documents of a unit are put in groups that use the same frequent words (of one language or
subject) and each group is cut by length into classes. A class has a matrix of the score parts of the words that
are frequent in it, with their maxima over some documents of a block of ``BLOCK_DOCS`` and over all; all other
parts are postings.

Search, per unit and query: a threshold is known from the start, the k-th best
score in the query's own unit (found first), and units are searched
in waves of doubling size, each starting from the k-th best of the waves before. Queries of
a batch go through a unit together, in the order of their own unit's groups. The postings of a query's words are added up by
document. What a class can reach at most is bounded twice by matrix products for the queries of the batch: from the block maxima, and for
queries that are not ruled out from maxima over ``TIERS`` documents, the fewer the more frequent the word. Documents
that these sums do not rule out are summed up but for rounding, and those that still reach the
threshold are scored exactly. The k best of every unit are merged. No document that
belongs to the k best is ever skipped; ties go to the smaller id.

Score: sum over the query's different words of
ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean length)),
rounded to 6 decimals before ranking.

The queries are a stated set of rows; tasks read them in groups from the shared
folder, so a task holds one unit and the queries of one other unit at a time. Words are
runs of characters other than white space, A-Z lower-cased, compared by 64-bit
XXH64.

Defined results: a null or empty text has no words, it is never found and finds
nothing; only documents that share a word with the query are found; repeated
query rows are queries of their own; repeated documents are found each; a null
id can be found but is never a query of a rule on ids; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.llm.arrays import pack, unpack
from visitstat.llm.common import batches, filesystem, text_bytes, word_blocks
from visitstat.llm.katz import MESSAGE, gathered, hashes, messages, read_part, replies, reply, slices, word_order
from visitstat.session import scratch_path, write_table

K1, B = 1.2, 0.75
TOP = 10
BLOCK_DOCS = 64              # documents per block
GROUPS, GROUP_DOCS, ROUNDS = 8, 256, 5   # groups of a unit at most, documents of a group on average at least, rounds to find them
NEAR = 0.5                   # groups are one if the cosine of their centres is above
GROUP_WORDS, GROUP_SHARE = 512, 16       # the most frequent words, in one of so many documents, decide the groups
CLASS_DOCS = 2048            # documents per class, about
DENSE = 20                   # a word in one of so many documents of a class, and of its group, is a row of the class's matrix
TIERS = (1, 0.18), (2, 0.1), (4, 0.0)    # maxima of so many documents, for words in at least this part of a class
STEPS = (1 << 16) - 1        # score parts in postings are rounded up to so many steps of the largest one
BATCH_QUERIES, BATCH_CELLS = 512, 12 << 20  # queries worked together, and their sums
FEW, PAIR_CELLS = 20, 1 << 21   # one in so many pairs of a query and a document is scored by itself; numbers multiplied at once for such
SHARD_WORDS = 10_000_000     # a shard ends with the document that passes this; a unit has about as many at most
SHARD_DOCS = 50_000          # or with the batch that passes this: places have 16 bits
READ_ROWS, READ_BYTES = 8192, 8 << 20   # documents split into words at once
BUCKET_WORDS = 400_000       # words of shards per bucket, on average
FIRST_WAVE = 6               # units searched before the thresholds are raised for the first time
GROUP_QUERIES = 250_000      # queries a task runs against its unit
DECIMALS, SLACK = 6, 1e-5    # scores are ranked after rounding; bounds are widened by the slack


def words_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """The index of some texts: their lengths, numbers of different words, places of these words (of one text after the
    other) and their frequencies, and the sorted hashes of all words."""
    texts = texts.cast(pa.large_binary())
    cut = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    text = pa.Array.from_buffers(pa.large_utf8(), len(texts), [     # from zero: kernels for text take nothing else
        None, pa.py_buffer(cut - cut[0]), (texts.buffers()[2] or pa.py_buffer(b"")).slice(int(cut[0]), int(cut[-1] - cut[0]))])
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(text))
    coded = split.values.dictionary_encode()
    doc, kind = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy())), coded.dictionary
    raw, cut = (kind.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(kind.buffers()[1], np.int64)[kind.offset:kind.offset + len(kind) + 1]
    has, cut = np.diff(cut) > 0, cut.tolist()                       # an empty word stands for white space at an end
    h = hashes([raw[a:z] for a, z in zip(cut, cut[1:])])
    place = np.full(len(kind), -1, np.int64)
    words, place[has] = np.unique(h[has], return_inverse=True)
    term = place[coded.indices.to_numpy()]
    doc, term = doc[term >= 0], term[term >= 0]
    key = np.sort(doc << 32 | term)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[first, len(key)]).astype(np.int32)
    return (np.bincount(doc, minlength=len(texts)), np.bincount(key[first] >> 32, minlength=len(texts)),
            (key[first] & 0xFFFFFFFF).astype(np.int32), tf, words)


def words_of_one(text: bytes) -> tuple[np.ndarray, ...]:
    """The same for one very long text, which is never split as a whole."""
    (length, _, terms, tf, words), _ = joined([words_of(pa.array([b" ".join(w)], pa.binary())) for w in word_blocks(text)])
    return (length.sum(keepdims=True), np.array([len(words)]), np.arange(len(words), dtype=np.int32),
            np.bincount(terms, tf, len(words)).astype(np.int32), words)


def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """One index of several; and the places in it of their words, of one part after the other."""
    words, place = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True)
    cut = np.cumsum([0, *[len(p[4]) for p in parts]])
    terms = [place[a:z].astype(np.int32)[p[2]] for a, z, p in zip(cut, cut[1:], parts)]
    return (*[np.concatenate([p[i] for p in parts]) for i in (0, 1)], np.concatenate(terms),
            np.concatenate([p[3] for p in parts]), words), place


def read_shards(docs: DataFrame, doc_id: str, text: str, is_query: Column, shard_words: int) -> DataFrame:
    """(block, ids, index, words, asked, n, length): one row per shard. ``index`` packs per document
    its length, number of words, word places and frequencies; ``words`` the sorted hashes and
    their document frequency in the shard; ``asked`` which documents are queries."""
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), text_bytes(text).alias("t"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(src.schema["id"].dataType))] + [
        T.StructField(c, T.BinaryType()) for c in ("index", "words")] + [
        T.StructField(c, T.LongType()) for c in ("n", "length", "types", "asked", "block")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0

        def row(parts, asked, ids):
            (length, count, terms, tf, h), _ = joined(parts)
            asked = np.concatenate(asked).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays([0, len(length)], pa.concat_arrays(ids)), pa.array([pack(length, count, terms, tf, asked)]),
                 pa.array([pack(h, np.bincount(terms, minlength=len(h)))]), *[pa.array([int(x)], pa.int64()) for x in (
                     len(length), length.sum(), len(h), asked.sum(), (part << 24) + seq)]], [f.name for f in schema])

        parts, asked, ids, n, m = [], [], [], 0, 0
        for b in batches(it, READ_ROWS, READ_BYTES):
            ids.append(b["id"])
            asked.append(b["q"].to_numpy(zero_copy_only=False))
            parts.append(words_of(b["t"]) if b.num_rows > 1 or b.nbytes <= READ_BYTES else words_of_one(b["t"][0].as_py()))
            n, m = n + int(parts[-1][0].sum()), m + b.num_rows
            if n >= shard_words or m > SHARD_DOCS:
                yield row(parts, asked, ids)
                parts, asked, ids, n, m, seq = [], [], [], 0, 0, seq + 1
        if parts:
            yield row(parts, asked, ids)

    return src.mapInArrow(run, schema)


def frequencies(shards: DataFrame, buckets: int) -> str:
    """Global document frequencies, sent back to the shards; returns the replies' path."""
    def ask(row):
        h, df = unpack(row["words"])
        order, bucket = word_order(h.astype(np.uint64), buckets)
        for b, s in slices(bucket):
            yield b, pack(h[order[s]], df[order[s]])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks, data in gathered(it):
            got = [unpack(d) for d in data]
            words, at = np.unique(np.concatenate([g[0].astype(np.uint64) for g in got]), return_inverse=True)
            df = np.bincount(at, np.concatenate([g[1] for g in got]), len(words)).astype(np.int64)
            first = np.cumsum([0, *[len(g[0]) for g in got]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket] * len(got), pa.int32()), pa.array(blocks, pa.int64()),
                 pa.array([pack(df[at[a:z]]) for a, z in zip(first, first[1:])])], ["bucket", "block", "data"])

    return replies(messages(shards.select("block", "words"), ask, buckets).mapInArrow(add, MESSAGE), "frequencies")


def alike(x: np.ndarray, groups: int) -> np.ndarray:
    """A group for each row of ``x``: k-means by angle. Only the work depends on it, no result."""
    if groups < 2 or not x.shape[1]:
        return np.zeros(len(x), np.int64)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    rng, far, centre = np.random.default_rng(0), np.ones(len(x)), []
    for _ in range(groups):                                   # far from those already chosen, at random
        far = np.minimum(far, 1 - x @ centre[-1]) if centre else far
        share = np.maximum(far, 1e-9) ** 2
        centre.append(x[rng.choice(len(x), p=share / share.sum())])
    centre = np.stack(centre)
    for i in range(ROUNDS):
        group = (x @ centre.T).argmax(axis=1)
        if i + 1 < ROUNDS:
            centre = np.eye(groups, dtype=x.dtype)[group].T @ x
            centre /= np.maximum(np.sqrt((centre ** 2).sum(axis=1)), 1e-9)[:, None]
    near = centre @ centre.T > NEAR                           # centres that are near are one group, and what is near to those
    for _ in range(groups):
        near = near @ near
    return near.argmax(axis=1)[group]


class Class:
    """Documents that are alike, at the places from ``start`` to ``end``: for each the score parts of the words that at
    least one document in ``DENSE`` has (more if the word is rarer in the group). ``tiers`` has maxima of these parts over some documents of
    a block, ``tops`` over all documents, and ``cap`` is the largest sum of a document's parts. The first documents of all blocks have the
    first places, then come the second ones and so on: halves of the class, laid on each other, give the maxima of ever more documents of a block."""

    def __init__(self, start: int, words: np.ndarray, often: np.ndarray, row: np.ndarray, at: np.ndarray, parts: np.ndarray, wide: int):
        tier = np.stack([often < least for _, least in TIERS]).sum(axis=0)
        order = np.argsort(tier, kind="stable")
        self.start, self.end, self.words, self.blocks = start, start + wide, words[order], wide // BLOCK_DOCS
        self.parts = np.zeros((wide, len(words)), np.float32)
        self.parts[at, np.argsort(order)[row]] = parts
        end = np.searchsorted(tier[order], np.arange(len(TIERS) + 1)).tolist()
        self.tiers = [(slice(a, z), self.most(slice(a, z), docs)) for (docs, _), a, z in zip(TIERS, end, end[1:])]
        self.tops = self.parts.max(axis=0)
        self.cap = float(self.parts.sum(axis=1, dtype=np.float64).max())

    def most(self, words: slice, docs: int) -> np.ndarray:
        """The largest parts of words in so many documents of a block."""
        return np.ascontiguousarray(self.parts[:, words].reshape(docs, len(self.parts) // docs, -1).max(axis=0).T)

    def halved(self, sums: np.ndarray, wide: int) -> np.ndarray:
        """The maxima of the documents of a block, of so many that ``wide`` columns are left."""
        while sums.shape[1] > wide:
            half = sums.shape[1] // 2
            sums = np.maximum(sums[:, :half], sums[:, half:])
        return sums

    def scores(self, sums: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """The scores of all documents for queries, but for rounding and steps."""
        out = chosen @ self.parts.T
        out += sums
        return out

    def found(self, sums: np.ndarray, chosen: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, documents (their places in the class) and scores as above, where these are at least ``least``."""
        most, more, wide = sums, [], len(self.parts)
        for words, tops in self.tiers:
            more.append(chosen[:, words] @ tops)
            most = self.halved(most, tops.shape[1]) + more[-1]
        query, at = np.divmod(np.flatnonzero((most >= least[:, None]).ravel()), most.shape[1])
        step, many = most.shape[1], np.bincount(query, minlength=len(sums)) * FEW > most.shape[1]
        out, whole = [], np.flatnonzero(many)
        if len(whole):                                           # too many to look at each
            most = self.scores(sums[whole], chosen[whole])
            i, j = np.divmod(np.flatnonzero((most >= least[whole, None]).ravel()), wide)
            out.append((whole[i], j, most[i, j]))
            query, at = query[~many[query]], at[~many[query]]
        query, at = query[:, None], at[:, None] + np.arange(0, wide, step)
        most = sums[query, at]
        i, j = np.nonzero(most + sum(m[query, at % m.shape[1]] for m in more) >= least[query])
        query, at, most, step = query[i, 0], at[i, j], most[i, j], max(1, PAIR_CELLS // max(len(self.words), 1))
        for i in range(0, len(most), step):
            most[i:i + step] += np.einsum("ij,ij->i", self.parts[at[i:i + step]], chosen[query[i:i + step]])
        hit = most >= least[query]
        return tuple(map(np.concatenate, zip(*out, (query[hit], at[hit], most[hit]))))


class Shard:
    """The index of a unit of shards in memory. Exact: each document's words with their score parts. To prune: the
    classes of its documents, and the postings of the words that have no row in the class of the document, with parts
    rounded up to steps. Blocks have documents of a class in the order of their lengths, so that the parts in a block are alike."""

    def __init__(self, index: bytes | list[np.ndarray], words: bytes | np.ndarray, df: np.ndarray, n: int, mean: float):
        """``index`` and ``words`` as packed by ``read_shards``, or their arrays; a list of arrays is emptied, so that they can go."""
        index = unpack(index) if isinstance(index, bytes) else index
        length, count, all_terms, all_tf = index[:4]
        index.clear()
        self.hashes = (unpack(words)[0] if isinstance(words, bytes) else words).astype(np.uint64)
        self.n, types = len(length), len(self.hashes)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        groups = self.groups(length, count, all_terms)
        sizes = [len(docs) for g in groups for docs in g]
        wide = [-(-s // BLOCK_DOCS) * BLOCK_DOCS for s in sizes]
        first = np.cumsum([0, *wide]).tolist()
        self.wide = first[-1]
        self.docs, self.count = np.full(self.wide, -1, np.int64), np.zeros(self.wide, np.int64)   # of each place
        self.norm = np.ones(self.wide)
        for a, w, docs in zip(first, wide, (docs for g in groups for docs in g)):
            rank = np.arange(len(docs))
            place = a + rank % BLOCK_DOCS * (w // BLOCK_DOCS) + rank // BLOCK_DOCS
            self.docs[place], self.count[place], self.norm[place] = docs, count[docs], K1 * (1 - B + B * length[docs] / mean)
        self.last = self.count.cumsum()
        end, at = np.r_[0, self.last].tolist(), count.cumsum() - count
        self.terms, self.tf = np.empty(len(all_terms), np.int32), np.empty(len(all_terms), np.int32)
        for a, z in zip(first, first[1:]):                       # class by class: the arrays are large
            m, docs = self.count[a:z], self.docs[a:z]
            move = np.arange(m.sum()) + np.repeat(at[docs] - (m.cumsum() - m), m)
            self.terms[end[a]:end[z]], self.tf[end[a]:end[z]] = all_terms[move], all_tf[move]
        del all_terms, all_tf, move
        self.mark, self.sums = np.zeros(types, bool), np.zeros((0, 0), np.float32)   # to work with
        self.top = np.zeros(types, np.float32)                   # the most a word can add
        self.step = max(float(self.idf.max(initial=0.0)), 1e-9) * (K1 + 1) / STEPS
        self.classes, posts, n_posts, self.row = [], np.empty(len(self.terms), np.uint64), 0, np.full(types, -1, np.int32)
        idf, norm = self.idf.astype(np.float32), self.norm.astype(np.float32)
        for cuts in groups:
            some = slice(len(self.classes), len(self.classes) + len(cuts))
            a, z = first[some.start], first[some.stop]
            often = np.bincount(self.terms[end[a]:end[z]], minlength=types) / max(sum(map(len, cuts)), BLOCK_DOCS)
            for a, z, docs in zip(first[some], first[some.start + 1:], cuts):
                terms, place = self.terms[end[a]:end[z]], np.repeat(np.arange(a, z, dtype=np.int32), self.count[a:z])
                adds, tf = idf[terms], self.tf[end[a]:end[z]].astype(np.float32)
                adds *= tf * np.float32(K1 + 1)
                adds /= tf + norm[place]
                np.maximum.at(self.top, terms, adds)
                adds /= np.float32(self.step)
                here = np.bincount(terms, minlength=types) / max(len(docs), BLOCK_DOCS)
                has = np.flatnonzero(here * often * DENSE ** 2 >= 1)
                self.row[has] = np.arange(len(has))
                row = self.row[terms]
                self.row[has] = -1
                hit = row >= 0
                self.classes.append(Class(a, has, here[has], row[hit], place[hit] - a, adds[hit], z - a))
                hit = ~hit
                key = posts[n_posts:n_posts + np.count_nonzero(hit)]
                key[:] = terms[hit]
                key <<= np.uint64(16)
                key |= place[hit].astype(np.uint64)
                key <<= np.uint64(16)
                key |= np.minimum(np.ceil(adds[hit]), STEPS).astype(np.uint64)
                n_posts += len(key)
        heads = np.unique(np.concatenate([np.zeros(0, np.int64), *[c.words for c in self.classes]]))
        self.heads, self.row[heads] = len(heads), np.arange(len(heads))
        self.tops, self.caps = np.zeros((len(heads), len(self.classes)), np.float32), np.array([c.cap for c in self.classes], np.float32)
        for i, c in enumerate(self.classes):
            c.words = self.row[c.words]
            self.tops[c.words, i] = c.tops
        # a posting is one number, place and steps; a word's postings are one value, so that Arrow copies those of a query together
        posts = posts[:n_posts]
        posts.sort()
        cut = 4 * np.searchsorted(posts, np.arange(types + 1, dtype=np.uint64) << np.uint64(32))
        self.posts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), types, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(posts.astype(np.uint32))])
        self.top = self.top.astype(np.float64) * (1 + 1e-6)                         # 64 bits: many are added up

    def groups(self, length: np.ndarray, count: np.ndarray, terms: np.ndarray) -> list[list[np.ndarray]]:
        """The documents of the classes of each group, in the order of their lengths."""
        size = np.bincount(terms, minlength=len(self.idf))
        frequent = np.argsort(size)[::-1][:GROUP_WORDS]
        frequent = frequent[size[frequent] * GROUP_SHARE >= self.n]
        column = np.full(len(size), -1, np.int32)
        column[frequent] = np.arange(len(frequent))
        x, end = np.zeros((self.n, len(frequent)), np.float32), np.r_[0, count.cumsum()].tolist()
        for i in range(0, self.n, CLASS_DOCS):                   # the arrays of all documents are large
            j = min(i + CLASS_DOCS, self.n)
            at = column[terms[end[i]:end[j]]]
            x[np.repeat(np.arange(i, j), count[i:j])[at >= 0], at[at >= 0]] = 1.0
        x *= self.idf[frequent].astype(np.float32)
        group = alike(x, min(GROUPS, self.n // GROUP_DOCS))
        number = np.bincount(group, minlength=1)
        group[number[group] * 4 * GROUPS < self.n] = -1          # small groups are one
        out = []
        for g in np.unique(group):
            docs = np.flatnonzero(group == g)
            docs = docs[np.argsort(length[docs], kind="stable")]
            out.append(np.array_split(docs, max(1, round(len(docs) / CLASS_DOCS))))
        return out

    def search(self, flat: np.ndarray, count: np.ndarray, k: int, before, levels: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, documents, scores) of queries, given by their words of one after the other and how many each has: the k best
        that score its level or more, ``before(docs)`` giving the order among ties."""
        cut, asked = np.r_[0, count.cumsum()], len(count)
        # all in steps; the part that sums of 32-bit floats may lose, and what rounding to steps may add
        loss, gain = (count + 8) * 1.2e-7, count + SLACK / self.step
        least = np.maximum((levels * (1 - loss) - SLACK) / self.step, 1e-30)     # any shared word adds more
        least[np.add.reduceat(self.top[flat], cut[:-1]) < levels] = np.inf
        if len(self.sums) < asked:
            self.sums = np.empty((asked, self.wide), np.float32)
        sums = self.sums[:asked]
        sums.fill(0)
        for i in np.flatnonzero(least < np.inf).tolist():
            posts = np.frombuffer(self.posts.take(pa.array(flat[cut[i]:cut[i + 1]])).buffers()[2] or b"", np.uint32)
            np.add.at(sums[i], (posts >> np.uint32(16)).astype(np.intp), (posts & np.uint32(0xFFFF)).astype(np.float32))
        chosen, row = np.zeros((asked, self.heads), np.float32), self.row[flat]
        chosen[np.repeat(np.arange(asked), count)[row >= 0], row[row >= 0]] = 1.0
        parts = [sums[:, c.start:c.end] for c in self.classes]
        reach = np.minimum(chosen @ self.tops, self.caps) + np.stack([p.max(axis=1) for p in parts], axis=1)
        new = np.flatnonzero((levels <= 0) & (least < np.inf))
        best = reach[new].argmax(axis=1)
        for x in np.unique(best).tolist():                       # no level yet: the k-th best in the class where most can be reached
            who, c = new[best == x], self.classes[x]
            if c.end - c.start >= k:
                most = c.scores(parts[x][who], chosen[who].take(c.words, axis=1))
                least[who] = np.maximum(least[who], np.partition(most, -k, axis=1)[:, -k] * (1 - 3 * loss[who]) - 2 * gain[who])
        low, found = least.astype(np.float32), []
        for x, c in enumerate(self.classes):
            who = np.flatnonzero(reach[:, x] >= low)
            if len(who):
                query, at, most = c.found(parts[x][who], chosen[who].take(c.words, axis=1), low[who])
                found.append((who[query], at + c.start, most))
        i, at, most = map(np.concatenate, zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        order = np.argsort(i, kind="stable")
        at, most, (i, first) = at[order], most[order], np.unique(i[order], return_index=True)
        for q, a, z in zip(i.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
            places, top = at[a:z], most[a:z]
            if len(places) > k:
                kth = float(np.partition(top, -k)[-k])
                places = places[top >= kth * (1 - 3 * loss[q]) - 2 * gain[q]]
            docs, scores = self.docs[places], self.scores(flat[cut[q]:cut[q + 1]], places)
            order = np.lexsort((before(docs), -scores))[:k]
            yield q, docs[order], scores[order]

    def scores(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The exact scores of the documents at these places for a query."""
        n = self.count[places]
        at = np.arange(n.sum()) + np.repeat(self.last[places] - n.cumsum(), n)
        self.mark[words] = True
        hit = self.mark[self.terms[at]]
        self.mark[words] = False
        at, who = at[hit], np.repeat(np.arange(len(places)), n)[hit]
        adds, tf = self.idf[self.terms[at]], self.tf[at].astype(np.float64)
        adds *= tf * (K1 + 1)
        adds /= tf + self.norm[places][who]
        return np.round(np.bincount(who, adds, len(places)), DECIMALS)


class Asked:
    """The queries of one part: rows, ids, words and thresholds. ``data`` has the rows, how many words each has, the words and the
    thresholds; the words are places in the sorted hashes ``words``, or hashes themselves."""

    def __init__(self, part: int, ids: pa.Array, data: bytes, words: bytes | None = None):
        self.part, self.ids = part, ids
        self.rows, self.count, self.flat, *level = unpack(data)
        if words is None:
            self.words, self.flat = np.unique(self.flat.astype(np.uint64), return_inverse=True)
        else:
            self.words = unpack(words)[0].astype(np.uint64)
        self.level = np.array(level[0]) if level else np.zeros(len(self.rows))

    def raise_levels(self, path: str) -> None:
        """Take over the thresholds of the waves before."""
        order = np.argsort(self.rows)
        for t in read_part(f"{path}/block={self.part}", ["row", "score"]):
            for rows, scores in zip(t["row"], t["score"]):
                at = order[np.searchsorted(self.rows[order], rows.values.to_numpy())]
                self.level[at] = np.maximum(self.level[at], scores.values.to_numpy() - SLACK)

    def run(self, shard: Shard, k: int, before) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, documents, scores) of each query that finds something in the shard."""
        if not len(shard.hashes) or not len(self.words):
            return
        place = np.minimum(np.searchsorted(shard.hashes, self.words), len(shard.hashes) - 1)
        place[shard.hashes[place] != self.words] = -1
        flat = place[self.flat]
        known = flat >= 0
        ends = self.count.cumsum()
        size = np.r_[0, known.cumsum()]
        size = size[ends] - size[ends - self.count]
        flat, some = flat[known], np.flatnonzero(size)
        cut, step = np.r_[0, size[some].cumsum()], max(1, min(BATCH_QUERIES, BATCH_CELLS // max(shard.wide, 1)))
        for i in range(0, len(some), step):
            who = some[i:i + step]
            for q, docs, scores in shard.search(flat[cut[i]:cut[i + len(who)]], size[who], k, before, self.level[who]):
                yield int(who[q]), docs, scores


def tasks_at_once(spark: SparkSession) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # a remote (Spark Connect) session has no SparkContext
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


def units(shards: DataFrame, words: float) -> tuple[list[list[int]], list[int]]:
    """The shards in units of about so many words, and the number of queries in each unit."""
    out, asked, length, docs = [], [], 0, 0
    for r in sorted(shards.select("block", "n", "length", "asked").collect(), key=lambda r: r["block"]):
        length, docs = length + r["length"], docs + r["n"]
        if not out or length > 1.2 * words or docs > SHARD_DOCS + 512:
            out.append([])
            asked.append(0)
            length, docs = r["length"], r["n"]
        out[-1].append(r["block"])
        asked[-1] += r["asked"]
    return out, asked


def open_unit(path: str, blocks: list[int], counts: str, buckets: int, n: int, mean: float) -> tuple[Shard, pa.Array, np.ndarray, object]:
    """The unit of some shards with its global frequencies, the ids of its documents, which are queries, and the order of its ids."""
    parts, dfs, ids = [], [], []
    for block in blocks:
        for t in read_part(f"{path}/block={block}", ["ids", "index", "words"]):
            for index, words, own in zip(t["index"], t["words"], t["ids"]):
                length, count, terms, tf, asked = unpack(index.as_py())
                h = unpack(words.as_py())[0].astype(np.uint64)
                order, bucket = word_order(h, buckets)
                df, got = np.zeros(len(order), np.int64), reply(counts, block)
                for x, s in slices(bucket):
                    df[order[s]] = got[x][0]
                parts.append((length, count, terms.astype(np.int32), tf.astype(np.int32), h, asked))
                del terms, tf
                dfs.append(df)
                ids.append(own.values)
    asked = np.concatenate([p[5] for p in parts])
    (*index, words), place = joined(parts)
    del parts
    df, ids = np.zeros(len(words), np.int64), pa.concat_arrays(ids)
    df[place] = np.concatenate(dfs)
    rank = np.empty(len(ids), np.int64)
    rank[pa.compute.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return Shard(index, words, df, n, mean), ids, asked, rank.__getitem__


def write_queries(spark: SparkSession, kind: T.DataType, asked: list[int], opened, k: int) -> str:
    """The queries, one part per unit: their places, ids, words, and as threshold
    the k-th best score of their own unit, which bounds the k-th best of all from below."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
                           T.StructField("data", T.BinaryType()), T.StructField("words", T.BinaryType())])
    some = [u for u, n in enumerate(asked) if n]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for unit in (some[i] for i in b["id"].to_pylist()):
                shard, ids, asked, before = opened(unit)
                places = np.flatnonzero(np.r_[asked, 0][shard.docs])     # in the order of the classes: the queries of a batch are alike
                rows, count = shard.docs[places], shard.count[places]
                at = np.arange(count.sum()) + np.repeat(shard.last[places] - count.cumsum(), count)
                words, flat = np.unique(shard.terms[at], return_inverse=True)
                words = pack(shard.hashes[words])
                own = Asked(unit, ids.take(pa.array(rows)), pack(rows, count, flat), words)
                level = np.zeros(len(rows))
                for q, _, scores in own.run(shard, k, before):
                    level[q] = max(scores[-1] - SLACK, 0.0) if len(scores) == k else 0.0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unit], pa.int64()), pa.ListArray.from_arrays([0, len(rows)], own.ids),
                     pa.array([pack(rows, count, flat, level)]), pa.array([words])], [f.name for f in schema])

    path = scratch_path(spark, "queries")
    spark.range(0, len(some), 1, max(len(some), 1)).mapInArrow(run, schema).write.parquet(path)
    return path


def search(docs: DataFrame, is_query: Column, doc_id: str = "doc_id", text: str = "text", k: int = TOP,
           shard_words: int = SHARD_WORDS, bucket_words: int = BUCKET_WORDS, group: int = GROUP_QUERIES) -> DataFrame:
    """query_id, doc_id, rank and score: the k best documents for each row where ``is_query`` holds."""
    spark = docs.sparkSession
    rows, seen, path = read_shards(docs, doc_id, text, is_query, shard_words), Observation(), scratch_path(spark, "shards")
    rows.observe(seen, *[F.sum(c).alias(c) for c in ("n", "length", "types", "asked")]).write.option(
        "compression", "zstd").partitionBy("block").parquet(path)
    shards, seen = spark.read.schema(rows.schema).parquet(path), seen.get
    kind = rows.schema["ids"].dataType.elementType
    n, mean = seen["n"] or 0, max((seen["length"] or 0) / max(seen["n"] or 0, 1), 1e-9)
    buckets = max(1, -(-(seen["types"] or 0) // bucket_words))
    counts = frequencies(shards, buckets)
    blocks, asked = units(shards, min(shard_words, (seen["length"] or 0) / (2 * tasks_at_once(spark))))

    def opened(unit):
        return open_unit(path, blocks[unit], counts, buckets, n, mean)

    queries = write_queries(spark, kind, asked, opened, k)
    groups = max(1, -(-(seen["asked"] or 0) // group))
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("part", T.LongType()), T.StructField("row", T.LongType()),
                           T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch], levels: str | None) -> Iterator[pa.RecordBatch]:
        for b in it:
            for unit, g in (divmod(i, groups) for i in b["id"].to_pylist()):
                shard, ids, _, before = opened(unit)
                for asked in read_queries(queries, g, groups):
                    if levels:
                        asked.raise_levels(levels)
                    got = list(asked.run(shard, k, before))
                    who = np.repeat([q for q, *_ in got], [len(d) for _, d, _ in got]).astype(np.int64)
                    if len(who):
                        found = pa.array(np.concatenate([d for _, d, _ in got]))
                        yield pa.RecordBatch.from_arrays(
                            [asked.ids.take(pa.array(who)), pa.array(np.full(len(who), asked.part)), pa.array(asked.rows[who]),
                             ids.take(found), pa.array(np.concatenate([s for *_, s in got]))], [f.name for f in schema])

    order = Window.partitionBy("part", "row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    best, levels = None, None
    for wave in waves(list(range(len(blocks)))):
        tasks = spark.range(wave[0] * groups, (wave[-1] + 1) * groups, 1, len(wave) * groups)
        found = tasks.mapInArrow(lambda it, path=levels: run(it, path), schema)
        found = found if best is None else best.drop("rank").union(found)
        best = write_table(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        levels = write_levels(best, k)
    if best is None:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("doc_id", kind),
                                                       T.StructField("rank", T.IntegerType()),
                                                       T.StructField("score", T.DoubleType())]))
    return best.select("query_id", "doc_id", "rank", "score")


def waves(blocks: list[int]) -> Iterator[list[int]]:
    """The units in waves, each twice as large as the one before: few rows of a wave get past
    thresholds that half of the units before it have raised."""
    at, size = 0, FIRST_WAVE
    while at < len(blocks):
        yield blocks[at:at + size]
        at, size = at + size, 2 * size


def write_levels(best: DataFrame, k: int) -> str:
    """The k-th best score so far of every query that has k results, by part; returns the path."""
    kth = best.filter(F.col("rank") == k).groupBy(F.col("part").alias("block")).agg(
        F.collect_list(F.struct("row", "score")).alias("l"))
    path = scratch_path(best.sparkSession, "levels")
    kth.select("block", F.col("l.row").alias("row"), F.col("l.score").alias("score")).write.partitionBy("block").parquet(path)
    return path


def read_queries(path: str, g: int, groups: int) -> Iterator[Asked]:
    """The query parts in group ``g``, one at a time."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector
    fs, place = filesystem(path)
    files = sorted(f.path for f in fs.get_file_info(FileSelector(place)) if f.path.endswith(".parquet"))
    for f in files[g::groups]:
        with fs.open_input_file(f) as source:
            for b in pq.ParquetFile(source).iter_batches(batch_size=1):
                yield Asked(b["block"][0].as_py(), b["ids"][0].values, b["data"][0].as_py(), b["words"][0].as_py())
