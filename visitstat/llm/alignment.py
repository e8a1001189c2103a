"""Alignment of two tokenizers' tokens over the bytes of the same texts, as an Arrow pipeline.

A document is read as a space and its text. Tokenizer A (byte-level BPE) encodes
both, tokenizer B (sentencepiece) encodes the text and puts the space before it
itself. Offsets at which a token of A and one of B both end cut the tokens into
groups; every token of A and every token of B in a group are linked.

Per batch of documents, with Arrow functions only: the two list columns of ids
are flattened and their parent indices kept; the bytes of the tokens are joined
per document and compared with the text; byte lengths are summed cumulatively
and each document's start is taken off, which gives the end of every token; a
hash join on (document, end) finds the common ends, which are the groups'
borders; groups are list arrays over the flat ids. Links are counted per
(document, pair of ids) by ``Table.group_by``, and per pair in how many
documents it is linked.

Pairs of ids are counted over the corpus in two steps: a block of documents
holds a dictionary of its pairs with partial counts, Spark sums them up, and
each block gets the sums of its own pairs back. A pair that every document has
is one row per block. No links of single documents are shuffled.

Defined results: a null or empty text, and one whose joined tokens differ from
the space and the text, has no tokens: all zero, and an empty digest. Special
tokens' strings are plain text. Repeated rows count as documents of their own; a null id
stays null; an empty table gives an empty result. Extra columns are ignored. A document's
tokens are in memory at once (some 100 bytes a token); its links are expanded in
slices of ``SLICE`` and not at all in groups beyond it, where equal ids are counted first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.llm.arrays import pack, unpack
from visitstat.llm.common import batches, text_bytes
from visitstat.llm.tokens import byte_letters, encoder, piece_encoder
from visitstat.session import write_table

BATCH_BYTES = 1 << 19        # text bytes of a batch
CACHE_CHUNKS = 250_000       # chunks of text whose ids each tokenizer keeps
BLOCK_PAIRS = 1_000_000      # a block ends with the batch that passes so many (document, pair) rows
SLICE = 1 << 20              # links expanded at once


class Side:
    """One tokenizer: its ids of a text, and bytes, byte lengths and decimal form of each id."""

    def __init__(self, encode, entries: list[bytes], before: str):
        self.encode, self.before = encode, before
        self.bytes = pa.array(entries, pa.binary())
        self.length = pa.array([len(e) for e in entries], pa.int64())
        self.decimal = pa.array([str(i) for i in range(len(entries))])

    def lists(self, texts: list[str]) -> pa.ListArray:
        found = [self.encode(self.before + t) if t else b"" for t in texts]
        ends = np.cumsum([0, *map(len, found)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))

    def ends(self, lists: pa.ListArray, base: pa.Array) -> pa.Table:
        """(doc, end, at): the byte offset in its document at which each token ends, and its place."""
        parent = pc.list_parent_indices(lists).cast(pa.int32())
        length = pc.take(self.length, pc.list_flatten(lists))
        return pa.table({"doc": parent, "end": pc.subtract(pc.cumulative_sum(length), pc.take(base, parent)),
                         "at": pa.array(np.arange(len(parent), dtype=np.int32))})


def byte_side(path: str) -> Side:
    """A byte-level BPE file of the tokenizers library; special tokens' strings are plain text."""
    enc = encoder(path, plain=True, limit=CACHE_CHUNKS)
    vocabulary = enc.tokenizer.get_vocab(with_added_tokens=True)
    back = {c: b for b, c in byte_letters().items()}
    entries = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        entries[i] = bytes(map(back.__getitem__, piece)) if all(c in back for c in piece) else piece.encode()
    return Side(enc.encode, entries, " ")


def piece_side(path: str) -> Side:
    """A sentencepiece model, which puts the space before the text itself."""
    enc = piece_encoder(path, limit=CACHE_CHUNKS)
    entries = [bytes([int(p[3:5], 16)]) if enc.model.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in enumerate(enc.pieces)]
    return Side(enc.encode, entries, "")


_SIDES: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """The two tokenizers, loaded once per Python worker."""
    if (path_a, path_b) not in _SIDES:
        _SIDES[path_a, path_b] = byte_side(path_a), piece_side(path_b)
    return _SIDES[path_a, path_b]


def same_bytes(side: Side, lists: pa.ListArray, wanted: pa.Array) -> pa.Array:
    """Which documents' token bytes, joined, are the wanted ones."""
    parts = pa.ListArray.from_arrays(lists.offsets, pc.take(side.bytes, pc.list_flatten(lists)))
    return pc.equal(pc.binary_join(parts, b""), wanted)


class Aligned:
    """A batch of documents: the documents with tokens (``rows``), the flat ids of both
    sides and the groups as offsets into them."""

    def __init__(self, texts: list[bytes], a: Side, b: Side):
        decoded = [t.decode("utf-8", "replace") for t in texts]
        wanted = pa.array([b" " + t for t in texts], pa.binary())
        la, lb = a.lists(decoded), b.lists(decoded)
        whole = pc.and_(pc.and_(same_bytes(a, la, wanted), same_bytes(b, lb, wanted)), pa.array([bool(t) for t in texts]))
        self.rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        la, lb, wanted = (x.filter(whole) for x in (la, lb, wanted))
        self.a, self.b = pc.list_flatten(la), pc.list_flatten(lb)
        size = pc.binary_length(wanted).cast(pa.int64())
        base = pc.subtract(pc.cumulative_sum(size), size)
        common = a.ends(la, base).join(b.ends(lb, base), ["doc", "end"], join_type="inner", right_suffix="_b",
                                       use_threads=False).sort_by("at")
        doc, at, at_b = (common[c].combine_chunks().to_numpy().astype(np.int64) for c in ("doc", "at", "at_b"))
        self.doc, self.cut_a, self.cut_b = doc, np.r_[0, at + 1], np.r_[0, at_b + 1]
        n = len(self.rows)
        self.size_a, self.size_b = np.diff(self.cut_a), np.diff(self.cut_b)
        self.n_a, self.n_b = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (la, lb))
        self.n_groups = np.bincount(doc, minlength=n)
        ends = self.n_groups.cumsum()
        links = np.r_[0, (self.size_a * self.size_b).cumsum()]
        self.n_links = links[ends] - links[ends - self.n_groups]

    def digests(self, a: Side, b: Side) -> list[str]:
        """SHA-256 of each document's groups, written with decimal ids."""
        def joined(side: Side, cut: np.ndarray, ids: pa.Array) -> pa.Array:
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pc.take(side.decimal, ids)), ",")

        groups = pc.binary_join_element_wise(joined(a, self.cut_a, self.a), joined(b, self.cut_b, self.b), "|")
        cut = np.r_[0, self.n_groups.cumsum()]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), groups), ";")
        return [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]

    def _links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, number) of links, a pair being A's id * 2^32 + B's id."""
        a, b = (x.to_numpy().astype(np.int64) for x in (self.a, self.b))
        count = self.size_a * self.size_b
        huge = count > SLICE
        for g in np.flatnonzero(huge):
            ua, na = np.unique(a[self.cut_a[g]:self.cut_a[g + 1]], return_counts=True)
            ub, nb = np.unique(b[self.cut_b[g]:self.cut_b[g + 1]], return_counts=True)
            step = max(1, SLICE // len(ub))
            for i in range(0, len(ua), step):
                pair = ((ua[i:i + step] << 32)[:, None] + ub).ravel()
                yield np.full(len(pair), self.doc[g]), pair, np.outer(na[i:i + step], nb).ravel()
        some = np.flatnonzero(~huge)
        upto = np.r_[0, count[some].cumsum()]
        at = 0
        while at < len(some):
            z = max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE, "right")) - 1)
            g, n = some[at:z], count[some[at:z]]
            of = np.repeat(g, n)
            k = np.arange(len(of)) - np.repeat(upto[at:z] - upto[at], n)
            wide = self.size_b[of]
            i = k // wide
            yield self.doc[of], (a[self.cut_a[of] + i] << 32) + b[self.cut_b[of] + k - i * wide], np.ones(len(of), np.int64)
            at = z

    def pairs(self) -> pa.Table:
        """(doc, pair, n): how often each pair of ids is linked in each document."""
        parts = [pa.table({"doc": d, "pair": p, "n": n}).group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")])
                 for d, p, n in self._links()]
        if not parts:
            return pa.table({c: pa.array([], pa.int64()) for c in ("doc", "pair", "n")})
        t = parts[0] if len(parts) == 1 else pa.concat_tables(parts).rename_columns(["doc", "pair", "n"]).group_by(
            ["doc", "pair"], use_threads=False).aggregate([("n", "sum")])
        return t.rename_columns(["doc", "pair", "n"])


class Block:
    """Documents of a partition up to ``BLOCK_PAIRS`` (document, pair) rows."""

    def __init__(self):
        self.ids, self.stats, self.digests, self.pairs, self.docs, self.size = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: list[bytes], a: Side, b: Side) -> None:
        x = Aligned(texts, a, b)
        stats = np.zeros((4, len(texts)), np.int64)
        stats[:, x.rows] = x.n_a, x.n_b, x.n_groups, x.n_links
        digests = [""] * len(texts)
        for i, d in zip(x.rows.tolist(), x.digests(a, b)):
            digests[i] = d
        pairs = x.pairs()
        self.pairs.append(pairs.set_column(0, "doc", pa.array(x.rows[pairs["doc"].to_numpy()] + self.docs)))
        self.ids.append(ids)
        self.stats.append(stats)
        self.digests += digests
        self.docs += len(texts)
        self.size += pairs.num_rows

    def row(self, block: int, names: list[str]) -> pa.RecordBatch:
        t = pa.concat_tables(self.pairs)
        known = t.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        pair, docs = (known[c].to_numpy() for c in ("pair", "count_all"))
        doc = t["doc"].to_numpy()
        order = np.argsort(doc, kind="stable")
        place = np.searchsorted(pair, t["pair"].to_numpy()[order])
        stats = np.concatenate(self.stats, axis=1)
        one = [0, self.docs]
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.ListArray.from_arrays(one, pa.concat_arrays(self.ids)),
             pa.ListArray.from_arrays(one, pa.array(self.digests, pa.string())), pa.array([pack(*stats)], pa.binary()),
             pa.array([pack(pair, docs)], pa.binary()),
             pa.array([pack(np.bincount(doc, minlength=self.docs), place, t["n"].to_numpy()[order])], pa.binary())], names)


def blocks(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str, block_pairs: int) -> DataFrame:
    """(block, ids, digests, stats, known, links): one row per block of documents. ``known`` are its
    pairs and in how many of its documents each is linked, ``links`` the documents' pairs as places in it."""
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), text_bytes(text).alias("t"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(src.schema["id"].dataType)),
                           T.StructField("digests", T.ArrayType(T.StringType()))] + [
        T.StructField(c, T.BinaryType()) for c in ("stats", "known", "links")])
    names = [f.name for f in schema]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        part, seq, block = TaskContext.get().partitionId(), 0, Block()
        for x in batches(it, size=BATCH_BYTES):
            block.add(x["id"], x["t"].to_pylist(), a, b)
            if block.size >= block_pairs:
                yield block.row((part << 32) + seq, names)
                seq, block = seq + 1, Block()
        if block.docs:
            yield block.row((part << 32) + seq, names)

    return src.mapInArrow(run, schema)


def known_pairs(table: DataFrame) -> DataFrame:
    """(block, pair, n) from the blocks' dictionaries."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            for block, data in zip(x["block"].to_pylist(), x["known"]):
                pair, n = unpack(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block)), pa.array(pair.astype(np.int64)), pa.array(n)],
                                                 ["block", "pair", "n"])

    return table.select("block", "known").mapInArrow(run, "block bigint, pair bigint, n bigint")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether that is the
    most of its A id. The join's small side has a row per id of A's vocabulary at most."""
    counts = write_table(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
          block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its A id's
    most frequent), count_sum (over links, their pair's count) and groups_sha256."""
    table = write_table(blocks(docs, path_a, path_b, doc_id, text, block_pairs), "blocks")
    pairs = write_table(known_pairs(table), "pairs")
    counts = pair_counts(pairs)
    answer = F.sort_array(F.collect_list(F.struct("pair", "n", "best")))
    found = pairs.select("block", "pair").join(counts, "pair").groupBy("block").agg(answer.alias("x")).select(
        "block", F.col("x.n").alias("n"), F.col("x.best").alias("best"))
    kind = table.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(c, T.LongType()) for c in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [T.StructField("groups_sha256", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            for r in range(x.num_rows):
                sizes, place, times = unpack(x["links"][r].as_py())
                doc = np.repeat(np.arange(len(sizes)), sizes)
                if len(place):
                    n, best = (x[c][r].values.to_numpy(zero_copy_only=False) for c in ("n", "best"))
                    sums = np.zeros((2, len(sizes)), np.int64)
                    np.add.at(sums[0], doc, times * best[place])
                    np.add.at(sums[1], doc, times * n[place])
                else:
                    sums = np.zeros((2, len(sizes)), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [x["ids"][r].values, *map(pa.array, unpack(x["stats"][r].as_py())), *map(pa.array, sums), x["digests"][r].values],
                    [f.name for f in schema])

    return table.drop("known").join(found, "block", "left").mapInArrow(run, schema)
