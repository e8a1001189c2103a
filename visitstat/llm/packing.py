"""Concatenate and cut: all documents as one stream of ids, cut into fixed windows.

Pass 1 encodes every document once, in the order of the input's partitions, and
writes its ids with its offset inside its partition. The token totals of the
partitions, summed up in order, give each partition's global offset. Pass 2
adds the two offsets and cuts every document at the window borders: one record
per piece. No row is shuffled, every window but the last is full, and a
document or partition of any size is handled alike.

The order is that of the input's partitions; to pack in another order, sort
first. Defined results: a null or empty text is the end id alone; repeated
rows are packed each; a null id stays null; an empty table has no pieces.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.llm.common import batches, text_bytes
from visitstat.llm.tokens import encoder
from visitstat.operators.attach import attach
from visitstat.session import write_table

WINDOW = 2048
END = 1


def encoded(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Pass 1: (part, local, id, n, ids) of every document, written once. ``local`` counts
    the ids before it in its partition; ``ids`` are 16-bit where the vocabulary allows it."""
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), text_bytes(text).alias("t"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()),
                           src.schema["id"], T.StructField("n", T.LongType()), T.StructField("wide", T.BooleanType()),
                           T.StructField("ids", T.BinaryType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, local = encoder(tokenizer), TaskContext.get().partitionId(), 0
        tail = np.array([end], "<u4").tobytes()
        for b in batches(it):
            starts, counts, wide, ids = [], [], [], []
            for t in b["t"]:
                x = np.frombuffer(enc.encode(t.as_py().decode("utf-8", "replace")) + tail, "<u4")
                starts.append(local)
                counts.append(len(x))
                wide.append(bool(x.max() > 0xFFFF))
                ids.append((x if wide[-1] else x.astype("<u2")).tobytes())
                local += len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), b["id"],
                 pa.array(counts, pa.int64()), pa.array(wide), pa.array(ids, pa.binary())],
                ["part", "local", "id", "n", "wide", "ids"])

    return write_table(src.mapInArrow(run, schema), "encoded")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
         end: int = END) -> DataFrame:
    """One record per piece: doc_id, start (the document's ids before it), length, ids (array),
    ids_crc32 (of the ids as little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    table = encoded(docs, tokenizer, doc_id, text, end)
    # one row per partition, so the running sum is over a bounded table
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0).cast("bigint")).alias("base"))
    placed = attach(table, base, ["part"]).select("id", "n", "wide", "ids", (F.col("base") + F.col("local")).alias("at"))
    schema = T.StructType([T.StructField("doc_id", placed.schema["id"].dataType)] + [
        T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            row, piece, ids = [], [], []
            for i, (wide, raw, at) in enumerate(zip(b["wide"].to_pylist(), b["ids"], b["at"].to_pylist())):
                x = np.frombuffer(raw.as_py(), "<u4" if wide else "<u2").astype("<u4")
                cuts = [0, *range(window - at % window, len(x), window), len(x)]
                for a, z in zip(cuts, cuts[1:]):
                    ids.append(x[a:z].astype(np.int32))
                    piece.append((a, z - a, zlib.crc32(x[a:z].tobytes()), len(x), (at + a) // window, (at + a) % window))
                    row.append(i)
            values = np.array(piece, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [b["id"].take(pa.array(row, pa.int64())), *[pa.array(values[:, k]) for k in range(6)],
                 pa.ListArray.from_arrays(pa.array(np.r_[0, values[:, 1].cumsum()], pa.int32()),
                                          np.concatenate(ids) if ids else np.zeros(0, np.int32))],
                [f.name for f in schema])

    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame, pad: int | None = None, window: int = WINDOW) -> DataFrame:
    """(sequence_id, ids): the windows put together from their pieces (at most ``window``
    ids each); with ``pad`` the last one is filled up."""
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    out = pieces.groupBy("sequence_id").agg(ids.alias("ids"))
    if pad is None:
        return out
    return out.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad), F.lit(window) - F.size("ids"))))
