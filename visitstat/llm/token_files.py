"""Token ids in binary files of independent zstandard frames.

File format (all numbers little-endian):

* one zstandard frame per document, holding its ids as unsigned 32-bit numbers
  (a document of more than ``FRAME_IDS`` ids takes several frames),
* a skippable frame (0x184D2A50) with the document table: a zstandard frame of
  records (doc_id int64, null uint8, frames uint32),
* the seek table of the public seekable format: a skippable frame (0x184D2A5E)
  with compressed size, decompressed size and checksum (low 32 bits of XXH64 of
  the ids) per frame, then the number of frames, a descriptor and 0x8F92EAB1.

A reader takes the seek table from the end of the file and then decompresses
the frames of the requested documents only, checking each one's checksum.

Documents are range-partitioned and sorted by id, one file per partition, and
the files' order is the partitions' order. A file's name carries a random
part; the manifest (a Parquet table, committed by Spark) names the files of
the attempts that succeeded, so a task that is lost and repeated leaves no
wrong file behind in the manifest. The first id of a file is the sum of the
ids of the files before it.

Defined results: a null or empty text is the end id alone; null ids come
first; repeated rows are written each, in the order of their texts' hashes;
an empty table has files without documents. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitstat.llm.common import batches, filesystem, text_bytes
from visitstat.llm.tokens import encoder

# Fixed values of the file format.
SEEK_MAGIC, TABLE_MAGIC, END_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FRAME_IDS = 1 << 26
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frames", "<u4")])
FRAME = np.dtype([("size", "<u4"), ("raw", "<u4"), ("sum", "<u4")])


class Writer:
    """Writes one file document by document; only the tables are kept in memory."""

    def __init__(self, out, level: int = 3):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=level)
        self.docs: list[tuple[int, int, int]] = []
        self.frames: list[tuple[int, int, int]] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        step = 4 * FRAME_IDS
        cuts = range(0, max(len(ids), 1), step)
        for i in cuts:
            raw = ids[i:i + step]
            data = self.zip.compress(raw)
            self.out.write(data)
            self.frames.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append((doc_id or 0, doc_id is None, len(cuts)))
        self.n_ids += len(ids) // 4

    def close(self) -> None:
        table = self.zip.compress(np.array(self.docs, DOC).tobytes())
        seek = np.array(self.frames, FRAME).tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, END_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)


class Reader:
    """Random access to the documents of one file opened for reading."""

    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flag, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != END_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        at = size - 9 - n * FRAME.itemsize
        self.frames = np.frombuffer(self._read(at, n * FRAME.itemsize), FRAME)
        self.place = np.r_[0, self.frames["size"].astype(np.int64).cumsum()]
        table = int(self.place[-1])
        head, length = struct.unpack("<II", self._read(table, 8))
        if head != TABLE_MAGIC:
            raise ValueError("no document table before the seek table")
        self.docs = np.frombuffer(self.unzip.decompress(self._read(table + 8, length)) if length else b"", DOC)
        self.first = np.r_[0, self.docs["frames"].astype(np.int64).cumsum()]

    def _read(self, at: int, length: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(length))

    def doc_id(self, i: int) -> int | None:
        return None if self.docs["null"][i] else int(self.docs["doc_id"][i])

    def ids(self, i: int) -> bytes:
        """The ids of the i-th document; only its own frames are read and decompressed."""
        out = []
        for k in range(int(self.first[i]), int(self.first[i + 1])):
            raw = self.unzip.decompress(self._read(self.place[k], self.frames["size"][k]))
            if len(raw) != self.frames["raw"][k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames["sum"][k]:
                raise ValueError(f"frame {k} does not match its checksum")
            out.append(raw)
        return b"".join(out)

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """(doc_id, ids) of the documents of this file that have one of the given ids."""
        wanted = np.fromiter(doc_ids, np.int64)
        for i in np.flatnonzero(np.isin(self.docs["doc_id"], wanted) & (self.docs["null"] == 0)):
            yield int(self.docs["doc_id"][i]), self.ids(int(i))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                      end: int = 0) -> DataFrame:
    """Write the files below ``path`` (seen by all executors); returns the manifest
    (part, file, n_docs, n_ids, low, high), one row per file."""
    src = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), text_bytes(text).alias("t"))
    src = src.withColumn("h", F.xxhash64("t"))
    src = src.repartitionByRange("id", "h").sortWithinPartitions("id", "h").drop("h")
    folder = path.rstrip("/")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        tail = np.array([end], "<u4").tobytes()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        fs, place = filesystem(f"{folder}/files/{name}")
        fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
        low = high = None
        with fs.open_output_stream(place, compression=None) as out:
            w = Writer(out)
            for b in batches(it):
                for i, t in zip(b["id"].to_pylist(), b["t"]):
                    w.add(i, enc.encode(t.as_py().decode("utf-8", "replace")) + tail)
                    low, high = (i if low is None else low), (high if i is None else i)
            w.close()
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "file": f"files/{name}", "n_docs": len(w.docs), "n_ids": w.n_ids, "low": low, "high": high}],
            pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                       ("low", pa.int64()), ("high", pa.int64())]))

    manifest = src.mapInArrow(run, "part int, file string, n_docs bigint, n_ids bigint, low bigint, high bigint")
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of ``path`` with ``base``, the number of ids in the files before each."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    m = spark.read.parquet(f"{path.rstrip('/')}/manifest")
    return m.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("bigint")))


def _read(spark: SparkSession, path: str, doc_ids: list[int] | None, content: str, kind: str, of) -> DataFrame:
    """(doc_id, start, ...) of the documents in the files; ``of`` makes the columns ``content`` (DDL) from
    the ids of some documents, inside the task that reads them."""
    folder, manifest = path.rstrip("/"), read_manifest(spark, path)
    if doc_ids is not None:
        ids = sorted(doc_ids)
        manifest = manifest.filter(F.exists(F.array(*[F.lit(i).cast("bigint") for i in ids]),
                                            lambda i: i.between(F.col("low"), F.col("high"))) if ids else F.lit(False))
    files = manifest.count()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if doc_ids is None else np.array(sorted(doc_ids), np.int64)
        for b in it:
            for name, base in zip(b["file"].to_pylist(), b["base"].to_pylist()):
                fs, place = filesystem(f"{folder}/{name}")
                with fs.open_input_file(place) as source:
                    r = Reader(source)
                    size = r.frames["raw"].astype(np.int64) // 4
                    start = base + np.r_[0, size.cumsum()][r.first]
                    keep = np.arange(len(r.docs)) if wanted is None else np.flatnonzero(
                        np.isin(r.docs["doc_id"], wanted) & (r.docs["null"] == 0))
                    for some in np.array_split(keep, max(1, len(keep) // 256)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r.doc_id(i) for i in some], pa.int64()), pa.array(start[some], pa.int64()),
                             *of(r.ids(int(i)) for i in some)], ["doc_id", "start", *kind.split()])

    # one task per file, however few rows the manifest has
    return manifest.repartitionByRange(max(files, 1), "part").mapInArrow(run, f"doc_id bigint, start bigint, {content}")


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids): the documents read back from the files, all of them or
    those with the given ids (other files are not opened, other frames not read)."""
    return _read(spark, path, doc_ids, "ids binary", "ids", lambda ids: [pa.array(list(ids), pa.binary())])


def read_token_digests(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``token_digest`` of ``read_token_files``, made where the ids are read: they do not leave the task."""
    def of(ids: Iterator[bytes]) -> list[pa.Array]:
        found = [(len(x) // 4, zlib.crc32(x)) for x in ids]
        return [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]

    return _read(spark, path, doc_ids, "n_tokens bigint, ids_crc32 bigint", "n_tokens ids_crc32", of)


def token_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids read back."""
    return rows.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))
