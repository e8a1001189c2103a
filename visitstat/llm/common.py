"""Helpers shared by the operators of this package."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitstat.session import checkpoint_dir

# White space that separates words everywhere in this package (fixed value).
SPACE = "\\x20\\x09-\\x0D"
_CUT = re.compile(rb"[\x20\x09-\x0D]")


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`"), F.lit("")).cast("binary")


def id_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(f"`{name}`").cast("string").cast("binary")) % modulus


def held_out(name: str, modulus: int, remainder: int) -> Column:
    """True where ``id_remainder`` equals ``remainder``; a null id is never held out."""
    return F.coalesce(id_remainder(name, modulus) == remainder, F.lit(False))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names starting with ``names`` that clash with none of ``taken`` (any case)."""
    used = {t.lower() for t in taken}
    out = []
    for n in names:
        c = f"__{n}"
        while c.lower() in used:
            c = f"_{c}"
        used.add(c.lower())
        out.append(c)
    return out


def batches(it: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows and about ``size`` bytes, so that
    the working memory of a task does not follow the session's batch size."""
    for b in it:
        n = max(1, min(rows, int(size * b.num_rows / max(b.nbytes, 1)) or 1))
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


def rows_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns (extra columns of the input never reach an operator)."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text (runs of bytes other than white space), in blocks of
    about ``size`` bytes cut at white space, so a very long text is never one list."""
    if len(data) <= size:
        yield data.split()
        return
    start = 0
    while start < len(data):
        m = _CUT.search(data, start + size)
        end = m.start() if m else len(data)
        yield data[start:end].split()
        start = end


def filesystem(path: str):
    """(file system, path in it) of a Hadoop-style path or URI."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this library to the executors (once per application), so that tasks can
    import it where it is not installed. The archive lies in the shared checkpoint folder and is no
    intermediate table: executors that start later fetch it, so ``drop_scratch`` leaves it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import visitstat
    top = Path(visitstat.__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    path = f"{checkpoint_dir(spark).rstrip('/')}/visitstat/package-{uuid.uuid4().hex}/visitstat.zip"
    fs, place = filesystem(path)
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(place, compression=None) as out:
        out.write(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
