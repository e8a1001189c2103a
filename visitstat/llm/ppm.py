"""Language ID by prediction by partial matching.

For each language a variable-order context tree over bytes is counted (contexts
of 0 to ``MAX_ORDER`` bytes) and then frozen. A byte b after context s costs

    -log2(c(s,b) / (n(s) + q(s)))            if b was seen after s,
    -log2(q(s) / (n(s) + q(s))) + cost(b | s without its first byte)   if not,

with n(s) the number of bytes seen after s and q(s) the number of different
ones (escape method C); an unseen context costs nothing, and after the empty
context every byte has 8 bits. The language of a text is the one with the
shortest code for the whole text; its score is that code's share,
2^-length over the sum of 2^-length of all languages.

Fitting uses a bounded sample: at most ``TRAIN_BYTES`` bytes of different texts
per language (all of them where a language has fewer), in pieces of at most a
``PIECES``-th of that, chosen by a hash of text and place. That bounds the trees (at most MAX_ORDER + 1 counts per sampled byte),
which are broadcast. Every text is scored whole. Neither lang, source nor id
is an input of a prediction.

Defined results: a null text or one without a letter is ``und`` with score 0;
ties go to the language first in text order; with no labelled text every
document is ``und``; repeated rows get equal results; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.llm.common import batches, text_bytes


MAX_ORDER = 4
TRAIN_BYTES = 1 << 20      # sampled bytes per language
PIECES = 64                # a sampled piece is at most this part of the sample
RAW_BITS = 8.0             # a code of this many bits per byte is no better than the bytes themselves
MAX_LANGUAGES = 1000       # more labels than this are an error
UNKNOWN = "und"
_START = b"\n" * MAX_ORDER     # what stands before a text
_ASCII = re.compile(rb"[A-Za-z]")


def codes(data: bytes) -> np.ndarray:
    """The last MAX_ORDER + 1 bytes up to each position of the text, as one number."""
    x = np.frombuffer(_START + data, np.uint8).astype(np.uint64)
    n, out = len(data), np.zeros(len(data), np.uint64)
    for k in range(MAX_ORDER + 1):
        out |= x[k:k + n] << np.uint64(8 * (MAX_ORDER - k))
    return out


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """``codes`` of a text in pieces of bounded size."""
    for i in range(0, len(data), size):
        lead = data[max(0, i - MAX_ORDER):i]
        yield codes(lead + data[i:i + size])[len(lead):]


def mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * (order + 1))) - 1)


class Rows:
    """Row numbers of distinct 64-bit keys: an open-addressing table over arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.zeros(1 << bits, np.uint64)
        self.row = np.full(1 << bits, -1, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.row[slot[rest]] < 0
            self.row[slot[rest[free]]] = rest[free]                # of several, one stays
            self.key[slot[rest[free]]] = keys[rest[free]]
            rest = rest[self.row[slot[rest]] != rest]
            slot[rest] = (slot[rest] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        slot = self._slot(keys)
        row = self.row[slot]
        rest = np.flatnonzero((row >= 0) & (self.key[slot] != keys))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.last
            row[rest] = self.row[slot[rest]]
            rest = rest[(row[rest] >= 0) & (self.key[slot[rest]] != keys[rest])]
        return row


class Model:
    """Frozen statistics: per order, the cost of each byte in its context and the
    escape cost of each context, one column per language."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``counts[k]``: (language number, code, count) of the strings of k + 1 bytes."""
        self.langs, self.rows, self.cost, self.escape = langs, [], [], []
        size = len(langs)
        for k, (lang, code, count) in enumerate(counts):
            grams, at = np.unique(code, return_inverse=True)
            c = np.zeros((len(grams), size))
            c[at, lang] = count
            heads, head = np.unique(grams >> np.uint64(8), return_inverse=True)
            n, q = np.zeros((len(heads), size)), np.zeros((len(heads), size))
            np.add.at(n, head, c)
            np.add.at(q, head, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.log2(n + q)[head] - np.log2(c)
                esc = np.where(n > 0, np.log2(n + q) - np.log2(q), 0.0)
            lower = np.full((len(grams), size), RAW_BITS) if k == 0 else \
                self.cost[k - 1][self.rows[k - 1].find(grams & mask(k - 1))]
            self.rows.append(Rows(grams))
            self.cost.append(np.where(c > 0, seen, esc[head] + lower).astype(np.float32))
            self.escape.append((Rows(heads), esc.astype(np.float32)))

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Bits of each position in each language (positions x languages)."""
        out = np.zeros((len(code), len(self.langs)), np.float32)
        rest = np.arange(len(code))
        for k in range(MAX_ORDER, -1, -1):
            gram = code[rest] & mask(k)
            row = self.rows[k].find(gram)
            hit = row >= 0
            out[rest[hit]] += self.cost[k][row[hit]]
            rest, gram = rest[~hit], gram[~hit]
            if len(rest) == 0:
                return out
            heads, esc = self.escape[k]
            head = heads.find(gram >> np.uint64(8))
            out[rest[head >= 0]] += esc[head[head >= 0]]
        out[rest] += np.float32(RAW_BITS)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each whole text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        group, first, n = [], 0, 0
        for i, t in enumerate([*texts, None]):
            if group and (t is None or n + len(t) > 1 << 20):
                bits = self.costs(np.concatenate(group))
                ends = np.cumsum([len(g) for g in group])
                for j, (a, z) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                    out[first + j] = bits[a:z].sum(axis=0, dtype=np.float64)
                group, first, n = [], i, 0
            if t is None:
                break
            if len(t) > 1 << 20:                       # a very long text: by itself, in pieces
                out[i] = sum(self.costs(p).sum(axis=0, dtype=np.float64) for p in pieces(t))
                first = i + 1
                continue
            group.append(codes(t))
            n += len(t)
        return out


def sample(labelled: DataFrame, train_bytes: int) -> tuple[list[str], DataFrame]:
    """Languages, and (lang, lead, t): pieces ``t`` of different texts, about ``train_bytes`` bytes
    per language, with the at most MAX_ORDER bytes ``lead`` before them in their text.

    Texts are cut into pieces of at most a ``PIECES``-th of the bound, each with a hash of its own,
    so a long text is sampled like short ones and the bound is filled up to one piece. One pass over
    the different texts gives each language's bytes and smallest hash; a threshold per language then
    leaves little more than the bound and always that smallest piece, and only this remainder
    is put in order and cut at the bound.
    """
    size = max(1, train_bytes // PIECES)
    src = labelled.select("lang", "t", F.octet_length("t").alias("size"), F.xxhash64("t").alias("h"))
    last = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / F.lit(size)).cast("int")

    def place(i: Column) -> Column:
        return F.pmod(F.xxhash64("h", i), F.lit(1 << 30))

    texts = src.groupBy("lang", "h").agg(F.max("size").alias("size"))        # copies count once
    first = F.array_min(F.transform(F.sequence(F.lit(0), last), place))
    found = texts.groupBy("lang").agg(F.sum("size").alias("n"), F.min(first).alias("first"))
    found = found.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the column holds no language labels")
    langs = sorted(r["lang"] for r in found)
    if not langs:
        return [], src.select("lang", F.lit(b"").alias("lead"), "t")
    # a language's share of hash values; 3 x the bound leaves room for uneven lengths
    below = {r["lang"]: max(int(min(1.0, 3.0 * train_bytes / max(r["n"], 1)) * (1 << 30)), r["first"] + 1) for r in found}
    limit = F.element_at(F.create_map(*[F.lit(v) for x in langs for v in (x, below[x])]), F.col("lang"))

    def piece(i: Column) -> Column:
        at = i * F.lit(size)
        lead = F.least(at, F.lit(MAX_ORDER))
        return F.struct(F.xxhash64("h", i).alias("g"), F.substring(F.col("t"), at - lead + 1, lead).alias("lead"),
                        F.substring(F.col("t"), at + 1, F.lit(size)).alias("t"))

    src = src.withColumn("below", limit)
    some = F.transform(F.filter(F.sequence(F.lit(0), last), lambda i: place(i) < F.col("below")), piece)
    near = src.select("lang", F.explode(some).alias("p")).select("lang", "p.*").dropDuplicates(["lang", "g"])
    order = Window.partitionBy("lang").orderBy(F.pmod("g", F.lit(1 << 30)), "g")
    upto = F.sum(F.octet_length("t")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return langs, near.withColumn("upto", upto).filter(F.col("upto") <= max(train_bytes, 1)).select("lang", "lead", "t")


def fit(labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> Model:
    """The frozen model of the rows (lang, t); null languages must be filtered out."""
    langs, rows = sample(labelled, train_bytes)
    if not langs:
        return Model([], [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))] * (MAX_ORDER + 1))
    number = {x: i for i, x in enumerate(langs)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, size=1 << 20):
            by: dict[int, list[np.ndarray]] = {}
            for x, lead, t in zip(b["lang"].to_pylist(), b["lead"].to_pylist(), b["t"].to_pylist()):
                by.setdefault(number[x], []).append(codes(lead + t)[len(lead):])
            for x, found in by.items():
                code = np.concatenate(found)
                for k in range(MAX_ORDER + 1):
                    g, c = np.unique(code & mask(k), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(g), k, np.int32)), pa.array(np.full(len(g), x, np.int32)),
                         pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], ["k", "lang", "code", "n"])

    counted = rows.mapInArrow(run, "k int, lang int, code bigint, n bigint").groupBy("k", "lang", "code")
    got = counted.agg(F.sum("n").alias("n")).toArrow()       # bounded by the sample
    k, lang, code, n = (got[c].to_numpy() for c in ("k", "lang", "code", "n"))
    code = code.view(np.uint64)
    return Model(langs, [(lang[k == i], code[k == i], n[k == i]) for i in range(MAX_ORDER + 1)])


def has_letter(data: bytes) -> bool:
    return bool(_ASCII.search(data)) or any(map(str.isalpha, data.decode("utf-8", "replace")))


def score(texts: list[bytes], model: Model) -> list[tuple[str, float, float]]:
    """(language, share of its code, bits per byte) of each whole text."""
    out = []
    for t, bits in zip(texts, model.lengths(texts)):
        if not model.langs or not has_letter(t):
            out.append((UNKNOWN, 0.0, RAW_BITS))
            continue
        best = int(bits.argmin())
        with np.errstate(under="ignore"):
            share = 1.0 / np.exp2(bits[best] - bits).sum()
        out.append((model.langs[best], float(share), float(bits[best] / len(t))))
    return out


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang",
          train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on the rows where ``learn`` holds and the language is known."""
    rows = docs.filter(learn & F.col(f"`{lang}`").isNotNull())
    return fit(rows.select(F.col(f"`{lang}`").alias("lang"), text_bytes(text).alias("t")), train_bytes)


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` plus lang_pred, score and bits_per_byte of every row."""
    src = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], text_bytes(text).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = list(src.schema)[:-1]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("bits", T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            got = score([t.as_py() for t in b["t"]], shared.value)
            cols = list(zip(*got)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()),
                 pa.array(cols[2], pa.float64())], [f.name for f in schema])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score",
                      F.col("bits").alias("bits_per_byte"))


def keep_identified(docs: DataFrame, learn: Column | None = None, text: str = "text", lang: str = "lang",
                    train_bytes: int = TRAIN_BYTES, excess_bits: float = 64.0) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with ``lang`` set to it.

    Rejected are texts without a letter, and texts whose shortest code is longer
    than their bytes by ``excess_bits`` (no learned language explains them; a
    text of a few bytes is too little evidence and stays).
    """
    model = train(docs, F.lit(True) if learn is None else learn, text, lang, train_bytes)
    names = docs.columns
    got = predict(docs, model, {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(names)}, text)
    size = F.octet_length(F.col(f"c{names.index(text)}"))
    got = got.filter((F.col("lang_pred") != UNKNOWN)
                     & ((F.col("bits_per_byte") - RAW_BITS) * size <= excess_bits))
    return got.select(*[F.col("lang_pred" if c == lang else f"c{i}").alias(c) for i, c in enumerate(names)])
