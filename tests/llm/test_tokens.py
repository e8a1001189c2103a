import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.data import frame, rows
from visitstat.llm import token_files
from visitstat.llm.packing import pack, sequences
from visitstat.llm.token_files import Reader, Writer, read_token_digests, read_token_files, token_digest, write_token_files
from visitstat.llm.tokens import Encoder, encoder
from visitstat.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
PIECES = [" ", "  ", "\n", "\nab", "b.\nC", "\n\n", "\t", "a", "Word", "'s", "'ll", ".", ",", "?!", "12", "é", "漢字", "\u00a0", "\u0085", "\x1c", "²", "_",
          "<|endoftext|>", "😀", "the", "ing"]


def ids(text, end=None):
    x = TOKENIZER.encode(text or "", add_special_tokens=False).ids if text else []
    return x + ([] if end is None else [end])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=14).map("".join)))
def test_cached_encoding_equals_the_library(text):
    assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == ids(text)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some words,  and More words"
    assert not encoder(path).cut
    assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == \
        Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_file_round_trip_and_random_access(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 5)              # long documents take several frames
    rng, out = random.Random(1), io.BytesIO()
    docs = [(None if i == 0 else i, np.array([rng.randint(0, 50256) for _ in range(n)], "<u4").tobytes())
            for i, n in enumerate([1, 0, 5, 6, 23, 2])]
    w = Writer(out)
    for d in docs:
        w.add(*d)
    w.close()
    r = Reader(Source(out.getvalue()))
    assert [(r.doc_id(i), r.ids(i)) for i in range(len(r.docs))] == docs
    assert list(r.find([4, 2, 99])) == [docs[2], docs[4]]
    reads = []
    read = r._read
    r._read = lambda at, n: reads.append((int(at), int(n))) or read(at, n)
    r.ids(3)
    assert len(reads) == 2 and sum(n for _, n in reads) < len(out.getvalue()) / 2


def test_a_damaged_frame_is_found():
    out = io.BytesIO()
    w = Writer(out)
    w.add(1, np.arange(100, dtype="<u4").tobytes())
    w.close()
    data = bytearray(out.getvalue())
    data[20] ^= 0xFF
    with pytest.raises(Exception):
        Reader(Source(bytes(data))).ids(0)


def order(data):
    return sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_files_equal_a_plain_loop(spark):
    data = order(rows())
    path = scratch_path(spark, "test_tokens")
    write_token_files(frame(spark), path, PATH)
    got = token_digest(read_token_files(spark, path)).collect()
    assert sorted(map(str, read_token_digests(spark, path).collect())) == sorted(map(str, got))
    assert [g.doc_id for g in sorted(got, key=lambda g: g.start)] == [r[0] for r in data]
    total = sum(len(ids(r[1], 0)) for r in data)
    assert sum(g.n_tokens for g in got) == total
    crc = lambda t: zlib.crc32(np.array(ids(t, 0), "<u4").tobytes())
    assert sorted((g.doc_id is None, g.doc_id or 0, g.n_tokens, g.ids_crc32) for g in got) == sorted(
        (r[0] is None, r[0] or 0, len(ids(r[1], 0)), crc(r[1])) for r in data)
    at = 0
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at
        at += g.n_tokens
    some = read_token_files(spark, path, [7, 305, 12345]).collect()
    assert sorted(r.doc_id for r in some) == [7, 305]


def test_packing_equals_the_concatenated_stream(spark):
    docs = frame(spark)
    pieces = pack(docs, PATH, window=64).collect()
    by = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == len(by.setdefault(p.sequence_id, []))       # gapless
        by[p.sequence_id] += p.ids
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
    last = max(by)
    assert sorted(by) == list(range(last + 1)) and all(len(by[s]) == 64 for s in range(last))
    stream = sum((by[s] for s in range(last + 1)), [])
    want = sorted(tuple(ids(r[1], 1)) for r in rows())
    cut, got = [], []
    for x in stream:
        cut.append(x)
        if x == 1:
            got.append(tuple(cut))
            cut = []
    if all(1 not in ids(r[1]) for r in rows()):
        assert sorted(got) == want
    assert len(stream) == sum(map(len, want))
    whole = {r.sequence_id: r.ids for r in sequences(pack(docs, PATH, window=64), pad=0, window=64).collect()}
    assert all(len(v) == 64 for v in whole.values()) and whole[0] == by[0]


def test_empty_tables(spark):
    path = scratch_path(spark, "test_empty")
    write_token_files(frame(spark, []), path, PATH)
    assert read_token_files(spark, path).collect() == []
    assert pack(frame(spark, []), PATH).collect() == []


@pytest.mark.parametrize("limit", [1, 2, 6, 40, 1_000_000])
def test_cache_keeps_the_words_met_last(limit):
    """At its limit the cache drops words not met for long; the ids stay those of the library."""
    enc = Encoder(PATH, limit=limit)
    rng = random.Random(limit)
    for i in range(300):
        words = ["the"] + [f"w{rng.choice('abcdef') * 2}{x}" for x in rng.choices(["", ".", "&&&", "\nNew", "|", " ", "'s", "%%%,"], k=8)] + ["the"]
        text = " ".join(words) + rng.choice(["", " ", "\n"])
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(enc.cache) + len(enc.cache.older) <= max(limit, 2)
    if limit == 40:          # a cache that starts anew would lose the word now and then
        for _ in range(200):
            enc.encode("x the " + "".join(rng.choices("abcdefghij", k=6)) + " a")
            assert "the" in enc.cache or "the" in enc.cache.older
