"""Tokenizer alignment against plain loops."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.data import frame, rows
from visitstat.llm.alignment import Aligned, align, sides
from visitstat.llm.queries.op13 import TOKENIZER_A, TOKENIZER_B
from visitstat.llm.tokens import byte_letters, piece_encoder


TOK = Tokenizer.from_file(TOKENIZER_A)
TOK.encode_special_tokens = True
SP = SentencePieceProcessor(model_file=TOKENIZER_B)


def token_bytes(text):
    """[(id, bytes)] of both tokenizers, straight from the libraries."""
    tok, sp = TOK, SP
    back = {c: b for b, c in byte_letters().items()}
    a = [(i, bytes(back[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
         for i in sp.encode(text)]
    return a, b


def grouped(text):
    """[(A ids, B ids)] of a text's groups, or None."""
    if not text:
        return None
    a, b = token_bytes(text)
    if any(b"".join(x for _, x in s) != (" " + text).encode() for s in (a, b)):
        return None

    def ends(side):
        at, out = 0, []
        for i, x in side:
            at += len(x)
            out.append((at, i))
        return out
    ea, eb = ends(a), ends(b)
    common = sorted({e for e, _ in ea} & {e for e, _ in eb})
    out = [([], []) for _ in common]
    for k, side in enumerate((ea, eb)):
        for e, i in side:
            out[bisect_left(common, e)][k].append(i)
    return out


def brute(data):
    groups = [grouped(t) for t in data]
    links = [Counter((x, y) for p, q in g or [] for x in p for y in q) for g in groups]
    count = Counter(p for c in links for p in c)
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g, c in zip(groups, links):
        s = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g or [])
        out.append((sum(len(p) for p, _ in g or []), sum(len(q) for _, q in g or []), len(g or []), sum(c.values()),
                    sum(n for (x, y), n in c.items() if count[x, y] == best[x]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(s.encode()).hexdigest() if g else ""))
    return out


ODD = ["a  b", " a", "a ", "   ", "\n a\n\nb", "a\tb", "x▁y", "ﬁne é", "　wide　", "naïve café 東京 🙂🙂",
       "<|endoftext|> <s></s>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890" * 5, "\x00\x01", "a" + " " * 40 + "b", "=" * 70]


def test_equals_plain_loops(spark):
    rng = random.Random(3)
    texts = [r[1] for r in rows() if r[1] is None or len(r[1]) < 5000] + ODD
    texts += ["".join(rng.choice("ab \n.é東<s>" * 9 + "▁") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    data = [(i, t, "en", "s") for i, t in enumerate(texts)]
    want = brute(texts)
    assert sum(w[0] > 0 for w in want) > 150 and sum(w[0] == 0 for w in want) > 10
    for block_pairs in (10**6, 300):        # one block per partition, many blocks
        got = align(frame(spark, data).repartition(3), TOKENIZER_A, TOKENIZER_B, block_pairs=block_pairs).collect()
        assert [tuple(r)[1:] for r in sorted(got)] == want


def test_all_kinds_of_rows(spark):
    got = align(frame(spark), TOKENIZER_A, TOKENIZER_B).collect()
    assert len(got) == len(rows())
    assert {r.n_a for r in got if r.doc_id in (300, 301)} == {0} and {r.groups_sha256 for r in got if r.doc_id in (300, 301)} == {""}
    assert len([r for r in got if r.doc_id is None]) == 2
    assert align(frame(spark, []), TOKENIZER_A, TOKENIZER_B).collect() == []


def test_groups_beyond_a_slice(monkeypatch):
    """Links of large groups are counted by equal ids, with the same result."""
    a, b = sides(TOKENIZER_A, TOKENIZER_B)
    texts = [t.encode() for t in (*ODD, "zqzqjxjxkv" * 30)]
    plain = Aligned(texts, a, b).pairs().sort_by([("doc", "ascending"), ("pair", "ascending")]).to_pydict()
    for limit in (1, 3, 7):
        monkeypatch.setattr("visitstat.llm.alignment.SLICE", limit)
        assert Aligned(texts, a, b).pairs().sort_by([("doc", "ascending"), ("pair", "ascending")]).to_pydict() == plain


@pytest.mark.parametrize("seed", range(3))
def test_pieces_by_chunks_equal_whole_texts(seed):
    rng = random.Random(seed)
    enc, sp = piece_encoder(TOKENIZER_B), SP
    assert enc.cut
    for _ in range(2000):
        t = "".join(rng.choice("  ab\n\tcd.é東▁ ") for _ in range(rng.randint(0, 30)))
        assert memoryview(enc.encode(t)).cast("I").tolist() == sp.encode(t), t


def test_query(spark):
    from visitstat.llm.queries import op13
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in op13.query(spark, "/root/testdata/sf0.001").collect()}
    texts = docs.select("doc_id", "text").collect()
    assert public_tokenizers.path("byte_bpe_50k.json") == TOKENIZER_A
    assert got == {r.doc_id: w for r, w in zip(texts, brute([r.text for r in texts]))}
