"""The registered queries that SQL cannot state, over the whole small tables, against plain loops."""

import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from visitstat.llm import catalog
from visitstat.llm.queries.op8 import TOKENIZER

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOK = Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()


def run(spark, name):
    df = catalog.queries()[name](spark, SF)
    return df, df.collect()


def types(df, columns):
    found = dict(df.dtypes)
    return {c: found.get(c) for c in columns}


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def ids(text, end):
    return TOK.encode(text or "", add_special_tokens=False).ids + [end]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in catalog.queries()] == [f"op{i}" for i in range(1, 14)]


def test_op1(spark, docs):
    df, got = run(spark, "op1_language_id")
    assert types(df, ["doc_id", "held_out", "lang_pred", "score"]) == {
        "doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    by = {r.doc_id: r for r in got}
    assert sorted(by) == [d.doc_id for d in docs] and len(got) == len(docs)
    for d in docs:
        r = by[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
    held = [(by[d.doc_id].lang_pred, d.lang) for d in docs if by[d.doc_id].held_out and d.lang and by[d.doc_id].lang_pred != "und"]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.95


def test_op3(spark, docs):
    df, got = run(spark, "op3_token_files")
    assert types(df, ["doc_id", "start", "n_tokens", "ids_crc32"]) == dict.fromkeys(["doc_id", "start", "n_tokens", "ids_crc32"], "bigint")
    want, at = [], 0
    for d in docs:
        x = ids(d.text, 0)
        want.append((d.doc_id, at, len(x), crc(x)))
        at += len(x)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_op4(spark, docs):
    df, got = run(spark, "op4_lm_scoring")
    assert types(df, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]) == {
        "doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint",
        "base_score": "double", "score": "double"}
    tokens = {d.doc_id: [*WORD.findall(lower(d.text)), None] for d in docs}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 10 == 0}
    count = Counter(t for i, ts in tokens.items() if i not in held for t in ts)
    total, kinds = sum(count.values()), len(count)
    assert sorted(r.doc_id for r in got) == sorted(tokens)
    for r in got:
        ts = tokens[r.doc_id]
        base = math.fsum(math.log10((count[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(ts), sum(t in count for t in ts), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and -math.inf < r.score < 0
    # more context tells more: the model beats the base on held-out text
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def fingerprint(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def test_op6(spark, docs):
    df, got = run(spark, "op6_simhash")
    assert types(df, ["doc_id", "fingerprint", "component_id"]) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    fps = {d.doc_id: fingerprint(d.text) for d in docs}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    order = sorted(fps)
    for n, a in enumerate(order):
        for b in order[n + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(i, f"{fps[i]:016x}", find(i)) for i in order]
    assert len({find(i) for i in order}) < len(order)


def test_op7(spark, docs):
    df, got = run(spark, "op7_mixing")
    assert types(df, ["doc_id", "size", "source_size", "target", "taken"]) == {
        "doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    from tests.llm.test_mixing import plain_targets
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    want = plain_targets(total)
    taken = Counter()
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert math.isclose(r.target, want[source[r.doc_id]], rel_tol=1e-9)
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    # a source of few documents can miss its target by half of its smallest one
    least = {s: min(n for i, n in size.items() if source[i] == s and n) for s in want}
    assert all(abs(taken[s] - t) <= max(0.01 * t, least[s] / 2) for s, t in want.items())
    again = catalog.queries()["op7_mixing"](spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_op8(spark, docs):
    df, got = run(spark, "op8_packing")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert types(df, columns) == dict.fromkeys(columns, "bigint")
    all_ids = {d.doc_id: ids(d.text, 1) for d in docs}
    covered = Counter()
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        x = all_ids[r.doc_id]
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(x) and r.length > 0     # each id in exactly one piece
        assert r.ids_crc32 == crc(x[r.start:r.start + r.length])
        covered[r.doc_id] += r.length
    assert covered == {i: len(x) for i, x in all_ids.items()}
    full = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full[r.sequence_id]
        full[r.sequence_id] += r.length
    assert sorted(full) == list(range(len(full))) and sorted(full.values())[1:] == [2048] * (len(full) - 1)


def test_op9(spark):
    df, got = run(spark, "op9_extraction")
    assert types(df, ["page_id", "url", "text", "n_chars"]) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)       # the one layout of the given pages
        blocks = re.split(r"</?(?:p|h1|h2|div)[^>]*>", article[1].replace("<br>", " ")) if article else []
        clean = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert r.text == "\n".join(b for b in clean if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_pipeline_run(spark, docs):
    """All stages, one after the other: what the packed pieces hold are whole documents that the stages before kept."""
    got = corpus_pipeline.run(spark, SF).collect()
    all_ids = {d.doc_id: ids(d.text, 1) for d in docs}
    per = {}
    for r in got:
        assert r.ids_crc32 == crc(all_ids[r.doc_id][r.start:r.start + r.length])
        per.setdefault(r.doc_id, Counter())[r.start] += 1
    for i, pieces in per.items():
        tokens = sum(r.length for r in got if r.doc_id == i)
        assert tokens % len(all_ids[i]) == 0 and tokens // len(all_ids[i]) <= 3             # one to three whole copies
    fps = [fingerprint(d.text) for d in docs if d.doc_id in per]
    assert all((a ^ b).bit_count() > 3 for n, a in enumerate(fps) for b in fps[n + 1:])    # no near-duplicates left
    assert 0 < len(per) < len(docs)
