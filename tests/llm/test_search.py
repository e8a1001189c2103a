import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.data import frame, rows
from visitstat.llm.search import search


def plain(data, k):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower()) for r in data]
    tf, n = [Counter(w) for w in words], len(data)
    mean, df = sum(map(len, words)) / n, Counter(t for c in tf for t in c)
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    out = []
    for i, r in enumerate(data):
        if r[0] is None or r[0] % 20:
            continue
        hits = []
        for j, c in enumerate(tf):
            common = tf[i].keys() & c.keys()
            if common:
                norm = 1.2 * (0.25 + 0.75 * len(words[j]) / mean)
                hits.append((-round(sum(idf[t] * c[t] * 2.2 / (c[t] + norm) for t in common), 6),
                             data[j][0] is not None, data[j][0] or 0))
        out += [(r[0], rank, d if some else None, -s) for rank, (s, some, d) in enumerate(sorted(hits)[:k], 1)]
    return out


@pytest.mark.parametrize("size", [(10 ** 9, 10 ** 9, 10 ** 9), (300, 50, 1)])
def test_results_equal_an_exhaustive_search(spark, size):
    """One shard, or many shards, buckets and query groups: the same top 5."""
    data = rows() + [rows()[20]]                    # a query row that is repeated
    got = search(frame(spark, data), F.col("doc_id") % 20 == 0, k=5, shard_words=size[0], bucket_words=size[1],
                 group=size[2]).collect()
    got, want = sorted((g.query_id, g.rank, g.score) for g in got), sorted((w[0], w[1], w[3]) for w in plain(data, 5))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)


def test_documents_found_are_the_right_ones(spark):
    data = rows()
    got = {(g.query_id, g.rank): g.doc_id for g in search(frame(spark, data), F.col("doc_id") % 20 == 0, k=5,
                                                          shard_words=400).collect()}
    assert got == {(q, rank): d for q, rank, d, _ in plain(data, 5)}


def test_batches_and_thresholds_lose_nothing(monkeypatch):
    """Queries worked together, with thresholds that rule out most blocks: the k best of a plain sum."""
    from visitstat.llm import search as S
    from visitstat.llm.arrays import pack
    rng, k = np.random.default_rng(3), 4
    docs = [np.unique(rng.zipf(1.3, rng.integers(0, 200)) % 5000) for _ in range(700)]
    docs += docs[:5]
    flat, count = np.concatenate(docs), np.array([len(d) for d in docs])
    hashes, terms = np.unique(flat, return_inverse=True)
    tf, df = rng.integers(1, 4, len(flat)), np.bincount(terms)
    shard = S.Shard(pack(count, count, terms, tf, np.zeros(len(docs), np.int64)), pack(hashes, df), df, len(docs), count.mean())
    parts = np.zeros((len(docs), len(hashes)))
    who = np.repeat(np.arange(len(docs)), count)
    parts[who, terms] = np.log1p((len(docs) - df + 0.5) / (df + 0.5))[terms] * tf * 2.2 / (
        tf + 1.2 * (0.25 + 0.75 * count[who] / count.mean()))
    cut = np.r_[0, count.cumsum()]
    queries = [terms[cut[q]:cut[q + 1]] for q in range(len(docs)) if count[q]]
    want = []
    for words in queries:
        scores = np.round(parts[:, words].sum(axis=1), 6)
        best = [d for d in np.lexsort((np.arange(len(docs)), -scores))[:k] if scores[d] > 0]
        want.append((best, scores[best]))
    monkeypatch.setattr(S, "BATCH_QUERIES", 50)
    for share in (0.0, 0.9, 1.0):
        asked = S.Asked(0, None, pack(np.arange(len(queries)), np.array([len(w) for w in queries]),
                                      hashes[np.concatenate(queries)], np.array([share * (w[1][-1] - 1e-5) for w in want])))
        got = list(asked.run(shard, k, lambda d: d))
        assert [g[0] for g in got] == list(range(len(queries)))
        for (_, found, scores), (best, most) in zip(got, want):
            assert scores == pytest.approx(most, abs=2e-6) and found.tolist() == best


def test_words_are_those_of_a_plain_split():
    """Bytes of any kind, cut out of a larger array: lengths, different words, frequencies."""
    from visitstat.llm import search as S
    texts = [b"left out", b"", b"  A b\x0b\x0cc\n a", b" \t\r", b"\xff\x80 A\xc3\x84 \x1c x\x1d\xc2\xa0y a\xc3\x84", b"b " * 3000, b""]
    length, count, terms, tf, words = S.words_of(pa.array(texts)[1:])
    assert words.tolist() == sorted(set(words.tolist()))
    end = np.r_[0, count.cumsum()]
    for i, t in enumerate(texts[1:]):
        want = Counter(t.lower().split())
        got = dict(zip(words[terms[end[i]:end[i + 1]]].tolist(), tf[end[i]:end[i + 1]].tolist()))
        assert length[i] == sum(want.values())
        assert got == dict(zip(S.hashes(list(want)).tolist(), want.values()))


def test_a_very_long_text_is_split_in_pieces():
    from visitstat.llm import search as S
    text = b"\n".join(b"Word%d  x" % (i % 70_000) for i in range(300_000))
    assert len(text) > 3 << 20
    for got, want in zip(S.words_of_one(text), S.words_of(pa.array([text]))):
        assert got.tolist() == want.tolist()


def test_small_shards_are_searched_together(spark):
    """The work for a query is per unit: shards of small input parts are one unit, unless they are large."""
    from visitstat.llm import search as S
    docs = frame(spark, rows()).repartition(6)
    shards = S.read_shards(docs, "doc_id", "text", F.col("doc_id") % 20 == 0, S.SHARD_WORDS).cache()
    seen = sorted(shards.select("block", "length", "asked").collect())
    assert len(seen) > 3
    assert S.units(shards, 10 ** 6) == ([[r.block for r in seen]], [sum(r.asked for r in seen)])
    assert S.units(shards, 1) == ([[r.block] for r in seen], [r.asked for r in seen])


@pytest.mark.parametrize("few", [0, 1, 10 ** 9])
def test_bounds_rule_out_no_document(monkeypatch, few):
    """Documents in two languages and of many lengths: all that reach a threshold are found, whether pairs or whole
    classes are summed up, and classes of the other language are not even bounded closely."""
    from visitstat.llm import search as S
    rng, closely = np.random.default_rng(7), []
    docs = [np.unique(rng.zipf(1.2, rng.integers(5, 120)) % 3000) + 3000 * (i % 2) for i in range(1500)]
    flat, count = np.concatenate(docs), np.array([len(d) for d in docs])
    hashes, terms = np.unique(flat, return_inverse=True)
    df, tf, cut = np.bincount(terms), rng.integers(1, 4, len(flat)), np.r_[0, count.cumsum()]
    parts = np.zeros((len(docs), len(hashes)))
    who = np.repeat(np.arange(len(docs)), count)
    parts[who, terms] = np.log1p((len(docs) - df + 0.5) / (df + 0.5))[terms] * tf * 2.2 / (
        tf + 1.2 * (0.25 + 0.75 * count[who] / count.mean()))
    monkeypatch.setattr(S, "CLASS_DOCS", 200)
    monkeypatch.setattr(S, "FEW", few)
    shard = S.Shard([count, count, terms, tf], hashes, df, len(docs), count.mean())
    assert len(shard.classes) > 4 and sorted(shard.docs[shard.docs >= 0].tolist()) == list(range(len(docs)))
    found = S.Class.found
    monkeypatch.setattr(S.Class, "found", lambda self, sums, *x: closely.append(len(sums)) or found(self, sums, *x))
    for q in range(0, 400, 2):
        words = terms[cut[q]:cut[q + 1]]
        score = np.round(parts[:, words].sum(axis=1), 6)
        level = np.sort(score)[-10]
        got = {d: s for _, ds, ss in shard.search(words, np.array([len(words)]), 10, lambda d: d, np.array([level - 1e-5])) for d, s in zip(
            ds.tolist(), ss.tolist())}
        assert set(np.flatnonzero(score > level)) <= set(got) and len(got) == 10
        assert all(s == pytest.approx(score[d], abs=2e-6) for d, s in got.items())
    assert sum(closely) <= 200 * len(shard.classes) * 0.6


def test_empty_table(spark):
    assert search(frame(spark, []), F.col("doc_id") % 20 == 0).collect() == []
