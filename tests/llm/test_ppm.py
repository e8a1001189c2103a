import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import frame, prose, rows
from visitstat.llm import ppm


def plain_length(text, texts):
    """Code length by the recursion of the docstring, with dictionaries."""
    counts = [defaultdict(Counter) for _ in range(ppm.MAX_ORDER + 1)]
    for t in texts:
        x = b"\n" * ppm.MAX_ORDER + t
        for i in range(ppm.MAX_ORDER, len(x)):
            for k in range(ppm.MAX_ORDER + 1):
                counts[k][x[i - k:i]][x[i]] += 1

    def cost(context, b):
        c = counts[len(context)].get(context)
        lower = 8.0 if not context else None
        if not c:
            return lower if lower is not None else cost(context[1:], b)
        n, q = sum(c.values()), len(c)
        if c[b]:
            return math.log2((n + q) / c[b])
        return math.log2((n + q) / q) + (lower if lower is not None else cost(context[1:], b))

    x = b"\n" * ppm.MAX_ORDER + text
    return sum(cost(x[i - ppm.MAX_ORDER:i], x[i]) for i in range(ppm.MAX_ORDER, len(x)))


def test_code_lengths_equal_the_recursion(spark):
    rng = random.Random(1)
    data = [(i, prose(rng, x, 25), x, "s") for i, x in enumerate(["en", "de"] * 15)]
    model = ppm.train(frame(spark, data), F.lit(True))
    assert model.langs == ["de", "en"]
    texts = [prose(rng, "en", 30).encode(), "völlig Anderes € \x00".encode(), b"", b"the"]
    got = model.lengths(texts)
    for t, bits in zip(texts, got):
        for lang, b in zip(model.langs, bits):
            assert b == pytest.approx(plain_length(t, [r[1].encode() for r in data if r[2] == lang]), rel=1e-5, abs=1e-3)


def test_long_text_in_pieces_equals_one_pass():
    rng = random.Random(2)
    data = bytes(rng.choice(b"abc \n") for _ in range((1 << 20) + 1000))
    assert (np.concatenate(list(ppm.pieces(data, 1000))) == ppm.codes(data)).all()


def test_hash_rows_find_every_key():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 50_000, dtype=np.uint64))
    table = ppm.Rows(keys[::2])
    assert (table.find(keys[::2]) == np.arange(len(keys[::2]))).all()
    assert (table.find(keys[1::2]) == -1).all()


def test_held_out_accuracy_and_odd_rows(spark):
    docs = frame(spark)
    learn = F.coalesce(F.col("doc_id") % 4 != 2, F.lit(True))
    got = ppm.predict(docs, ppm.train(docs, learn), {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert len(got) == len(rows())
    by = {r[0]: r[2] for r in rows()}
    held = [g for g in got if g.doc_id is not None and g.doc_id < 60 and g.doc_id % 4 == 2]
    assert all(g.lang_pred == by[g.doc_id] for g in held)
    for g in got:
        if not any(c.isalpha() for c in g.text or ""):
            assert (g.lang_pred, g.score) == ("und", 0.0)
        else:
            assert 0 < g.score <= 1
    kept = ppm.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows() if any(c.isalpha() for c in r[1] or "")}


def test_sample_is_bounded_and_whole_for_small_languages(spark):
    rng = random.Random(4)
    data = [(i, prose(rng, "en", 40), "en", "s") for i in range(400)] + [(900, "ein text", "de", "s")]
    src = frame(spark, data).select("lang", F.col("text").cast("binary").alias("t"))
    langs, rows_ = ppm.sample(src, 20_000)
    size = {r.lang: r.n for r in rows_.groupBy("lang").agg(F.sum(F.octet_length("t")).alias("n")).collect()}
    assert langs == ["de", "en"] and size["de"] == 8 and 10_000 < size["en"] <= 20_000


def test_languages_of_a_few_long_texts_fill_their_sample(spark):
    """Texts above the bound are sampled in pieces; a long one neither ends nor empties the sample."""
    rng = random.Random(6)
    bound = 6_400
    data = [(i, prose(rng, "en", 40_000), "en", "s") for i in range(10)]
    data += [(100 + i, prose(rng, "de", 40_000 if i < 3 else 5), "de", "s") for i in range(300)]
    data += [(500 + i, "immer derselbe Satz " * 20, "copies", "s") for i in range(200)]
    src = frame(spark, data).select("lang", F.col("text").cast("binary").alias("t"))
    langs, rows_ = ppm.sample(src, bound)
    got = rows_.collect()
    size = Counter()
    for r in got:
        size[r.lang] += len(r.t)
    assert langs == ["copies", "de", "en"] and size["copies"] == 400
    for x in ("de", "en"):
        assert bound - bound // ppm.PIECES < size[x] <= bound
    texts = {x: [r[1].encode() for r in data if r[2] == x] for x in langs}
    for r in got:                              # a piece follows its lead in a text, or begins one
        assert len(r.lead) in (0, ppm.MAX_ORDER)
        assert any(t.startswith(r.t) if not r.lead else r.lead + r.t in t for t in texts[r.lang])
    model = ppm.fit(src, bound)
    probe = [prose(rng, x, 30).encode() for x in ("en", "de") * 5]
    assert [g[0] for g in ppm.score(probe, model)] == ["en", "de"] * 5
    assert {r.lang for r in ppm.sample(src, 1)[1].collect()} == set(langs)       # the smallest piece stays


def test_counts_of_pieces_are_those_of_whole_texts(spark):
    rng = random.Random(7)
    data = [(i, prose(rng, "en", 400), "en", "s") for i in range(3)]
    total = sum(len(r[1]) for r in data)
    model = ppm.train(frame(spark, data), F.lit(True), train_bytes=total)
    texts = [prose(rng, "en", 30).encode(), b"other"]
    for t, bits in zip(texts, model.lengths(texts)):
        assert bits[0] == pytest.approx(plain_length(t, [r[1].encode() for r in data]), rel=1e-5, abs=1e-3)


def test_without_labels_and_empty_table(spark):
    empty = frame(spark, [])
    model = ppm.train(empty, F.lit(True))
    assert ppm.predict(empty, model, {"doc_id": F.col("doc_id")}).collect() == []
    got = ppm.predict(frame(spark, [(1, "text", None, "s")]), model, {"doc_id": F.col("doc_id")}).collect()
    assert [tuple(g)[:3] for g in got] == [(1, "und", 0.0)]
