import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.data import frame, rows
from visitstat.llm import katz


class Plain:
    """The model of the docstring, with dictionaries."""

    def __init__(self, docs):
        self.c1, self.c2 = Counter(), defaultdict(Counter)
        for tokens in docs:
            for v, w in zip(["<s>", *tokens], tokens):
                self.c1[w] += 1
                self.c2[v][w] += 1
        self.n = sum(self.c1.values())
        self.d1 = katz.discounts(Counter(self.c1.values()))
        self.d2 = katz.discounts(Counter(c for q in self.c2.values() for c in q.values()))
        gone = sum((1 - self.d(self.d1, c)) * c for c in self.c1.values())
        self.more = int(gone <= 0)
        self.rest = (gone + self.more) / (self.n + self.more)

    @staticmethod
    def d(table, c):
        return table[c] if c <= katz.CUTOFF else 1.0

    def word(self, w):
        return self.d(self.d1, self.c1[w]) * self.c1[w] / (self.n + self.more) if w in self.c1 else self.rest

    def after(self, v):
        q = self.c2[v]
        total = sum(q.values()) + (not any(self.d(self.d2, c) < 1 for c in q.values()))
        left = 1 - sum(self.d(self.d2, c) * c / total for c in q.values())
        return total, left / (1 - sum(map(self.word, q)))

    def p(self, w, v):
        if v not in self.c2:
            return self.word(w)
        total, back = self.after(v)
        c = self.c2[v].get(w, 0)
        return self.d(self.d2, c) * c / total if c else back * self.word(w)


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + ["</s>"]


@pytest.mark.parametrize("size", [(200, 60), (10 ** 9, 10 ** 9)])
def test_scores_equal_plain_dictionaries(spark, size):
    """Many blocks, buckets and spread contexts, or one of each: the same scores."""
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    got = katz.score(frame(spark), held, block_tokens=size[0], bucket_tokens=size[1]).collect()
    data = rows()
    out = [r[0] is not None and r[0] % 5 == 0 for r in data]
    m = Plain([tokens(r[1]) for r, o in zip(data, out) if not o])
    want = []
    for r, o in zip(data, out):
        t = tokens(r[1])
        base = sum(math.log10((m.c1.get(w, 0) + 0.1) / (m.n + 0.1 * (len(m.c1) + 1))) for w in t)
        logp = sum(math.log10(m.p(w, v)) for v, w in zip(["<s>", *t], t))
        want.append((r[0] is None, r[0] or 0, o, len(t), sum(w in m.c1 for w in t), m.n, base, logp))
    got = sorted((g.id is None, g.id or 0, *g[1:]) for g in got)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:6] == w[:6]
        assert g[6:] == pytest.approx(w[6:], rel=1e-9)


def test_probabilities_sum_to_one():
    m = Plain([tokens(r[1]) for r in rows()])
    for v in list(m.c2)[:40]:
        assert sum(m.p(w, v) for w in m.c1) + m.after(v)[1] * m.rest == pytest.approx(1.0)


def test_discounts_are_good_turing():
    n = {1: 1000, 2: 400, 3: 200, 4: 120, 5: 80, 6: 60}
    common = 6 * 60 / 1000
    d = katz.discounts(n)
    assert d[1] == pytest.approx((2 * 400 / 1000 - common) / (1 - common))
    assert all(0 < x < 1 for x in d[1:])
    assert (katz.discounts({1: 3}) <= 1).all() and katz.discounts({1: 3})[1] == 0.5


def test_no_training_text_and_empty_table(spark):
    got = katz.score(frame(spark, [(1, "a b", "en", "s")]), F.lit(True)).collect()
    assert [(g.n_tokens, g.n_known, g.train_tokens, g.score) for g in got] == [(3, 0, 0, 0.0)]
    assert katz.score(frame(spark, []), F.lit(False)).collect() == []
