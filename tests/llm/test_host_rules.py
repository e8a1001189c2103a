import re
from collections import Counter

import pytest

from tests.llm.data import frame, rows
from visitstat.llm.host_rules import Rules, beta_prior, host_rules, keep_passing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_equal_a_plain_loop(spark):
    got = host_rules(frame(spark)).collect()
    want = sorted([(r[0] is None, r[0] or 0, *plain(r[1])) for r in rows()])
    assert sorted([(g.doc_id is None, g.doc_id or 0, *g[1:6]) for g in got]) == want
    for g in got:
        assert g.base_failed == (g.n_words < 20 or 100 * g.n_repeat_words > 30 * g.n_words)
        assert g.kept == (not g.base_failed and g.host_ok)


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(40))
    data = [(i, good if i % 20 == 0 else "too short", "en", "bad") for i in range(200)]
    data += [(1000 + i, good, "en", f"ok{i % 9}") for i in range(400)]
    data += [(5000, "too short", "en", "single")]
    verdict = {r.doc_id: r for r in host_rules(frame(spark, data)).collect()}
    assert not verdict[0].kept and not verdict[0].base_failed          # clean, on a bad host
    assert all(verdict[1000 + i].kept for i in range(400))
    # one failure of one document is drawn to the common rate, not taken at its word
    assert verdict[5000].host_rate < 1.0
    kept = keep_passing(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    assert {r.doc_id for r in kept.collect()} == {1000 + i for i in range(400)}


def test_empty_table(spark):
    assert host_rules(frame(spark, [])).collect() == []
    assert keep_passing(frame(spark, [])).collect() == []


def test_prior_of_equal_hosts_is_strong():
    a, b = beta_prior(1000.0, 100.0, 10, 10 * 100.0 ** 2, 10 * 10.0 ** 2 / 100.0)
    assert a / (a + b) == pytest.approx(0.1) and a + b > 1e5


def test_main_path_has_no_python(spark):
    plan = host_rules(frame(spark), Rules())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
