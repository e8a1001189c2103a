import math
import random
import re

import pytest

from tests.llm.data import frame, prose, rows
from visitstat.llm.mixing import CAP, SIZE_WEIGHT, WEIGHTS, mix, mixed


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > CAP * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = float(CAP * sizes[s])
            left -= target[s]
        free -= over
    return target


def plain_rates(sizes, target):
    """The tilt by bisection."""
    total, mean = sum(sizes), sum(sizes) / len(sizes)
    if target >= CAP * total * (1 - 1e-9):
        return [float(CAP)] * len(sizes)
    rate = lambda tilt: [min(CAP, math.exp(min(tilt * (x / mean) ** (1 - SIZE_WEIGHT), 9))) for x in sizes]
    low, high = -200.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(w * x for w, x in zip(rate(mid), sizes)) < target else (low, mid)
    return rate(low)


def check(got):
    by = {}
    for g in got:
        by.setdefault(g.source, []).append(g)
    target = plain_targets({s: sum(g.size for g in gs) for s, gs in by.items()})
    for s, gs in by.items():
        assert {round(g.target, 6) for g in gs} == {round(target[s], 6)}
        assert {g.source_size for g in gs} == {sum(g.size for g in gs)}
        full = [g for g in gs if g.size > 0]
        for g, w in zip(full, plain_rates([g.size for g in full], target[s]) if full else []):
            assert g.rate == pytest.approx(w, rel=1e-5)
            assert g.taken == g.copies * g.size and 0 <= g.copies <= CAP
        if full:
            assert abs(sum(g.taken for g in gs) - target[s]) <= max(g.size for g in full) / 2 + 1
    return by


def test_targets_rates_and_copies(spark):
    rng = random.Random(3)
    data = [(i, prose(rng, "en", int(rng.lognormvariate(3.5, 0.8)) + 1), "en", f"s{min(i % 9, 4)}") for i in range(500)]
    data += [(1000 + i, prose(rng, "en", 5), "en", "small") for i in range(6)]
    by = check(mix(frame(spark, data)).collect())
    for gs in by.values():            # with many documents the rest is next to nothing
        if len(gs) > 40:
            assert abs(sum(g.taken for g in gs) - gs[0].target) <= 3


def test_odd_rows_and_reruns(spark):
    docs = frame(spark)
    got = mix(docs).drop("tag").collect()
    check(got)
    sizes = sorted((r[0] is None, r[0] or 0, len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows())
    assert sorted((g.doc_id is None, g.doc_id or 0, g.size) for g in got) == sizes
    key = lambda g: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in g)
    assert sorted(map(key, mix(docs).drop("tag").collect())) == sorted(map(key, got))


def test_mixed_repeats_rows_and_keeps_columns(spark):
    docs = frame(spark)
    out = mixed(docs)
    assert out.columns == docs.columns
    plan = mix(docs).collect()
    assert out.count() == sum(g.copies for g in plan)


def test_empty_table(spark):
    assert mix(frame(spark, [])).collect() == []
