from __future__ import annotations

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import packing
from tests.conftest import rows


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_plan_covers_the_histogram(h):
    left = Counter()
    for c, r in packing.plan(h, 64, 3):
        assert r > 0 and sum(s * k for s, k in c.items()) <= 64
        for s, k in c.items():
            left[s] += k * r
    assert left == Counter(h)


def test_plan_leaves_little_space():
    rng = np.random.default_rng(0)
    h = Counter(np.clip(rng.lognormal(5, 0.8, 50_000).astype(int), 1, 4096).tolist())
    total = sum(s * n for s, n in h.items())
    bins = sum(r for _, r in packing.plan(h))
    assert total / (bins * 4096) > 0.995
    half = {2049: 10, 2047: 10}
    assert sum(r for _, r in packing.plan(half)) == 10


def test_solver_is_non_negative_least_squares():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, (12, 20)).astype(float)
    x = np.maximum(rng.normal(size=20), 0)
    r, c = np.nonzero(a)
    got = packing.nnls(r, c, a[r, c], a @ x, 20, 5000)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 0.05


def test_items_are_packed_once_and_only_large_ones_split(spark):
    rng = np.random.default_rng(3)
    sizes = [(i, int(n)) for i, n in enumerate(rng.integers(0, 130, 3000))] + [(9000, 250), (9001, 100), (9002, 200), (9003, None), (9004, 0), (9005, -5)]
    d = spark.createDataFrame(sizes, "doc_id long, n_tokens long").selectExpr("*", "1 as piece", "2 as len", "3 as item")
    p = packing.packed(d, capacity=100, per_group=7)
    got = p.collect()
    per = Counter()
    for r in got:
        if r.container is not None:
            per[r.container] += r.piece_tokens
    assert max(per.values()) <= 100 and set(per) == set(range(len(per)))
    want = {i: max(n or 0, 0) for i, n in sizes}
    have = Counter()
    for r in got:
        have[r.doc_id] += r.piece_tokens
    assert {i: have[i] for i in want} == want and {r.doc_id for r in got} == set(want)
    split = {r.doc_id for r in got if r.n_pieces > 1}
    assert split == {i for i, n in want.items() if n > 100}
    assert [(r.piece, r.piece_tokens) for r in sorted((r for r in got if r.doc_id == 9000), key=lambda r: r.piece)] == [(0, 100), (1, 100), (2, 50)]
    f = packing.fill(p, 100).collect()[0]
    assert f.containers == len(per) and f.used_share > 0.98
    assert rows(packing.packed(d.where("doc_id = 9004"), capacity=100)) == [(9004, 0, 1, 0, None)]
    assert packing.packed(d.where("false"), capacity=100).count() == 0
