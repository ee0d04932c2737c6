from __future__ import annotations

import random

import numpy as np
import pytest

from attestry.llm.sampling import BalancedSample, flight, quotas
from tests.conftest import rows

T = [("factual", 0.5, 2), ("causal", 0.3, 2), ("contrast", 0.2, 1)]
TS = "category string, target_share double, min_keep int"
QS = "id string, sourceId string, category string"


def test_quotas_keep_minimums_and_size():
    share, least = np.array([0.5, 0.3, 0.2]), np.array([2, 2, 1])
    have = np.array([[100, 100, 100], [1, 100, 100], [1, 1, 1], [0, 0, 0], [3, 2, 100], [2, 2, 1]])
    q = quotas(have, share, least, 10)
    assert np.allclose(q[0], [5, 3, 2]) and q[1][0] == 1 and np.isclose(q[1].sum(), 10)
    assert np.allclose(q[2], 1) and np.allclose(q[3], 0) and np.allclose(q[4], [3, 2, 5]) and np.allclose(q[5], [2, 2, 1])
    assert np.allclose(quotas(have[:1], share, np.array([9, 9, 9]), 10).sum(), 10)
    assert quotas(np.zeros((0, 3)), share, least, 10).shape == (0, 3)


def test_flight_keeps_category_sums_and_probabilities():
    rng = random.Random(1)
    cats = [i % 3 for i in range(60)]
    pi = [[0.12, 0.31, 0.05][c] for c in cats]
    hits = np.zeros(60)
    for _ in range(4000):
        p = flight(list(pi), cats, rng.random, land=False)
        for c in range(3):
            got = sum(x for x, k in zip(p, cats) if k == c)
            assert abs(got - sum(x for x, k in zip(pi, cats) if k == c)) < 1e-6
            assert sum(0 < x < 1 for x, k in zip(p, cats) if k == c) <= 1
        hits += np.array(flight(p, cats, rng.random, land=True))
    assert np.abs(hits / 4000 - np.array(pi)).max() < 0.04


@pytest.mark.parametrize("block,fan", [(10_000, 64), (20, 3)])
def test_sample_of_hot_and_small_sources(spark, block, fan):
    rng = random.Random(2)
    q = [(f"h{i}", rng.choice(["Hot", " hot "]), rng.choice(["factual", "Causal", "contrast ", "odd", None])) for i in range(700)]
    q += [("s1", "small", "factual"), ("s2", "small", "causal"), ("n1", None, "factual"), ("n2", " ", "causal"), (None, "small", "factual"), ("o1", "other", "odd"), ("s1", "small", "factual")]
    d = spark.createDataFrame(q, QS).selectExpr("*", "1 as c", "2 as block", "'z' as source_id")
    b = BalancedSample(d, spark.createDataFrame(T, TS), size=10, block=block, fan=fan)
    got = rows(b.sample)
    assert got == rows(BalancedSample(d, spark.createDataFrame(T, TS), size=10, block=block, fan=fan).sample)
    hot = [c for s, c, _ in got if s == "hot"]
    assert len(hot) == 10 and {c: hot.count(c) for c in hot} == {"factual": 5, "causal": 3, "contrast": 2}
    assert [x for x in got if x[0] == "small"] == [("small", "causal", "s2"), ("small", "factual", "s1")] and len(set(got)) == len(got)
    r = {(x.source_id, x.category): x for x in b.report.collect()}
    assert len(r) == 9 and r["small", "factual"].short and r["small", "factual"].available == 1 and r["other", "causal"].available == 0 and not r["hot", "causal"].short
    assert abs(sum(r["hot", c].imbalance for c in ("factual", "causal", "contrast"))) < 1e-6


def test_crowded_targets_are_reported(spark):
    """Where the wanted counts add up to more than the sample holds, what comes short is reported though the source has enough."""
    t = spark.createDataFrame([("a", 0.9, 0), ("b", 0.1, 4), ("c", 0.0, 4), ("d", 0.0, 2)], TS)
    d = spark.createDataFrame([(f"{c}{i}", "s", c) for c in "abc" for i in range(50)] + [("d0", "s", "d")], QS)
    b = BalancedSample(d, t, size=10)
    r = {x.category: x for x in b.report.collect()}
    assert sum(x.sampled for x in r.values()) == 10 and all(x.short == (x.sampled < x.wanted) for x in r.values())
    assert r["a"].available >= r["a"].wanted == 9 and r["a"].short and r["a"].unmet == "size" and abs(r["a"].imbalance - (r["a"].sampled - 9)) < 1e-6
    assert r["d"].unmet == "supply" and r["d"].sampled == 1 and r["b"].unmet is None and r["c"].unmet is None
    t = spark.createDataFrame([("a", 0.5, 9), ("b", 0.5, 9)], TS)
    r = {x.category: x for x in BalancedSample(d, t, size=10).report.collect()}
    assert {x.sampled for x in r.values()} == {5} and all(x.unmet == "size" and x.short for x in r.values())


def test_fractional_quotas_keep_the_size(spark):
    t = spark.createDataFrame([("a", 1 / 3, 0), ("b", 1 / 3, 0), ("c", 1 / 3, 0)], TS)
    d = spark.createDataFrame([(f"{s}{c}{i}", s, c) for s in ("x", "y", "z") for c in "abc" for i in range(30)], QS)
    b = BalancedSample(d, t, size=10, block=25, fan=2)
    for s in ("x", "y", "z"):
        n = [c for k, c, _ in rows(b.sample) if k == s]
        assert len(n) == 10 and all(3 <= n.count(c) <= 4 for c in "abc")


def test_empty_tables(spark):
    t, none = spark.createDataFrame(T, TS), spark.createDataFrame([], QS)
    b = BalancedSample(none, t)
    assert b.sample.count() == 0 and b.report.count() == 0
    one = spark.createDataFrame([("a", "s", "factual")], QS)
    b = BalancedSample(one, t.where("false"))
    assert b.sample.count() == 0 and b.report.count() == 0
