from __future__ import annotations

import itertools
import random
import re

import pytest

from attestry.llm import neardup
from tests.conftest import rows


def plain(recs, t=0.7):
    sets = {i: frozenset(re.findall(r"[^\W_]+", (x or "").lower())) for i, x in recs}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= t * len(x | y) - 1e-12:
            out.add((a, b))
    return sorted(out)


def edited(rng, words, vocab, n):
    w = list(words)
    for _ in range(n):
        k = rng.random()
        i = rng.randrange(len(w))
        if k < 0.35:
            w[i] = rng.choice(vocab)
        elif k < 0.6 and len(w) > 3:
            del w[i]
        elif k < 0.85:
            w.insert(i, rng.choice(vocab))
        else:
            rng.shuffle(w)
    return w


@pytest.mark.parametrize("seed,low,high,postings,limit", [(1, 3, 12, 12.0, 10**9), (2, 15, 30, 1.0, 4), (3, 25, 90, 12.0, 10**9), (4, 1, 5, 100.0, 2), (5, 100, 250, 12.0, 3)])
def test_every_pair_of_random_edits(spark, seed, low, high, postings, limit):
    """With a small ``limit`` nearly every run is frequent, so runs are made longer and lists divided."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    vocab = common * 6 + [f"w{i}" for i in range(150)]
    recs = []
    for g in range(30):
        base = [rng.choice(vocab) for _ in range(rng.randint(low, high))]
        for j in range(rng.randint(1, 4)):
            recs.append((f"r{g:02}-{j}", " ".join(edited(rng, base, vocab, rng.randint(0, max(1, len(base) // 4)))) + rng.choice(["", ".", " !"])))
    recs += [("e1", None), ("e2", ""), ("e3", " ?! "), ("e4", "?")]
    got = rows(neardup.NearDuplicates(spark.createDataFrame(recs, "id string, text string"), postings=postings, limit=limit, every=1).record_pairs())
    assert got == plain(recs)


def test_groups_classes_and_long_texts(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    recs = [("a", "One two three four five six seven eight"), ("b", "eight seven six five four three two one!"), ("c", "one two three four five six seven nine"), ("d", "unlike all else"),
            ("x", long), ("y", long + " more"), ("x", long), ("z", "é É É́ ñandú 42")]
    d = spark.createDataFrame(recs, "id string, text string").selectExpr("*", "1 as cid", "'q' as wset", "2 as key")
    n = neardup.NearDuplicates(d)
    assert rows(n.record_pairs()) == [("a", "b"), ("a", "c"), ("b", "c"), ("x", "y")]
    g = {r.id: r for r in n.groups().collect()}
    assert g["a"].group_id == g["b"].group_id == g["c"].group_id and g["a"].group_size == 3 and g["d"].group_size == 1 and g["d"].links == 0 and g["x"].links == 1
    assert n.members.count() == 7


def test_no_side_is_broadcast(spark):
    d = spark.createDataFrame([(str(i), f"the old boat of w{i} and w{i % 7} came home to the w{i % 5} mill") for i in range(60)], "id string, text string")
    n = neardup.NearDuplicates(d)
    for df in (n.record_pairs(), n.groups()):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows(n.record_pairs()) == plain([tuple(r) for r in d.collect()])


def test_hot_runs_are_divided_evenly():
    """Any two records of a divided list meet in exactly one cell more than not at all, and no cell holds more than two parts."""
    at = {c: {k for k, _ in neardup._divided(12345, 0, c, 7)} for c in range(300)}
    assert all(at[x] & at[y] for x in at for y in at)
    cells = [sum(k in s for s in at.values()) for k in set().union(*at.values())]
    assert len(cells) == 28 and max(cells) < 300 * 2 / 7 * 1.6


def test_bands_join_every_possible_pair():
    for n in range(1, 400):
        for m in range(n, 600):
            if 10 * n >= 7 * m:
                assert set(neardup.bands(n, 7, 10)) & set(neardup.bands(m, 7, 10))
    assert all(len(neardup.bands(n, 7, 10)) <= 2 for n in range(1, 3000))


def test_chain_of_links_is_one_group(spark):
    from attestry.scratch import Scratch

    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    rng.shuffle(chain)
    got = dict(rows(neardup.components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t"))))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and len(got) == 44


def test_empty(spark):
    n = neardup.NearDuplicates(spark.createDataFrame([], "id string, text string"))
    assert n.record_pairs().count() == 0 and n.groups().count() == 0


def test_least_shared_is_exact():
    for a in range(1, 60):
        for b in range(a, 60):
            o = neardup.least_shared(a, b, 7, 10)
            assert o * 17 >= 7 * (a + b) > (o - 1) * 17
