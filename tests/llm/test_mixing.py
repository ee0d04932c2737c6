from __future__ import annotations

from collections import Counter

from attestry.llm import mixing, tokens
from tests.conftest import rows

TS = "source string, target_share double, max_uses int"


def test_rates_copies_and_report(spark):
    docs = [(i, "big" if i % 3 else " Small ", 10) for i in range(900)] + [(1000, None, 50), (1001, "unused", 50), (1002, "big", None), (1003, "big", 0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").selectExpr("*", "9.9 as rate", "'k' as key", "1 as copy")
    t = spark.createDataFrame([("Big", 0.2, 3), ("small", 0.75, 2), ("absent", 0.05, 4), ("small", 0.75, 2), (None, 0.1, 1), ("zero", None, None)], TS)
    r = mixing.rates(d, t)
    by = {x.source: x for x in r.collect()}
    assert set(by) == {"Big", "small", "absent", "zero"} and by["small"].rate == 2.0 and by["small"].short and by["absent"].short and not by["Big"].short and not by["zero"].short
    assert abs(by["Big"].rate - 0.2 * 9100 / 6000) < 1e-12
    m = mixing.mixed(d, r)
    got = m.collect()
    uses = Counter(x.doc_id for x in got)
    assert all(uses[i] == 2 for i in range(0, 900, 3)) and max(uses.values()) == 2 and 1001 not in uses and 1000 not in uses
    n = sum(uses[i] for i in range(900) if i % 3)
    assert abs(n - 600 * by["Big"].rate) < 40
    assert rows(m) == rows(mixing.mixed(d, r)) != rows(mixing.mixed(d, r, seed=7))
    rep = {x.source: x for x in mixing.report(r, m).collect()}
    assert rep["absent"].reached_share == 0 and abs(sum(x.reached_share for x in rep.values()) - 1) < 1e-6 and rep["small"].most_uses == 2


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("a", 0.5, 2)], TS)
    r = mixing.rates(d, t)
    assert rows(r, "source", "rate", "short") == [("a", 0.0, False)] and mixing.mixed(d, r).count() == 0
    assert mixing.rates(d, t.where("false")).count() == 0
    zero = spark.createDataFrame([(1, "a", 0)], "doc_id long, source string, n_tokens long")
    r = mixing.rates(zero, t)
    assert rows(mixing.report(r, mixing.mixed(zero, r)), "reached_share", "short") == [(None, False)]


def test_sizes_of_whole_texts(spark):
    long = "word and wörd 12,5 " * 30_000
    texts = [(1, "Hello there"), (2, None), (3, ""), (4, long), (5, "<|endoftext|>"), (6, " \n\t ")]
    d = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as extra")
    got = dict(rows(tokens.sized(d, "text", ["doc_id"])))
    enc = tokens.encoder(tokens.RANKS, tokens.PATTERN)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in texts} and got[4] > 100_000 and got[5] > 1
