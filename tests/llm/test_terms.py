from __future__ import annotations

import random
from collections import Counter

import pytest

from attestry.llm import terms
from tests.conftest import rows


def plain(recs, max_n):
    tf, df = Counter(), Counter()
    for f, ts in recs:
        ts = [t for t in ts or [] if t]
        grams = [(f, " ".join(ts[i : i + n])) for i in range(len(ts)) for n in range(1, (max_n or len(ts)) + 1) if i + n <= len(ts)]
        tf.update(grams)
        df.update(set(grams))
    return sorted((f, g, len(g.split(" ")), tf[f, g], df[f, g]) for f, g in tf)


@pytest.mark.parametrize("max_n", [1, 3, None])
def test_against_plain_counts(spark, max_n):
    rng = random.Random(7)
    recs = [(rng.choice("xy"), [rng.choice("ab" if rng.random() < 0.5 else ["c", "é", "10"]) for _ in range(rng.randint(0, 7))]) for _ in range(120)]
    recs += [("x", ["a", "a", "a", "a"])] * 40 + [("x", None), ("y", [None, "", "b"]), ("x", [])]
    d = spark.createDataFrame(recs, "field string, tokens array<string>").selectExpr("*", "1 as w", "'s' as suffix", "2 as dup")
    assert rows(terms.ngrams(d, max_n=max_n)) == sorted(plain(recs, max_n), key=repr)


def test_long_record_and_empty(spark):
    ts = ["a", "b"] * 2000
    got = dict((r.ngram, (r.occurrences, r.records)) for r in terms.ngrams(spark.createDataFrame([("x", ts)], "field string, tokens array<string>"), max_n=2).collect())
    assert got == {"a": (2000, 1), "b": (2000, 1), "a b": (2000, 1), "b a": (1999, 1)}
    assert terms.ngrams(spark.createDataFrame([], "field string, tokens array<string>")).count() == 0


def test_suffix_array_of_long_records():
    rng = random.Random(3)
    for m, alphabet in ((65, "a"), (300, "ab"), (500, "abcdefgh"), (80, ["x", "xy", "é"])):
        ts = [rng.choice(alphabet) for _ in range(m)]
        order, shared = terms.suffix_array(ts)
        assert order == sorted(range(m), key=lambda i: ts[i:])
        assert shared == [terms.common(ts[order[k - 1] :], ts[i:]) if k else 0 for k, i in enumerate(order)]


def test_reported_depth_of_the_uncut_array(spark):
    rng = random.Random(8)
    recs = [("x", [rng.choice("abcdefghij") for _ in range(m)]) for m in (1500, 5, 90, 0)] + [("x", ["a", "b", "a", "b"])] * 5
    d = spark.createDataFrame(recs, "field string, tokens array<string>")
    assert rows(terms.ngrams(d, max_n=None, report_n=2)) == sorted(plain(recs, 2), key=repr)


def test_marks(spark):
    c = spark.createDataFrame([("x", "a", 2), ("x", "b", 3), ("x", "c", 15), ("x", "d", 16), ("y", "e", 2)], "field string, ngram string, records long")
    n = spark.createDataFrame([("x", 100), ("y", 2)], "field string, n_records long")
    assert rows(terms.marked(c, n), "ngram", "mark") == [("a", "rare"), ("b", None), ("c", None), ("d", "common"), ("e", "rare")]


def test_query_of_ngrams_of_any_length(spark, tmp_path):
    from attestry.llm import queries

    at = "timestamp '2024-01-01 00:00:00'"
    f = spark.createDataFrame([("f1", "one two three four five six seven"), ("f2", "Two three, four"), ("f3", None)], "id string, criterion string")
    f.selectExpr("*", f"{at} as recordedAt").write.parquet(f"{tmp_path}/findings.parquet")
    q = spark.createDataFrame([("q1", "themes")], "id string, category string")
    q.selectExpr("*", f"{at} as recordedAt").write.parquet(f"{tmp_path}/questions.parquet")
    got = rows(queries.QUERIES["p5_all_ngrams"][0](spark, str(tmp_path)))
    assert got == sorted(plain([("criterion", "one two three four five six seven".split()), ("criterion", "two three four".split())], None), key=repr)
