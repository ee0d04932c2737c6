from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import catalog
from tests.conftest import rows


def test_candidates_need_every_list(spark):
    posted = spark.createDataFrame([("p", 0, "a", "r1"), ("p", 1, "b", "r1"), ("p", 0, "a", "r2"), ("p", 1, "c", "r2"), ("q", 0, "a", "r3")], "pred string, position long, arg string, id string")
    assert rows(catalog.candidates(posted, [("p", 0, "a"), ("p", 1, "b"), ("p", 0, "a")])) == [("r1",)]
    assert rows(catalog.candidates(posted, [("p", 0, "a")])) == [("r1",), ("r2",)] and catalog.candidates(posted, []).count() == 0


def test_pages_versions_duplicates(spark):
    d = spark.createDataFrame([("a", "1.10", "Hi  there"), ("a", "1.9", "hi there "), ("a", None, " "), (None, "2", None), (None, "2", "x")], "k string, v string, t string")
    assert rows(catalog.page(d.select("v").orderBy("v"), [F.col("v").asc_nulls_last()], 1, 2)) == [("1.9",), ("2",)]
    assert rows(catalog.newest(d, ["k"], "v"), "k", "v") == [("a", "1.9"), (None, "2"), (None, "2")]
    assert rows(catalog.duplicates(d, "t")) == [("hi there", 2)]


def test_sentences_and_anchors(spark):
    long = "The old miller of the valley carried his lamp over the bridge."
    s = catalog.sentences(spark.createDataFrame([(1, f"Short one. {long} no capital here at all, however long it may be. {long}"), (2, None), (3, "A" + "b" * 400 + ".")], "doc long, text string"), "doc")
    assert rows(s) == [(1, 0, long), (1, 1, long)]
    d = spark.createDataFrame([("x", i) for i in range(11)] + [("y", 0), ("y", 1)], "g string, i int")
    assert rows(catalog.anchors(d, ["g"], ["i"])) == [("x", 10), ("x", 2), ("x", 5), ("x", 8), ("y", 0), ("y", 1)]


def test_quotes_over_white_space(spark):
    d = spark.createDataFrame([("one  two\n three. four", "two three. four"), ("a.b a+b", "a+b"), ("axb", "a.b"), ("x \\E y", "\\E  y"), ("x", " "), ("x", None), (None, "x")], "t string, q string")
    a, b = catalog.quote_at(F.col("t"), F.col("q"))
    assert [tuple(r) for r in d.select(a.alias("a"), b.alias("b")).collect()] == [(5, 21), (4, 7), (None, None), (2, 6), (None, None), (None, None), (None, None)]


def test_usage_and_roll_up(spark):
    d = spark.createDataFrame([("x", {"a": 1, "b": None}), ("x", {"a": 2}), ("y", {}), ("z", None)], "k string, used map<string,int>")
    assert {r.k: r.used for r in catalog.usage(d, ["k"], "used").collect()} == {"x": {"a": 3, "b": 0}, "y": {}, "z": {}}
    r = spark.createDataFrame([("x", "fine", 1), ("x", "run", 9), ("y", "run", 5), ("y", None, 2), ("z", "fine", None)], "k string, level string, n int")
    assert rows(catalog.rolled_up(r, ["k"], F.col("level") == "fine", "n")) == [("x", 1), ("y", 7), ("z", 0)]


def test_review_problems(spark):
    a = spark.createDataFrame([("1",), ("2",), ("3",), ("3",), (None,)], "id string")
    b = spark.createDataFrame([("1", "ok"), ("1", "ok"), ("9", "?"), (" ", "?"), ("2 ", "ok")], "id string, note string")
    assert rows(catalog.review_problems(a, b)) == [("1", "duplicate"), ("3", "missing"), ("9", "unknown"), (None, "unknown")]
    assert rows(catalog.review_problems(a.where("false"), b.where("false"))) == []


def test_gold_spans_fall_back_and_are_clipped(spark):
    regions = spark.createDataFrame([("r1", "s", 100, 200, "the old lamp of Rome"), ("r2", "s", 200, 9000, "a boat, a boat"), ("r1", "t", 0, 10, "lamp")], "region_id string, source_version_id string, start long, end long, text string")
    gold = [("a", "s", "r1", 150, 250, "x"), ("b", "s", "r1", None, None, None), ("c", "s", None, 190, 8000, None), ("d", "s", "gone", None, None, "boat"), ("e", "s", None, None, None, " "), ("f", "u", "r1", 1, 2, "lamp"), ("g", "s", "r1", 500, 600, None)]
    g = spark.createDataFrame(gold, "gold_id string, source_version_id string, region_id string, start long, end long, quote string")
    assert rows(catalog.gold_spans(g, regions)) == [("a", "r1", 150, 200, "id"), ("b", "r1", 100, 200, "id"), ("c", "r1", 190, 200, "overlap"), ("c", "r2", 200, 8000, "overlap"), ("d", "r2", 202, 206, "quote"), ("g", "r1", 100, 200, "id")]
    assert catalog.gold_spans(g.where("false"), regions).count() == 0 and catalog.gold_spans(g, regions.where("false")).count() == 0
