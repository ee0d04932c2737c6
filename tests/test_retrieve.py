from __future__ import annotations

import math
import re

import numpy as np
import pytest

from attestry.operators import graph, metrics, retrieve
from tests.conftest import rows

DOCS = [("d1", "The copper kettle and the kettle of rain"), ("d2", "A rain of letters"), ("d3", "Nothing here"), ("d4", None), ("d5", ""), ("d6", "kettle kettle kettle")]


def test_bm25_against_plain(spark):
    docs = spark.createDataFrame(DOCS, "id string, text string")
    q = spark.createDataFrame([("q", "kettle rain rain the"), ("none", "zzz"), ("null", None)], "query_id string, query string")
    got = {r.id: r.score for r in retrieve.bm25(docs, q).collect()}
    toks = {i: [w for w in re.findall(r"[\w'-]+", (t or "").lower()) if w not in retrieve.STOP_A] for i, t in DOCS}
    avg, n = sum(map(len, toks.values())) / len(toks), len(toks)
    for i, ts in toks.items():
        s = 0.0
        for t in ["kettle", "rain", "rain"]:
            f, df = ts.count(t), sum(t in x for x in toks.values())
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ts) / avg)) if f else 0
        assert math.isclose(got.get(i, 0.0), s, rel_tol=1e-9)
    assert rows(retrieve.top(retrieve.bm25(docs, q), 2, by=["query_id"]), "id", "rank")[0][0] == "d1"


@pytest.mark.parametrize("block", [2, 2048])
def test_dense_is_exact_and_ties_go_by_id(spark, block):
    rng = np.random.default_rng(1)
    v = [(i, rng.normal(size=8).tolist()) for i in range(80)] + [(80, None), (81, [0.0] * 8), (82, [1.0, 2.0]), (83, None)]
    v.append((84, v[3][1]))
    d = spark.createDataFrame(v, "id long, vector array<double>")
    q = d.where("id % 20 = 0 or id = 3").selectExpr("id as query_id", "vector as query_vector")
    got = retrieve.dense(d, q, 5, block=block).collect()
    ok = [(i, np.array(x)) for i, x in v if x is not None and len(x) == 8]
    for qi, qv in ok:
        if qi % 20 == 0 or qi == 3:
            score = lambda x: round(float(qv @ x / max(np.linalg.norm(qv) * np.linalg.norm(x), 1e-300)), 10)
            want = sorted(((-score(x), i) for i, x in ok))[:5]
            assert [r.id for r in sorted((r for r in got if r.query_id == qi), key=lambda r: r.rank)] == [i for _, i in want]
    assert retrieve.dense(d, q.where("false"), 5).count() == 0
    c = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(retrieve.cosine("a", "b").alias("c")).collect()
    assert [round(r.c, 6) for r in c] == [0.707107, 0.0]


def test_fusion_budget_expansion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, id string, rank int")
    f = retrieve.fused(a, b, 3).orderBy("rank").collect()
    assert [r.id for r in f] == ["y", "x", "z"] and math.isclose(f[0].score, 1 / 61 + 1 / 62)
    regions = spark.createDataFrame([("s", 1, "abcd"), ("s", 2, ""), ("s", 3, "efgh"), ("s", 4, "i")], "s string, o int, text string")
    assert rows(retrieve.within_budget(regions, 6, ["s"], ["o"]), "o", "text") == [(1, "abcd"), (3, "ef")]
    docs = spark.createDataFrame([("a", "kettle weather"), ("b", "weather station"), ("c", "station master")], "id string, text string")
    assert {r.id for r in retrieve.expanded(docs, "kettle").collect()} == {"a", "b", "c"}


def test_graph(spark):
    docs = spark.createDataFrame([(1, "Anna Smith met Bo in Rome. Anna Smith left."), (2, "Bo saw Anna Smith"), (3, "Carl and Dora"), (4, "Dora, Carl"), (5, None), (6, "none")], "id long, text string")
    ents = graph.entities(docs)
    assert rows(ents.where("id = 1"), "entity") == [("Anna Smith",), ("Bo",), ("Rome",)]
    rel = spark.createDataFrame([("Rome", "Bo")], "subject string, object string")
    e = {(r.a, r.b): r.weight for r in graph.cooccurrence(ents, rel).collect()}
    assert e == {("Anna Smith", "Bo"): 2, ("Anna Smith", "Rome"): 1, ("Bo", "Rome"): 3, ("Carl", "Dora"): 2}
    edges = graph.cooccurrence(ents)
    for least in (1e-4, 0.0):
        home = dict(rows(graph.communities(edges, least=least)))
        assert home["Carl"] == home["Dora"] != home["Bo"] == home["Anna Smith"]
    homes = graph.communities(edges)
    s = graph.summaries(ents, homes, docs)
    assert s.count() == 2
    hits = graph.graph_scores(ents, homes, s, "where is Carl").orderBy("rank").collect()
    assert {hits[0].id, hits[1].id} == {3, 4} and graph.graph_scores(ents, homes, s, "the").count() == 0


def test_metrics(spark):
    sp = spark.createDataFrame([("s", 0, 5), ("s", 5, 7), ("s", 3, 4), ("s", 9, 12), ("s", 9, 12), ("s", 4, 4), ("s", 8, 2), ("s", None, 3), ("t", 1, 2)], "src string, start long, end long")
    assert rows(metrics.interval_union(sp, ["src"])) == [("s", 0, 7), ("s", 9, 12), ("t", 1, 2)]
    b = spark.createDataFrame([("s", 6, 10), ("s", 0, 7)], "src string, start long, end long")
    for width in (1, 3, 4096):
        o = metrics.overlaps(metrics.interval_union(sp, ["src"]), b, ["src"], width)
        assert sorted(r.shared for r in o.collect()) == [1, 1, 7]
    k = lambda d: d.selectExpr("'q' as q", "*")
    r = metrics.span_scores(k(sp), k(b), ["q"], "src").collect()[0]
    assert (round(r.precision, 6), round(r.recall, 6), r.span_recall) == (round(8 / 11, 6), round(8 / 10, 6), 0.5)
    m, low, high = metrics.bootstrap([1.0, 0.0, 1.0, 1.0], "deadbeef00", 500)
    assert m == 0.75 and low <= m <= high
    d = spark.createDataFrame([("a", float(i % 10)) for i in range(300)], "k string, v double").selectExpr("monotonically_increasing_id() as i", "*")
    x = metrics.bootstrap_rows(d, "v", ["k"]).collect()[0]
    assert x.low < 4.5 < x.high and x.high - x.low < 1.2
    assert metrics.family(spark.createDataFrame([(1, float("nan")), (1, 2.0), (1, None)], "g int, v double"), ["g"], ["v"]).collect()[0].mean_v == 2.0
