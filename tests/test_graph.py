from __future__ import annotations

import random

from attestry.operators import graph
from attestry.plans import reference
from tests.conftest import rows


def test_single_ties_and_lone_names_have_communities(spark, tmp_path):
    docs = [(1, "Anna met Bo."), (2, "then Carl and Dora"), (3, "the copper kettle of Louskovald"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    home = dict(rows(reference.QUERIES["graph_communities"][0](spark, str(tmp_path)), "entity", "community"))
    assert home == {"Anna": "Anna", "Bo": "Anna", "Carl": "Carl", "Dora": "Carl", "Louskovald": "Louskovald"}
    hits = reference.QUERIES["graph_search"][0](spark, str(tmp_path))
    assert hits.orderBy("rank").first().id == 3


def test_moves_end_where_none_gains_at_every_size(spark):
    rng = random.Random(5)
    ties = {}
    for _ in range(160):
        a, b = rng.sample(range(40), 2)
        if a % 4 == b % 4 or rng.random() < 0.15:
            ties[min(a, b), max(a, b)] = rng.randint(1, 3)
    e = [(f"n{a:02}", f"n{b:02}", w) for (a, b), w in ties.items()]
    edges = spark.createDataFrame(e, "a string, b string, weight long")
    homes = [dict(rows(graph.communities(edges, least=0.0), "entity", "community"))]

    def quality(home):
        m2 = 2 * sum(w for _, _, w in e)
        total = {}
        for a, b, w in e:
            for x in (a, b):
                total[home[x]] = total.get(home[x], 0) + w
        return 2 * sum(w for a, b, w in e if home[a] == home[b]) / m2 - sum((t / m2) ** 2 for t in total.values())

    q = quality(homes[0])
    assert all(quality(homes[0] | {n: c}) <= q + 1e-9 for n in homes[0] for c in set(homes[0].values()))
    made = spark.createDataFrame(list(homes[0].items()), "entity string, community string")
    planted = {n: str(int(n[1:]) % 4) for n in homes[0]}
    assert abs(graph.modularity(edges, made) - q) < 1e-9 and q >= 0.85 * quality(planted)
    rough = dict(rows(graph.communities(edges, least=0.01), "entity", "community"))
    assert 0.5 * q < quality(rough) <= q + 1e-9


def test_relations_and_deny_list(spark):
    docs = spark.createDataFrame([(1, "The End. Anna met Bo."), (2, "Anna saw Carl"), (3, "Dora")], "id long, text string")
    ents = graph.entities(docs)
    assert "The End" not in {r.entity for r in ents.collect()}
    rel = spark.createDataFrame([("Bo", "owes", "Anna"), ("Anna", "knows", "Dora"), (None, "x", "Anna"), ("Bo", "owes", "Anna")], "subject string, predicate string, object string")
    assert rows(graph.cooccurrence(ents, rel)) == [("Anna", "Bo", 5), ("Anna", "Carl", 1), ("Anna", "Dora", 2)]
    homes = spark.createDataFrame([("Anna", "Anna"), ("Bo", "Anna"), ("Carl", "Anna"), ("Dora", "Dora")], "entity string, community string")
    s = {r.community: r.summary for r in graph.summaries(ents, homes, docs, relations=rel).collect()}
    assert s["Anna"].startswith("Names: Anna, Bo, Carl. Relations: Bo owes Anna. The End.") and s["Dora"] == "Names: Dora. Dora"
