from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from attestry import facts as fx
from attestry import terms
from attestry.operators import scan
from attestry.plans.controlled import evaluated
from tests.conftest import rows


def test_scans_over_hot_and_null_groups(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.randint(-5, 5)) for i in range(400)]
    rng.shuffle(data)
    d = spark.createDataFrame(data, "g string, i int, v int")
    p = scan.spread(d, ["g"], ["i"], parts=7)
    assert p.select("_part").distinct().count() == 7
    got = {r.i: r for r in scan.neighbours(scan.running(scan.running(scan.rank(p, ["g"], ["i"]), ["g"], ["i"], F.col("v"), "total"), ["g"], ["i"], F.col("v"), "top", "max"), ["g"], ["i"], "v").collect()}
    assert len(got) == 400
    for g in ("hot", "a", "b", None):
        own = sorted((i, v) for x, i, v in data if x == g)
        for n, (i, v) in enumerate(own):
            r, before = got[i], [x for _, x in own[:n]]
            assert (r.rank, r.total, r.top) == (n + 1, sum(before) if before else None, max(before, default=None))
            assert (r.before, r.after) == (own[n - 1][1] if n else None, own[n + 1][1] if n + 1 < len(own) else None)
    assert scan.rank(scan.spread(d.where("false"), ["g"], ["i"]), ["g"], ["i"]).count() == 0


def plain(goal, recs, scope, want):
    """State of one case by nested loops."""
    try:
        t = terms.read(goal)
    except terms.TermError:
        return "unresolved"
    live = [r for r in recs if r["lifecycle"] == "current" and (scope is None or r["src"] in scope)]
    states = []
    for combo in itertools.product(live, repeat=len(terms.goals(t.args[0] if t.kind == "find" else t))):
        b = {}
        if len({r["pol"] for r in combo}) > 1 or any(terms.bind(g, terms.read(r["ske"]), b) is None for g, r in zip(terms.goals(t.args[0] if t.kind == "find" else t), combo)):
            continue
        if any(o["ske"] == r["ske"] and o["pol"] != r["pol"] for r in combo for o in live):
            states.append(2)
        elif all((want["polarity"] in (None, r["pol"])) and (r["pol"] == "positive" or want["polarity"] == "negative") and want["time"] is None for r in combo):
            states.append(1)
        else:
            states.append(0)
    return ["unresolved", "supported", "contested"][max(states, default=0)]


def test_batch_of_cases_against_plain(spark):
    rng = random.Random(9)
    cases, recs, want = [], [], {}
    goals = ["(p a ?x)", "(find (?x) (and (p a ?x) (p ?x b)))", "(p a b)", "(find (?x ?y) (and (p ?x ?y) (q ?y ?x) (p ?y ?y)))", "(p ?x ?x)", "broken (", "(find (?x) (q ?x 4))"]
    for n in range(40):
        own = [{"src": rng.choice("st"), "lifecycle": rng.choice(["current"] * 4 + ["stale"]), "pol": rng.choice(["positive"] * 4 + ["negative"]), "ske": f"({rng.choice('pppq')} {rng.choice('abc')} {rng.choice(['a', 'b', 'c', '4'])})"} for _ in range(rng.randint(0, 7))]
        scope, w = rng.choice([None, ["s"], ["s", "t"]]), {"time": rng.choice([None, None, "1"]), "polarity": rng.choice([None, "positive", "negative"])}
        goal = rng.choice(goals)
        cases.append((f"c{n}", goal, scope, (w["time"], None, None, w["polarity"], None)))
        recs += [(f"c{n}", f"r{i}", r["ske"], r["src"], r["lifecycle"], r["pol"]) for i, r in enumerate(own)]
        want[f"c{n}"] = plain(goal, own, scope, w)
    c = spark.createDataFrame(cases, "case_id string, goal string, scope array<string>, want struct<time string, modality string, attribution string, polarity string, world string>")
    r = spark.createDataFrame(recs, "case_id string, id string, ske string, source_version_id string, lifecycle string, polarity string")
    f = fx.parsed(r, "ske")
    base = fx.facts(f.withColumn("id", F.concat_ws("|", "case_id", "id"))).withColumn("case_id", F.split("id", r"\|")[0])
    assert dict(rows(evaluated(c, base), "case_id", "state")) == want
