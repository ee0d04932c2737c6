"""Matching, joining, reasoning and answering, also against a plain row-wise interpreter."""

from __future__ import annotations

import itertools
import random

import pytest

from attestry import facts as fx
from attestry import terms
from attestry.operators import audit, closure, procedures
from attestry.operators.reason import Rule, reason, relevant
from attestry.operators.resolve import resolve
from attestry.plans import conjunctive as cj
from tests.conftest import rows

_COLS = ["id", "ske", "source_version_id", "source_id", "lifecycle", "support_state", "polarity", "time", "modality", "attribution", "world", "dependencies", "ord"]
_SCHEMA = "id string, ske string, source_version_id string, source_id string, lifecycle string, support_state string, polarity string, time string, modality string, attribution string, world string, dependencies array<string>, ord long"


def make(spark, records):
    """Facts from dicts; what isn't given is plain."""
    data = []
    for i, r in enumerate(records):
        r = {"id": f"r{i}", "source_version_id": "s1", "lifecycle": "current", "ord": i} | r
        data.append(tuple(r.get(c) for c in _COLS))
    return fx.facts(fx.parsed(spark.createDataFrame(data, _SCHEMA), "ske"))


def test_constants_repeats_and_types(spark):
    f = make(spark, [{"ske": s} for s in ("(p a a)", "(p a b)", "(p 4 x)", '(p "4" x)', "(p 04 x)", "(q a a)", "no term (", "(p a)", None, "(p ?v a)", "(p (f a) b)")])
    assert rows(cj.matched(f, "(p ?x ?x)"), "id") == [("r0",)]
    assert rows(cj.matched(f, "(p 4 ?y)"), "id") == [("r2",), ("r4",)]
    assert rows(cj.matched(f, '(p "4" ?y)'), "id") == [("r3",)]
    assert rows(cj.matched(f, "(p (f ?x) ?y)"), "v_x", "v_y") == [("a:a", "a:b")]
    assert f.where("id = 'r9'").count() == 0  # variables make no fact
    assert cj.matched(f, "(and (p a a) (p a b))").count() == 0


def test_scope_relations(spark):
    f = make(spark, [
        {"ske": "(p a)"}, {"ske": "(p b)", "time": "2025"}, {"ske": "(p c)", "polarity": "negative"}, {"ske": "(p d)"}, {"ske": "(p d)", "polarity": "negative"},
        {"ske": "(p e)"}, {"ske": "(p e)", "polarity": "negative", "time": "2024"}, {"ske": "(p f)", "lifecycle": "stale"}, {"ske": "(p g)", "support_state": "unresolved"}, {"ske": "(p h)", "attribution": " "}])
    got = dict(rows(cj.matched(f, "(p ?x)"), "id", "relation"))
    assert got == {"r0": "equivalent", "r1": "ambiguous", "r2": "ambiguous", "r3": "contested", "r4": "contested", "r5": "equivalent", "r6": "ambiguous", "r9": "equivalent"}
    asked = dict(rows(cj.matched(f, "(p ?x)", want={"time": "2025"}), "id", "relation"))
    assert asked["r1"] == "equivalent" and asked["r0"] == "ambiguous"
    assert dict(rows(cj.matched(f, "(p c)", want={"polarity": "negative"}), "id", "relation")) == {"r2": "equivalent"}


def test_source_scope_hides_opponents(spark):
    f = make(spark, [{"ske": "(p a)"}, {"ske": "(p a)", "polarity": "negative", "source_version_id": "s2"}])
    assert rows(cj.matched(f, "(p a)"), "relation") == [("contested",), ("contested",)]
    assert rows(cj.matched(f, "(p a)", sources=["s1"]), "relation") == [("equivalent",)]
    assert rows(cj.matched(f, "(p a)", sources=spark.createDataFrame([("s1",)], "id string")), "relation") == [("equivalent",)]


def test_joins_need_one_scope(spark):
    f = make(spark, [{"ske": "(p a b)", "time": "1"}, {"ske": "(q b c)", "time": "2"}, {"ske": "(p d e)", "time": "1"}, {"ske": "(q e f)", "time": "1"}])
    r = cj.found(f, "(find (?x ?z) (and (p ?x ?y) (q ?y ?z)))", want={"time": "1"})
    assert rows(r, "v_x", "v_z", "relation") == [("a:d", "a:f", "equivalent")]


def test_zero_variables_bag_and_residuals(spark):
    f = make(spark, [{"ske": "(p a)"}, {"ske": "(p a)"}])
    assert cj.found(f, "(find () (p a))").count() == 2
    q = "(find (?x) (and (p ?x) (q ?x)))"
    assert rows(cj.residuals(spark, q, cj.found(f, q)), "goal") == [("(p ?x)",), ("(q ?x)",)]
    assert cj.residuals(spark, "(p a)", cj.matched(f, "(p a)")).count() == 0


def plain(records, query):
    """The bindings a row-wise interpreter finds: nested loops over goals with one shared scope."""
    q = terms.read(query)
    out = []
    for combo in itertools.product(records, repeat=len(terms.goals(q.args[0]))):
        if len({(r.get("time"), r.get("polarity", "positive")) for r in combo}) > 1:
            continue
        b = {}
        if all(terms.bind(g, terms.read(r["ske"]), b) is not None for g, r in zip(terms.goals(q.args[0]), combo)):
            out.append(tuple(terms.tagged(b[v]) for v in q.value))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_random_conjunctions_against_interpreter(spark, seed):
    rng = random.Random(seed)
    recs = [{"ske": f"({rng.choice('pq')} {rng.choice('abc')} {rng.choice(['a', 'b', '1', '(f a)'])})", "time": rng.choice([None, "t"]), "polarity": rng.choice(["positive", "negative"])} for _ in range(24)]
    goals = " ".join(f"({rng.choice('pq')} {rng.choice(['?x', '?y', 'a'])} {rng.choice(['?x', '?y', '?z', '(f ?w)'])})" for _ in range(2))
    used = sorted(terms.read(f"(and {goals})").variables())
    query = f"(find ({' '.join('?' + v for v in used)}) (and {goals}))"
    got = cj.found(make(spark, recs), query)
    assert sorted(tuple(r[f"v_{v}"] for v in used) for r in got.collect()) == plain(recs, query)


def test_reasoning_reaches_and_proves(spark):
    f = make(spark, [{"ske": f"(edge n{i} n{i + 1})"} for i in range(6)] + [{"ske": "(edge n6 n0)", "time": "other"}])
    rules = [Rule.read("base", ["(edge ?a ?b)"], "(path ?a ?b)"), Rule.read("step", ["(path ?a ?b)", "(edge ?b ?c)"], "(path ?a ?c)"), Rule.read("idle", ["(none ?a)"], "(other ?a)")]
    assert [r.id for r in relevant(rules, terms.read("(path n0 ?x)"))] == ["base", "step"]
    r = reason(f, rules, max_facts=None)
    assert r.complete and r.derived.count() == 21 + 1
    far = r.derived.where("expr_key = '(path n0 n6)'").collect()[0]
    assert sorted(far.dependencies) == [f"r{i}" for i in range(6)] and len(far.premise_ids) == 2
    cut = reason(f, rules, max_rounds=2, max_facts=None)
    assert not cut.complete and cut.derived.count() < 22
    with pytest.raises(ValueError):
        Rule.read("bad", ["(p ?x)"], "(q ?y)")


def test_cyclic_rules_end_and_nested_conclusions(spark):
    f = make(spark, [{"ske": "(sym a b)"}, {"ske": "(sym b c)"}])
    r = reason(f, [Rule.read("flip", ["(sym ?x ?y)"], "(sym ?y ?x)"), Rule.read("wrap", ["(sym a ?y)"], '(says (f ?y) "lit")')])
    assert r.complete
    assert {x[0] for x in r.derived.select("expr_key").collect()} == {"(sym b a)", "(sym c b)", '(says (f b) "lit")'}
    assert terms.call_of('(says (f b) "lit")') is not None


def test_resolve_states(spark):
    f = make(spark, [{"ske": "(bird t)"}, {"ske": "(flies t)", "polarity": "negative"}, {"ske": "(p a)"}])
    rule = Rule.read("fly", ["(bird ?x)"], "(flies ?x)")
    assert resolve(f, "(flies t)", rules=[rule]).state == "contested"
    a = resolve(f, "(p a)")
    assert (a.state, a.residuals.count(), a.evidence.count()) == ("supported", 0, 1)
    assert resolve(f, "(p zzz)").state == "unresolved" and resolve(f, "who did it?").state == "unresolved"
    deep = resolve(f.where("id = 'r0'"), "(flies t)", rules=[rule])
    assert deep.state == "supported" and sorted(x[1] for x in deep.evidence.collect()) == [0, 1]


def test_authorisation_and_staleness(spark):
    recs = [{"ske": "(p a)"}, {"ske": "(p b)", "source_version_id": "s2"}, {"ske": "(p c)", "dependencies": ["r0"]}, {"ske": "(p d)", "dependencies": ["r0", "r1"]}, {"ske": "(p e)", "dependencies": ["r2", "r2"]},
            {"ske": "(p f)", "dependencies": ["r6"]}, {"ske": "(p g)", "dependencies": ["r5"]}, {"ske": "(p h)", "dependencies": ["gone"]}]
    f = make(spark, recs)
    assert rows(closure.authorised(f, ["s1"])) == [("r0",), ("r2",), ("r4",)]
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert dict(rows(closure.stale(f, one("s2"), one("r0")))) == {"r1": "source-version-updated", "r2": "dependency-invalidated", "r3": "dependency-invalidated", "r4": "dependency-invalidated"}
    assert rows(closure.cyclic(f.selectExpr("id", "explode(dependencies) as dep"))) == [("r5",), ("r6",)]
    assert closure.stale(f, one(), one()).count() == 0


def test_procedures(spark):
    f = make(spark, [{"ske": "(p a)"}, {"ske": "(p a)", "polarity": "negative"}, {"ske": "(p a)", "polarity": "negative", "time": "2"}, {"ske": "(p b)", "lifecycle": "stale"}, {"ske": "(p c)", "lifecycle": "staged"}])
    got = rows(procedures.apply(f, "contradiction-audit"), "left_id", "right_id", "label", "support_state")
    assert got == [("r0", "r1", "potential_contradiction", "contested"), ("r0", "r2", "scope_difference", "unresolved")]
    assert rows(procedures.apply(f, "relevance-synthesis", goal="(p ?x)"), "id") == [("r0",), ("r1",), ("r2",), ("r4",)]
    assert procedures.apply(f, "document-literary-rubric", criteria=["x", "y"]).select("finding_id").distinct().count() == 8
    assert procedures.apply(f, "unheard-of").collect()[0].label == "unsupported-procedure"


def test_evidence_audit(spark):
    f = make(spark, [{"ske": "(p a)"}, {"ske": "(p b)", "lifecycle": "stale"}, {"ske": "(p c)", "source_version_id": "s2"}])
    regions = spark.createDataFrame([("s1", "g1", "here is a quote")], "source_version_id string, region_id string, text string")
    ev = spark.createDataFrame([("e0", "r0", "s1", "g1", "a quote", "(p a)"), ("e1", "r1", "s1", "g1", "a quote", "(p b)"), ("e2", "r2", "s2", "g9", "x", "(p c)"), ("e3", "r9", "s1", "g1", "q", "(p z)"), ("e4", "r0", "s1", "g1", "other", "(p q)"), ("e5", "r0", "s1", "g1", None, "(p a)")],
                               "id string, record_id string, source_version_id string, region_id string, quote string, expr_key string")
    v = audit.evidence_violations(ev, f, regions, sources=["s1"])
    assert rows(v) == [("e1", "stale or unusable record"), ("e2", "out of scope"), ("e2", "region not found"), ("e3", "missing record"), ("e4", "expression differs"), ("e4", "quote not in region"), ("e5", "quote not in region")]
    claims = spark.createDataFrame([("c0", "(p a)", "supported", ["e0"]), ("c1", "", "supported", []), ("c2", "(p a)", "supported", ["e4"]), ("c3", None, "unresolved", None)], "id string, goal string, support_state string, evidence_ids array<string>")
    assert rows(audit.claim_violations(claims, v)) == [("c1", "supported without evidence"), ("c1", "supported without goal"), ("c2", "supported by unsound evidence")]


def _cases():
    """An independent set of small cases per family: (records, rules, goal, want, sources, expected)."""
    edge = [Rule.read("base", ["(edge ?a ?b)"], "(path ?a ?b)"), Rule.read("step", ["(path ?a ?b)", "(edge ?b ?c)"], "(path ?a ?c)")]
    for k in range(2, 6):
        chain = [{"ske": f"(edge c{i} c{i + 1})"} for i in range(k)] + [{"ske": "(edge x y)"}]
        yield f"multihop-{k}", chain, edge, f"(path c0 c{k})", None, None, "supported"
        yield f"multihop-gap-{k}", chain[1:], edge, f"(path c0 c{k})", None, None, "unresolved"
        premises = " ".join(f"(q{i} ?x)" for i in range(k))
        every = [{"ske": f"(q{i} a)"} for i in range(k)]
        yield f"join-{k}", every + [{"ske": "(q0 b)"}], [], f"(find (?x) (and {premises}))", None, None, "supported"
        yield f"missing-{k}", every[1:] + [{"ske": "(q0 b)"}], [], f"(find (?x) (and {premises}))", None, None, "unresolved"
    for dim, val in (("time", "2025"), ("modality", "reported"), ("attribution", "narrator"), ("world", "dream"), ("polarity", "negative")):
        yield f"aligned-{dim}", [{"ske": "(p a)", dim: val}], [], "(p a)", {dim: val}, None, "supported"
        yield f"misaligned-{dim}", [{"ske": "(p a)", dim: val}], [], "(p a)", {}, None, "unresolved"
    yield "opposition", [{"ske": "(p a)"}, {"ske": "(p a)", "polarity": "negative"}], [], "(p a)", None, None, "contested"
    yield "revision", [{"ske": "(p a)", "time": "1"}, {"ske": "(p a)", "polarity": "negative", "time": "2"}], [], "(p a)", {"time": "1"}, None, "supported"
    yield "exception", [{"ske": "(bird a)"}, {"ske": "(flies a)", "polarity": "negative"}], [Rule.read("r", ["(bird ?x)"], "(flies ?x)")], "(flies a)", None, None, "contested"
    for life in ("stale", "staged", "retracted", "superseded"):
        yield f"life-{life}", [{"ske": "(p a)", "lifecycle": life}], [], "(p a)", None, None, "unresolved"
    yield "foreign", [{"ske": "(p a)", "source_version_id": "s2"}], [], "(p a)", None, ["s1"], "unresolved"
    yield "roles", [{"ske": "(gave a b)"}], [], "(gave b a)", None, None, "unresolved"


@pytest.mark.parametrize("case", list(_cases()), ids=lambda c: c[0])
def test_families(spark, case):
    _, records, rules, goal, want, sources, expected = case
    assert resolve(make(spark, records), goal, sources, want, rules).state == expected


def test_goals_are_joined_where_they_share_variables(spark):
    body = terms.goals(terms.read("(find (?x) (and (a ?x) (b ?y) (c ?x ?y) (d 1 ?z)))").args[0])
    assert cj.linked(body) == [3, 0, 2, 1]
    said = [("r1", "(a p)"), ("r2", "(a q)"), ("r3", "(b u)"), ("r4", "(b v)"), ("r5", "(c p u)"), ("r6", "(c q w)"), ("r7", "(d 1 k)"), ("r8", "(d 2 k)"), ("r9", "(d 1 m)")]
    f = make(spark, [{"id": i, "ske": s} for i, s in said])
    got = sorted((r.v_x, r.v_z) for r in cj.found(f, "(find (?x ?z) (and (a ?x) (b ?y) (c ?x ?y) (d 1 ?z)))").collect())
    assert got == [("a:p", "a:k"), ("a:p", "a:m")]
    assert cj.found(f, "(find (?x ?y) (and (a ?x) (b ?y)))").count() == 4
