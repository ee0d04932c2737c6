"""Answers: authorise, reason, match, classify, collect evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry import terms
from attestry.operators import closure
from attestry.operators.reason import Reasoned, Rule, reason, relevant
from attestry.plans import conjunctive as cj
from attestry.scratch import Scratch


@dataclass
class Answer:
    """state and text of the answer, and tables: ``claims``, ``evidence`` (ids with depth), ``residuals``."""

    state: str
    text: str
    claims: DataFrame
    evidence: DataFrame
    residuals: DataFrame
    reasoned: Reasoned | None


_STATE = {"contested": 2, "supported": 1, "unresolved": 0}


def resolve(facts: DataFrame, goal: str, sources=None, want: dict | None = None, rules: list[Rule] | None = None, regions: DataFrame | None = None, lenient: bool = False) -> Answer:
    """What the facts in the sources' scope say about ``goal``.

    A claim per match: equivalent is supported, contested contested, else unresolved; the answer is
    contested before supported before unresolved.  Text that is no goal is unresolved, with the first
    20 ``regions`` as candidates to read.
    """
    spark = facts.sparkSession
    try:
        g = terms.read(goal)
    except terms.TermError:
        g = None
    if g is None or g.kind not in ("call", "find", "and"):
        none = spark.createDataFrame([], "relation string, support_state string, evidence_ids array<string>")
        ev = regions.orderBy("source_version_id", "ord").limit(20).select(F.col("region_id").alias("id"), F.lit(0).alias("depth")) if regions is not None else spark.createDataFrame([], "id string, depth int")
        return Answer("unresolved", goal, none, ev, spark.createDataFrame([(goal, "no goal can be read from the question")], "goal string, reason string"), None)
    base = facts if sources is None else facts.join(closure.authorised(facts, sources, lenient), "id", "left_semi")
    r = reason(base, relevant(rules or [], g)) if rules else None
    known = r.facts if r else base
    rows = cj.found(known, g, None, want) if g.kind == "find" else cj.matched(known, g, None, want)
    state = F.when(F.col("relation") == "equivalent", "supported").when(F.col("relation") == "contested", "contested").otherwise("unresolved")
    claims = Scratch(spark, "resolve").write(rows.withColumn("support_state", state), "claims")
    states = [x[0] for x in claims.select("support_state").distinct().collect()]  # at most three
    best = max(states, key=_STATE.get, default="unresolved")
    cited = claims.select(F.explode("evidence_ids").alias("id"))
    edges = known.select("id", F.explode("premise_ids").alias("dep"))
    # Evidence is what is cited and, below derived facts, their premises: reached along the edges downwards.
    down = closure.spread(cited, edges.select(F.col("dep").alias("id"), F.col("id").alias("dep")))
    return Answer(best, terms.show(g), claims, down.select("id", F.col("round").alias("depth")), cj.residuals(spark, g, claims), r)
