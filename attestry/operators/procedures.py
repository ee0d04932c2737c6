"""The three built-in procedures over facts; their findings are never supported statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry import facts as fx
from attestry import terms
from attestry.plans import conjunctive as cj


def _live(facts: DataFrame) -> DataFrame:
    return facts.where(~F.coalesce(F.col("lifecycle") == "stale", F.lit(False)))


def _finding(kind: str, *parts) -> F.Column:
    return F.concat(F.lit(f"finding_{kind}_"), F.substring(F.sha2(F.concat_ws("\x1e", *parts), 256), 1, 24))


def contradictions(facts: DataFrame) -> DataFrame:
    """(finding_id, left_id, right_id, label, support_state): pairs of the same call with different polarity, the earlier first.

    ``potential_contradiction`` (contested) if the rest of the scope agrees, else ``scope_difference``
    (unresolved).  Rows of equal call, scope and polarity are compared as one side: the pair names the
    first row of each, ``n_left`` and ``n_right`` say how many there are, so nothing grows with the
    square of a call's repetitions.
    """
    side = _live(facts).withColumn("claim", fx.claim_key()).groupBy("expr_key", "claim", "polarity").agg(F.min(F.struct("ord", "id")).alias("f"), F.count(F.lit(1)).alias("n"))
    a = side.select("expr_key", F.col("claim").alias("c1"), F.col("polarity").alias("p1"), F.col("f").alias("f1"), F.col("n").alias("n_left"))
    b = side.select("expr_key", F.col("claim").alias("c2"), F.col("polarity").alias("p2"), F.col("f").alias("f2"), F.col("n").alias("n_right"))
    j = a.join(b, "expr_key").where("p1 <> p2 and f1 < f2")
    same = F.col("c1") == F.col("c2")
    label = F.when(same, "potential_contradiction").otherwise("scope_difference")
    return j.select(_finding("contradiction", F.col("f1.id"), F.col("f2.id")).alias("finding_id"), F.col("f1.id").alias("left_id"), F.col("f2.id").alias("right_id"), "n_left", "n_right",
                    label.alias("label"), F.when(same, "contested").otherwise("unresolved").alias("support_state"))


def relevance(facts: DataFrame, goal: str) -> DataFrame:
    """(finding_id, id, label): rows that a goal matches exactly, usable or not (but not stale)."""
    rows = cj.atom(_live(facts), terms.read(goal), [F.col("id")])
    return rows.select(_finding("relevance", F.lit(goal), F.col("id")).alias("finding_id"), "id", F.lit("exactly_relevant").alias("label"))


def rubric(facts: DataFrame, criteria: list[str]) -> DataFrame:
    """(finding_id, id, criterion, label): every row under every stated criterion."""
    each = F.explode(F.array(*[F.lit(c) for c in criteria]) if criteria else F.array().cast("array<string>")).alias("criterion")
    rows = _live(facts).select("id", each)
    return rows.select(_finding("rubric", F.col("id"), F.col("criterion")).alias("finding_id"), "id", "criterion", F.lit("evidence_for_review").alias("label"))


def apply(facts: DataFrame, procedure: str, goal: str | None = None, criteria: list[str] | None = None) -> DataFrame:
    """The findings of a procedure by name; another name gives one row that says so."""
    if procedure == "contradiction-audit":
        return contradictions(facts)
    if procedure == "relevance-synthesis":
        return relevance(facts, goal)
    if procedure == "document-literary-rubric" or criteria:
        return rubric(facts, criteria or [])
    return facts.sparkSession.createDataFrame([(procedure, "unsupported-procedure")], "procedure string, label string")


def eligible(facts: DataFrame, sources) -> DataFrame:
    """Facts a procedure may read: supported, validated, in scope, resting on such only."""
    from attestry.operators.closure import authorised

    ok = facts.where(fx.usable())
    return ok.join(authorised(ok, sources), "id", "left_semi")
