"""Forward chaining to a fixpoint, semi-naive: each round joins only what the last round added.

Rules are few and live on the driver; facts stay in tables.  A round's conclusions are written, so
lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import facts as fx
from attestry import terms
from attestry.plans import conjunctive as cj
from attestry.scratch import Scratch
from attestry.terms import Term


@dataclass(frozen=True)
class Rule:
    id: str
    premises: tuple[Term, ...]
    conclusion: Term
    version: str = "1"

    @staticmethod
    def read(id: str, premises: list[str], conclusion: str, version: str = "1") -> "Rule":
        """A rule whose conclusion uses only what its premises bind; ValueError else."""
        r = Rule(id, tuple(terms.read(p) for p in premises), terms.read(conclusion), version)
        bound = set().union(*(p.variables() for p in r.premises)) if r.premises else set()
        if not r.premises or r.conclusion.kind != "call" or r.conclusion.variables() - bound:
            raise ValueError(f"rule {id} concludes what its premises don't bind")
        return r


def relevant(rules: list[Rule], goal: Term) -> list[Rule]:
    """The rules that can reach a predicate of the goal, directly or through other rules."""
    body = goal.args[0] if goal.kind == "find" else goal
    wanted, kept = {g.value for g in terms.goals(body)}, []
    grew = True
    while grew:
        grew = False
        for r in rules:
            if r not in kept and r.conclusion.value in wanted:
                kept.append(r)
                wanted |= {p.value for p in r.premises}
                grew = True
    return [r for r in rules if r in kept]


def _text(t: Term) -> Column:
    """The print of a term with variables replaced by the columns' values."""
    if t.kind == "variable":
        return F.substring(F.col(cj.var(t.value)), 3, 1 << 30)
    if t.kind in ("call", "and"):
        parts = [F.lit("and" if t.kind == "and" else t.value), *map(_text, t.args)]
        return F.concat(F.lit("("), F.concat_ws(" ", *parts), F.lit(")"))
    return F.lit(terms.show(t))


def _argument(t: Term) -> Column:
    if t.kind == "variable":
        return F.col(cj.var(t.value))
    return F.lit(terms.tagged(t)) if t.ground else F.concat(F.lit("c:"), _text(t))


_CARRIED = ["id", "ord", "pred", "arity", "args", "expr_key", "scope_key", "bases", *fx.SCOPE]


def _fire(rule: Rule, rank: int, parts: list[DataFrame]) -> DataFrame:
    """Conclusions of one rule from one choice of tables per premise."""
    joined = []
    for i, (g, df) in enumerate(zip(rule.premises, parts)):
        keep = [F.col("scope_key"), F.col("id").alias(f"id_{i}"), F.col("ord").alias(f"ord_{i}")]
        if i == 0:
            keep += [F.col(d) for d in fx.SCOPE]
        joined.append(cj.atom(df, g, keep))
    rows = reduce(lambda a, b: a.join(b, ["scope_key", *sorted(set(a.columns) & set(b.columns) - {"scope_key"})]), joined)
    n, c = range(len(rule.premises)), rule.conclusion
    args = F.array(*map(_argument, c.args)) if c.args else F.array().cast("array<string>")
    return rows.select(
        F.lit(c.value).alias("pred"), F.lit(len(c.args)).alias("arity"), args.alias("args"), _text(c).alias("expr_key"), "scope_key", *fx.SCOPE,
        F.array(*[F.col(f"id_{i}") for i in n]).alias("premise_ids"),
        F.lit(rule.id).alias("rule_id"), F.lit(rule.version).alias("rule_version"), F.struct(F.lit(rank), F.array(*[F.col(f"ord_{i}") for i in n])).alias("_proof"))


@dataclass
class Reasoned:
    """``facts`` (base and derived, in the layout of ``attestry.facts``), ``rounds`` and whether nothing more follows."""

    facts: DataFrame
    derived: DataFrame
    rounds: int
    complete: bool


def reason(base: DataFrame, rules: list[Rule], max_rounds: int = 20, max_facts: int | None = 1000, bases: bool = True) -> Reasoned:
    """All that follows from the usable ``base`` facts.

    All premises of a proof stand in one scope, which the conclusion takes over.  A call in a scope is
    concluded once, with its first proof (earliest round, then rule, then premises in order).  Derived
    facts name their premises and the base facts they rest on; a base fact that names none rests on
    itself (without ``bases`` they name their premises only, which long chains of rules make far
    smaller).  At most ``max_rounds`` (1 to 100) rounds and ``max_facts`` derived facts (null: as many as
    follow); if either ends the work, ``complete`` is false and the facts of the last round are whole.
    """
    scratch = Scratch(base.sparkSession, "reason")
    max_rounds = min(100, max(1, max_rounds))
    preds = sorted({p.value for r in rules for p in r.premises} | {r.conclusion.value for r in rules})
    rest = F.when(F.size("dependencies") > 0, F.col("dependencies")).otherwise(F.array("id")) if bases else F.lit(None).cast("array<string>")
    known = base.where(fx.usable()).where(F.col("pred").isin(preds)).withColumn("scope_key", fx.scope_key()).withColumn("bases", rest).select(*_CARRIED)
    known = scratch.write(known, "known_0")
    delta, derived, total, n, complete = known, None, 0, 0, not rules
    while not complete and n < max_rounds:
        n += 1
        fired = []
        for rank, r in enumerate(rules):
            # Position i takes the new facts, those before it the old ones, those after it all: every new proof once.
            for i in range(len(r.premises)):
                if n == 1 and i:
                    break
                parts = [known if j > i else (delta if j == i else old) for j in range(len(r.premises))] if n > 1 else [known] * len(r.premises)
                fired.append(_fire(r, rank, parts))
        # What is known goes out first; the join has then placed the rest as the choice of first proofs needs it.
        every = reduce(DataFrame.unionByName, fired).join(known.select("expr_key", "scope_key"), ["expr_key", "scope_key"], "left_anti")
        first = every.groupBy("expr_key", "scope_key").agg(F.min_by(F.struct(*[c for c in every.columns if c not in ("expr_key", "scope_key")]), "_proof").alias("p"))
        new = first.select("expr_key", "scope_key", "p.*")
        ident = F.concat(F.lit("drv_"), F.substring(F.sha2(F.concat_ws("\x1e", "expr_key", "scope_key"), 256), 1, 24))
        order = F.xxhash64("expr_key", "scope_key").bitwiseAND(F.lit((1 << 44) - 1)) + F.lit((1 << 62) + (n << 46))
        new = new.withColumn("id", ident).withColumn("ord", order).drop("_proof")
        if bases:
            # What a conclusion rests on is looked up for its first proof only; proofs in the making stay narrow.
            new = scratch.write(new, f"first_{n}")
            rests = new.select("id", F.explode("premise_ids").alias("p")).join(known.select(F.col("id").alias("p"), "bases"), "p")
            new = new.join(rests.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("bases"))).alias("bases")), "id")
        else:
            new = new.withColumn("bases", F.lit(None).cast("array<string>"))
        new = scratch.write(new, f"new_{n}")
        count = new.count()
        if not count:
            complete = True
            break
        total += count
        derived = new if derived is None else derived.unionByName(new)
        old, delta = known, new.select(*_CARRIED)
        known = known.unionByName(delta)
        if max_facts is not None and total >= max_facts:
            break
    if derived is None:
        extra = base.where("false")
    else:
        extra = fx.facts(derived.withColumn("dependencies", F.col("bases")).withColumn("lifecycle", F.lit("current")).withColumn("support_state", F.lit("supported"))
                         .withColumn("validation", F.lit("rule-replayed")).withColumn("origin", F.lit("explicit-derivation")))
    return Reasoned(base.unionByName(extra), extra, n, complete)
