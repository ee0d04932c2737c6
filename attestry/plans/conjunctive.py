"""Goals compiled to DataFrame plans: constants become filters, shared variables join keys.

The query is read once on the driver; rows never pass through Python, except arguments that are
patterns nested inside a call.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import facts as fx
from attestry import terms
from attestry.terms import Term


def var(name: str) -> str:
    """The column of a variable."""
    return f"v_{name}"


def _nested(pattern: Term, names: list[str]):
    @F.pandas_udf("array<string>")
    def bound(args: pd.Series) -> pd.Series:
        def one(x):
            b = terms.bind(pattern, terms.untagged(x)) if x and x[0] == "c" else None
            return None if b is None else [terms.tagged(b[n]) for n in names]

        return args.map(one)

    return bound


def atom(df: DataFrame, goal: Term, keep: list[Column]) -> DataFrame:
    """The facts that ``goal`` matches: one column per variable, and ``keep``."""
    if goal.kind != "call":
        return df.where("false").select(*keep)
    rows = df.where((F.col("pred") == goal.value) & (F.col("arity") == len(goal.args)))
    seen: dict[str, Column] = {}

    def meet(name: str, c: Column) -> Column | None:
        if name in seen:
            return seen[name] == c
        seen[name] = c
        return None

    for i, a in enumerate(goal.args):
        c = F.get("args", F.lit(i))
        if a.kind == "variable":
            test = meet(a.value, c)
            rows = rows.where(test) if test is not None else rows
        elif a.ground:
            rows = rows.where(c == terms.tagged(a))
        else:
            names = sorted(a.variables())
            rows = rows.withColumn(f"_n{i}", _nested(a, names)(c)).where(F.col(f"_n{i}").isNotNull())
            for k, n in enumerate(names):
                test = meet(n, F.col(f"_n{i}")[k])
                rows = rows.where(test) if test is not None else rows
    return rows.select(*[c.alias(var(n)) for n, c in seen.items()], *keep)


def prepared(df: DataFrame, sources=None, want: dict | None = None) -> DataFrame:
    """Usable facts in the sources' scope, with scope_key, aligned, qualified and opponent_id."""
    base = fx.in_sources(sources, df).where(fx.usable())
    opp = fx.opponents(base)
    base = base.withColumn("claim", fx.claim_key()).withColumn("scope_key", fx.scope_key()).withColumn("aligned", fx.aligned(want)).withColumn("qualified", fx.qualified(want))
    return base.join(opp, ["expr_key", "claim", "polarity"], "left")


def matched(df: DataFrame, goal: Term | str, sources=None, want: dict | None = None) -> DataFrame:
    """Every fact a single goal matches: variables, id, evidence_ids, relation and its scope.

    relation is ``contested`` if the same call is stated with another polarity in the same scope,
    else ``equivalent`` if all that was asked is met and nothing else is qualified, else ``ambiguous``.
    A conjunction outside a query matches nothing.
    """
    goal = terms.read(goal) if isinstance(goal, str) else goal
    if goal.kind == "find":
        return found(df, goal, sources, want)
    # Filter by predicate first: the opposition is only looked up among statements of the same predicate.
    base = df.where((F.col("pred") == goal.value) & (F.col("arity") == len(goal.args))) if goal.kind == "call" else df.where("false")
    rel = F.when(F.col("opponent_id").isNotNull(), "contested").when(F.col("aligned") & ~F.col("qualified"), "equivalent").otherwise("ambiguous")
    keep = [F.col("id"), F.array_compact(F.array("id", "opponent_id")).alias("evidence_ids"), rel.alias("relation"), *[F.col(d) for d in fx.SCOPE]]
    return atom(prepared(base, sources, want), goal, keep)


def linked(body: tuple[Term, ...]) -> list[int]:
    """The order in which goals are joined: always one that shares most variables with those before it, constants breaking ties.

    A conjunction has the same rows in any order; this one puts off products until nothing else is left.
    """
    names = [g.variables() if g.kind == "call" else set() for g in body]
    fixed = [sum(a.ground for a in g.args) if g.kind == "call" else 0 for g in body]
    left, out, met = list(range(len(body))), [], set()
    while left:
        i = max(left, key=lambda j: (len(names[j] & met), fixed[j], -j))
        out.append(i)
        left.remove(i)
        met |= names[i]
    return out


#: Cells a side of a join without shared variables.
CELLS = 8


def joined(df: DataFrame, body: tuple[Term, ...]) -> DataFrame:
    """The conjunction of ``body`` over prepared facts: variables and, per goal i, id_i, opp_i, qual_i, al_i, ord_i; scope_key of all.

    Goals join on the variables they share and on the scope.  Goals that share none still join on the
    scope, never as a bare cross join, and as nearly all facts may stand in one scope, both sides are
    spread over the cells of a grid: each pair of facts meets in one of them.
    """
    parts = {}
    for i, g in enumerate(body):
        keep = [F.col("scope_key"), F.col("id").alias(f"id_{i}"), F.col("ord").alias(f"ord_{i}"), F.col("opponent_id").alias(f"opp_{i}"), F.col("qualified").alias(f"qual_{i}"), F.col("aligned").alias(f"al_{i}")]
        parts[i] = atom(df, g, keep)
    order = linked(body)
    rows, met = parts[order[0]], [order[0]]
    for i in order[1:]:
        shared = sorted(set(rows.columns) & set(parts[i].columns) - {"scope_key"})
        if shared:
            rows = rows.join(parts[i], ["scope_key", *shared])
        else:
            every = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))
            left = rows.withColumn("_x", F.pmod(F.xxhash64(*[f"id_{j}" for j in met]), F.lit(CELLS)).cast("int")).withColumn("_y", every)
            right = parts[i].withColumn("_y", F.pmod(F.xxhash64(f"id_{i}"), F.lit(CELLS)).cast("int")).withColumn("_x", every)
            rows = left.join(right, ["scope_key", "_x", "_y"]).drop("_x", "_y")
        met.append(i)
    return rows


def found(df: DataFrame, query: Term | str, sources=None, want: dict | None = None) -> DataFrame:
    """The rows of a query ``(find (?x ...) body)``: a column per variable asked for, evidence_ids and relation.

    All premises of a row stand in one scope.  Rows are a bag: the same bindings come once per proof.
    A variable that the body doesn't bind gives no column.
    """
    query = terms.read(query) if isinstance(query, str) else query
    body = terms.goals(query.args[0])
    preds = sorted({g.value for g in body if g.kind == "call"})
    rows = joined(prepared(df.where(F.col("pred").isin(preds)), sources, want), body)
    n = range(len(body))
    opp = F.array_compact(F.array(*[F.col(f"opp_{i}") for i in n]))
    any_qual = reduce(lambda a, b: a | b, [F.col(f"qual_{i}") for i in n])
    all_al = reduce(lambda a, b: a & b, [F.col(f"al_{i}") for i in n])
    rel = F.when(F.size(opp) > 0, "contested").when(any_qual | ~all_al, "ambiguous").otherwise("equivalent")
    names = [v for v in query.value if var(v) in rows.columns]
    evidence = F.array_distinct(F.concat(F.array(*[F.col(f"id_{i}") for i in n]), opp))
    return rows.select(*[F.col(var(v)) for v in names], evidence.alias("evidence_ids"), rel.alias("relation"), "scope_key")


def residuals(spark, goal: Term | str, rows: DataFrame) -> DataFrame:
    """(goal, reason): the goals left open, if ``rows`` is empty; else no rows."""
    goal = terms.read(goal) if isinstance(goal, str) else goal
    if goal.kind == "find":
        open_ = [(terms.show(g), "the join has no complete binding") for g in terms.goals(goal.args[0])]
    else:
        open_ = [(terms.show(goal), "no statement matches exactly")]
    return spark.createDataFrame(open_, "goal string, reason string").where(~rows.exists())
