"""Many small goals evaluated at once: each case has its own goal, scope and records (a controlled evaluation).

Goals are read once per case into goal atoms; then all cases advance together, one goal per round, by
joins on (case, predicate).  The number of rounds is the longest body, not the number of cases.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import facts as fx
from attestry import terms
from attestry.functions.text import label
from attestry.operators import metrics
from attestry.scratch import Scratch
from attestry.tables import latest, table

_GOALS = T.ArrayType(T.StructType([T.StructField("pred", T.StringType()), T.StructField("args", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_GOALS)
def goal_atoms(text: pd.Series) -> pd.Series:
    """The goals of a query or call: arguments tagged, variables as ``v:name``; null where the text is no goal or nests variables."""

    def one(x):
        try:
            t = terms.read(x) if x else None
        except terms.TermError:
            return None
        if t is None or t.kind not in ("call", "find"):
            return None
        body = terms.goals(t.args[0]) if t.kind == "find" else (t,)
        if any(g.kind != "call" or any(a.kind == "call" and not a.ground for a in g.args) for g in body):
            return None
        return [(g.value, [f"v:{a.value}" if a.kind == "variable" else terms.tagged(a) for a in g.args]) for g in body]

    return text.map(one)


def evaluated(cases: DataFrame, records: DataFrame) -> DataFrame:
    """(case_id, state, n_rows, evidence_ids) for cases (case_id, goal, scope, want struct) over facts with a case_id.

    Facts outside a case's scope don't count, neither for it nor against it.  A case without a goal, or
    without rows, is unresolved.
    """
    scratch = Scratch(cases.sparkSession, "controlled")
    c = scratch.write(cases.withColumn("goals", goal_atoms("goal")), "cases")
    live = records.where(fx.usable()).join(c.select("case_id", "scope"), "case_id").where("scope is null or array_contains(scope, source_version_id) or array_contains(scope, source_id) or array_contains(scope, id)").drop("scope")
    live = live.withColumn("claim", fx.claim_key()).withColumn("scope_key", fx.scope_key())
    keyed = live.withColumn("expr_key", F.concat_ws("\x1e", "case_id", "expr_key"))
    live = live.join(fx.opponents(keyed.drop("claim")).select(F.split("expr_key", "\x1e")[0].alias("case_id"), F.split("expr_key", "\x1e")[1].alias("expr_key"), "claim", "polarity", "opponent_id"), ["case_id", "expr_key", "claim", "polarity"], "left")
    live = scratch.write(live.select("case_id", "id", "pred", "args", "scope_key", "opponent_id", *fx.SCOPE), "facts")
    want = lambda d: F.col(f"want.{d}")
    ok, plain = F.lit(True), F.lit(True)
    for d in fx.SCOPE:
        ok = ok & (want(d).isNull() | want(d).eqNullSafe(F.col(d)))
        default = fx.DEFAULTS.get(d)
        usual = F.col(d).isNull() if default is None else (F.col(d) != "negative" if d == "polarity" else F.col(d) == default)
        plain = plain & (usual | want(d).eqNullSafe(F.col(d)))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = c.where("goals is not null").select("case_id", "goals", "want", empty.alias("b"), F.lit(None).cast("string").alias("sk"), F.array().cast("array<string>").alias("ev"), F.lit(False).alias("opp"), F.lit(True).alias("fine"))
    longest = c.agg(F.max(F.size("goals"))).first()[0] or 0
    done = rows.where("false")
    for i in range(max(0, longest)):
        done = done.unionByName(rows.where(F.size("goals") <= i))
        r = rows.where(F.size("goals") > i).withColumn("g", F.get("goals", F.lit(i))).withColumn("pred", F.col("g.pred"))
        f = live.select("case_id", "pred", "id", F.col("args").alias("fa"), "scope_key", "opponent_id", *fx.SCOPE)
        j = r.join(f, ["case_id", "pred"]).where((F.size("fa") == F.size("g.args")) & (F.col("sk").isNull() | (F.col("sk") == F.col("scope_key"))))
        pairs = F.arrays_zip(F.col("g.args").alias("p"), F.col("fa").alias("a"))
        j = j.withColumn("z", pairs)
        j = j.where(F.forall("z", lambda x: F.when(x["p"].startswith("v:"), F.coalesce(F.col("b")[x["p"]], x["a"]) == x["a"]).otherwise(x["p"] == x["a"])))
        new = F.array_distinct(F.filter("z", lambda x: x["p"].startswith("v:") & F.col("b")[x["p"]].isNull()))
        j = j.withColumn("new", new).where(F.size("new") == F.size(F.array_distinct(F.transform("new", lambda x: x["p"]))))
        rows = j.select("case_id", "goals", "want", F.map_concat("b", F.map_from_arrays(F.transform("new", lambda x: x["p"]), F.transform("new", lambda x: x["a"]))).alias("b"), F.col("scope_key").alias("sk"),
                        F.concat("ev", F.array_compact(F.array("id", "opponent_id"))).alias("ev"), (F.col("opp") | F.col("opponent_id").isNotNull()).alias("opp"), (F.col("fine") & ok & plain).alias("fine"))
    done = done.unionByName(rows)
    level = F.when(F.col("opp"), 2).when(F.col("fine"), 1).otherwise(0)
    best = done.groupBy("case_id").agg(F.max(level).alias("level"), F.count(F.lit(1)).alias("n_rows"), F.array_distinct(F.flatten(F.collect_list("ev"))).alias("evidence_ids"))
    state = F.element_at(F.array(F.lit("unresolved"), F.lit("supported"), F.lit("contested")), F.coalesce("level", F.lit(0)) + 1)
    return c.select("case_id").join(best, "case_id", "left").select("case_id", state.alias("state"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"))


def _tables(s, d):
    c = latest(table(s, d, "controlled_cases"), "id", ["family", "goal", "scope", "scopeQuery", "expected", "gold"])
    r = latest(table(s, d, "controlled_records"), ["caseId", "id"], ["ske", "sourceVersionId", "lifecycle", "supportState", "polarity", "deletedAt"]).where("deletedAt is null")
    r = r.select("id", F.col("caseId").alias("case_id"), "ske", F.col("sourceVersionId").alias("source_version_id"), "lifecycle", F.col("supportState").alias("support_state"), "polarity")
    f = fx.parsed(r, "ske").where("pred is not null").withColumn("k", F.concat_ws("\x1e", "case_id", "id"))
    # The fact layout has one id; a record's key is its case and id.
    f = fx.facts(f.withColumn("id", F.col("k"))).withColumn("case_id", F.split("id", "\x1e")[0]).withColumn("id", F.split("id", "\x1e")[1])
    return c, f


def controlled_states(s, d):
    c, f = _tables(s, d)
    return evaluated(c.select(F.col("id").alias("case_id"), "goal", "scope", F.col("scopeQuery").alias("want")), f).select("case_id", "state", "n_rows")


def controlled_evaluation(s, d):
    """Per family: cases, share whose state is the expected one, mean precision and recall of cited records against the gold ones."""
    c, f = _tables(s, d)
    e = evaluated(c.select(F.col("id").alias("case_id"), "goal", "scope", F.col("scopeQuery").alias("want")), f)
    gold = F.array_distinct(F.array_compact(F.transform("gold.recordIds", label)))
    j = c.withColumn("g", gold).join(e.withColumnRenamed("case_id", "id"), "id")
    hit = F.size(F.array_intersect("g", F.transform("evidence_ids", label)))
    j = j.select("family", (F.col("expected") == F.col("state")).cast("double").alias("correct"), F.when(F.size("evidence_ids") > 0, hit / F.size("evidence_ids")).alias("precision"), F.when(F.size("g") > 0, hit / F.size("g")).alias("recall"))
    return metrics.family(j, ["family"], ["correct", "precision", "recall"])


_W = r"\(linked_to ([^ ()]+) ([^ ()]+)\)"
_STATES = rf"""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recordedAt DESC) rn FROM controlled_cases) WHERE rn = 1),
r AS (SELECT caseId, r.id, regexp_extract(ske, '{_W}', 1) a, regexp_extract(ske, '{_W}', 2) b, ske, coalesce(polarity, 'positive') pol
  FROM (SELECT *, row_number() OVER (PARTITION BY caseId, id ORDER BY recordedAt DESC) rn FROM controlled_records) r JOIN c ON c.id = r.caseId WHERE r.rn = 1 AND r.deletedAt IS NULL
  AND r.lifecycle NOT IN ('stale', 'retracted', 'superseded', 'staged') AND (r."supportState" IS NULL OR r."supportState" = 'supported') AND (c.scope IS NULL OR list_contains(c.scope, r.sourceVersionId) OR list_contains(c.scope, r.id))),
o AS (SELECT x.*, EXISTS (SELECT 1 FROM r y WHERE y.caseId = x.caseId AND y.ske = x.ske AND y.pol <> x.pol) opp FROM r x),
g AS (SELECT id, goal, scopeQuery q, regexp_extract_all(goal, '{_W}', 1) p, regexp_extract_all(goal, '{_W}', 2) s FROM c),
f AS (SELECT o.*, (q.time IS NULL) AND (q.modality IS NULL OR q.modality = 'asserted') AND (q.attribution IS NULL) AND (q.world IS NULL) AND (q.polarity IS NULL OR q.polarity = pol) AND (pol <> 'negative' OR coalesce(q.polarity, '') = 'negative') fine FROM o JOIN g ON g.id = o.caseId),
rows_ AS (SELECT g.id, f.opp, f.fine FROM g JOIN f ON f.caseId = g.id AND len(p) = 1 AND f.a = p[1] AND f.b = s[1]
  UNION ALL SELECT g.id, x.opp OR y.opp, x.fine AND y.fine FROM g JOIN f x ON x.caseId = g.id JOIN f y ON y.caseId = g.id AND x.pol = y.pol WHERE len(p) = 2 AND x.a = p[1] AND x.b = y.a AND y.b = s[2])
SELECT c.id case_id, CASE max(CASE WHEN opp THEN 2 WHEN fine THEN 1 ELSE 0 END) WHEN 2 THEN 'contested' WHEN 1 THEN 'supported' ELSE 'unresolved' END state, count(rows_.id) n_rows FROM c LEFT JOIN rows_ ON rows_.id = c.id GROUP BY c.id"""

QUERIES = {"controlled_states": (controlled_states, _STATES), "controlled_evaluation": (controlled_evaluation, None)}
