"""Audits as violations: one row per broken rule; no row means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import facts as fx
from attestry.operators import closure
from attestry.operators.reason import Rule, reason

# States a coverage row may have.
COVERAGE_STATES = ["deferred", "intentionally-excluded", "processed", "unreadable", "failed", "partial", "readable", "model-reviewed", "reviewed-no-assertions"]


def _rows(df: DataFrame, rule: str, when: Column | None = None) -> DataFrame:
    d = df if when is None else df.where(F.coalesce(when, F.lit(False)))
    return d.select(F.col("id"), F.lit(rule).alias("violation"))


def evidence_violations(evidence: DataFrame, records: DataFrame, regions: DataFrame, sources=None, rules: list[Rule] | None = None) -> DataFrame:
    """(id, violation) of cited evidence (id, record_id, source_version_id, region_id, quote, expr_key) against the records and regions.

    Checked: the record exists and is usable; its version is in scope; the region opens; the quote
    stands in it; expression and source are the record's; derived records have premises, don't rest on
    themselves, rest on live ones only, and follow from their rule when it is run again.
    """
    rec = records.select(F.col("id").alias("r"), F.lit(True).alias("has"), F.col("expr_key").alias("r_expr"), F.col("source_version_id").alias("r_src"), "lifecycle", "support_state", "validation", "origin", "rule_id", F.size("premise_ids").alias("n_prem"))
    j = evidence.join(rec, F.col("record_id") == F.col("r"), "left")
    reg = regions.select(F.col("source_version_id").alias("g_src"), F.col("region_id").alias("g_id"), F.col("text").alias("g_text"))
    source = j.where("has and rule_id is null")
    opened = source.join(reg, (F.col("source_version_id") == F.col("g_src")) & (F.col("region_id") == F.col("g_id")), "left")
    out = [
        _rows(j, "missing record", F.col("has").isNull()),
        _rows(j.where("has"), "stale or unusable record", ~fx.usable()),
        _rows(j, "expression differs", ~F.col("expr_key").eqNullSafe(F.col("r_expr")) & F.col("has")),
        _rows(source, "source differs", ~F.col("source_version_id").eqNullSafe(F.col("r_src"))),
        _rows(opened, "region not found", F.col("g_id").isNull()),
        _rows(opened, "quote not in region", F.col("g_id").isNotNull() & ((F.trim(F.coalesce("quote", F.lit(""))) == "") | ~F.contains("g_text", "quote"))),
        _rows(j.where("has and rule_id is not null"), "derived without premises", F.col("n_prem") == 0),
    ]
    if sources is not None:
        allowed = closure.authorised(records, sources).select(F.col("id").alias("record_id"))
        out.append(_rows(j.where("has").join(allowed, "record_id", "left_anti"), "out of scope"))
    edges = records.select("id", F.explode("premise_ids").alias("dep"))
    ring = closure.cyclic(edges).select(F.col("id").alias("record_id"))
    out.append(_rows(evidence.join(ring, "record_id", "left_semi"), "rests on itself"))
    alive = records.where(fx.usable()).select(F.col("id").alias("dep"))
    broken = edges.join(alive, "dep", "left_anti").select(F.col("id").alias("record_id")).distinct()
    out.append(_rows(evidence.join(broken, "record_id", "left_semi"), "premise missing or stale"))
    if rules:
        derived = records.where("rule_id is not null")
        again = reason(records.where("rule_id is null"), rules, max_facts=None).derived.select("expr_key", fx.scope_key().alias("sk"))
        gone = derived.withColumn("sk", fx.scope_key()).join(again, ["expr_key", "sk"], "left_anti").select(F.col("id").alias("record_id"))
        out.append(_rows(evidence.join(gone, "record_id", "left_semi"), "rule does not give it"))
    return reduce(DataFrame.unionByName, out).distinct()


def claim_violations(claims: DataFrame, violations: DataFrame) -> DataFrame:
    """(id, violation) of claims (id, goal, support_state, evidence_ids): supported ones need a goal and sound evidence."""
    s = claims.where("support_state = 'supported'")
    bad = violations.select(F.col("id").alias("e")).distinct()
    cites = s.select("id", F.explode("evidence_ids").alias("e"))
    return reduce(DataFrame.unionByName, [
        _rows(s, "supported without goal", F.coalesce("goal", F.lit("")) == ""),
        _rows(s, "supported without evidence", F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0),
        _rows(cites.join(bad, "e", "left_semi").select("id").distinct(), "supported by unsound evidence"),
    ])


def change_violations(new: DataFrame, held: DataFrame, regions: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(id, violation) of records to be added (facts layout, ``ske`` text optional) against those held."""
    safe = F.col("id").rlike(r"^[A-Za-z0-9_-]{1,128}$")
    twice = new.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    taken = new.select("id", "expr_key").join(held.select("id", F.col("expr_key").alias("k")), "id").where("not (expr_key <=> k)")
    reg = regions.select("source_version_id", "region_id", F.col("text").alias("g"))
    open_ = new.where("rule_id is null").join(reg, ["source_version_id", "region_id"], "left")
    edges = new.select("id", F.explode(F.array_union(F.coalesce("dependencies", F.array().cast("array<string>")), F.coalesce("premise_ids", F.array().cast("array<string>")))).alias("dep"))
    there = held.where(fx.usable()).select(F.col("id").alias("dep")).unionByName(new.select(F.col("id").alias("dep"))).unionByName(regions.select(F.col("source_version_id").alias("dep"))).distinct()
    out = [
        _rows(new, "unsafe id", ~safe | F.col("id").isNull()),
        _rows(twice, "id given twice"),
        _rows(taken, "id already means something else"),
        _rows(new, "no ground call", F.col("pred").isNull()),
        _rows(new, "dead lifecycle", F.col("lifecycle").isin("stale", "retracted", "superseded")),
        _rows(open_, "region not found", F.col("g").isNull()),
        _rows(open_, "quote not in region", F.col("g").isNotNull() & (~F.contains("g", "quote") | (F.trim("quote") == "") | F.col("quote").isNull())),
        _rows(edges.join(there, "dep", "left_anti").select("id").distinct(), "depends on what is not there"),
        _rows(closure.cyclic(edges), "rests on itself"),
    ]
    if sources is not None:
        out.append(_rows(new.where("rule_id is null"), "source out of scope", ~F.coalesce(F.col("source_version_id").isin(sources) | F.col("source_id").isin(sources), F.lit(False))))
    return reduce(DataFrame.unionByName, out).distinct()


def coverage_violations(coverage: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, violation) of coverage rows (id, source_version_id, region_id, state, parameters, parameter_fingerprint)."""
    reg = regions.select("source_version_id", "region_id").distinct()
    stated = coverage.where("region_id is not null")
    return reduce(DataFrame.unionByName, [
        _rows(coverage.groupBy("id").count().where("count > 1"), "id given twice"),
        _rows(coverage, "unknown state", ~F.coalesce(F.col("state").isin(COVERAGE_STATES), F.lit(False))),
        _rows(stated.join(reg, ["source_version_id", "region_id"], "left_anti"), "region not found"),
        _rows(coverage, "parameters differ", F.col("parameter_fingerprint").isNotNull() & ~F.col("parameter_fingerprint").eqNullSafe(F.sha2(F.coalesce("parameters", F.lit("{}")), 256))),
    ])


def covered(regions: DataFrame, coverage: DataFrame, done: tuple[str, ...] = ("processed", "intentionally-excluded")) -> DataFrame:
    """(source_version_id, complete): whether every region has a row in a done state and none in another."""
    ok = coverage.groupBy("source_version_id", "region_id").agg(F.bool_and(F.col("state").isin(*done)).alias("ok"))
    return regions.select("source_version_id", "region_id").join(ok, ["source_version_id", "region_id"], "left").groupBy("source_version_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("complete"))
