"""Closures over dependency edges: authorisation, staleness, ancestry, cyclic evidence.

All run as rounds of semi- and anti-joins over written tables until nothing changes; only row counts
reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry import facts as fx
from attestry.operators.hierarchy import Forest
from attestry.scratch import Scratch


def authorised(records: DataFrame, sources, lenient: bool = False) -> DataFrame:
    """(id): records that rest on the sources in scope only.

    A record without dependencies is in if its version, source or id is in scope; one with them if all
    are in.  Dependencies may name records or source versions in scope.  ``lenient`` also lets in a record whose own
    source is in scope though a dependency is not.  Records that depend on each other in a ring, or on
    what doesn't exist, are never in.
    """
    scratch = Scratch(records.sparkSession, "authorised")
    records = scratch.write(records.select(*[c for c in ("id", "source_version_id", "source_id", "dependencies") if c in records.columns]), "records")
    own = fx.in_sources(sources, records).select("id").distinct()
    deps = F.coalesce("dependencies", F.array().cast("array<string>"))
    edge = scratch.write(records.select("id", F.explode(F.array_distinct(deps)).alias("dep")).where("id is not null and dep is not null").distinct(), "edges")
    needs = scratch.write(edge.groupBy("id").agg(F.count(F.lit(1)).alias("needs")), "needs")
    seeds = own if lenient else own.join(needs.select("id"), "id", "left_anti")
    if isinstance(sources, DataFrame):
        named = sources.select("id").distinct()
    else:
        named = records.sparkSession.createDataFrame([(s,) for s in sources or []], "id string")
    # A round looks only at records that the last one let something of in: a record is in when all it needs is.
    front = first = scratch.write(seeds.unionByName(named).distinct(), "ok_0")
    ok, n = [first], 0
    while not front.isEmpty():
        n += 1
        all_in = reduce(DataFrame.unionByName, ok).select(F.col("id").alias("dep"), F.lit(1).alias("there"))
        new = front.select(F.col("id").alias("dep"), F.lit(1).alias("new"))
        met = edge.join(all_in, "dep").join(new, "dep", "left").groupBy("id").agg(F.count("there").alias("met"), F.count("new").alias("new")).where("new > 0")
        front = scratch.write(needs.join(met, "id").where("met = needs").select("id").join(first, "id", "left_anti"), f"ok_{n}")
        ok.append(front)
    return records.select("id").distinct().join(reduce(DataFrame.unionByName, ok), "id", "left_semi")


def spread(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, round): everything that depends on a seed (column ``id``), over ``edges`` (id, dep), with the round it was reached in; seeds have 0."""
    scratch = Scratch(seeds.sparkSession, "spread")
    edges = scratch.write(edges.select("id", "dep").where("id is not null and dep is not null").distinct(), "edges")
    front = scratch.write(seeds.select("id").where("id is not null").distinct().withColumn("round", F.lit(0)), "round_0")
    reached, n = front, 0
    while front.limit(1).count():
        n += 1
        step = edges.join(front.select(F.col("id").alias("dep")), "dep", "left_semi").select("id").distinct()
        front = scratch.write(step.join(reached.select("id"), "id", "left_anti").withColumn("round", F.lit(n)), f"round_{n}")
        reached = reached.unionByName(front)
    return reached


def stale(records: DataFrame, changed_versions: DataFrame, changed_records: DataFrame, procedures: DataFrame | None = None) -> DataFrame:
    """(id, reason) of records that a change makes stale.

    ``changed_versions`` and ``changed_records`` have a column ``id``; ``procedures`` (procedure_id,
    active_version) names procedures whose active version changed.  Reasons, the first that holds:
    ``dependency-invalidated`` (on something changed or stale), ``source-version-updated``,
    ``procedure-version-updated``.  A table without dependencies or source versions has none.
    """
    for c, kind in (("dependencies", "array<string>"), ("source_version_id", "string")):
        if c not in records.columns:
            records = records.withColumn(c, F.lit(None).cast(kind))
    deps = F.coalesce("dependencies", F.array().cast("array<string>"))
    edges = records.select("id", F.explode(deps).alias("dep"))
    touched = changed_versions.select("id").unionByName(changed_records.select("id")).distinct()
    by_dep = edges.join(touched.select(F.col("id").alias("dep")), "dep", "left_semi").select("id").distinct()
    by_source = records.join(changed_versions.select(F.col("id").alias("source_version_id")).distinct(), "source_version_id", "left_semi").select("id")
    direct = by_dep.withColumn("w", F.lit(0)).unionByName(by_source.withColumn("w", F.lit(1)))
    if procedures is not None:
        p = procedures.select("procedure_id", "active_version")
        by_proc = records.join(p, "procedure_id").where(~F.col("procedure_version").eqNullSafe(F.col("active_version"))).select("id")
        direct = direct.unionByName(by_proc.withColumn("w", F.lit(2)))
    direct = direct.groupBy("id").agg(F.min("w").alias("w"))
    reached = spread(direct, edges).select(F.col("id").alias("dep"))
    later = edges.join(reached, "dep", "left_semi").select("id", F.lit(0).alias("w")).distinct()
    why = F.element_at(F.array(F.lit("dependency-invalidated"), F.lit("source-version-updated"), F.lit("procedure-version-updated")), F.col("w") + 1)
    return direct.unionByName(later).groupBy("id").agg(F.min("w").alias("w")).select("id", why.alias("reason"))


def ancestry(snapshots: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, ancestor, distance) along parent pointers, by pointer doubling."""
    return Forest(snapshots, id, parent).descendants().select(F.col("descendant").alias("id"), "ancestor", "distance")


def cyclic(edges: DataFrame) -> DataFrame:
    """(id): nodes on or depending on a cycle of ``edges`` (id, dep): what is left after repeatedly removing nodes all of whose dependencies are settled."""
    scratch = Scratch(edges.sparkSession, "cyclic")
    e = scratch.write(edges.select("id", "dep").where("id is not null and dep is not null").distinct(), "edges_0")
    left, n = e.count(), 0
    while left:
        n += 1
        nodes = e.select(F.col("id").alias("dep")).distinct()
        e = scratch.write(e.join(nodes, "dep", "left_semi").select("id", "dep"), f"edges_{n}")
        now = e.count()
        if now == left:
            break
        left = now
    return e.select("id").distinct()
