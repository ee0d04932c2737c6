"""Samples that match target category proportions (problem 1), by the cube method.

Inclusion probabilities come from quotas per source and category.  The balancing constraints are the
category indicators: a sample must hold each category's expected count.  Two undecided records of one
category always give a vector in the kernel of that constraint matrix (one up, one down), so a flight
phase moves along such vectors until at most one record per category is undecided.  Flights run in
blocks spread over the cluster, so a source of any size is divided; undecided records merge upward
and fly again until one block per source is left, where the landing gives up the category constraints
and keeps the size.  What the landing could not balance is reported.
"""

from __future__ import annotations

import math
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import hyphened, label
from attestry.scratch import Scratch

_EPS = 1e-9


def quotas(have: np.ndarray, share: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """Expected counts, one row per source: at least ``least`` where the source has it, else all it has.

    What the minimums leave of ``size`` goes to the categories below their share in proportion to what
    they lack, and then, where some can't be met, to the others in proportion to their shares.
    """
    have = have.astype(float)
    q = np.minimum(have, least)
    over = q.sum(1, keepdims=True)
    q = np.where(over > size, q * size / np.maximum(over, 1), q)
    for wish in (share * size, np.full(len(share), np.inf)):
        for _ in range(len(share) + 1):
            left = size - q.sum(1, keepdims=True)
            cap = np.minimum(have, wish)
            room = np.maximum(0.0, cap - q)
            weight = room if np.isfinite(wish).all() else np.where(room > _EPS, share, 0.0)
            total = weight.sum(1, keepdims=True)
            if not ((left > _EPS) & (total > _EPS)).any():
                break
            give = np.where(total > _EPS, np.maximum(left, 0) * weight / np.maximum(total, _EPS), 0.0)
            q = q + np.minimum(give, room)
    return q


def _pivot(pi: list[float], i: int, j: int, u: float) -> None:
    up, down = min(1 - pi[i], pi[j]), min(pi[i], 1 - pi[j])
    if u * (up + down) < down:
        pi[i] += up
        pi[j] -= up
    else:
        pi[i] -= down
        pi[j] += down
    for k in (i, j):
        if pi[k] < _EPS:
            pi[k] = 0.0
        elif pi[k] > 1 - _EPS:
            pi[k] = 1.0


def flight(pi: list[float], category: list[int], draw, land: bool) -> list[float]:
    """Moves ``pi`` along kernel vectors of the category constraints; with ``land`` also of the size alone.

    Afterwards each category has at most one record strictly between 0 and 1; after landing all are
    0 or 1 but for one, if the probabilities don't add up to a whole number, which is then drawn.
    """
    open_: dict[int, int] = {}
    for i, c in enumerate(category):
        if not 0 < pi[i] < 1:
            continue
        j = open_.pop(c, None)
        if j is not None:
            _pivot(pi, i, j, draw())
        for k in ((i,) if j is None else (i, j)):
            if 0 < pi[k] < 1:
                open_[c] = k
    if land:
        held = None
        for i in open_.values():
            if held is not None:
                _pivot(pi, i, held, draw())
                held = next((k for k in (i, held) if 0 < pi[k] < 1), None)
            else:
                held = i
        if held is not None:
            pi[held] = 1.0 if draw() < pi[held] else 0.0
    return pi


class BalancedSample:
    """A sample of ``size`` records of each source with the shares of ``targets`` (category, target_share, min_keep).

    * ``sample``: (source_id, category, id);
    * ``report``: per source and target category: available (different ids), wanted (the larger of
      min_keep and the rounded share), quota (expected count), sampled, sampled_share, imbalance
      (sampled less target_share x ``size``), residual (sampled less quota: what the landing left over),
      short (sampled below wanted) and unmet: ``supply`` if the source has fewer records than wanted,
      ``size`` if it has enough but the wanted counts of all categories add up to more than ``size`` or
      the landing gave the place to another category, null if the target is met.

    Sources are compared without case and surrounding white space, categories also with runs of white
    space and underscores as one hyphen.  Records without id or source belong to no source; those of
    other or no categories are never sampled, but their sources are reported.  A source with fewer
    eligible records than ``size`` gives all of them.  Repeated ids count once (by their largest
    category); an id under two sources is a record of each.  Empty tables give empty results.
    The draw depends on ``seed`` and the ids only.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, size: int = 25, seed: int = 42, block: int = 20_000, fan: int = 64,
                 id: str = "id", source: str = "sourceId", category: str = "category"):
        scratch = Scratch(records.sparkSession, "sampling")
        # The targets are a parameter table: a handful of categories, collected like any parameter.
        t = (targets.select(hyphened("category").alias("category"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("min_keep", F.lit(0)).alias("least"))
             .where("category is not null").groupBy("category").agg(F.max("share").alias("share"), F.max("least").alias("least")).orderBy("category").limit(10_001).collect())
        if len(t) > 10_000:
            raise ValueError("more than 10,000 target categories")
        names = [r.category for r in t]
        share, least = np.array([r.share for r in t], dtype=float), np.array([r.least for r in t], dtype=float)
        rows = records.select(label(source).alias("source_id"), hyphened(category).alias("category"), F.col(id).alias("id"))
        rows = rows.where("source_id is not null and id is not null").groupBy("source_id", "id").agg(F.max("category").alias("category"))
        rows = scratch.write(rows, "records")
        no = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]) if names else F.create_map().cast("map<string,int>")
        rows = rows.withColumn("c", no[F.col("category")])
        per = rows.groupBy("source_id", "c").count().groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "count")))).alias("have"))

        def allot(batches):
            for b in batches:
                have = np.zeros((len(b), len(names)))
                for i, m in enumerate(b["have"]):
                    for c, n in dict(m).items():
                        have[i, int(c)] = n
                q = quotas(have, share, least, size)
                yield pd.DataFrame({"source_id": b["source_id"], "have": have.astype(np.int64).tolist(), "quota": q.tolist(), "blocks": np.maximum(1, -(-have.sum(1) // block)).astype(np.int64)})

        per = scratch.write(per.mapInPandas(allot, "source_id string, have array<long>, quota array<double>, blocks long"), "quotas")
        todo = (rows.where("c is not null").hint("merge").join(per, "source_id")
                .select("source_id", "c", "id", (F.col("quota")[F.col("c")] / F.col("have")[F.col("c")]).alias("pi"), "blocks",
                        F.pmod(F.xxhash64(F.lit(seed), "id"), "blocks").alias("block"), F.xxhash64(F.lit(seed + 1), "id").alias("at"))
                .where("pi > 0"))
        most = per.agg(F.max("blocks")).first()[0] or 1
        parts, level = [], 0
        while True:
            level += 1
            flown = todo.repartition("source_id", "block").sortWithinPartitions("source_id", "block", "at", "id").mapInPandas(_flyer(seed, level), todo.schema)
            flown = scratch.write(flown.withColumn("decided", F.col("pi") == 1), f"level_{level}", by=["decided"])
            parts.append(flown.where("decided").drop("decided"))
            if most == 1:
                break
            most = math.ceil(most / fan)
            todo = flown.where("not decided").drop("decided").withColumn("block", F.floor(F.col("block") / fan)).withColumn("blocks", F.ceil(F.col("blocks") / fan))
        chosen = parts[0]
        for p in parts[1:]:
            chosen = chosen.unionByName(p)
        name = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
        self.sample = chosen.select("source_id", name[F.col("c")].alias("category"), "id")
        got = chosen.groupBy("source_id", "c").agg(F.count(F.lit(1)).alias("sampled"))
        whole = chosen.groupBy("source_id").agg(F.count(F.lit(1)).alias("whole"))
        cats = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(r.category).alias("category"), F.lit(float(r.share)).alias("target_share"), F.lit(int(r.least)).alias("min_keep"),
                                  F.lit(max(int(r.least), math.floor(r.share * size + 0.5 + _EPS))).cast("long").alias("wanted")) for i, r in enumerate(t)])
        if not t:
            self.report = per.where("false").selectExpr("source_id", "cast(null as string) category", "0D target_share", "0 min_keep", "0L wanted", "0L available", "0D quota", "0L sampled", "0D sampled_share", "0D imbalance", "0D residual", "false short", "cast(null as string) unmet")
            return
        wide = per.select("source_id", F.explode(cats).alias("t"), "have", "quota").select("source_id", "t.*", F.col("have")[F.col("t.c")].alias("available"), F.col("quota")[F.col("t.c")].alias("quota"))
        j = wide.hint("merge").join(got, ["source_id", "c"], "left").hint("merge").join(whole, "source_id", "left")
        sampled = F.coalesce("sampled", F.lit(0))
        lacking = F.when(F.col("available") < F.col("wanted"), "supply").when(sampled < F.col("wanted"), "size")
        self.report = j.select("source_id", "category", "target_share", "min_keep", "wanted", "available", F.round("quota", 6).alias("quota"), sampled.alias("sampled"), F.round(sampled / F.col("whole"), 6).alias("sampled_share"),
                               F.round(sampled - F.col("target_share") * size, 6).alias("imbalance"), F.round(sampled - F.col("quota"), 6).alias("residual"), (sampled < F.col("wanted")).alias("short"), lacking.alias("unmet"))


def _flyer(seed: int, level: int):
    def fly(batches):
        def rows():
            for b in batches:
                yield from b.itertuples(index=False, name=None)

        out: list[tuple] = []
        columns = ["source_id", "c", "id", "pi", "blocks", "block", "at"]
        for (source, block), group in groupby(rows(), key=itemgetter(0, 5)):
            g = list(group)  # at most about one block
            rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}/{level}/{source}/{block}".encode()))
            draws = iter(rng.random(len(g) * 2 + 2).tolist())
            pi = flight([r[3] for r in g], [r[1] for r in g], lambda d=draws: next(d), land=g[0][4] == 1)
            out += [(*r[:3], p, *r[4:]) for r, p in zip(g, pi) if p > 0]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return fly
