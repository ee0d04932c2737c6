"""Spans and evaluation measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import scan


def interval_union(spans: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(by, start, end): overlapping or touching half-open spans merged; empty, reversed and null ones left out."""
    s = spans.select(*by, F.col(start).alias("start"), F.col(end).alias("end")).where("start < end")
    s = scan.spread(s.groupBy(*by, "start").agg(F.max("end").alias("end")), by, ["start"])
    s = scan.running(s, by, ["start"], F.col("end"), "_reach", "max")
    new = F.when(F.col("start") <= F.col("_reach"), 0).otherwise(1)
    s = scan.running(s, by, ["start"], new, "_island").withColumn("_island", F.coalesce("_island", F.lit(0)) + new)
    return s.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def overlaps(left: DataFrame, right: DataFrame, by: list[str], width: int = 4096) -> DataFrame:
    """(by, l_start, l_end, r_start, r_end, shared): pairs of spans of one source that overlap.

    Spans are cut into buckets of ``width`` and joined on the bucket, so the join is an equality; a pair
    counts in the bucket where its overlap begins.
    """
    def cut(df: DataFrame, p: str) -> DataFrame:
        s = df.select(*by, F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end")).where(f"{p}_start < {p}_end")
        return s.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / width), F.floor((F.col(f"{p}_end") - 1) / width))))

    j = cut(left, "l").join(cut(right, "r"), [*by, "_b"]).where("l_start < r_end and r_start < l_end")
    begin = F.greatest("l_start", "r_start")
    return j.where(F.floor(begin / width) == F.col("_b")).withColumn("shared", F.least("l_end", "r_end") - begin).drop("_b")


def span_scores(found: DataFrame, gold: DataFrame, by: list[str], source: str) -> DataFrame:
    """(by, precision, recall, span_recall): characters found that are gold, gold characters found, gold spans found whole; null where undefined."""
    key = [*by, source]
    f, g = interval_union(found, key), interval_union(gold, key)
    size = lambda d, n: d.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias(n))
    both = overlaps(f, g, key).groupBy(*by).agg(F.sum("shared").alias("shared"))
    each = gold.select(*key, "start", "end").where("start < end").distinct()
    held = overlaps(f, each, key).where("l_start <= r_start and l_end >= r_end").select(*key, F.col("r_start").alias("start"), F.col("r_end").alias("end")).distinct()
    whole = each.groupBy(*by).agg(F.count(F.lit(1)).alias("spans"))
    got = held.groupBy(*by).agg(F.count(F.lit(1)).alias("whole"))
    j = size(f, "found").join(size(g, "gold"), by, "full").join(both, by, "left").join(whole, by, "left").join(got, by, "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    ratio = lambda a, b: F.when(z(F.col(b)) > 0, z(F.col(a)) / F.col(b))
    return j.select(*by, ratio("shared", "found").alias("precision"), ratio("shared", "gold").alias("recall"), ratio("whole", "spans").alias("span_recall"))


def mean(c: str | Column) -> Column:
    """Mean of the finite values; null without any."""
    c = F.col(c) if isinstance(c, str) else c
    return F.avg(F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), c.cast("double")))


def family(df: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(mean(m), 6).alias(f"mean_{m}") for m in measures])


def xorshift(seed_hex: str):
    """Uniform draws in [0, 1) from the first eight hex digits of a digest: 32-bit shifts by 13, 17 and 5."""
    x = int(seed_hex[:8], 16) or 1
    while True:
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        yield x / 2**32


def bootstrap(differences: list[float], seed_hex: str, resamples: int = 5000) -> tuple[float, float, float]:
    """(mean, low, high): paired differences with the 2.5 and 97.5 % marks of resampled means; for reports of a few hundred cases."""
    d = np.asarray(differences, dtype=float)
    if not len(d):
        return (float("nan"),) * 3
    draw = xorshift(seed_hex)
    means = sorted(float(np.mean([d[int(next(draw) * len(d))] for _ in range(len(d))])) for _ in range(resamples))
    return float(d.mean()), means[int(resamples * 0.025)], means[int(resamples * 0.975)]


def bootstrap_rows(df: DataFrame, value: str, by: list[str], resamples: int = 200, seed: int = 42) -> DataFrame:
    """(by, mean, low, high) for any number of rows: each row enters each resample a Poisson(1) number of times, drawn from its hash.

    One pass and one aggregation; no row is collected or repeated.
    """
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    u = F.pmod(F.xxhash64(key, F.col("_i")), F.lit(1 << 40)) / float(1 << 40)
    marks, total, p = [], 0.0, np.exp(-1)
    for k in range(1, 8):
        total += p
        marks.append(total)
        p /= k
    times = sum((F.when(u >= m, 1).otherwise(0) for m in marks), F.lit(0))
    rows = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).groupBy(*by, "_i").agg(F.try_divide(F.sum(times * F.col(value)).cast("double"), F.sum(times)).alias("m"))
    point = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return point.join(rows.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")), by)
