"""Filling fixed-capacity containers with items (problem 7).

Only the histogram of sizes, at most ``capacity`` numbers, reaches the driver.  There shallow
combinations of sizes that fill a window below the capacity are enumerated, their repeat counts are
solved by non-negative least squares against the histogram and rounded down, and the residual counts
are packed greedily (largest first, best fit).  The resulting plan names sizes, not items, so it stays
as small as the histogram; items get their container from their rank within their size.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attestry.scratch import Scratch

CAPACITY = 4096


def combinations(sizes: np.ndarray, capacity: int, window: int, shapes: int = 12) -> list[dict[int, int]]:
    """Combinations of up to three different sizes, each repeated, that fill (capacity - window, capacity].

    For every size a: repeated as often as fits or a little less often, the rest filled by one further
    size, or by one repeated and one last.  At most about ``shapes`` per size, so their number is
    bounded by the number of different sizes.
    """
    have, order = {int(s) for s in sizes}, sorted(int(s) for s in sizes)
    found: dict[tuple, dict[int, int]] = {}

    def add(*parts: tuple[int, int]) -> bool:
        c: dict[int, int] = {}
        for s, k in parts:
            if k:
                c[s] = c.get(s, 0) + k
        if not capacity - window < sum(s * k for s, k in c.items()) <= capacity:
            return False
        return found.setdefault(tuple(sorted(c.items())), c) is c

    for a in order:
        n, top = 0, capacity // a
        for i in sorted({top, top - 1, top - 2, (top + 1) // 2, 1}, reverse=True):
            if i < 1 or n >= shapes:
                continue
            rest = capacity - i * a
            n += add((a, i))
            for b in range(rest, max(0, rest - window), -1):
                if b in have:
                    n += add((a, i), (b, 1))
                    break
            for step in range(3):
                j = bisect_right(order, rest // (step + 2)) - 1
                if j < 0:
                    continue
                b = order[j]
                k = rest // b
                for kb in (k, k - 1):
                    left = rest - kb * b
                    c = next((c for c in range(left, max(0, left - window), -1) if c in have), 0)
                    n += add((a, i), (b, kb), *([(c, 1)] if c else []))
    return list(found.values())


def nnls(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, h: np.ndarray, n: int, rounds: int = 400) -> np.ndarray:
    """x >= 0 with A x close to h in the least-squares sense; A sparse (rows, cols, vals). Accelerated projected gradient."""
    if not n:
        return np.zeros(0)
    # Columns are scaled to unit length first, which evens out long and short combinations.
    norm = np.sqrt(np.bincount(cols, vals**2, n))
    v = vals / norm[cols]
    step = 1.0 / max(1e-9, (np.bincount(rows, v, len(h)).max() * np.bincount(cols, v, n).max()))
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        gap = np.bincount(rows, v * y[cols], len(h)) - h
        new = np.maximum(0, y - step * np.bincount(cols, v * gap[rows], n))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x / norm


def plan(histogram: dict[int, int], capacity: int = CAPACITY, window: int = 8) -> list[tuple[dict[int, int], int]]:
    """[(combination {size: count}, repeats)] covering the histogram exactly; sizes lie in 1..capacity."""
    left = {s: n for s, n in histogram.items() if n > 0}
    done: list[tuple[dict[int, int], int]] = []
    if left.get(capacity):
        done.append(({capacity: 1}, left.pop(capacity)))
    sizes = np.array(sorted(left), dtype=np.int64)
    combos = combinations(sizes, capacity, window) if len(sizes) else []
    if combos:
        at = {int(s): i for i, s in enumerate(sizes)}
        rows = np.array([at[s] for c in combos for s in c])
        cols = np.array([j for j, c in enumerate(combos) for _ in c])
        vals = np.array([float(k) for c in combos for k in c.values()])
        x = nnls(rows, cols, vals, np.array([float(left[int(s)]) for s in sizes]), len(combos))
        for j in np.argsort(-x, kind="stable"):
            c = combos[j]
            r = min(int(x[j]), *(left[s] // k for s, k in c.items()))
            if r > 0:
                done.append((c, r))
                for s, k in c.items():
                    left[s] -= k * r
    left = {s: n for s, n in left.items() if n}
    order = sorted(left)
    while order:
        # Largest first; then always the largest size that still fits. A combination is repeated until one of its sizes runs out.
        c, room, hi = {}, capacity, len(order) - 1
        while hi >= 0 and room >= order[0]:
            hi = min(hi, bisect_right(order, room) - 1)
            if hi < 0:
                break
            s = order[hi]
            k = min(left[s], room // s)
            c[s] = k
            room -= k * s
            hi -= 1
        r = min(left[s] // k for s, k in c.items())
        done.append((c, r))
        for s, k in c.items():
            left[s] -= k * r
            if not left[s]:
                order.remove(s)
    return done


def segments(planned: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: first rank, first container and items per container of each stretch of ranks."""
    raw: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    first = 0
    for c, r in planned:
        for s, k in c.items():
            raw.setdefault(s, []).append((rank.get(s, 0), first, k))
            rank[s] = rank.get(s, 0) + k * r
        first += r
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for s, v in raw.items()}


def packed(sizes: DataFrame, item: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, per_group: int = 200_000) -> DataFrame:
    """(item, piece, n_pieces, piece_tokens, container): where each item, or each piece of an oversized one, goes.

    Only items larger than the capacity are split: into full containers and one rest, which is packed
    like any item.  Items of size 0 or null need no container: one row, piece 0, container null.
    Ranks within a size are taken in parts of about ``per_group`` items, so that no task orders a whole hot
    size; that decides which of equally long items goes where, never how containers are filled.
    Repeated items are packed each on its own; they must not share ``item`` if the result is to tell
    them apart.  An empty table gives an empty result.  Other columns of ``sizes`` are ignored.
    """
    spark, scratch = sizes.sparkSession, Scratch(sizes.sparkSession, "packing")
    s = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    base = sizes.select(F.col(item).alias("item"), s.alias("n")).withColumn("n_pieces", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / capacity)))
    parts = base.select("item", "n", "n_pieces", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)).alias("piece"))
    parts = parts.withColumn("len", F.when(F.col("piece") < F.col("n_pieces") - 1, capacity).otherwise(F.col("n") - capacity * (F.col("n_pieces") - 1)))
    parts = scratch.write(parts.select("item", "piece", "n_pieces", "len"), "pieces")
    hist = {r["len"]: r["count"] for r in parts.where("len > 0").groupBy("len").count().collect()}  # at most `capacity` rows
    where = segments(plan(hist, capacity))
    salts = max(1, math.ceil(max(hist.values(), default=1) / per_group))
    salted = parts.where("len > 0").withColumn("salt", F.pmod(F.xxhash64("item", "piece"), F.lit(salts)))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("len", "salt").orderBy("item", "piece")) - 1)
    if salts > 1:
        per = salted.groupBy("len", "salt").count()
        before = F.sum("count").over(Window.partitionBy("len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
        ranked = ranked.join(per.select("len", "salt", F.coalesce(before, F.lit(0)).alias("before")), ["len", "salt"]).withColumn("r", F.col("r") + F.col("before"))
    schema = T.StructType([parts.schema["item"], parts.schema["piece"], parts.schema["n_pieces"], T.StructField("piece_tokens", T.LongType()), T.StructField("container", T.LongType())])

    def place(batches):
        for b in batches:
            out = np.empty(b.num_rows, dtype=np.int64)
            lens, ranks = b["len"].to_numpy(), b["r"].to_numpy()
            for s in np.unique(lens):
                start, first, k = where[int(s)]
                m = lens == s
                i = np.searchsorted(start, ranks[m], side="right") - 1
                out[m] = first[i] + (ranks[m] - start[i]) // k[i]
            yield pa.RecordBatch.from_arrays([b["item"], b["piece"], b["n_pieces"], b["len"], pa.array(out)], ["item", "piece", "n_pieces", "piece_tokens", "container"])

    placed = ranked.select("item", "piece", "n_pieces", "len", F.col("r").cast("long").alias("r")).mapInArrow(place, schema)
    none = parts.where("len = 0").select("item", "piece", "n_pieces", F.col("len").alias("piece_tokens"), F.lit(None).cast("long").alias("container"))
    return placed.unionByName(none).withColumnRenamed("item", item)


def bounds(sizes: DataFrame, placed: DataFrame, item: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, slack: float = 0.02) -> DataFrame:
    """One row: items, tokens lost or doubled, containers over the capacity, items split without need, and
    whether the containers are at most ``slack`` (and one) more than tokens / capacity, which no packing can beat.
    """
    per = placed.groupBy("container").agg(F.sum("piece_tokens").alias("t"), F.first("container").isNotNull().alias("real"))
    c = per.agg(F.count_if(F.col("real") & (F.col("t") > capacity)).alias("overfull"), F.count_if("real").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("placed"))
    n = sizes.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum(size), F.lit(0)).alias("tokens"))
    split = placed.where("n_pieces > 1").groupBy(item).agg(F.sum("piece_tokens").alias("t")).agg(F.count_if(F.col("t") <= capacity).alias("split_small"))
    row = n.withColumn("c", c.select(F.struct("*")).scalar()).withColumn("split_small", split.scalar())
    near = F.col("c.containers") <= F.ceil(F.col("tokens") / capacity) * (1 + slack) + 1
    return row.select("n_items", (F.col("tokens") - F.col("c.placed")).alias("lost"), F.col("c.overfull").alias("overfull"), "split_small", near.alias("near_least"))


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens and the share of their space that is used."""
    per = placed.where("container is not null").groupBy("container").agg(F.sum("piece_tokens").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"),
                   F.round(F.try_divide(F.sum("t").cast("double"), F.count(F.lit(1)) * capacity), 6).alias("used_share"))
