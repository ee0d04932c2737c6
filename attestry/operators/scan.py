"""Ordered computations within groups of any size: running sums and maxima, ranks, neighbours.

A plain window keeps a whole group in one task, which a hot group turns into the slowest.  Here rows are
first spread by range over (group, order), so a hot group lies in many parts; each part is computed on
its own, and what crosses part borders is carried by a small table with one row per group and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.scratch import Scratch

PART = "_part"


def spread(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned by group and order and written, with the part each row is in.

    ``parts`` fixes their number; else it follows from the data's size.
    ``order`` must tell the rows of a group apart, else rows that tie across a border stand in either part.
    """
    count = [] if parts is None else [parts]
    ranged = df.repartitionByRange(*count, *by, *order).withColumn(PART, F.spark_partition_id())
    return Scratch(df.sparkSession, "scan").write(ranged, "parts")


def _inner(by: list[str], order: list[str]):
    return Window.partitionBy(*by, PART).orderBy(*order)


def _before(by: list[str]):
    return Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def _keys(by: list[str], left: DataFrame, right: DataFrame) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the null-safe condition that joins it."""
    for k in (*by, PART):
        right = right.withColumnRenamed(k, f"_k_{k}")
    on = left[PART] == right[f"_k_{PART}"]
    for k in by:
        on = on & left[k].eqNullSafe(right[f"_k_{k}"])
    return right, on


def running(parts: DataFrame, by: list[str], order: list[str], value: Column, name: str, how: str = "sum") -> DataFrame:
    """``parts`` (from ``spread``) with ``name``: sum or max of ``value`` over the rows before each in its group; null for the first."""
    agg = {"sum": F.sum, "max": F.max}[how]
    local = parts.withColumn(name, agg(value).over(_inner(by, order).rowsBetween(Window.unboundedPreceding, -1)))
    carry = parts.groupBy(*by, PART).agg(agg(value).alias("_v")).withColumn("_carry", agg("_v").over(_before(by))).drop("_v")
    carry, on = _keys(by, local, carry)
    joined = local.join(carry, on, "left")
    both = F.greatest(name, "_carry") if how == "max" else F.when(F.col(name).isNull() & F.col("_carry").isNull(), None).otherwise(F.coalesce(name, F.lit(0)) + F.coalesce("_carry", F.lit(0)))
    return joined.withColumn(name, both).select(*parts.columns, name)


def rank(parts: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``parts`` with each row's position in its group, from 1."""
    return running(parts, by, order, F.lit(1), name).withColumn(name, F.coalesce(name, F.lit(0)) + 1)


def neighbours(parts: DataFrame, by: list[str], order: list[str], column: str, before: str = "before", after: str = "after") -> DataFrame:
    """``parts`` with the value of ``column`` in the rows before and after in the group; null at its ends."""
    w = _inner(by, order)
    local = parts.withColumn(before, F.lag(column).over(w)).withColumn(after, F.lead(column).over(w)).withColumn("_n", F.row_number().over(w)).withColumn("_z", F.row_number().over(Window.partitionBy(*by, PART).orderBy(*[F.desc(o) for o in order])))
    at = F.struct(*order, F.col(column).alias("_c"))
    edge = parts.groupBy(*by, PART).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    g = Window.partitionBy(*by).orderBy(PART)
    edge = edge.select(*by, PART, F.lag("_last").over(g)["_c"].alias("_b"), F.lead("_first").over(g)["_c"].alias("_a"))
    edge, on = _keys(by, local, edge)
    j = local.join(edge, on, "left")
    return j.withColumn(before, F.when(F.col("_n") == 1, F.col("_b")).otherwise(F.col(before))).withColumn(after, F.when(F.col("_z") == 1, F.col("_a")).otherwise(F.col(after))).select(*parts.columns, before, after)
