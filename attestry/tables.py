"""Reading the tables, and the row that holds for each key."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str | list[str], columns: list[str], order: str = "recordedAt") -> DataFrame:
    """The row with the latest ``order`` of each key, with ``columns`` besides the key.

    Rows with a null in the key name no thing and are left out.  Rows whose ``order`` is null count
    as the earliest.  Rows that tie are told apart by their columns, so the result is repeatable.
    One shuffle on the key; repeated deliveries are combined before it where the plan allows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in columns if c not in keys]
    held = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rest])).alias("_held")
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return known.groupBy(*keys).agg(held).select(*keys, *[F.col(f"_held.{c}").alias(c) for c in rest])


