"""Structured Streaming: each arriving batch processed once, with what it made stale.

A processed-once ledger, invalidation on change, a hook that runs on arrival, and windowed counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry.operators import closure
from attestry.storage import Files


def ingest(stream: DataFrame, target: str, checkpoint: str, key: list[str], on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends each batch to ``target`` and calls ``on_batch`` with what was new in it.

    One folder per batch, rewritten if the batch is retried; keys of earlier batches are left out, so
    nothing comes twice, whether in a batch, by a retry or in a later batch.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        before = [f for f in Files(spark, target).names("") if f.startswith("batch=") and int(f.removeprefix("batch=")) < n]
        if before:
            done = spark.read.parquet(*[f"{target}/{f}" for f in before]).select(*[F.col(k).alias(f"_{k}") for k in key])
            new = new.join(done, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left_anti")
        new.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{target}/batch={n}")
        if on_batch:
            on_batch(spark.read.parquet(f"{target}/batch={n}"), n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(chunks: DataFrame, ledger: DataFrame | None, key: str = "chunk_id") -> DataFrame:
    """Chunks without a ``processed`` row in the ledger."""
    return chunks if ledger is None else chunks.join(ledger.where("state = 'processed'").select(key).distinct(), key, "left_anti")


def stale_on_change(records: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, reason) for a batch of changes (kind, id), kind being ``version`` or ``record``."""
    return closure.stale(records, changes.where("kind = 'version'").select("id"), changes.where("kind = 'record'").select("id"))


def counts_by_window(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Event counts per window and key, on a stream or a table; rows later than ``late`` behind the newest are dropped by a stream only."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(F.col(ts), width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def parquet_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
