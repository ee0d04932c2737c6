"""Mixing sources to target weights with capped repetition (problem 8).

Tokens are summed per source, rates follow from the targets, and each document is emitted
floor(rate) times plus once more with the rate's fraction as probability, drawn from a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import label


def rates(sizes: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Per target source: tokens had and wanted, the repetition rate and whether the source falls short.

    (key, source, target_share, max_uses, tokens, wanted, rate, short).  The mix is as large as all
    documents together, those of other sources and without source included.  Sources are compared
    without case and surrounding white space; a target named twice counts with its largest share.
    A source without documents has rate 0 and is short if anything is wanted of it; null shares or
    uses count as 0.
    """
    per = sizes.groupBy(label(source).alias("key")).agg(F.sum(size).alias("tokens"))
    whole = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("whole")).scalar()
    t = (targets.select(label("source").alias("key"), "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_uses", F.lit(0)).alias("max_uses"))
         .where("key is not null").groupBy("key").agg(F.max(F.struct("target_share", "max_uses", "source")).alias("t")).select("key", "t.source", "t.target_share", "t.max_uses"))
    j = t.join(per, "key", "left").withColumn("whole", whole)
    tokens, wanted = F.coalesce("tokens", F.lit(0)), F.col("target_share") * F.col("whole")
    return j.select("key", "source", "target_share", "max_uses", tokens.alias("tokens"), wanted.alias("wanted"),
                    F.when(tokens > 0, F.least(wanted / tokens, F.col("max_uses").cast("double"))).otherwise(0.0).alias("rate"),
                    (tokens * F.col("max_uses") < wanted).alias("short"))


def mixed(sizes: DataFrame, rate: DataFrame, item: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 42) -> DataFrame:
    """(item, source, n_tokens, copy): every copy of every document in the mix; copies count from 1.

    The draw depends on the document and the seed only, so it is the same however often it is made.
    No document has more copies than max_uses.  Documents of no target source have none.
    """
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(item)), F.lit(1 << 40)) / float(1 << 40)
    r = rate.select(F.col("key").alias("_k"), "rate", F.col("source").alias("_s"))
    times = F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    own = sizes.select(item, F.col(source).alias("_src"), size)
    j = own.join(r, label("_src") == F.col("_k")).withColumn("_n", times).where("_n > 0")
    return j.select(item, F.col("_s").alias("source"), size, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("copy"))


def report(rate: DataFrame, mix: DataFrame, size: str = "n_tokens") -> DataFrame:
    """Per target source: the share wanted, the share reached in the mix, uses and shortfall."""
    got = mix.groupBy("source").agg(F.sum(size).alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_docs"), F.max("copy").alias("most_uses"))
    j = rate.join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_docs", "most_uses"])
    total = got.agg(F.sum("mixed_tokens").alias("mix")).scalar()
    return j.withColumn("mix", total).select("source", "target_share", "max_uses", "tokens", F.round("rate", 9).alias("rate"), "mixed_tokens", "mixed_docs", "most_uses",
                                     F.round(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("mix")), 9).alias("reached_share"), "short")
