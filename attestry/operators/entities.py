"""Entities named by statements: ids, known names, keys, links across batches, merging with undo."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x else x)


def slug(c: str | Column) -> Column:
    """Lower case, compatibility forms folded, runs of other than letters and digits as one underscore."""
    c = F.col(c) if isinstance(c, str) else c
    folded = F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(_nfkc(c))
    return F.regexp_replace(F.regexp_replace(F.lower(folded), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def entity_id(source: str | Column, name: str | Column) -> Column:
    """A repeatable id of a name within a source."""
    s = F.col(source) if isinstance(source, str) else source
    return F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat_ws("\x00", s, slug(name)), 256), 1, 24))


def known(records: DataFrame, mentions: str = "entity_mentions", order: str = "ord") -> DataFrame:
    """(entity_id, surface, canonical_name): the last unambiguous mention of each entity."""
    m = records.select(order, F.explode(mentions).alias("m")).select(order, "m.*").where("entityId is not null and coalesce(decision, '') <> 'ambiguous'")
    last = m.groupBy("entityId").agg(F.max(F.struct(order, "surface", "canonicalName")).alias("l"))
    return last.select(F.col("entityId").alias("entity_id"), "l.surface", F.col("l.canonicalName").alias("canonical_name"))


def keys(records: DataFrame, mentions: str = "entity_mentions") -> DataFrame:
    """(id, key): what links a record with others: ``id:`` of resolved entities and ``name:`` of names, each once."""
    m = records.select("id", F.explode(mentions).alias("m"))
    each = F.array_compact(F.array(F.when(F.col("m.decision") != "ambiguous", F.concat(F.lit("id:"), F.col("m.entityId"))), F.concat(F.lit("name:"), slug("m.canonicalName"))))
    return m.select("id", F.explode(each).alias("key")).where("key not in ('name:', 'id:')").distinct()


def linked(rows: DataFrame, most: int | None = 512) -> DataFrame:
    """(left, right, keys): pairs of rows (id, batch, key) of different batches that share a key, smaller id first.

    Keys in one batch only are left out first.  ``most`` keeps the first pairs in order of ids, as a
    bounded reading list; null keeps all.  With ``most``, only the first ``most`` + 1 ids of each key and
    batch are paired: a pair with a later id comes after at least ``most`` others, so none is lost, and
    no key, however often used, is paired in full.  The keys of the kept pairs are then looked up whole.
    """
    r = rows.select("id", "batch", "key").where("key is not null").distinct()
    several = r.groupBy("key").agg(F.countDistinct("batch").alias("n")).where("n > 1").select("key")
    r = r.join(several, "key", "left_semi")
    first = r if most is None else _first(r, ["key", "batch"], most + 1)
    a, b = first.select(F.col("id").alias("left"), F.col("batch").alias("lb"), "key"), first.select(F.col("id").alias("right"), F.col("batch").alias("rb"), "key")
    pairs = a.join(b, "key").where("left < right and lb <> rb")
    if most is None:
        return pairs.groupBy("left", "right").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    kept = pairs.select("left", "right").distinct().orderBy("left", "right").limit(most)
    x, y = r.select(F.col("id").alias("left"), F.col("batch").alias("lb"), "key"), r.select(F.col("id").alias("right"), F.col("batch").alias("rb"), "key")
    return kept.join(x, "left").join(y, ["right", "key"]).where("lb <> rb").groupBy("left", "right").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def _first(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The ``n`` smallest ids of each group, cut within small parts of a group before the whole."""
    part = Window.partitionBy(*by, "_p").orderBy("id")
    cut = rows.withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
    return cut.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("_r") <= n).drop("_p", "_r")


def merged(facts: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(facts, journal): every argument ``old`` replaced by ``new``; the journal keeps what each changed row was."""
    a, b = f"a:{old}", f"a:{new}"
    hit = F.array_contains("args", a)
    args = F.transform("args", lambda x: F.when(x == a, b).otherwise(x))
    text = F.concat(F.lit("("), F.concat_ws(" ", F.array("pred"), F.transform(args, lambda x: F.substring(x, 3, 1 << 30))), F.lit(")"))
    journal = facts.where(hit).select("id", F.col("args").alias("args_before"), F.col("expr_key").alias("expr_before"))
    return facts.withColumn("expr_key", F.when(hit, text).otherwise(F.col("expr_key"))).withColumn("args", F.when(hit, args).otherwise(F.col("args"))), journal


def restored(facts: DataFrame, journal: DataFrame) -> DataFrame:
    """``facts`` as they were before the merge that wrote ``journal``."""
    j = facts.join(journal, "id", "left")
    return j.withColumn("args", F.coalesce("args_before", "args")).withColumn("expr_key", F.coalesce("expr_before", "expr_key")).select(facts.columns)
