"""The given tables as facts, regions and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import facts as fx
from attestry.functions.text import label
from attestry.scratch import Scratch
from attestry.tables import latest, table


def _fact(df: DataFrame, ident: Column, pred: str, args: list[Column], ord_: Column, **scope: Column) -> DataFrame:
    shown = F.transform(F.array(*args), lambda a: F.substring(a, 3, 1 << 30))
    key = F.concat(F.lit(f"({pred} "), F.array_join(shown, " "), F.lit(")"))
    return fx.facts(df.select(ident.alias("id"), ord_.cast("long").alias("ord"), F.lit(pred).alias("pred"), F.lit(len(args)).alias("arity"), F.array(*args).alias("args"), key.alias("expr_key"), *[c.alias(n) for n, c in scope.items()]))


def atom(c: str) -> Column:
    return F.concat(F.lit("a:"), F.col(c).cast("string"))


def number(c: str) -> Column:
    return F.concat(F.lit("n:"), F.col(c).cast("string"))


def trade(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Facts of the trade tables: in_region, lives_in, ordered_by, pair, region, nation."""
    t = lambda n: table(spark, sf_dir, n)
    made = {
        "in_region": lambda: _fact(t("nation"), F.concat(F.lit("n"), "n_nationkey"), "in_region", [number("n_nationkey"), number("n_regionkey")], F.col("n_nationkey")),
        "nation": lambda: _fact(t("nation"), F.concat(F.lit("nn"), "n_nationkey"), "nation", [number("n_nationkey")], F.col("n_nationkey")),
        "region": lambda: _fact(t("region"), F.concat(F.lit("r"), "r_regionkey"), "region", [number("r_regionkey")], F.col("r_regionkey")),
        "lives_in": lambda: _fact(t("customer"), F.concat(F.lit("c"), "c_custkey"), "lives_in", [number("c_custkey"), number("c_nationkey")], F.col("c_custkey")),
        "ordered_by": lambda: _fact(t("orders"), F.concat(F.lit("o"), "o_orderkey"), "ordered_by", [number("o_orderkey"), number("o_custkey")], F.col("o_orderkey")),
        "pair": lambda: _fact(t("lineitem"), F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber"), "pair", [number("l_partkey"), number("l_suppkey")], F.col("l_orderkey")),
    }
    out = made[names[0]]()
    for n in names[1:]:
        out = out.unionByName(made[n]())
    return out


def did(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as statements (did type user) with the day as time; values below 35 speak against."""
    e = table(spark, sf_dir, "events")
    return _fact(e, F.concat(F.lit("e"), "event_id"), "did", [atom("event_type"), number("user_id")], F.col("event_id"), time=F.date_format("ts", "yyyy-MM-dd"), polarity=F.when(F.col("value") < 35, "negative").otherwise("positive"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that hold, removed ones left out, as facts."""
    p = latest(table(spark, sf_dir, "passages"), "id", ["sourceVersionId", "sourceId", "regionId", "ske", "quote", "lifecycle", "supportState", "polarity", "startChar", "endChar"])
    p = p.where("coalesce(lifecycle, '') <> 'deleted'")
    p = p.select("id", F.col("sourceVersionId").alias("source_version_id"), F.col("sourceId").alias("source_id"), F.col("regionId").alias("region_id"), "ske", "quote", "lifecycle", F.col("supportState").alias("support_state"), "polarity", "startChar", "endChar")
    return p


def passage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read and parsed once, then a table: goals, oppositions and audits each read only the columns they need."""
    return Scratch(spark, "facts").write(fx.facts(fx.parsed(passages(spark, sf_dir), "ske")), "passages")


def finding_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, dep): what findings depend on, in compared form; region references and blanks aside."""
    f = latest(table(spark, sf_dir, "findings"), "id", ["dependencies"])
    return f.select(label("id").alias("id"), F.explode(F.array_distinct(F.transform("dependencies", label))).alias("dep")).where("dep is not null")


def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and findings as (id, source_version_id, source_id, dependencies)."""
    f = latest(table(spark, sf_dir, "findings"), "id", ["dependencies", "sourceVersionId"])
    f = f.select(label("id").alias("id"), F.col("sourceVersionId").alias("source_version_id"), F.lit(None).cast("string").alias("source_id"), F.array_compact(F.array_distinct(F.transform(F.coalesce("dependencies", F.array().cast("array<string>")), label))).alias("dependencies"))
    p = passages(spark, sf_dir).select(label("id").alias("id"), "source_version_id", "source_id", F.array().cast("array<string>").alias("dependencies"))
    return f.unionByName(p)
