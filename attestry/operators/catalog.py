"""Catalogues and checks over facts, texts and questions: vocabulary, postings, pages, sentences, quotes, reviews, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import facts as fx
from attestry.operators import scan


def vocabulary(facts: DataFrame) -> DataFrame:
    """(pred, arity, n, example): predicates in use with how often and their first example."""
    return facts.groupBy("pred", F.col("arity").cast("long").alias("arity")).agg(F.count(F.lit(1)).alias("n"), F.min("expr_key").alias("example"))


def postings(facts: DataFrame) -> DataFrame:
    """(pred, position, arg, id): where each plain word stands as an argument."""
    a = facts.select("id", "pred", F.posexplode("args").alias("position", "arg")).where("arg like 'a:%'")
    return a.select("pred", F.col("position").cast("long").alias("position"), F.substring("arg", 3, 1 << 30).alias("arg"), "id").distinct()


def candidates(posted: DataFrame, wanted: list[tuple[str, int, str]]) -> DataFrame:
    """(id): facts on the posting lists of all ``wanted`` (predicate, position, word); none wanted, none found.

    One pass and one count per fact instead of a join per list.
    """
    if not wanted:
        return posted.where("false").select("id")
    of = reduce(lambda a, b: a | b, [(F.col("pred") == p) & (F.col("position") == i) & (F.col("arg") == w) for p, i, w in set(wanted)])
    return posted.where(of).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(wanted))).select("id")


def page(df: DataFrame, order: list[str | Column], offset: int, limit: int) -> DataFrame:
    """``limit`` rows in order, after ``offset`` of them; ``order`` should be total."""
    return df.orderBy(*order).offset(offset).limit(limit)


def newest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The rows of each key whose version is the largest as a string; null versions come last."""
    top = df.groupBy(*key).agg(F.max(version).alias("_v"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key] + [F.col(f"a.{version}").eqNullSafe(F.col("b._v"))]
    return df.alias("a").join(top.alias("b"), same, "left_semi")


def duplicates(df: DataFrame, text: str) -> DataFrame:
    """(normal, n): texts that occur more than once when case and white space don't count; blank ones aside."""
    normal = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    return df.select(normal.alias("normal")).where("normal <> ''").groupBy("normal").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: A capital, then so much within one line and sentence that the whole has 40 to 240 characters.
SENTENCE = r"[A-Z][^.!?\n]{38,238}[.!?]"


def sentences(docs: DataFrame, id: str, text: str = "text") -> DataFrame:
    """(id, pos, sentence): sentences of 40 to 240 characters, in order, from 0."""
    s = docs.select(F.col(id).alias("id"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), F.lit(0))).alias("pos", "sentence"))
    return s.select("id", F.col("pos").cast("long").alias("pos"), "sentence")


def anchors(rows: DataFrame, by: list[str], order: list[str], n: int = 4) -> DataFrame:
    """``rows`` at ``n`` evenly spaced places of each group's order: those where the n-th parts begin anew."""
    parts = scan.spread(rows, by, order)
    ranked = scan.rank(parts, by, order, "_i").withColumn("_i", F.col("_i") - 1)
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    j = ranked.join(size, by)
    return j.where((F.col("_n") <= n) | (F.floor((F.col("_i") + 1) * n / F.col("_n")) > F.floor(F.col("_i") * n / F.col("_n")))).select(*rows.columns)


def quote_at(text: Column, quote: Column) -> tuple[Column, Column]:
    """(start, end) of a quote in a text, any white space standing for any other; null where it isn't there or blank."""
    words = F.filter(F.split(F.trim(F.regexp_replace(quote, r"(?U)\s+", " ")), " "), lambda w: w != "")
    pattern = F.concat(F.lit("(?U)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), "\\s+"))
    at = F.when(F.size(words) > 0, F.regexp_instr(text, pattern))
    start = F.when(at > 0, at - 1)
    return start, start + F.length(F.regexp_substr(text, pattern))


def usage(df: DataFrame, by: list[str], counts: str) -> DataFrame:
    """(by, counts): maps of counters added up key by key; null values count as 0, groups of empty or null maps have an empty one."""
    each = df.select(*by, F.explode_outer(counts).alias("_k", "_v")).groupBy(*by, "_k").agg(F.sum(F.coalesce("_v", F.lit(0))).alias("_v"))
    entries = F.array_compact(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v"))))
    return each.groupBy(*by).agg(F.map_from_entries(entries).alias(counts))


def rolled_up(rows: DataFrame, by: list[str], fine: Column, value: str) -> DataFrame:
    """(by, value): the sum over the ``fine`` rows of each group; groups without any fall back to their other rows."""
    v = F.coalesce(F.col(value), F.lit(0))
    s = rows.groupBy(*by).agg(F.count_if(fine).alias("_n"), F.sum(F.when(fine, v)).alias("_fine"), F.sum(F.when(~F.coalesce(fine, F.lit(False)), v)).alias("_rest"))
    return s.select(*by, F.when(F.col("_n") > 0, F.col("_fine")).otherwise(F.col("_rest")).alias(value))


def project_report(facts: DataFrame, by: str = "source_version_id") -> DataFrame:
    """(by, records, excluded, supported, unsupported): records by lifecycle, and the live ones by whether they can be used."""
    dead = F.coalesce(F.col("lifecycle").isin(fx.DEAD), F.lit(False))
    use = F.coalesce(fx.usable(), F.lit(False))
    return facts.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.count_if(dead).alias("excluded"), F.count_if(~dead & use).alias("supported"), F.count_if(~dead & ~use).alias("unsupported"))


def review_problems(asked: DataFrame, reviewed: DataFrame, id: str = "id") -> DataFrame:
    """(id, problem): rows of a review that came back ``unknown`` or ``duplicate``, and those that are ``missing``; blank ids are unknown."""
    key = F.nullif(F.trim(F.col(id).cast("string")), F.lit(""))
    a, r = asked.select(key.alias("id")).where("id is not null").distinct(), reviewed.select(key.alias("id"))
    n = r.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(a.withColumn("known", F.lit(True)), "id", "left")
    back = n.select("id", F.when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "duplicate").alias("problem")).where("problem is not null")
    return back.unionByName(a.join(r.where("id is not null").distinct(), "id", "left_anti").select("id", F.lit("missing").alias("problem")))


def gold_spans(gold: DataFrame, regions: DataFrame) -> DataFrame:
    """(gold_id, region_id, start, end, how): the regions that gold spans stand for, clipped to them.

    ``gold`` has gold_id, source_version_id, region_id, start, end, quote, any of the last four null;
    ``regions`` region_id (unique in a source version), source_version_id, start, end, text.  The first of
    these that gives any region holds: the same ``id``, an ``overlap`` of offsets, a text that contains the
    ``quote``.  A span without offsets takes its region's.  Overlaps are looked for in buckets.
    """
    r = regions.select(F.col("region_id").alias("r_id"), "source_version_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("text").alias("r_text"))
    by_id = gold.join(r, (gold.region_id == r.r_id) & (gold.source_version_id == r.source_version_id)).drop(r.source_version_id).withColumn("how", F.lit("id"))
    rest = gold.join(by_id.select("gold_id").distinct(), "gold_id", "left_anti")
    width = 4096
    cells = lambda d, a, b: d.where(f"{a} < {b}").withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))))
    near = cells(rest, "start", "end").join(cells(r, "r_start", "r_end"), ["source_version_id", "_b"]).where("start < r_end and r_start < end")
    near = near.drop("_b").dropDuplicates(["gold_id", "r_id"]).withColumn("how", F.lit("overlap"))
    last = rest.join(near.select("gold_id").distinct(), "gold_id", "left_anti").where("trim(quote) <> ''")
    quoted = last.join(r, "source_version_id").where(F.contains("r_text", "quote"))
    at = F.col("r_start") + F.expr("locate(quote, r_text)") - 1
    quoted = quoted.withColumn("start", at).withColumn("end", at + F.length("quote")).withColumn("how", F.lit("quote"))
    cols = ["gold_id", "r_id", "start", "end", "r_start", "r_end", "how"]
    every = by_id.select(*cols).unionByName(near.select(*cols)).unionByName(quoted.select(*cols))
    # Offsets beyond the region say nothing about it: the whole region counts.
    inside = F.coalesce((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")), F.lit(False))
    return every.select("gold_id", F.col("r_id").alias("region_id"), F.when(inside, F.greatest("start", "r_start")).otherwise(F.col("r_start")).cast("long").alias("start"),
                        F.when(inside, F.least("end", "r_end")).otherwise(F.col("r_end")).cast("long").alias("end"), "how")
