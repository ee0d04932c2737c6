"""Entity graphs over documents: extraction, co-occurrence, communities, summaries, graph retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.operators.retrieve import BASELINE, top
from attestry.scratch import Scratch

#: Up to three title-case words; word limits are ASCII, which both engines of the comparison share.
TITLE = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}(?![A-Za-z0-9_])"

# Title-case phrases of a library's own frame, which are no names.
DENY = ["The Project Gutenberg", "Project Gutenberg", "The End"]


def entities(docs: DataFrame, id: str = "id", text: str = "text", most: int = 40, deny: list[str] | None = DENY) -> DataFrame:
    """(id, entity, pos): the first ``most`` different title-case names of each document."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TITLE), F.lit(0)))
    if deny:
        found = F.array_except(found, F.array(*[F.lit(d) for d in deny]))
    return docs.select(F.col(id).alias("id"), F.posexplode(F.slice(found, 1, most)).alias("pos", "entity"))


def cooccurrence(ents: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(a, b, weight) with a < b: documents that name both, plus 2 per stated relation (subject, object).

    Pairs are made within a document's bounded list, not by a join, and summed before the shuffle.
    """
    lists = ents.groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias("e"))
    pairs = lists.select(F.explode(F.expr("flatten(transform(e, (x, i) -> transform(slice(e, i + 2, size(e)), y -> struct(x as a, y as b))))")).alias("p")).select("p.*")
    e = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    if relations is not None:
        r = relations.where("subject is not null and object is not null").select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"))
        e = e.unionByName(r.groupBy("a", "b").agg((F.count(F.lit(1)) * 2).alias("weight"))).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    return e


def modularity(edges: DataFrame, homes: DataFrame) -> float:
    """Modularity of the communities ``homes`` (entity, community) over ``edges`` (a, b, weight); 0 without edges."""
    e = edges.where("a != b").select("a", "b", F.col("weight").cast("double").alias("weight"))
    h = homes.select("entity", "community")
    e = e.join(h.toDF("a", "ca"), "a").join(h.toDF("b", "cb"), "b")
    ends = e.select("weight", (F.col("ca") == F.col("cb")).alias("inside"), F.explode(F.array("ca", "cb")).alias("c"))
    per = ends.groupBy("c").agg(F.sum("weight").alias("t"), F.sum(F.when(F.col("inside"), F.col("weight"))).alias("w"))
    r = per.agg(F.sum("t").alias("m2"), F.sum("w").alias("w"), F.sum(F.col("t") * F.col("t")).alias("tt")).first()
    return (r.w or 0.0) / r.m2 - r.tt / r.m2**2 if r.m2 else 0.0


def communities(edges: DataFrame, nodes: DataFrame | None = None, least: float = 1e-4) -> DataFrame:
    """(entity, community): modularity moves until a round of them raises modularity by less than ``least``; with 0, until no move of one name to a neighbour's community raises it at all.

    A community is named by its first name.  Names of ``nodes`` (entity) without an edge are communities
    of their own.  In a round each name finds its best community and some of those that gain move at
    once: a half of them, chosen by a hash.  A round counts only if modularity rose; after one that did
    not a smaller part moves, at last only best moves that share no community, whose gains add up
    exactly.  So modularity rises with each round, and the rounds end without a limit on their number.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "communities")
    ends = edges.select(F.explode(F.array("a", "b")).alias("entity"))
    names = (ends if nodes is None else ends.unionByName(nodes.select("entity"))).where("entity is not null").distinct()
    # Ids in the order of the names, so that ties don't depend on how the names are spread.
    names = scratch.write(names.orderBy("entity").select("entity", F.monotonically_increasing_id().alias("k")), "names")
    e = edges.where("a != b").select("a", "b", F.col("weight").cast("double").alias("weight"))
    e = e.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select("x", "y", "weight")
    e = scratch.write(e, "edges")
    both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"), "weight"))
    degree = both.groupBy("x").agg(F.sum("weight").alias("d"))
    start = names.join(degree, F.col("k") == F.col("x")).select("k", F.col("k").alias("c"), "d", F.xxhash64("entity").alias("h"))
    m2 = degree.agg(F.sum("d")).first()[0]
    if not m2:
        return names.select("entity", F.col("entity").alias("community"))

    def judged(state: DataFrame, name: str) -> tuple[DataFrame, float, int]:
        """The state with each name's best other community and gain, its modularity, and how many names want to move."""
        at = state
        total = at.groupBy("c").agg(F.sum("d").alias("t"))
        pull = both.join(at.select(F.col("k").alias("y"), "c"), "y").groupBy("x", "c").agg(F.sum("weight").alias("w")).join(total, "c")
        own = at.join(total, "c").select("k", F.col("c").alias("c0"), "d", "h", F.col("t").alias("t0"))
        j = pull.join(own, F.col("x") == F.col("k"))
        other = F.col("c") != F.col("c0")
        g = F.col("w") - F.col("d") * F.col("t") / m2
        per = j.groupBy("k", "c0", "d", "h", "t0").agg(
            F.max(F.when(other, F.struct(g.alias("g"), (-F.col("c")).alias("c")))).alias("best"), F.sum(F.when(~other, F.col("w")).otherwise(0.0)).alias("w0"))
        stay = F.col("w0") - F.col("d") * (F.col("t0") - F.col("d")) / m2
        per = per.withColumn("gain", F.coalesce(F.col("best.g") - stay, F.lit(0.0)))
        out = per.select("k", F.col("c0").alias("c"), "d", "h", (-F.col("best.c")).alias("to"), "gain", "w0", (F.col("gain") > 1e-9 + 1e-13 * F.col("d")).alias("wants"))
        out = scratch.write(out, name)
        r = out.agg(F.sum("w0"), F.count_if("wants")).first()
        tt = out.groupBy("c").agg(F.sum("d").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
        return out, r[0] / m2 - tt / m2 / m2, r[1]

    def moved(state: DataFrame, go) -> DataFrame:
        return state.select("k", F.when(go, F.col("to")).otherwise(F.col("c")).alias("c"), "d", "h")

    now, q, wanting = judged(start, "state_0")
    i = kept = 0
    halvings = 1
    while wanting:
        i += 1
        alone = wanting >> halvings == 0
        if alone:
            w = now.where("wants").select("k", F.struct((-F.col("gain")).alias("g"), "k").alias("r"), F.explode(F.array("c", "to")).alias("c"))
            first = w.groupBy("c").agg(F.min("r").alias("r")).groupBy(F.col("r.k").alias("m")).count().where("count = 2").select("m")
            step = moved(now.join(first, F.col("k") == F.col("m"), "left"), F.col("m").isNotNull())
        else:
            step = moved(now, F.col("wants") & (F.pmod(F.xxhash64("h", F.lit(i)), F.lit(1 << halvings)) == 0))
        new, q_new, n = judged(step, f"state_{i}")
        if alone or q_new > q + 1e-12:
            scratch.drop(f"state_{kept}")
            slow = q_new - q < least
            now, q, wanting, kept, halvings = new, q_new, n, i, max(1, halvings - 1)
            if slow:
                break
        else:
            scratch.drop(f"state_{i}")
            halvings += 1
    homes = names.join(now.select("k", "c"), "k", "left").withColumn("c", F.coalesce("c", "k"))
    first = homes.groupBy("c").agg(F.min("entity").alias("community"))
    return homes.join(first, "c").select("entity", "community")


def inside(relations: DataFrame, homes: DataFrame, most: int = 20) -> DataFrame:
    """(community, relations): up to ``most`` stated relations (subject, predicate, object) between names of one community, in order."""
    a, b = homes.select(F.col("entity").alias("subject"), "community"), homes.select(F.col("entity").alias("object"), F.col("community").alias("_c"))
    r = relations.select("subject", "predicate", "object").distinct().join(a, "subject").join(b, "object").where("community = _c")
    said = F.concat_ws(" ", "subject", "predicate", "object")
    rank = F.row_number().over(Window.partitionBy("community").orderBy("said"))
    r = r.select("community", said.alias("said")).distinct().withColumn("r", rank).where(F.col("r") <= most)
    return r.groupBy("community").agg(F.array_sort(F.collect_list("said")).alias("relations"))


def summaries(ents: DataFrame, homes: DataFrame, docs: DataFrame, central: int = 12, passages: int = 4, relations: DataFrame | None = None) -> DataFrame:
    """(community, n_documents, entities, summary): the names in most documents, stated relations between them and the first passages."""
    e = ents.join(homes, "entity")
    size = e.groupBy("community").agg(F.countDistinct("id").alias("n_documents"))
    per = e.groupBy("community", "entity").agg(F.countDistinct("id").alias("n"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "entity"))
    names = per.withColumn("r", rank).where(F.col("r") <= central).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "entity"))), lambda s: s["entity"]).alias("entities"))
    d = e.select("community", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("id"))).where(F.col("r") <= passages)
    text = d.join(docs.select("id", "text"), "id").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda s: s["text"]), " ").alias("passages"))
    j = names.join(text, "community").join(size, "community")
    j = j.join(inside(relations, homes), "community", "left") if relations is not None else j.withColumn("relations", F.lit(None).cast("array<string>"))
    stated = F.when(F.size("relations") > 0, F.concat(F.lit("Relations: "), F.array_join("relations", "; "), F.lit(".")))
    return j.select("community", "n_documents", "entities", F.concat_ws(" ", F.concat(F.lit("Names: "), F.array_join("entities", ", "), F.lit(".")), stated, "passages").alias("summary"))


def graph_scores(ents: DataFrame, homes: DataFrame, summary: DataFrame, query: str, k: int = 10, best: int = 4, weight: float = 0.1) -> DataFrame:
    """(id, score, rank): documents of the ``best`` communities by query terms in their summaries.

    A document scores the query terms contained in its entities plus ``weight`` times its best community's score.
    """
    spark = ents.sparkSession
    q = [r[0] for r in spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(BASELINE.column("q")))).collect()]
    if not q:
        return ents.where("false").select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    terms = F.array(*[F.lit(t) for t in q])
    s = summary.select("community", F.size(F.array_intersect(BASELINE.column("summary"), terms)).alias("hits")).orderBy(F.desc("hits"), "community").limit(best)
    docs = ents.join(homes, "entity").join(s, "community").groupBy("id").agg(F.max("hits").alias("hits"))
    overlap = F.size(F.filter(terms, lambda t: F.contains(F.lower("entity"), t)))
    per = ents.select("id", overlap.alias("o")).groupBy("id").agg(F.sum("o").alias("o"))
    return top(docs.join(per, "id").select("id", (F.col("o") + weight * F.col("hits")).alias("score")), k)
