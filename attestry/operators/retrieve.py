"""Retrieval: scoped BM25, exact dense search, rank fusion, expansion, and reading within a budget.

Documents are rows with an id, a text and, where ties are broken by order, ``ord``.  Scope is a filter
before any statistic, as document frequencies depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.functions.text import ASCII_TOKEN, SEARCH_TOKEN, tokens
from attestry.operators import scan
from attestry.scratch import Scratch

# Words the two searches leave out.
STOP_A = "the a an and or of to in on for is are was were be by as at with from that this it".split()
STOP_B = (
    "the a an and or but of to in on at for from with by as is are was were be been being this that these those it its he she they them their his her you your we our "
    "what which who when where how why does did do into out up down then than if because while after before over under about not yes no"
).split()


@dataclass(frozen=True)
class Analyzer:
    """How text becomes search terms: the pattern of tokens, the stop list, the least length, and whether a query's repeated terms count once."""

    pattern: str
    stop: tuple[str, ...]
    least: int = 1
    distinct_query: bool = False

    def column(self, text: str | Column) -> Column:
        stop = F.array(*[F.lit(w) for w in self.stop])
        return F.filter(tokens(text, self.pattern), lambda t: ~F.array_contains(stop, t) & (F.length(t) >= self.least))


SCOPED = Analyzer(SEARCH_TOKEN, tuple(STOP_A))
BASELINE = Analyzer(ASCII_TOKEN, tuple(STOP_B), 2, True)


def frequencies(docs: DataFrame, analyzer: Analyzer, id: str = "id", text: str = "text") -> DataFrame:
    """(id, dl, term, tf): the terms of each document with its length; documents without terms have none."""
    t = docs.select(F.col(id).alias("id"), analyzer.column(text).alias("ts")).withColumn("dl", F.size("ts"))
    return t.select("id", "dl", F.explode("ts").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, analyzer: Analyzer = SCOPED, k1: float = 1.2, b: float = 0.75, id: str = "id", text: str = "text") -> DataFrame:
    """(query_id, id, score) for every document that shares a term with a query (query_id, query).

    Document frequencies are counted for the queries' terms only, and only those terms' postings are
    joined; the number of documents and their mean length come from one pass.  A query's terms count
    as often as it repeats them unless the analyzer says otherwise.
    """
    q = queries.select("query_id", F.explode(analyzer.column("query")).alias("term"))
    q = q.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
    q = q.withColumn("qn", F.lit(1)) if analyzer.distinct_query else q
    sized = docs.select(F.col(id).alias("id"), analyzer.column(text).alias("ts"))
    whole = sized.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("avgdl")).alias("w")).scalar()
    asked = q.select("term").distinct()
    tf = (sized.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(asked, "term", "left_semi")
          .groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    df = document_frequency(tf)
    j = tf.join(df, "term").join(q, "term").withColumn("w", whole)
    idf = F.ln(1 + (F.col("w.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qn") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("w.avgdl")))
    return j.groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")


def top(scored: DataFrame, k: int, score: str = "score", by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """The ``k`` best rows per ``by`` with their rank; equal scores (to ten digits) in the order of ``ties``.

    A first cut within each of many small parts of a group precedes the exact one, so no group, however
    large, is sorted whole in one task.
    """
    by, ties = by or [], ties or ["id"]
    order = [F.desc(F.round(score, 10)), *[F.asc(t) for t in ties]]
    part = F.pmod(F.xxhash64(*ties), F.lit(64)).alias("_p")
    first = scored.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order))).where(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).drop("_p", "_r")


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays in double precision; 0 where either has no length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def dense(vectors: DataFrame, queries: DataFrame, k: int, id: str = "id", vector: str = "vector", block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): the exact ``k`` nearest by cosine for stated queries (query_id, query_vector).

    Queries are taken in blocks of about ``block`` rows, one on the driver at a time; each block is one
    pass over all vectors in which every task multiplies its rows with the block and keeps its own best,
    so what is shuffled is k rows per query and task.  Vectors of another length than the block's, or
    null, are not comparable and left out.
    """
    scratch = Scratch(vectors.sparkSession, "dense")
    stated = queries.select("query_id", "query_vector").where("query_vector is not null")
    blocks = max(1, -(-stated.count() // block))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema[id].dataType.simpleString()}, score double"
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")).where("v is not null")
    out = None
    for i in range(blocks):
        part = stated.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()  # about `block` rows
        for dim in sorted({len(r[1]) for r in part}):
            own = [r for r in part if len(r[1]) == dim]
            near = rows.mapInPandas(_nearest([r[0] for r in own], np.array([r[1] for r in own], dtype=np.float64), k), schema)
            near = near if blocks == 1 else scratch.write(top(near, k, by=["query_id"]).drop("rank"), f"block_{i}_{dim}")
            out = near if out is None else out.unionByName(near)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    return top(out, k, by=["query_id"])


def _nearest(ids: list, mat: np.ndarray, k: int):
    mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)

    def near(batches):
        best = None
        for b in batches:
            b = b[b["v"].map(len) == mat.shape[1]]
            for at in range(0, len(b), 4096):
                c = b.iloc[at : at + 4096]
                v = np.array(c["v"].to_list(), dtype=np.float64)
                s = ((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)) @ mat.T).round(12)
                # Per query the k best of this piece; ties by id are settled among all that reach the k-th score.
                take = np.ones_like(s, dtype=bool) if len(c) <= k else s.round(10) >= np.partition(s.round(10), len(c) - k, axis=0)[len(c) - k]
                r, q = np.nonzero(take)
                new = pd.DataFrame({"query_id": np.array(ids, dtype=object)[q], "id": c["id"].to_numpy()[r], "score": s[r, q]})
                best = new if best is None else pd.concat([best, new])
                best = best.assign(_s=best["score"].round(10)).sort_values(["query_id", "_s", "id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k).drop(columns="_s")
        if best is not None:
            yield best

    return near


def fused(first: DataFrame, second: DataFrame, k: int, base: int = 60, missing: int = 10_000) -> DataFrame:
    """(query_id, id, score, rank): reciprocal-rank fusion of two ranked lists (query_id, id, rank); an absent rank counts as ``missing``."""
    a = first.select("query_id", "id", F.col("rank").alias("r1"))
    b = second.select("query_id", "id", F.col("rank").alias("r2"))
    score = 1.0 / (base + F.coalesce("r1", F.lit(missing))) + 1.0 / (base + F.coalesce("r2", F.lit(missing)))
    return top(a.join(b, ["query_id", "id"], "full").withColumn("score", score), k, by=["query_id"])


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, rerank_k: int = 12, rerank=None) -> DataFrame:
    """Lexical and dense lists fused, then reranked by an optional ``rerank(DataFrame) -> DataFrame`` that sets ``score``."""
    depth = max(4 * k, rerank_k)
    lexical = top(bm25(docs, queries, BASELINE), depth, by=["query_id"])
    both = fused(lexical, dense(vectors, queries, depth), rerank_k)
    if rerank is None:
        return both.where(F.col("rank") <= k)
    return top(rerank(both).drop("rank"), k, by=["query_id"])


def expanded(docs: DataFrame, query: str, rounds: int = 3, k: int = 10, decide=None) -> DataFrame:
    """(id, score): search, take two new long terms from the best four hits, search again; later scores hold.

    ``decide(hits)`` may name the terms instead.  Only the at most four best texts reach the driver.
    """
    spark, seen, best, active = docs.sparkSession, None, None, query
    known = {r[0] for r in spark.createDataFrame([(query,)], "q string").select(F.explode(BASELINE.column("q"))).collect()}
    for i in range(rounds):
        q = spark.createDataFrame([("q", active)], "query_id string, query string")
        hits = top(bm25(docs, q, BASELINE), k, by=["query_id"]).select("id", "score", "rank")
        now = hits.select("id", "score", F.lit(i).alias("round"))
        seen = now if seen is None else seen.unionByName(now)
        if i == rounds - 1:
            break
        if decide is not None:
            new = decide(hits)
        else:
            rows = hits.where("rank <= 4").join(docs, "id").select("rank", BASELINE.column("text").alias("ts")).orderBy("rank").collect()
            new = []
            for r in rows:
                for t in r.ts:
                    if len(new) < 2 and len(t) > 4 and t not in known:
                        known.add(t)
                        new.append(t)
        if not new:
            break
        active = f"{query} {' '.join(new)}"
    best = seen.groupBy("id").agg(F.max_by("score", "round").alias("score"))
    return top(best, k).select("id", "score", "rank")


def within_budget(regions: DataFrame, budget: int, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Regions in order until ``budget`` characters per ``by``; the last one cut to what is left."""
    parts = scan.spread(regions, by, order)
    r = scan.running(parts, by, order, F.length(text), "_used").withColumn("_used", F.coalesce("_used", F.lit(0)))
    r = r.where((F.col("_used") < budget) & (F.length(text) > 0))
    return r.withColumn(text, F.substring(F.col(text), F.lit(1), F.lit(budget) - F.col("_used"))).select(regions.columns)
