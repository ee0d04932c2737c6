"""The training-data problems on the tables of the evidence knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.text import hyphened, words
from attestry.llm import mixing, neardup, packing, pairs, residue, sampling, terms, tokens
from attestry.scratch import Scratch
from attestry.tables import latest, table


def term_counts(spark: SparkSession, sf_dir: str, report_n: int | None) -> DataFrame:
    """Counts and marks of criterion n-grams and category values, from the uncut suffix array."""
    f = latest(table(spark, sf_dir, "findings"), "id", ["criterion"]).select(F.lit("criterion").alias("field"), words("criterion").alias("tokens"))
    q = latest(table(spark, sf_dir, "questions"), "id", ["category"]).select(F.lit("category").alias("field"), F.array(hyphened("category")).alias("tokens"))
    records = f.unionByName(q)
    totals = records.groupBy("field").agg(F.count(F.lit(1)).alias("n_records"))
    return terms.marked(terms.ngrams(records, max_n=None, report_n=report_n), totals)


def document_sizes(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    return tokens.sized(table(spark, sf_dir, "documents").select(*keep, "text"), "text", keep)


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(document_sizes(spark, sf_dir, ["doc_id"]))


def mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rates, sizes): sizes are written once, as both the rates and the mix need them."""
    sizes = Scratch(spark, "mixing").write(document_sizes(spark, sf_dir, ["doc_id", "source"]), "sizes")
    return mixing.rates(sizes, table(spark, sf_dir, "mix_targets")), sizes


def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of the questions of both tables, as they hold."""
    q = latest(table(spark, sf_dir, "questions"), "id", ["question"]).select("id", F.col("question").alias("text"))
    c = latest(table(spark, sf_dir, "checkpoint_items"), "itemId", ["question"]).select(F.col("itemId").alias("id"), F.col("question").alias("text"))
    return q.unionByName(c)


def near_duplicates(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(question_texts(spark, sf_dir))


def balanced_sample(spark: SparkSession, sf_dir: str) -> sampling.BalancedSample:
    q = latest(table(spark, sf_dir, "questions"), "id", ["sourceId", "category"])
    return sampling.BalancedSample(q, table(spark, sf_dir, "category_targets"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question, answer) of both tables, as they hold."""
    q = latest(table(spark, sf_dir, "questions"), "id", ["question", "expected"]).select("id", "question", F.col("expected").alias("answer"))
    c = latest(table(spark, sf_dir, "checkpoint_items"), "itemId", ["question", "answer"]).select(F.col("itemId").alias("id"), "question", "answer")
    return q.unionByName(c)


def broken_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(answered(spark, sf_dir))


def residual_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"))
