"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.llm import knowledge, mixing, packing, sql
from attestry.scratch import Scratch
from attestry.tables import table


def p1_found(spark, sf_dir):
    return knowledge.balanced_sample(spark, sf_dir).report.where("unmet = 'supply'").select("source_id", "category")


def p1_sample(spark, sf_dir):
    return knowledge.balanced_sample(spark, sf_dir).sample


def p1_report(spark, sf_dir):
    return knowledge.balanced_sample(spark, sf_dir).report


def p1_supply(spark, sf_dir):
    """What each source has of what is wanted of it."""
    return knowledge.balanced_sample(spark, sf_dir).report.select("source_id", "category", "wanted", "available", F.col("unmet").eqNullSafe("supply").alias("lacks"))


def p1_totals(spark, sf_dir):
    """Size of each source's sample and how many different records it holds; none for sources without any eligible record."""
    return knowledge.balanced_sample(spark, sf_dir).sample.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_sampled"), F.countDistinct("id").alias("n_ids"))


def p3_found(spark, sf_dir):
    return knowledge.near_duplicates(spark, sf_dir).record_pairs()


def p3_groups(spark, sf_dir):
    return knowledge.near_duplicates(spark, sf_dir).groups()


def p5_found(spark, sf_dir):
    return knowledge.term_counts(spark, sf_dir, 1).where("mark is not null").select("field", F.col("ngram").alias("term"), "mark")


def p5_terms(spark, sf_dir):
    return knowledge.term_counts(spark, sf_dir, 1).select("field", F.col("ngram").alias("term"), "occurrences", "records", "mark")


def p5_ngrams(spark, sf_dir):
    return knowledge.term_counts(spark, sf_dir, 5).where("field = 'criterion'").select("field", "ngram", "n", "occurrences", "records")


def p5_all_ngrams(spark, sf_dir):
    """The n-grams of p5_ngrams and all longer ones."""
    return knowledge.term_counts(spark, sf_dir, None).where("field = 'criterion'").select("field", "ngram", "n", "occurrences", "records")


def p6_found(spark, sf_dir):
    return knowledge.broken_pairs(spark, sf_dir)


def p6_by_kind(spark, sf_dir):
    return knowledge.broken_pairs(spark, sf_dir).groupBy("defect").agg(F.count(F.lit(1)).alias("n_pairs"))


def p7_found(spark, sf_dir):
    return knowledge.packed_documents(spark, sf_dir).where("n_pieces > 1").select("doc_id").distinct()


def p7_packed(spark, sf_dir):
    return knowledge.packed_documents(spark, sf_dir)


def p7_fill(spark, sf_dir):
    return packing.fill(knowledge.packed_documents(spark, sf_dir))


def p7_bounds(spark, sf_dir):
    """Nothing lost, doubled, overfull or split without need, and hardly more containers than the tokens fill."""
    sizes = Scratch(spark, "packing").write(knowledge.document_sizes(spark, sf_dir, ["doc_id"]), "sizes")
    return packing.bounds(sizes, Scratch(spark, "packing").write(packing.packed(sizes), "placed"))


def p8_found(spark, sf_dir):
    """From the report on the mix that is made."""
    rate, sizes = knowledge.mix(spark, sf_dir)
    return mixing.report(rate, mixing.mixed(sizes, rate)).where("short").select("source")


def p8_bounds(spark, sf_dir):
    """Per target source whether no document of it is used more than max_uses times, nor other than rate down or up."""
    rate, sizes = knowledge.mix(spark, sf_dir)
    uses = mixing.mixed(sizes, rate).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses")).groupBy("source").agg(F.max("uses").alias("most"), F.min("uses").alias("fewest"))
    j = rate.join(uses, "source", "left")
    kept = F.coalesce((F.col("most") <= F.least(F.col("max_uses"), F.ceil("rate"))) & (F.col("fewest") >= F.greatest(F.lit(1), F.floor("rate"))), F.lit(True))
    return j.select("source", kept.alias("uses_kept"))


def p8_mix(spark, sf_dir):
    rate, sizes = knowledge.mix(spark, sf_dir)
    return mixing.mixed(sizes, rate)


def p8_report(spark, sf_dir):
    rate, sizes = knowledge.mix(spark, sf_dir)
    return mixing.report(rate, mixing.mixed(sizes, rate))


def p9_found(spark, sf_dir):
    return knowledge.residual_documents(spark, sf_dir).select("doc_id").distinct()


def p9_kept(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.join(knowledge.residual_documents(spark, sf_dir).select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", "n_chars")


QUERIES = {
    "p1_found": (p1_found, sql.P1_FOUND),
    "p1_sample": (p1_sample, None),
    "p1_report": (p1_report, None),
    "p1_supply": (p1_supply, sql.P1_SUPPLY),
    "p1_totals": (p1_totals, sql.P1_TOTALS),
    "p3_found": (p3_found, sql.P3_FOUND),
    "p3_groups": (p3_groups, sql.P3_GROUPS),
    "p5_found": (p5_found, sql.P5_FOUND),
    "p5_terms": (p5_terms, sql.P5_TERMS),
    "p5_ngrams": (p5_ngrams, sql.P5_NGRAMS),
    "p5_all_ngrams": (p5_all_ngrams, sql.P5_ALL_NGRAMS),
    "p6_found": (p6_found, None),
    "p6_by_kind": (p6_by_kind, None),
    "p7_found": (p7_found, None),
    "p7_packed": (p7_packed, None),
    "p7_fill": (p7_fill, None),
    "p7_bounds": (p7_bounds, sql.P7_BOUNDS),
    "p8_found": (p8_found, None),
    "p8_mix": (p8_mix, None),
    "p8_bounds": (p8_bounds, sql.P8_BOUNDS),
    "p8_report": (p8_report, None),
    "p9_found": (p9_found, None),
    "p9_kept": (p9_kept, None),
}
