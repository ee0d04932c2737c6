"""The reference and hierarchy problems on the tables of the evidence knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.text import label
from attestry.operators import hierarchy, references
from attestry.tables import latest, table


def project_forest(spark: SparkSession, sf_dir: str, paths: bool = True) -> hierarchy.Forest:
    rows = table(spark, sf_dir, "projects").withColumn("k", label("id"))
    held = latest(rows, "k", ["id", "parentProjectId"])
    return hierarchy.Forest(held, "id", "parentProjectId", paths)


def _refs(df: DataFrame, columns: list[tuple[str, str]], holder: str) -> DataFrame:
    """(holder, field, holder_id, ref_id, at): each different reference once; null and blank ones are none."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.array_distinct(F.transform(c, label)).alias("refs")) for name, c in columns]))
    wide = df.select(F.lit(holder).alias("holder"), F.col("id").alias("holder_id"), F.col("createdAt").alias("at"), each.alias("f"))
    return (wide.select("holder", F.col("f.field").alias("field"), "holder_id", "at", F.explode("f.refs").alias("ref_id"))
            .where("ref_id is not null"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of passages, findings and source versions as (id, born, gone)."""
    removal = label("lifecycle") == "deleted"
    rows = []
    for name, removes, has_end in (("passages", True, True), ("findings", True, False), ("source_versions", False, True)):
        d = table(spark, sf_dir, name)
        born = F.when(~F.coalesce(removal, F.lit(False)), F.col("recordedAt")) if removes else F.col("recordedAt")
        gone = F.when(removal, F.col("recordedAt")) if removes else F.lit(None).cast("timestamp_ntz")
        gone = F.least(gone, F.col("deletedAt")) if has_end else gone
        rows.append(d.select(label("id").alias("id"), born.alias("born"), gone.alias("gone")).where("id is not null"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def orphan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(holder, field, holder_id, ref_id, at): references whose target wasn't there when their holder was made."""
    f = latest(table(spark, sf_dir, "findings"), "id", ["evidenceIds", "counterevidenceIds", "dependencies", "createdAt"])
    names = ["evidenceIds", "counterevidenceIds", "dependencies"]
    of_findings = _refs(f, [(n, F.col(n)) for n in names], "findings")
    known = references.lifetimes(_targets(spark, sf_dir), ["id"], "born", "gone")
    a = references.orphans(of_findings, known, [("ref_id", "id")], "at")
    c = latest(table(spark, sf_dir, "controlled_cases"), "id", ["gold", "createdAt"])
    of_cases = _refs(c, [("gold.recordIds", F.col("gold.recordIds"))], "controlled_cases").withColumn("case_key", label("holder_id"))
    r = table(spark, sf_dir, "controlled_records")
    removal = F.coalesce(label("lifecycle") == "deleted", F.lit(False))
    records = references.lifetimes(
        r.select(label("caseId").alias("case_key"), label("id").alias("id"), F.when(~removal, F.col("recordedAt")).alias("born"),
                 F.least(F.when(removal, F.col("recordedAt")), F.col("deletedAt")).alias("gone")), ["case_key", "id"], "born", "gone")
    b = references.orphans(of_cases, records, [("case_key", "case_key"), ("ref_id", "id")], "at").drop("case_key")
    return a.unionByName(b)


def source_references(spark: SparkSession, sf_dir: str, match: str) -> DataFrame:
    """(question_id, source_id, source_version_id, at): deliveries of questions that name a version of a source,
    the one or the other of which may be null, where no such version was there when the question was made.
    """
    v = table(spark, sf_dir, "source_versions").select(label("sourceId").alias("s"), label("id").alias("v"), F.col("recordedAt").alias("born"), F.col("deletedAt").alias("gone"))
    refs = table(spark, sf_dir, "questions").select(F.col("id").alias("question_id"), label("sourceId").alias("source_id"), label("sourceVersionId").alias("source_version_id"), F.col("createdAt").alias("at"))
    return references.orphans(refs, references.lifetimes(v, ["s", "v"], "born", "gone"), [("source_id", "s"), ("source_version_id", "v")], "at", match)
