"""Queries of the general problems: hierarchies (p2) and orphan references (p4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import evidence
from attestry.operators import references

_NORM = r"nullif(regexp_replace(lower({}), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '')"


def norm(x: str) -> str:
    return _NORM.format(x)


def p2_found(spark, sf_dir):
    f = evidence.project_forest(spark, sf_dir, paths=False)
    return f.rings.select(F.col("id").alias("project_id"), "cycle_id")


def p2_hierarchy(spark, sf_dir):
    f = evidence.project_forest(spark, sf_dir)
    return f.nodes.select(F.col("id").alias("project_id"), F.array_join("path", "/").alias("path"), F.col("depth").cast("long").alias("depth"), "root")


def p2_descendants(spark, sf_dir):
    return evidence.project_forest(spark, sf_dir).descendants().withColumn("distance", F.col("distance").cast("long"))


def p2_all_descendants(spark, sf_dir):
    """The pairs of p2_descendants and those of projects on or below a ring."""
    return evidence.project_forest(spark, sf_dir).descendants(rings=True).withColumn("distance", F.col("distance").cast("long"))


def p4_found(spark, sf_dir):
    return evidence.orphan_references(spark, sf_dir).select("holder", "field", "holder_id", "ref_id")


def p4_by_month(spark, sf_dir):
    return references.by_period(evidence.orphan_references(spark, sf_dir), "holder", "field", "at")


def p4_partial(spark, sf_dir):
    """Composite references, null columns left open."""
    return evidence.source_references(spark, sf_dir, "partial").select("question_id", "source_id", "source_version_id", "at")


def p4_full(spark, sf_dir):
    """Composite references, partly null ones never holding."""
    return evidence.source_references(spark, sf_dir, "full").select("question_id", "source_id", "source_version_id", "at")


_HELD = f"""held AS (SELECT k, id, pk FROM (SELECT {norm('id')} k, id, {norm('parentProjectId')} pk,
  row_number() OVER (PARTITION BY {norm('id')} ORDER BY recordedAt DESC) rn FROM projects) WHERE rn = 1 AND k IS NOT NULL),
e AS (SELECT a.k, a.id, b.k pk FROM held a LEFT JOIN held b ON a.pk = b.k)"""

P2_FOUND = f"""WITH RECURSIVE {_HELD},
up(k, anc) AS (SELECT k, pk FROM e WHERE pk IS NOT NULL UNION SELECT up.k, e.pk FROM up JOIN e ON up.anc = e.k WHERE e.pk IS NOT NULL),
ring AS (SELECT k FROM up WHERE k = anc),
named AS (SELECT r.k, min(h.id) cycle_id FROM ring r JOIN up ON up.k = r.k JOIN held h ON h.k = up.anc GROUP BY r.k)
SELECT DISTINCT h.id project_id, n.cycle_id FROM up JOIN named n ON up.anc = n.k JOIN held h ON h.k = up.k"""

_DOWN = f"""{_HELD},
down(k, id, path, depth, root) AS (SELECT k, id, id, 0::BIGINT, id FROM e WHERE pk IS NULL
  UNION ALL SELECT e.k, e.id, down.path || '/' || e.id, down.depth + 1, down.root FROM down JOIN e ON e.pk = down.k)"""

P2_HIERARCHY = f"WITH RECURSIVE {_DOWN} SELECT id project_id, path, depth, root FROM down"

P2_DESCENDANTS = f"""WITH RECURSIVE {_DOWN}
SELECT a.anc ancestor, d.id descendant, d.depth - (a.i - 1) distance FROM down d,
  LATERAL (SELECT unnest(string_split(d.path, '/')) anc, unnest(generate_series(1::BIGINT, d.depth + 1)) i) a WHERE a.i <= d.depth"""

# Each project's parents are followed until the next one has been met before; the project itself doesn't count.
P2_ALL_DESCENDANTS = f"""WITH RECURSIVE {_HELD},
up(k, anc, seen, distance) AS (SELECT k, pk, [pk], 1::BIGINT FROM e WHERE pk IS NOT NULL AND pk <> k
  UNION ALL SELECT up.k, e.pk, list_append(up.seen, e.pk), up.distance + 1 FROM up JOIN e ON up.anc = e.k
  WHERE e.pk IS NOT NULL AND e.pk <> up.k AND NOT list_contains(up.seen, e.pk))
SELECT a.id ancestor, d.id descendant, distance FROM up JOIN e a ON a.k = up.anc JOIN e d ON d.k = up.k"""

_P4 = f"""t AS (SELECT {norm('id')} id, CASE WHEN coalesce({norm('lifecycle')} <> 'deleted', true) THEN recordedAt END born,
   least(CASE WHEN {norm('lifecycle')} = 'deleted' THEN recordedAt END, deletedAt) gone FROM passages
  UNION ALL SELECT {norm('id')}, CASE WHEN coalesce({norm('lifecycle')} <> 'deleted', true) THEN recordedAt END,
   CASE WHEN {norm('lifecycle')} = 'deleted' THEN recordedAt END FROM findings
  UNION ALL SELECT {norm('id')}, recordedAt, deletedAt FROM source_versions),
life AS (SELECT id, min(born) born, min(gone) gone FROM t GROUP BY id HAVING min(born) IS NOT NULL),
fh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recordedAt DESC) rn FROM findings) WHERE rn = 1),
fr AS (SELECT 'findings' holder, 'evidenceIds' field, id holder_id, createdAt at_, unnest(evidenceIds) r FROM fh
  UNION ALL SELECT 'findings', 'counterevidenceIds', id, createdAt, unnest(counterevidenceIds) FROM fh
  UNION ALL SELECT 'findings', 'dependencies', id, createdAt, unnest(dependencies) FROM fh),
fd AS (SELECT DISTINCT holder, field, holder_id, at_, {norm('r')} ref_id FROM fr),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recordedAt DESC) rn FROM controlled_cases) WHERE rn = 1),
cd AS (SELECT DISTINCT 'controlled_cases' holder, 'gold.recordIds' field, holder_id, at_, {norm('r')} ref_id
  FROM (SELECT id holder_id, createdAt at_, unnest(gold.recordIds) r FROM ch)),
rl AS (SELECT {norm('caseId')} ck, {norm('id')} id, min(CASE WHEN coalesce({norm('lifecycle')} <> 'deleted', true) THEN recordedAt END) born,
  min(least(CASE WHEN {norm('lifecycle')} = 'deleted' THEN recordedAt END, deletedAt)) gone FROM controlled_records GROUP BY 1, 2),
found AS (SELECT fd.* FROM fd LEFT JOIN life ON life.id = fd.ref_id WHERE ref_id IS NOT NULL AND (born IS NULL OR born > at_ OR gone <= at_)
  UNION ALL SELECT cd.* FROM cd LEFT JOIN rl ON rl.ck = {norm('holder_id')} AND rl.id = cd.ref_id
  WHERE ref_id IS NOT NULL AND (born IS NULL OR born > at_ OR gone <= at_))"""

P4_FOUND = f"WITH {_P4} SELECT holder, field, holder_id, ref_id FROM found"
P4_BY_MONTH = f"""WITH {_P4} SELECT holder, field, strftime(at_, '%Y-%m') "month", count(*) n_refs, count(DISTINCT holder_id) n_holders
FROM found GROUP BY 1, 2, 3"""

_P4_SOURCES = f"""refs AS (SELECT id question_id, {norm('sourceId')} source_id, {norm('sourceVersionId')} source_version_id, createdAt AS "at" FROM questions),
life AS (SELECT {norm('sourceId')} s, {norm('id')} v, min(recordedAt) born, min(deletedAt) gone FROM source_versions GROUP BY 1, 2),
lost AS (SELECT * FROM refs WHERE NOT EXISTS (SELECT 1 FROM life WHERE (source_id IS NULL OR source_id = s) AND (source_version_id IS NULL OR source_version_id = v) AND born <= "at" AND (gone IS NULL OR gone > "at")))"""
P4_PARTIAL = f"WITH {_P4_SOURCES} SELECT * FROM lost WHERE source_id IS NOT NULL OR source_version_id IS NOT NULL"
P4_FULL = f"""WITH {_P4_SOURCES} SELECT * FROM lost WHERE source_id IS NOT NULL AND source_version_id IS NOT NULL
UNION ALL SELECT * FROM refs WHERE (source_id IS NULL) <> (source_version_id IS NULL)"""

QUERIES = {
    "p2_found": (p2_found, P2_FOUND),
    "p2_hierarchy": (p2_hierarchy, P2_HIERARCHY),
    "p2_descendants": (p2_descendants, P2_DESCENDANTS),
    "p2_all_descendants": (p2_all_descendants, P2_ALL_DESCENDANTS),
    "p4_found": (p4_found, P4_FOUND),
    "p4_partial": (p4_partial, P4_PARTIAL),
    "p4_full": (p4_full, P4_FULL),
    "p4_by_month": (p4_by_month, P4_BY_MONTH),
}
