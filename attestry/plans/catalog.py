"""Queries of catalogues and checks, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import facts as fx
from attestry.functions.text import label
from attestry.operators import audit, catalog
from attestry.operators.snapshots import Store
from attestry.plans import sources as src
from attestry.plans.reference import _DEPENDENTS, _PASSAGES, held, norm
from attestry.scratch import Scratch
from attestry.tables import latest, table

Q: dict[str, tuple] = {}


def query(sql: str | None):
    def register(plan):
        Q[plan.__name__] = (plan, sql)
        return plan

    return register


@query(f"WITH {_PASSAGES} SELECT id FROM p WHERE lifecycle <> 'stale' AND pred = 'hides' AND ske LIKE '% kettle)'")
def posting_candidates(s, d):
    posted = catalog.postings(src.passage_facts(s, d).where("lifecycle <> 'stale'"))
    return catalog.candidates(posted, [("hides", 1, "kettle")])


@query(f"SELECT id, family FROM {held('controlled_cases')} ORDER BY id LIMIT 15 OFFSET 20")
def cases_page(s, d):
    return catalog.page(latest(table(s, d, "controlled_cases"), "id", ["family"]), ["id"], 20, 15)


@query(f"WITH f AS (SELECT id, procedureId p, procedureVersion v FROM {held('findings')}) SELECT id, p procedure_id, v version FROM f WHERE v = (SELECT max(v) FROM f g WHERE g.p = f.p)")
def newest_versions(s, d):
    f = latest(table(s, d, "findings"), "id", ["procedureId", "procedureVersion"]).where("procedureId is not null and procedureVersion is not null")
    return catalog.newest(f, ["procedureId"], "procedureVersion").select("id", F.col("procedureId").alias("procedure_id"), F.col("procedureVersion").alias("version"))


_SENTENCES = r"""x AS (SELECT doc_id, source, regexp_extract_all(text, '[A-Z][^.!?\n]{38,238}[.!?]') l FROM documents),
st AS (SELECT doc_id, source, unnest(l) sentence, unnest(generate_series(0, len(l) - 1)) pos FROM x)"""


@query(f"WITH {_SENTENCES} SELECT doc_id, pos, sentence FROM st")
def long_sentences(s, d):
    return catalog.sentences(table(s, d, "documents"), "doc_id").select(F.col("id").alias("doc_id"), "pos", "sentence")


@query(f"""WITH {_SENTENCES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 i, count(*) OVER (PARTITION BY source) n FROM st WHERE source IS NOT NULL)
SELECT source, doc_id, pos FROM r WHERE n <= 4 OR floor((i + 1) * 4 / n) > floor(i * 4 / n)""")
def sentence_anchors(s, d):
    docs = table(s, d, "documents").where("source is not null")
    st = catalog.sentences(docs, "doc_id").withColumnRenamed("id", "doc_id").join(docs.select("doc_id", "source"), "doc_id").select("source", "doc_id", "pos")
    return catalog.anchors(st, ["source"], ["doc_id", "pos"])


@query(r"SELECT doc_id, true AS same FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> '')) >= 8")
def quotes_found(s, d):
    """A quote of the third to the eighth word, with single blanks, is found where these words stand."""
    docs = table(s, d, "documents").select("doc_id", "text")
    words = F.filter(F.split("text", r"(?U)[\s\p{Z}]+"), lambda w: w != "")
    q = docs.where(F.size(words) >= 8).withColumn("quote", F.array_join(F.slice(words, 3, 6), " "))
    start, end = catalog.quote_at(F.col("text"), F.col("quote"))
    q = q.withColumn("a", start).withColumn("b", end)
    found = F.expr("substring(text, cast(a + 1 as int), cast(b - a as int))")
    return q.select("doc_id", (F.trim(F.regexp_replace(found, r"(?U)\s+", " ")) == F.col("quote")).alias("same"))


@query("SELECT user_id, event_type, sum(value) total FROM events GROUP BY 1, 2")
def usage_totals(s, d):
    e = table(s, d, "events").select("user_id", F.create_map("event_type", "value").alias("used"))
    return catalog.usage(e, ["user_id"], "used").select("user_id", F.explode("used").alias("event_type", "total"))


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN sum(value) FILTER (event_type = 'purchase') ELSE sum(value) END AS value FROM events GROUP BY 1")
def rolled_up_usage(s, d):
    return catalog.rolled_up(table(s, d, "events"), ["user_id"], F.col("event_type") == "purchase", "value")


@query(f"""WITH {_PASSAGES}, u AS (SELECT sourceVersionId source_version_id, coalesce(lifecycle IN ('stale', 'retracted', 'superseded', 'staged'), false) dead, coalesce(usable, false) ok FROM p)
SELECT source_version_id, count(*) records, count(*) FILTER (dead) excluded, count(*) FILTER (NOT dead AND ok) supported, count(*) FILTER (NOT dead AND NOT ok) unsupported FROM u GROUP BY 1""")
def project_audit(s, d):
    return catalog.project_report(src.passage_facts(s, d))


@query(f"""WITH q AS (SELECT id FROM {held('questions')}) SELECT id, CASE WHEN id LIKE '%7' THEN 'missing' ELSE 'duplicate' END problem FROM q WHERE id LIKE '%7' OR id LIKE '%3' UNION ALL SELECT 'nobody', 'unknown'""")
def review_round_trip(s, d):
    """A review file that goes out as CSV and comes back with rows missing, doubled and made up."""
    q = latest(table(s, d, "questions"), "id", ["question", "expected"]).select("id", "question", "expected")
    back = q.where("id not like '%7'").unionByName(q.where("id like '%3'")).unionByName(s.createDataFrame([("nobody", "?", None)], q.schema))
    path = f"{Scratch(s, 'review').base}/csv"
    back.write.option("header", True).option("escape", '"').csv(path)
    read = s.read.option("header", True).option("escape", '"').option("multiLine", True).schema(q.schema).csv(path)
    return catalog.review_problems(q, read)


_GOLD = f"""r AS (SELECT regionId rid, sourceVersionId v, min(startChar) a, max(endChar) b, min(quote) t FROM {held('passages')} WHERE coalesce(lifecycle, '') <> 'deleted' AND regionId IS NOT NULL GROUP BY 1, 2),
g0 AS (SELECT id, sourceVersionId v, unnest(evidence) e, unnest(generate_series(0, len(evidence) - 1)) n FROM {held('questions')}),
g AS (SELECT id || '#' || n gid, v, CASE n % 3 WHEN 0 THEN (SELECT min(rid) FROM r WHERE r.v = g0.v) ELSE e.regionId END rid, CASE WHEN n % 3 < 2 THEN e.startChar END a, CASE WHEN n % 3 < 2 THEN e.endChar END b, e.quote q FROM g0),
i AS (SELECT gid, r.rid, g.a, g.b, r.a ra, r.b rb, 'id' how FROM g JOIN r ON g.rid = r.rid AND g.v = r.v),
o AS (SELECT gid, r.rid, g.a, g.b, r.a ra, r.b rb, 'overlap' how FROM g JOIN r ON g.v = r.v AND g.a < r.b AND r.a < g.b WHERE gid NOT IN (SELECT gid FROM i) AND g.a < g.b AND r.a < r.b),
t AS (SELECT gid, r.rid, r.a + instr(r.t, q) - 1 a, r.a + instr(r.t, q) - 1 + length(q) b, r.a ra, r.b rb, 'quote' how FROM g JOIN r ON g.v = r.v AND contains(r.t, q) WHERE trim(q) <> '' AND gid NOT IN (SELECT gid FROM i) AND gid NOT IN (SELECT gid FROM o)),
a AS (SELECT *, coalesce(a < rb AND ra < b, false) inside FROM (SELECT * FROM i UNION ALL SELECT * FROM o UNION ALL SELECT * FROM t))"""


@query(f"""WITH {_GOLD} SELECT gid gold_id, rid region_id, CASE WHEN inside THEN greatest(a, ra) ELSE ra END AS "start", CASE WHEN inside THEN least(b, rb) ELSE rb END AS "end", how FROM a""")
def gold_mapping(s, d):
    """Every third span of a question is given the first region of its source, every third has a quote only."""
    p = src.passages(s, d).where("region_id is not null").groupBy("region_id", "source_version_id").agg(F.min("startChar").alias("start"), F.max("endChar").alias("end"), F.min("quote").alias("text"))
    p = Scratch(s, "gold").write(p, "regions")
    q = latest(table(s, d, "questions"), "id", ["sourceVersionId", "evidence"]).select("id", F.col("sourceVersionId").alias("source_version_id"), F.posexplode("evidence").alias("n", "e"))
    first = p.groupBy("source_version_id").agg(F.min("region_id").alias("first"))
    q = q.join(first, "source_version_id", "left").withColumn("m", F.col("n") % 3)
    offset = lambda c: F.when(F.col("m") < 2, F.col(c))
    g = q.select(F.concat_ws("#", "id", "n").alias("gold_id"), "source_version_id", F.when(F.col("m") == 0, F.col("first")).otherwise(F.col("e.regionId")).alias("region_id"), offset("e.startChar").alias("start"), offset("e.endChar").alias("end"), F.col("e.quote").alias("quote"))
    return catalog.gold_spans(Scratch(s, "gold").write(g, "spans"), p)


_CITED = f"""{_PASSAGES}, f AS (SELECT id fid, unnest(evidenceIds) x FROM {held('findings')}), c AS (SELECT DISTINCT fid, {norm('x')} ref FROM f WHERE {norm('x')} IS NOT NULL),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recordedAt) rn FROM passages) WHERE rn = 1),
g AS (SELECT sourceVersionId v, regionId r, min(coalesce(quote, '')) t, true there FROM {held('passages')} WHERE coalesce(lifecycle, '') <> 'deleted' AND regionId IS NOT NULL GROUP BY 1, 2),
j AS (SELECT fid || '|' || ref id, p.id pid, p.usable, p.ske pske, p.sourceVersionId pv, a.ske, a.sourceVersionId v, a.quote, g.t, g.there
  FROM c LEFT JOIN p ON p.id = ref LEFT JOIN a ON a.id = ref LEFT JOIN g ON g.v = a.sourceVersionId AND g.r = a.regionId)"""


@query(f"""WITH {_CITED} SELECT id, 'missing record' violation FROM j WHERE pid IS NULL UNION ALL SELECT id, 'stale or unusable record' FROM j WHERE pid IS NOT NULL AND NOT coalesce(usable, false)
UNION ALL SELECT id, 'expression differs' FROM j WHERE pid IS NOT NULL AND ske IS DISTINCT FROM pske UNION ALL SELECT id, 'source differs' FROM j WHERE pid IS NOT NULL AND v IS DISTINCT FROM pv
UNION ALL SELECT id, 'region not found' FROM j WHERE pid IS NOT NULL AND there IS NULL
UNION ALL SELECT id, 'quote not in region' FROM j WHERE pid IS NOT NULL AND there AND (trim(coalesce(quote, '')) = '' OR NOT contains(t, quote))""")
def citation_violations(s, d):
    """What findings cite, as it first came, against the records and regions that hold now."""
    ref = latest(table(s, d, "findings"), "id", ["evidenceIds"]).select("id", F.explode(F.array_distinct(F.transform("evidenceIds", label))).alias("ref")).where("ref is not null")
    came = table(s, d, "passages").groupBy(F.col("id").alias("ref")).agg(F.min(F.struct("recordedAt", "sourceVersionId", "regionId", "quote", "ske")).alias("a"))
    cited = ref.join(came, "ref", "left").select(F.concat_ws("|", "id", "ref").alias("id"), F.col("ref").alias("record_id"), F.col("a.sourceVersionId").alias("source_version_id"), F.col("a.regionId").alias("region_id"), F.col("a.quote").alias("quote"), F.col("a.ske").alias("ske"))
    cited = Scratch(s, "cited").write(fx.parsed(cited, "ske").select("id", "record_id", "source_version_id", "region_id", "quote", "expr_key"), "evidence")
    regions = src.passages(s, d).where("region_id is not null").groupBy("source_version_id", "region_id").agg(F.min(F.coalesce("quote", F.lit(""))).alias("text"))
    return audit.evidence_violations(cited, src.passage_facts(s, d), regions)


@query(f"""WITH RECURSIVE {_DEPENDENTS}, hit(id) AS (SELECT id FROM ed WHERE dep IN (SELECT id FROM r WHERE id LIKE '%7') UNION SELECT ed.id FROM ed JOIN hit ON ed.dep = hit.id)
SELECT DISTINCT r.id, 'dependency-invalidated' reason FROM hit JOIN r USING (id) WHERE r.id NOT LIKE '%7'""")
def snapshot_stale(s, d):
    """A commit that changes records marks all that rest on them."""
    t = Scratch(s, "store").write(src.dependents(s, d).select("id", "source_version_id", "dependencies").withColumn("lifecycle", F.lit("current")), "records")
    store = Store(s, Scratch(s, "store").base)
    p = store.create("knowledge")
    h = store.commit(p, store.project(p)["head"], {"records": t})
    h = store.commit(p, h, {"records": t.where("id like '%7'").withColumn("source_version_id", F.lit("moved"))})
    return store.read(h, "records").where("lifecycle = 'stale'").select("id", F.col("stale_reason").alias("reason"))


@query("""SELECT c_custkey::VARCHAR id, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal + 100 END AS balance, c_custkey % 11 = 0 gone FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 11 = 0""")
def snapshot_diff(s, d):
    """What a fork changed against the snapshot it is pinned to."""
    t = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_custkey", F.col("c_acctbal").alias("balance"))
    store = Store(s, Scratch(s, "store").base)
    p = store.create("parent")
    store.commit(p, store.project(p)["head"], {"records": t}, invalidate=False)
    fork = store.fork(p, "fork")
    store.commit(fork, store.project(fork)["head"], {"records": t.where("c_custkey % 5 = 0 and c_custkey % 11 <> 0").withColumn("balance", F.col("balance") + 100)}, {"records": t.where("c_custkey % 11 = 0")}, invalidate=False)
    return store.diff(fork)["records"].select("id", "balance", F.col("_gone").alias("gone"))


@query("""WITH s AS (SELECT doc_id, source FROM documents WHERE source IS NOT NULL), d AS (SELECT *, doc_id % 10 < 7 done FROM s)
SELECT source source_version_id, bool_and(done) complete FROM d WHERE doc_id % 10 < 9 OR source LIKE '%s' GROUP BY 1""")
def coverage_of_documents(s, d):
    """Coverage as a ledger of its own: two documents in ten deferred, one without any row."""
    docs = table(s, d, "documents").where("source is not null and (doc_id % 10 < 9 or source like '%s')").select(F.col("source").alias("source_version_id"), F.col("doc_id").cast("string").alias("region_id"), "doc_id")
    ledger = docs.where("doc_id % 10 < 9").select("source_version_id", "region_id", F.when(F.col("doc_id") % 10 < 7, "processed").otherwise("deferred").alias("state"))
    return audit.covered(docs.select("source_version_id", "region_id"), ledger)


QUERIES = Q
