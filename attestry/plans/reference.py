"""Queries of the engine's own operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import facts as fx
from attestry.functions.text import label
from attestry.operators import audit, catalog, closure, entities, graph, metrics, procedures, retrieve, scan
from attestry.operators.reason import Rule, reason
from attestry.operators.resolve import resolve
from attestry.plans import conjunctive as cj
from attestry.plans import sources as src
from attestry.plans.general import norm
from attestry.scratch import Scratch
from attestry.sources import chunks, readers
from attestry.tables import latest, table

Q: dict[str, tuple] = {}


def query(sql: str | None):
    def register(plan):
        Q[plan.__name__] = (plan, sql)
        return plan

    return register


def value(name: str):
    """A variable's number without its tag."""
    return F.substring(F.col(cj.var(name)), 3, 100).cast("long")


def text(name: str):
    return F.substring(F.col(cj.var(name)), 3, 1 << 30)


_HELD = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY recordedAt DESC) rn FROM {t}) WHERE rn = 1)"


def held(t: str, k: str = "id") -> str:
    return _HELD.format(t=t, k=k)


# Matching and joins


@query("SELECT n_nationkey nation FROM nation WHERE n_regionkey = 1")
def match_ground(s, d):
    return cj.matched(src.trade(s, d, "in_region"), "(in_region ?n 1)").select(value("n").alias("nation"))


@query("SELECT l_partkey part FROM lineitem WHERE l_partkey = l_suppkey")
def match_repeated_var(s, d):
    return cj.matched(src.trade(s, d, "pair"), "(pair ?x ?x)").select(value("x").alias("part"))


@query("SELECT c_custkey customer, c_nationkey nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def find_join2(s, d):
    f = src.trade(s, d, "in_region", "lives_in")
    return cj.found(f, "(find (?c ?n) (and (lives_in ?c ?n) (in_region ?n 1)))").select(value("c").alias("customer"), value("n").alias("nation"))


@query("""SELECT o_orderkey "order", c_custkey customer, n_regionkey region FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def find_join4(s, d):
    f = src.trade(s, d, "in_region", "lives_in", "ordered_by", "region")
    r = cj.found(f, "(find (?o ?c ?r) (and (ordered_by ?o ?c) (lives_in ?c ?n) (in_region ?n ?r) (region ?r)))")
    return r.select(value("o").alias("order"), value("c").alias("customer"), value("r").alias("region"))


@query("SELECT r_regionkey region, n_nationkey nation FROM region CROSS JOIN nation")
def find_cartesian(s, d):
    f = src.trade(s, d, "region", "nation")
    return cj.found(f, "(find (?r ?n) (and (region ?r) (nation ?n)))").select(value("r").alias("region"), value("n").alias("nation"))


@query("SELECT count(*) > 0 holds FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def find_boolean(s, d):
    f = src.trade(s, d, "in_region", "lives_in")
    return cj.found(f, "(find () (and (lives_in ?c ?n) (in_region ?n 2)))").agg((F.count(F.lit(1)) > 0).alias("holds"))


_PASSAGES = f"""p AS (SELECT *, regexp_extract(ske, '^\\((\\S+) ', 1) pred, coalesce(polarity, 'positive') pol,
  lifecycle NOT IN ('stale', 'retracted', 'superseded', 'staged') AND ("supportState" IS NULL OR "supportState" = 'supported') usable
  FROM {held('passages')} WHERE coalesce(lifecycle, '') <> 'deleted' AND ske IS NOT NULL)"""


@query(f"""WITH {_PASSAGES}, u AS (SELECT * FROM p WHERE usable)
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM u o WHERE o.ske = u.ske AND o.pol <> u.pol) THEN 'contested' WHEN u.pol = 'negative' THEN 'ambiguous' ELSE 'equivalent' END relation
FROM u WHERE pred = 'kin_of'""")
def match_passages(s, d):
    return cj.matched(src.passage_facts(s, d), "(kin_of ?a ?b)").select("id", "relation")


@query(f"""WITH {_PASSAGES}, u AS (SELECT *, regexp_extract(ske, '^\\(\\S+ (\\S+) ', 1) a, regexp_extract(ske, ' (\\S+)\\)$', 1) b FROM p WHERE usable),
o AS (SELECT ske, count(DISTINCT pol) n FROM u GROUP BY ske)
SELECT x.a who, x.b what, y.b where_, CASE WHEN ox.n > 1 OR oy.n > 1 THEN 'contested' WHEN x.pol = 'negative' THEN 'ambiguous' ELSE 'equivalent' END relation
FROM u x JOIN u y ON x.a = y.a AND x.pol = y.pol JOIN o ox ON ox.ske = x.ske JOIN o oy ON oy.ske = y.ske WHERE x.pred = 'holds' AND y.pred = 'lives_in'""")
def find_passages(s, d):
    r = cj.found(src.passage_facts(s, d), "(find (?who ?what ?where) (and (holds ?who ?what) (lives_in ?who ?where)))")
    return r.select(text("who").alias("who"), text("what").alias("what"), text("where").alias("where_"), "relation")


_DID = "f AS (SELECT event_id, event_type, user_id, strftime(ts, '%Y-%m-%d') AS day_, CASE WHEN value < 35 THEN 'negative' ELSE 'positive' END pol FROM events)"


@query(f"""WITH {_DID} SELECT event_id, CASE WHEN pol = 'negative' THEN 'ambiguous' WHEN day_ = '2024-01-05' THEN 'equivalent' ELSE 'ambiguous' END relation
FROM f WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM f o WHERE o.event_type = f.event_type AND o.user_id = f.user_id AND o.day_ = f.day_ AND o.pol <> f.pol)""")
def scope_align(s, d):
    r = cj.matched(src.did(s, d), "(did click ?u)", want={"time": "2024-01-05"}).where("relation <> 'contested'")
    return r.select(F.substring("id", 2, 30).cast("long").alias("event_id"), "relation")


@query(f"""WITH {_DID} SELECT f.event_id, min(o.event_id) opponent FROM f JOIN f o ON o.event_type = f.event_type AND o.user_id = f.user_id AND o.day_ = f.day_ AND o.pol <> f.pol GROUP BY 1""")
def opposition(s, d):
    r = cj.prepared(src.did(s, d)).where("opponent_id is not null")
    return r.select(F.substring("id", 2, 30).cast("long").alias("event_id"), F.substring("opponent_id", 2, 30).cast("long").alias("opponent"))


@query(f"""WITH {_DID}, g AS (SELECT event_type, user_id, day_, pol, min(event_id) e, count(*) n FROM f GROUP BY 1, 2, 3, 4)
SELECT a.e "left", b.e "right", a.n n_left, b.n n_right, CASE WHEN a.day_ = b.day_ THEN 'potential_contradiction' ELSE 'scope_difference' END label
FROM g a JOIN g b USING (event_type, user_id) WHERE a.pol <> b.pol AND a.e < b.e""")
def contradictions(s, d):
    r = procedures.contradictions(src.did(s, d))
    return r.select(F.substring("left_id", 2, 30).cast("long").alias("left"), F.substring("right_id", 2, 30).cast("long").alias("right"), "n_left", "n_right", "label")


@query(f"WITH {_PASSAGES} SELECT id FROM p WHERE usable")
def lifecycle_filter(s, d):
    return src.passage_facts(s, d).where(fx.usable()).select("id")


@query("SELECT '(in_region ?n 9)' goal, 'no statement matches exactly' reason WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 9)")
def residuals(s, d):
    f = src.trade(s, d, "in_region")
    return cj.residuals(s, "(in_region ?n 9)", cj.matched(f, "(in_region ?n 9)"))


# Rules and closures


@query("SELECT DISTINCT c_custkey customer, n_regionkey region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def rule_two_premise(s, d):
    rule = Rule.read("buyers", ["(ordered_by ?o ?c)", "(lives_in ?c ?n)", "(in_region ?n ?r)"], "(buys_in ?c ?r)")
    r = reason(src.trade(s, d, "ordered_by", "lives_in", "in_region"), [rule], max_facts=None)
    return r.derived.select(F.substring(F.col("args")[0], 3, 30).cast("long").alias("customer"), F.substring(F.col("args")[1], 3, 30).cast("long").alias("region"))


_EDGES = f"""e AS (SELECT DISTINCT a.k, b.k anc FROM (SELECT {norm('id')} k, {norm('parentProjectId')} pk FROM {held('projects')}) a
  JOIN (SELECT DISTINCT {norm('id')} k FROM projects) b ON a.pk = b.k)"""


@query(f"WITH RECURSIVE {_EDGES}, r(k, anc) AS (SELECT * FROM e UNION SELECT r.k, e.anc FROM r JOIN e ON r.anc = e.k) SELECT k child, anc ancestor FROM r")
def fixpoint_reach(s, d):
    p = latest(table(s, d, "projects").withColumn("k", label("id")), "k", ["parentProjectId"]).select("k", label("parentProjectId").alias("pk"))
    e = p.join(p.select(F.col("k").alias("pk")), "pk").select(F.col("k").alias("child"), F.col("pk").alias("parent"))
    f = src._fact(e, F.concat(F.lit("f_"), "child"), "forked", [src.atom("child"), src.atom("parent")], F.xxhash64("child").bitwiseAND((1 << 40) - 1))
    rules = [Rule.read("one", ["(forked ?a ?b)"], "(reaches ?a ?b)"), Rule.read("far", ["(reaches ?a ?b)", "(reaches ?b ?c)"], "(reaches ?a ?c)")]
    r = reason(f, rules, max_rounds=100, max_facts=None, bases=False)
    return r.derived.select(F.substring(F.col("args")[0], 3, 200).alias("child"), F.substring(F.col("args")[1], 3, 200).alias("ancestor"))


_DEPENDENTS = f"""r AS (SELECT {norm('id')} id, sourceVersionId v, dependencies deps FROM {held('findings')}
  UNION ALL SELECT {norm('id')}, sourceVersionId, [] FROM {held('passages')} WHERE coalesce(lifecycle, '') <> 'deleted'),
ed AS (SELECT DISTINCT id, {norm('x')} dep FROM (SELECT id, unnest(deps) x FROM r) WHERE {norm('x')} IS NOT NULL),
named AS (SELECT DISTINCT {norm('id')} id FROM source_versions WHERE deletedAt IS NULL),
o0 AS (SELECT id FROM r WHERE {norm('v')} IN (SELECT id FROM named) AND id NOT IN (SELECT id FROM ed) UNION SELECT id FROM named)"""
_LEVELS = ", ".join(f"o{i} AS (SELECT id FROM o{i-1} UNION (SELECT DISTINCT id FROM ed EXCEPT SELECT id FROM ed WHERE dep NOT IN (SELECT id FROM o{i-1})))" for i in range(1, 7))


@query(f"WITH {_DEPENDENTS}, {_LEVELS} SELECT DISTINCT r.id FROM r JOIN o6 USING (id)")
def authorised_closure(s, d):
    scope = table(s, d, "source_versions").where("deletedAt is null").select(label("id").alias("id"))
    rows = src.dependents(s, d).withColumn("source_version_id", label("source_version_id"))
    return closure.authorised(rows, scope).select("id").distinct()


@query(f"""WITH RECURSIVE {_DEPENDENTS}, gone AS (SELECT DISTINCT {norm('id')} id FROM source_versions WHERE deletedAt IS NOT NULL),
hit(id) AS (SELECT id FROM ed WHERE dep IN (SELECT id FROM gone) UNION SELECT id FROM r WHERE {norm('v')} IN (SELECT id FROM gone) UNION SELECT ed.id FROM ed JOIN hit ON ed.dep = hit.id)
SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM ed WHERE dep IN (SELECT id FROM gone) OR dep IN (SELECT id FROM hit)) THEN 'dependency-invalidated' ELSE 'source-version-updated' END reason FROM hit""")
def stale_propagation(s, d):
    gone = table(s, d, "source_versions").where("deletedAt is not null").select(label("id").alias("id")).distinct()
    rows = src.dependents(s, d).withColumn("source_version_id", label("source_version_id"))
    return closure.stale(rows, gone, gone.where("false"))


@query(f"""SELECT DISTINCT {norm('x')} target, count(DISTINCT id) OVER (PARTITION BY {norm('x')}) dependents FROM (SELECT id, unnest(dependencies) x FROM {held('findings')}) WHERE {norm('x')} IS NOT NULL""")
def dependents_count(s, d):
    return src.finding_edges(s, d).groupBy(F.col("dep").alias("target")).agg(F.countDistinct("id").alias("dependents"))


@query(f"""WITH {_PASSAGES}, u AS (SELECT * FROM p WHERE usable AND pred = 'repaired')
SELECT count(*) claims, CASE WHEN bool_or(EXISTS (SELECT 1 FROM u o WHERE o.ske = u.ske AND o.pol <> u.pol)) THEN 'contested' WHEN bool_or(pol = 'positive') THEN 'supported' ELSE 'unresolved' END state FROM u""")
def resolve_answer(s, d):
    a = resolve(src.passage_facts(s, d), "(repaired ?who ?what)")
    return a.claims.agg(F.count(F.lit(1)).alias("claims")).withColumn("state", F.lit(a.state))


# Snapshots: set operations


@query("""SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT s_suppkey, s_name || ' II', s_acctbal + 1 FROM supplier WHERE s_suppkey % 7 = 0""")
def snapshot_upsert(s, d):
    from attestry.operators.snapshots import Store
    from attestry.scratch import Scratch

    t = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_suppkey", "s_name", "s_acctbal")
    store = Store(s, Scratch(s, "store").base)
    p = store.create("suppliers")
    h = store.commit(p, store.project(p)["head"], {"records": t}, invalidate=False)
    new = t.where("s_suppkey % 7 = 0").select("id", "s_suppkey", F.concat("s_name", F.lit(" II")).alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    h = store.commit(p, h, {"records": new}, invalidate=False)
    return store.read(h, "records").drop("id")


@query("""SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 100 WHEN c_custkey % 3 = 0 THEN 10 ELSE 0 END AS balance FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey % 5 = 0""")
def rebase_merge(s, d):
    from attestry.operators.snapshots import Store
    from attestry.scratch import Scratch

    t = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_custkey", F.col("c_acctbal").alias("balance"))
    store = Store(s, Scratch(s, "store").base)
    p = store.create("parent")
    h = store.commit(p, store.project(p)["head"], {"records": t}, invalidate=False)
    fork = store.fork(p, "fork")
    store.commit(fork, store.project(fork)["head"], {"records": t.where("c_custkey % 5 = 0").withColumn("balance", F.col("balance") + 100)}, invalidate=False)
    h = store.commit(p, h, {"records": t.where("c_custkey % 3 = 0 and c_custkey % 11 <> 0").withColumn("balance", F.col("balance") + 10)}, {"records": t.where("c_custkey % 11 = 0")}, invalidate=False)
    head = store.rebase(fork, h)
    r = store.read(head, "records")
    return r.select("c_custkey", "balance")


# Readers and chunks

_U16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


@query(f"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) t, unnest(list_concat(regexp_extract_all(text, '\\r\\n|\\r|\\n'), [''])) b, unnest(generate_series(1, len(regexp_extract_all(text, '\\r\\n|\\r|\\n')) + 1)) i FROM documents),
o AS (SELECT *, coalesce(sum({_U16.format('t')} + length(b)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT s FROM l)
SELECT doc_id, i::BIGINT ord, s AS "start", s + {_U16.format('t')} AS "end" FROM o WHERE regexp_replace(t, '[\\s\\p{{Z}}\\x85]+', '', 'g') <> ''""")
def lines_offsets(s, d):
    rows = readers.lines(table(s, d, "documents").select(F.col("doc_id").alias("source_version_id"), "text"))
    return rows.select(F.col("source_version_id").alias("doc_id"), "ord", "start", "end")


def _as_files(s, d):
    """The documents as files of nine kinds, chosen by their number."""
    t, i = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    body = {"txt": t, "markdown": t, "log": t, "jsonl": t, "bin": t, "json": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"id": '), i, F.lit("}"))).otherwise(t),
            "csv": F.concat(F.lit("id,note\n"), i, F.lit(',"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"\n')), "tsv": F.concat(F.lit("id\tsize\n"), i, F.lit("\t"), F.length(t).cast("string"), F.lit("\n\n")),
            "html": F.concat(F.lit("<html><head><title>x</title></head><body><p>No. "), i, F.lit("</p><script>var a;</script><p>a &amp; b</p></body></html>"))}
    kind = F.element_at(F.array(*[F.lit(k) for k in body]), (F.col("doc_id") % len(body) + 1).cast("int"))
    content = F.coalesce(*[F.when(kind == k, c) for k, c in body.items()])
    return table(s, d, "documents").select("doc_id", F.concat(i, F.lit("."), kind).alias("path"), content.cast("binary").alias("content"))


_FILES = r"""f AS (SELECT doc_id, coalesce(text, '') t, list_extract(['txt', 'markdown', 'log', 'jsonl', 'bin', 'json', 'csv', 'tsv', 'html'], (doc_id % 9 + 1)::INT) ext FROM documents),
ln AS (SELECT doc_id, CASE ext WHEN 'jsonl' THEN 'json-line' ELSE 'text-line' END kind, unnest(regexp_split_to_array(t, '\r\n|\r|\n')) AS text, unnest(generate_series(1, len(regexp_split_to_array(t, '\r\n|\r|\n')))) ord FROM f WHERE ext IN ('txt', 'markdown', 'log', 'jsonl')),
r AS (SELECT * FROM ln WHERE regexp_replace(text, '[\s\p{Z}\x85]+', '', 'g') <> '' UNION ALL SELECT doc_id, 'text-line', '{"id": ' || doc_id || '}', 1 FROM f WHERE ext = 'json' AND doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'csv-row', 'id: ' || doc_id || '; note: ' || t, 1 FROM f WHERE ext = 'csv' UNION ALL SELECT doc_id, 'csv-row', 'id: ' || doc_id || '; size: ' || length(t), 1 FROM f WHERE ext = 'tsv'
  UNION ALL SELECT doc_id, 'html-paragraph', unnest(['No. ' || doc_id, 'a & b']), unnest([1, 2]) FROM f WHERE ext = 'html')"""


@query(f"WITH {_FILES} SELECT doc_id, kind, ord::BIGINT ord, text FROM r")
def file_regions(s, d):
    raw = _as_files(s, d)
    regions, _ = readers.dispatched(raw)
    named = readers.versions(raw).join(raw.select("path", "doc_id"), "path")
    return named.join(regions, ["source_version_id", "ext"]).select("doc_id", "kind", "ord", "text")


@query(f"""WITH {_FILES}, n AS (SELECT doc_id, count(*) n FROM r GROUP BY 1)
SELECT doc_id, CASE WHEN ext = 'bin' THEN 'unreadable' WHEN ext = 'json' AND doc_id % 2 = 1 THEN 'partial' ELSE 'ready' END state, coalesce(n, 0) regions FROM f LEFT JOIN n USING (doc_id)""")
def file_coverage(s, d):
    raw = _as_files(s, d)
    _, coverage = readers.dispatched(raw)
    named = readers.versions(raw).join(raw.select("path", "doc_id"), "path")
    return named.join(coverage, ["source_version_id", "ext"]).select("doc_id", "state", "regions")


@query("""WITH m AS (SELECT doc_id, unnest(['front-matter', 'front-matter', 'work', 'back-matter', 'back-matter']) segment, unnest(['Title ' || doc_id, '*** START OF THE SAMPLE ***', 'Work of ' || source, '*** END OF THE SAMPLE ***', 'Licence']) AS text FROM documents WHERE source IS NOT NULL)
SELECT doc_id, segment, text FROM m""")
def work_segments(s, d):
    t = F.concat(F.lit("Title "), F.col("doc_id").cast("string"), F.lit("\r\n*** START OF THE SAMPLE ***\n\nWork of "), F.col("source"), F.lit("\r*** END OF THE SAMPLE ***\nLicence\n"))
    raw = table(s, d, "documents").where("source is not null").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".log")).alias("path"), t.cast("binary").alias("content"))
    regions, _ = readers.dispatched(raw)
    named = readers.versions(raw).join(raw.select("path", "doc_id"), "path")
    return named.join(regions, ["source_version_id", "ext"]).select("doc_id", "segment", "text")


_EDGE = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_CUT = f"""RECURSIVE p AS (SELECT doc_id, unnest(l) v, unnest(generate_series(1, len(l))) i FROM (SELECT doc_id, list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: {_EDGE.format('x')}) l FROM documents WHERE text IS NOT NULL)),
e AS (SELECT doc_id, i, v, 0::BIGINT a, NULL::VARCHAR piece FROM p UNION ALL
  SELECT doc_id, i, v, a + n, substr(v, a + 1, n) FROM (SELECT *, CASE WHEN rest <= 1400 THEN rest WHEN space > 770 THEN space ELSE 1400 END n FROM (
    SELECT *, length(v) - a rest, 1401 - instr(reverse(substr(v, a + 1, 1401)), ' ') space FROM e)) WHERE rest > 0)"""


@query(f"""WITH {_CUT} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, a) - 1 part, {_EDGE.format('piece')} AS text, true AS placed FROM e WHERE piece IS NOT NULL AND {_EDGE.format('piece')} <> ''""")
def cut_chunks(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    c = chunks.cut_rows(docs, "doc_id").join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("whole")), "id")
    return c.select(F.col("id").alias("doc_id"), "part", "text", (F.expr("substring(whole, cast(start + 1 as int), cast(end - start as int))") == F.col("text")).alias("placed"))


@query("""WITH RECURSIVE o AS (SELECT sourceVersionId v, coalesce(length(text), 0) n, row_number() OVER (PARTITION BY sourceVersionId ORDER BY doc_id) i FROM documents),
f AS (SELECT v, i, n, 0::BIGINT chunk, n chars FROM o WHERE i = 1 UNION ALL
  SELECT o.v, o.i, o.n, f.chunk + (f.chars + o.n > 18000)::BIGINT, CASE WHEN f.chars + o.n > 18000 THEN o.n ELSE f.chars + o.n END FROM f JOIN o ON o.v IS NOT DISTINCT FROM f.v AND o.i = f.i + 1)
SELECT v source_version_id, chunk, count(*) regions, sum(n)::BIGINT chars FROM f GROUP BY 1, 2""")
def packed_chunks(s, d):
    r = table(s, d, "documents").select(F.col("sourceVersionId").alias("source_version_id"), F.col("doc_id").alias("ord"), "text")
    return chunks.grouped(r).groupBy("source_version_id", "chunk").agg(F.count(F.lit(1)).alias("regions"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


@query(None)
def html_paragraphs(s, d):
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><p>"), F.regexp_replace("text", r"\n\s*\n", "</p><p>"), F.lit("</p></body></html>"))
    return readers.paragraphs(table(s, d, "documents").select("doc_id", page.alias("html")), "doc_id", "html")


# Counting, postings, retrieval

_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}][\\p{L}\\p{N}_''-]*')"
_STOP_A = "(" + ", ".join(f"'{w}'" for w in retrieve.STOP_A) + ")"
_STOP_B = "(" + ", ".join(f"'{w}'" for w in retrieve.STOP_B) + ")"
_TF = f"t AS (SELECT doc_id, unnest({_TOK}) term FROM documents), tf AS (SELECT doc_id, term, count(*) tf FROM t WHERE term NOT IN {_STOP_A} GROUP BY 1, 2)"


@query(f"WITH {_TF} SELECT term, count(*) df FROM tf GROUP BY term")
def document_frequency(s, d):
    return retrieve.document_frequency(retrieve.frequencies(table(s, d, "documents"), retrieve.SCOPED, "doc_id"))


@query(f"WITH {_TF} SELECT doc_id, term, tf FROM tf")
def term_frequency(s, d):
    return retrieve.frequencies(table(s, d, "documents"), retrieve.SCOPED, "doc_id").select(F.col("id").alias("doc_id"), "term", "tf")


@query(f"""WITH {_PASSAGES}, a AS (SELECT id, pred, unnest(string_split(regexp_extract(ske, '^\\(\\S+ (.*)\\)$', 1), ' ')) arg, unnest([0, 1])::BIGINT "position" FROM p WHERE lifecycle <> 'stale')
SELECT pred, "position", arg, count(DISTINCT id) n_records FROM a GROUP BY 1, 2, 3""")
def argument_postings(s, d):
    posted = catalog.postings(src.passage_facts(s, d).where("lifecycle <> 'stale'"))
    return posted.groupBy("pred", "position", "arg").agg(F.count(F.lit(1)).alias("n_records"))


@query(f"""WITH {_PASSAGES} SELECT pred, 2::BIGINT arity, count(*) n, min(ske) example FROM p GROUP BY pred""")
def vocabulary(s, d):
    return catalog.vocabulary(src.passage_facts(s, d))


_QUERIES = [("q1", "the unfinished letter of the weaver"), ("q2", "assessment of the granary and the copper kettle"), ("q3", "rope lantern lantern bridge")]
_QSQL = "q(query_id, query) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _QUERIES) + ")"


def _bm25_sql(tok: str, stop: str, least: int, distinct: bool, where: str) -> str:
    return f"""WITH {_QSQL}, d AS (SELECT doc_id, list_filter({tok.format('text')}, lambda x: x NOT IN {stop} AND length(x) >= {least}) ts FROM documents WHERE {where}),
w AS (SELECT count(*) n, avg(len(ts)) avgdl FROM d), tf AS (SELECT doc_id, len(ts) dl, term, count(*) tf FROM (SELECT doc_id, ts, unnest(ts) term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) df FROM tf GROUP BY 1), qt AS (SELECT query_id, term, {'1' if distinct else 'count(*)'} qn FROM (SELECT query_id, unnest({tok.format('query')}) term FROM q) WHERE term NOT IN {stop} AND length(term) >= {least} GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) score FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN w GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) score, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) "rank" FROM s) WHERE "rank" <= 10"""


_TOK_A = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}_''-]*')"
_TOK_B = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9''-]*')"


def _asked(s):
    return s.createDataFrame(_QUERIES, "query_id string, query string")


def _ranked(r):
    return r.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_bm25_sql(_TOK_A, _STOP_A, 1, False, "lang = 'en'"))
def bm25_scoped(s, d):
    docs = table(s, d, "documents").where("lang = 'en'")
    return _ranked(retrieve.top(retrieve.bm25(docs, _asked(s), retrieve.SCOPED, id="doc_id"), 10, by=["query_id"]))


@query(_bm25_sql(_TOK_B, _STOP_B, 2, True, "true"))
def bm25_baseline(s, d):
    return _ranked(retrieve.top(retrieve.bm25(table(s, d, "documents"), _asked(s), retrieve.BASELINE, id="doc_id"), 10, by=["query_id"]))


_DENSE = """c AS (SELECT q.vec_id query_id, v.vec_id id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
   / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) score
   FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 20 = 0),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, id) r FROM c)"""


@query(f'WITH {_DENSE} SELECT query_id, id, round(score, 6) score, r "rank" FROM dn WHERE r <= 10')
def dense_topk(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return retrieve.dense(v, q, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_DENSE}, l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10), id) r FROM c),
a AS (SELECT * FROM dn WHERE r <= 48), b AS (SELECT * FROM l WHERE r <= 48),
f AS (SELECT query_id, id, 1.0::DOUBLE / (60 + coalesce(a.r, 10000)) + 1.0::DOUBLE / (60 + coalesce(b.r, 10000)) score FROM a FULL JOIN b USING (query_id, id))
SELECT query_id, id, round(score, 9) score, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, id) "rank" FROM f) WHERE "rank" <= 12""")
def rank_fusion(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    near = retrieve.dense(v, q, 48)
    away = retrieve.dense(v.withColumn("vector", F.transform("vector", lambda x: -x)), q, 48)
    return retrieve.fused(near, away, 12).select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(None)
def expanded_search(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieve.expanded(docs, "the copper kettle of the weaver").select("id", F.round("score", 6).alias("score"), "rank")


@query("""WITH o AS (SELECT doc_id, source, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) used FROM documents)
SELECT doc_id, least(length(text), 5000 - used)::BIGINT chars FROM o WHERE used < 5000 AND length(text) > 0""")
def within_budget(s, d):
    r = retrieve.within_budget(table(s, d, "documents").select("doc_id", "source", "text"), 5000, ["source"], ["doc_id"])
    return r.select("doc_id", F.length("text").cast("long").alias("chars"))


# Graph

_TITLE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"
_ENT = f"""x AS (SELECT doc_id, regexp_extract_all(text, '{_TITLE}') a FROM documents),
y AS (SELECT doc_id, unnest(a) e, unnest(generate_series(1, len(a))) i FROM x), z AS (SELECT doc_id, e, min(i) i FROM y GROUP BY 1, 2),
ent AS (SELECT doc_id, e entity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) r FROM z) WHERE r <= 40)"""


@query(f"WITH {_ENT} SELECT doc_id, entity FROM ent")
def title_entities(s, d):
    return graph.entities(table(s, d, "documents"), "doc_id").select(F.col("id").alias("doc_id"), "entity")


@query(f"WITH {_ENT} SELECT p.entity a, q.entity b, count(*) weight FROM ent p JOIN ent q ON p.doc_id = q.doc_id AND p.entity < q.entity GROUP BY 1, 2")
def cooccurrence_edges(s, d):
    return graph.cooccurrence(graph.entities(table(s, d, "documents"), "doc_id"))


@query(f"""WITH {_ENT}, {_PASSAGES}, rel AS (SELECT split_part(regexp_extract(ske, '^\\(\\S+ (.*)\\)$', 1), ' ', 1) s, split_part(regexp_extract(ske, '^\\(\\S+ (.*)\\)$', 1), ' ', 2) o FROM p),
e AS (SELECT p.entity a, q.entity b, 1 w FROM ent p JOIN ent q ON p.doc_id = q.doc_id AND p.entity < q.entity UNION ALL SELECT least(s, o), greatest(s, o), 2 FROM rel)
SELECT a, b, sum(w)::BIGINT weight FROM e GROUP BY 1, 2""")
def relation_edges(s, d):
    """Names that stand in one document, and what passages state of two things, which weighs twice."""
    f = src.passage_facts(s, d).where("arity = 2")
    word = lambda i: F.substring(F.col("args")[i], 3, 1 << 30)
    return graph.cooccurrence(graph.entities(table(s, d, "documents"), "doc_id"), f.select(word(0).alias("subject"), F.col("pred").alias("predicate"), word(1).alias("object")))


@query(None)
def graph_communities(s, d):
    ents = graph.entities(table(s, d, "documents"), "doc_id")
    return graph.communities(graph.cooccurrence(ents), ents)


@query(None)
def graph_search(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    scratch = Scratch(s, "graph")
    ents = scratch.write(graph.entities(docs), "entities")
    homes = scratch.write(graph.communities(graph.cooccurrence(ents), ents), "homes")
    return graph.graph_scores(ents, homes, graph.summaries(ents, homes, docs), "the copper kettle of Louskovald")


# Windows and order


@query(f"""WITH p AS (SELECT * FROM {held('passages')} WHERE coalesce(lifecycle, '') <> 'deleted' AND startChar IS NOT NULL)
SELECT id, lag(id) OVER w before_id, lead(id) OVER w after_id FROM p WINDOW w AS (PARTITION BY sourceVersionId ORDER BY startChar, id)""")
def adjacent_context(s, d):
    by, order = ["source_version_id"], ["startChar", "id"]
    p = scan.spread(src.passages(s, d).where("startChar is not null").select(*by, *order), by, order)
    return scan.neighbours(p, by, order, "id", "before_id", "after_id").select("id", "before_id", "after_id")


@query("""WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 i, count(*) OVER (PARTITION BY source) n FROM documents)
SELECT doc_id, source FROM n WHERE n <= 20 OR floor((i + 1) * 20.0 / n) > floor(i * 20.0 / n)""")
def evenly_spaced(s, d):
    parts = scan.spread(table(s, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"])
    n = scan.rank(parts, ["source"], ["doc_id"], "i").withColumn("i", F.col("i") - 1)
    n = n.join(parts.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source")
    return n.where((F.col("n") <= 20) | (F.floor((F.col("i") + 1) * 20.0 / F.col("n")) > F.floor(F.col("i") * 20.0 / F.col("n")))).select("doc_id", "source")


@query("SELECT event_id, greatest(0, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) delta FROM events QUALIFY delta IS NOT NULL AND lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL")
def usage_delta(s, d):
    by, order = ["user_id"], ["ts", "event_id"]
    parts = scan.spread(table(s, d, "events").select(*by, *order, "value"), by, order)
    e = scan.neighbours(parts, by, order, "value", "b", "a").where("b is not null")
    return e.select("event_id", F.greatest(F.lit(0.0), F.col("value") - F.col("b")).alias("delta"))


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) event_id FROM events GROUP BY 1, 2")
def distinct_last_wins(s, d):
    return latest(table(s, d, "events"), ["user_id", "event_type"], ["event_id"], "ts")


# Procedures, audits, evaluation


@query(f"WITH {_PASSAGES} SELECT id, 'exactly_relevant' label FROM p WHERE lifecycle <> 'stale' AND pred = 'hides'")
def relevance_findings(s, d):
    return procedures.relevance(src.passage_facts(s, d), "(hides ?who ?what)").select("id", "label")


@query(f"WITH {_PASSAGES} SELECT id, criterion FROM p CROSS JOIN (VALUES ('coherence'), ('themes')) c(criterion) WHERE lifecycle <> 'stale'")
def rubric_findings(s, d):
    return procedures.rubric(src.passage_facts(s, d), ["coherence", "themes"]).select("id", "criterion")


@query(f"WITH p AS (SELECT * FROM {held('passages')} WHERE coalesce(lifecycle, '') <> 'deleted') SELECT sourceVersionId source_version_id, bool_and(quote IS NOT NULL) complete FROM p GROUP BY 1")
def coverage_division(s, d):
    p = src.passages(s, d).select("source_version_id", F.col("id").alias("region_id"), F.when(F.col("quote").isNotNull(), "processed").otherwise("deferred").alias("state"))
    return audit.covered(p, p)


@query(f"""WITH {_PASSAGES}, v AS (SELECT id, 'stale or unusable record' violation FROM p WHERE NOT coalesce(usable, false) UNION ALL SELECT id, 'quote not in region' FROM p WHERE quote IS NULL OR trim(quote) = '')
SELECT id, violation FROM v""")
def evidence_violations(s, d):
    f = src.passage_facts(s, d)
    regions = f.select("source_version_id", F.col("id").alias("region_id"), F.concat_ws(" ", F.lit("…"), "quote", F.lit("…")).alias("text"))
    ev = f.select("id", F.col("id").alias("record_id"), "source_version_id", F.col("id").alias("region_id"), "quote", "expr_key")
    return audit.evidence_violations(ev, f, regions)


@query("SELECT family, count(*) n, count(*) FILTER (expected = 'supported') supported, round(avg(len(gold.recordIds)), 6) mean_gold FROM " + held("controlled_cases") + " GROUP BY 1")
def family_metrics(s, d):
    c = latest(table(s, d, "controlled_cases"), "id", ["family", "expected", "gold"])
    c = c.withColumn("g", F.when(F.col("gold.recordIds").isNotNull(), F.size("gold.recordIds")))
    return c.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expected") == "supported").alias("supported"), F.round(metrics.mean("g"), 6).alias("mean_gold"))


@query(f"""WITH s AS (SELECT sourceVersionId v, startChar a, max(endChar) b FROM {held('passages')} WHERE endChar > startChar AND coalesce(lifecycle, '') <> 'deleted' GROUP BY 1, 2),
r AS (SELECT *, max(b) OVER (PARTITION BY v ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM s),
i AS (SELECT *, sum(CASE WHEN a <= m THEN 0 ELSE 1 END) OVER (PARTITION BY v ORDER BY a ROWS UNBOUNDED PRECEDING) g FROM r)
SELECT v source_version_id, min(a) AS "start", max(b) AS "end" FROM i GROUP BY v, g""")
def interval_union(s, d):
    p = src.passages(s, d)
    return metrics.interval_union(p, ["source_version_id"], "startChar", "endChar").select("source_version_id", "start", "end")


_SPANS = f"""g AS (SELECT lower(trim(sourceId)) sid, unnest(evidence, recursive := true) FROM {held('questions')}), gs AS (SELECT DISTINCT sid, startChar a, endChar b FROM g WHERE endChar > startChar AND sid <> ''),
ps AS (SELECT DISTINCT lower(trim(sourceId)) sid, startChar a, endChar b FROM {held('passages')} WHERE endChar > startChar AND coalesce(lifecycle, '') <> 'deleted' AND trim(sourceId) <> '')"""


def _spans(s, d):
    q = latest(table(s, d, "questions"), "id", ["sourceId", "evidence"])
    g = q.select(label("sourceId").alias("sid"), F.explode("evidence").alias("e")).select("sid", F.col("e.startChar").alias("start"), F.col("e.endChar").alias("end")).where("sid is not null and end > start").distinct()
    p = src.passages(s, d).select(label("source_id").alias("sid"), F.col("startChar").alias("start"), F.col("endChar").alias("end")).where("sid is not null and end > start").distinct()
    return g, p


@query(f"WITH {_SPANS} SELECT gs.sid, sum(least(gs.b, ps.b) - greatest(gs.a, ps.a))::BIGINT shared, count(*) pairs FROM gs JOIN ps ON gs.sid = ps.sid AND gs.a < ps.b AND ps.a < gs.b GROUP BY 1")
def interval_overlap(s, d):
    g, p = _spans(s, d)
    return metrics.overlaps(g, p, ["sid"], width=256).groupBy("sid").agg(F.sum("shared").cast("long").alias("shared"), F.count(F.lit(1)).alias("pairs"))


def _union_sql(n: str) -> str:
    return f"""{n}r AS (SELECT *, max(b) OVER (PARTITION BY sid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM {n}s),
{n}i AS (SELECT *, sum(CASE WHEN a <= m THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY a, b ROWS UNBOUNDED PRECEDING) k FROM {n}r), {n}u AS (SELECT sid, min(a) a, max(b) b FROM {n}i GROUP BY sid, k)"""


@query(f"""WITH {_SPANS}, {_union_sql('g')}, {_union_sql('p')}, sh AS (SELECT gu.sid, sum(least(gu.b, pu.b) - greatest(gu.a, pu.a)) n FROM gu JOIN pu ON gu.sid = pu.sid AND gu.a < pu.b AND pu.a < gu.b GROUP BY 1),
gl AS (SELECT sid, sum(b - a) n FROM gu GROUP BY 1), pl AS (SELECT sid, sum(b - a) n FROM pu GROUP BY 1), sp AS (SELECT sid, count(*) n FROM gs GROUP BY 1),
wh AS (SELECT gs.sid, count(*) n FROM gs WHERE EXISTS (SELECT 1 FROM pu WHERE pu.sid = gs.sid AND pu.a <= gs.a AND pu.b >= gs.b) GROUP BY 1)
SELECT sid, CASE WHEN pl.n > 0 THEN round(coalesce(sh.n, 0) / pl.n, 6) END "precision", CASE WHEN gl.n > 0 THEN round(coalesce(sh.n, 0) / gl.n, 6) END recall, CASE WHEN sp.n > 0 THEN round(coalesce(wh.n, 0) / sp.n, 6) END span_recall
FROM pl FULL JOIN gl USING (sid) LEFT JOIN sh USING (sid) LEFT JOIN sp USING (sid) LEFT JOIN wh USING (sid)""")
def span_precision_recall(s, d):
    g, p = _spans(s, d)
    one = F.lit(0).alias("src")
    r = metrics.span_scores(p.select("*", one), g.select("*", one), ["sid"], "src")
    return r.select("sid", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("span_recall", 6).alias("span_recall"))


@query(None)
def bootstrap_by_type(s, d):
    return metrics.bootstrap_rows(table(s, d, "events").select("event_id", "event_type", "value"), "value", ["event_type"])


@query(f"""WITH k AS (SELECT DISTINCT id, procedureId batch, {norm('x')} AS "key" FROM (SELECT id, procedureId, unnest(evidenceIds) x FROM {held('findings')}) WHERE {norm('x')} IS NOT NULL)
SELECT a.id AS "left", b.id AS "right", count(DISTINCT a.key) n_keys FROM k a JOIN k b ON a.key = b.key AND a.id < b.id AND a.batch <> b.batch GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 512""")
def linked_pairs(s, d):
    f = latest(table(s, d, "findings"), "id", ["procedureId", "evidenceIds"])
    rows = f.select("id", F.col("procedureId").alias("batch"), F.explode(F.transform("evidenceIds", label)).alias("key"))
    return entities.linked(rows).select("left", "right", F.size("keys").cast("long").alias("n_keys"))


@query(f"WITH {_PASSAGES} SELECT id, regexp_replace(regexp_replace(ske, ' kettle\\)', ' cauldron)'), ' kettle ', ' cauldron ') expr FROM p WHERE ske LIKE '% kettle%' AND regexp_matches(ske, ' kettle[ )]')")
def entity_merge(s, d):
    f = src.passage_facts(s, d)
    new, journal = entities.merged(f, "kettle", "cauldron")
    return new.join(journal.select("id"), "id", "left_semi").select("id", F.col("expr_key").alias("expr"))


@query(f"""SELECT q normal, count(*) n FROM (SELECT trim(regexp_replace(lower(question), '[\\s\\p{{Z}}]+', ' ', 'g')) q FROM {held('questions')}) WHERE q <> '' GROUP BY 1 HAVING count(*) > 1""")
def question_duplicates(s, d):
    return catalog.duplicates(latest(table(s, d, "questions"), "id", ["question"]), "question")


@query(f"""SELECT b profile, p procedure, s source_id FROM (SELECT DISTINCT lower(trim(sourceId)) s FROM source_versions) CROSS JOIN (VALUES ('short'), ('long')) x(b) CROSS JOIN (VALUES ('audit'), ('rubric')) y(p)""")
def task_product(s, d):
    each = lambda names: F.explode(F.array(*[F.lit(n) for n in names]))
    t = table(s, d, "source_versions").select(label("sourceId").alias("source_id")).distinct()
    return t.withColumn("profile", each(["short", "long"])).withColumn("procedure", each(["audit", "rubric"]))


QUERIES = Q
