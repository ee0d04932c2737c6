"""SQL to compare the training-data queries with."""

_TRIM = r"regexp_replace(lower({}), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def norm(x: str) -> str:
    return f"nullif({_TRIM.format(x)}, '')"


def hyphened(x: str) -> str:
    return f"nullif(regexp_replace({_TRIM.format(x)}, '[\\s\\p{{Z}}_]+', '-', 'g'), '')"


def held(table: str, key: str = "id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY recordedAt DESC) rn FROM {table}) WHERE rn = 1)"


_TERMS = rf"""t AS (SELECT 'criterion' field, id, unnest(regexp_extract_all(lower(criterion), '[\p{{L}}\p{{N}}]+')) term FROM {held('findings')}
  UNION ALL SELECT 'category', id, {hyphened('category')} FROM {held('questions')}),
n AS (SELECT 'criterion' field, count(DISTINCT id) n FROM findings UNION ALL SELECT 'category', count(DISTINCT id) FROM questions),
c AS (SELECT field, term, count(*) occurrences, count(DISTINCT id) records FROM t WHERE term IS NOT NULL GROUP BY 1, 2),
m AS (SELECT c.*, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.15 * n THEN 'common' END mark FROM c JOIN n USING (field))"""

P5_FOUND = f"WITH {_TERMS} SELECT field, term, mark FROM m WHERE mark IS NOT NULL"
P5_TERMS = f"WITH {_TERMS} SELECT field, term, occurrences, records, mark FROM m"
P5_NGRAMS = rf"""WITH w AS (SELECT id, regexp_extract_all(lower(criterion), '[\p{{L}}\p{{N}}]+') a FROM {held('findings')}),
g AS (SELECT id, i, k, list_aggregate(a[i:i + k - 1], 'string_agg', ' ') ngram FROM
  (SELECT id, a, unnest(generate_series(1::BIGINT, len(a))) i FROM w), generate_series(1::BIGINT, 5::BIGINT) s(k) WHERE i + k - 1 <= len(a))
SELECT 'criterion' field, ngram, k n, count(*) occurrences, count(DISTINCT id) records FROM g GROUP BY ngram, k"""

P5_ALL_NGRAMS = rf"""WITH w AS (SELECT id, regexp_extract_all(lower(criterion), '[\p{{L}}\p{{N}}]+') a FROM {held('findings')}),
s AS (SELECT id, a, unnest(generate_series(1::BIGINT, len(a))) i FROM w), k AS (SELECT id, a, i, unnest(generate_series(1::BIGINT, len(a) - i + 1)) k FROM s),
g AS (SELECT id, k, list_aggregate(a[i:i + k - 1], 'string_agg', ' ') ngram FROM k)
SELECT 'criterion' field, ngram, k n, count(*) occurrences, count(DISTINCT id) records FROM g GROUP BY ngram, k"""

_WORDS = rf"""w AS (SELECT id, list_distinct(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) a FROM (
  SELECT id, question t FROM {held('questions')} UNION ALL SELECT itemId, question FROM {held('checkpoint_items', 'itemId')}))"""
P3_FOUND = f"""WITH {_WORDS}
SELECT DISTINCT x.id id_a, y.id id_b FROM w x JOIN w y ON x.id < y.id AND len(x.a) > 0 AND len(y.a) >= 0.7 * len(x.a) AND len(x.a) >= 0.7 * len(y.a)
  AND len(list_intersect(x.a, y.a)) * 17 >= 7 * (len(x.a) + len(y.a))"""

P3_GROUPS = f"""WITH RECURSIVE {_WORDS}, m AS (SELECT id, list_sort(a) a FROM w WHERE len(a) > 0), c AS (SELECT a, min(id) cid FROM m GROUP BY a),
p AS (SELECT x.cid u, y.cid v FROM c x JOIN c y ON x.cid <> y.cid AND len(y.a) >= 0.7 * len(x.a) AND len(x.a) >= 0.7 * len(y.a) AND len(list_intersect(x.a, y.a)) * 17 >= 7 * (len(x.a) + len(y.a))),
r(u, v) AS (SELECT cid, cid FROM c UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u), g AS (SELECT u cid, min(v) root FROM r GROUP BY u), l AS (SELECT u cid, count(*) links FROM p GROUP BY u),
j AS (SELECT m.id, root, coalesce(links, 0) links FROM m JOIN c USING (a) JOIN g USING (cid) LEFT JOIN l USING (cid)), s AS (SELECT root, min(id) group_id, count(*) group_size FROM j GROUP BY root)
SELECT id, group_id, group_size, links FROM j JOIN s USING (root)"""

_WANTED = f"""q AS (SELECT id, {norm('sourceId')} s, {hyphened('category')} c FROM {held('questions')}),
s AS (SELECT DISTINCT s FROM q WHERE s IS NOT NULL), n AS (SELECT s, c, count(DISTINCT id) n FROM q GROUP BY 1, 2),
r AS (SELECT s.s source_id, t.category, greatest(t.min_keep, round(t.target_share * 25))::BIGINT wanted, coalesce(n.n, 0) available
  FROM s CROSS JOIN category_targets t LEFT JOIN n ON n.s = s.s AND n.c = t.category)"""
P1_FOUND = f"WITH {_WANTED} SELECT source_id, category FROM r WHERE available < wanted"
P1_SUPPLY = f"WITH {_WANTED} SELECT source_id, category, wanted, available, available < wanted lacks FROM r"
P1_TOTALS = f"WITH {_WANTED} SELECT source_id, least(25, sum(available))::BIGINT n_sampled, least(25, sum(available))::BIGINT n_ids FROM r GROUP BY 1 HAVING sum(available) > 0"
P7_BOUNDS = "SELECT count(*) n_items, 0::BIGINT lost, 0::BIGINT overfull, 0::BIGINT split_small, true near_least FROM documents"
P8_BOUNDS = "SELECT source, true uses_kept FROM mix_targets"
