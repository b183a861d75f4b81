"""Registered queries of the filter audit, the secret scan and the conversation trie, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgeline.llm import filter_audit, prefix_trie, secrets
from judgeline.llm.common import table

QUERIES, SQL = {}, {}

FILTERS = ["A", "B", "C", "D", "E"]

SQL["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
    WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x
    AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS seen
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (SELECT *, contains(fails, f) AS hit, translate(fails, seen, '') <> fails AS gone FROM c, s),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM m GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by language, in all 120 orders."""
    rows = filter_audit.failures(table(spark, sf_dir, "documents"), True, "doc_id", "text", F.col("lang").alias("part"))
    marked = rows.join(filter_audit.marks(table(spark, sf_dir, "labels")), "doc_id", "left")
    return filter_audit.audit(
        marked.fillna(0, ["good", "toxic"]), FILTERS, part="part", fails="fails", good="good", toxic="toxic")


QUERIES["op11_filter_audit"] = op11_filter_audit


def _matches_sql(kind: int, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, owner, {kind} AS kind, unnest(range(1, len(m) + 1)) AS i, m, g FROM (SELECT r, owner,
        regexp_extract_all(t, '{quoted}') AS m, list_transform(string_split_regex(t, '{quoted}'), lambda x: length(x)) AS g FROM d)"""


SQL["op12_secret_scan"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS owner FROM documents),
a AS (""" + "\n    UNION ALL ".join(
    _matches_sql(i, p) for i, (p, _, _) in enumerate([*secrets.BASE.values(), *secrets.ADDED.values()])) + """),
b AS (SELECT r, owner, kind, m[i] AS match, list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM a),
c AS (SELECT r, owner, kind, start::BIGINT AS start, (start + length(match))::BIGINT AS stop,
    CASE WHEN kind = 0 THEN regexp_extract(match, '""" + secrets.ASSIGN.replace("'", "''") + """', 2) ELSE match END AS value FROM b),
v AS (SELECT * FROM c WHERE length(value) >= [6, 20, 24, 64, 32, 20][kind + 1] AND (kind <> 5 OR (regexp_matches(value, '[0-9]')
    AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')))),
o AS (SELECT value, count(DISTINCT coalesce('+' || owner, '')) AS owners FROM v GROUP BY value),
j AS (SELECT v.*, CASE WHEN owners >= 3 OR NOT (length(v.value) >= 8 AND regexp_matches(v.value, '[0-9]') AND regexp_matches(v.value, '[A-Za-z]')
    AND NOT regexp_matches(v.value, '(?i)example|sample|dummy|changeme|placeholder|your|xxxx|secret|test')
    AND len(list_distinct(string_split(v.value, ''))) >= 6) THEN 'example' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS verdict
    FROM v JOIN o ON v.value = o.value),
k AS (SELECT * FROM j WHERE kind < 3 OR (verdict = 'live' AND NOT EXISTS (SELECT 1 FROM j x WHERE x.r = j.r AND x.kind < 3
    AND x.start < j.stop AND j.start < x.stop))),
n AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(['assign', 'access', 'hex', 'private', 'signed', 'opaque'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
    string_agg(verdict, ',' ORDER BY start, kind) AS verdicts FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(verdicts, '') AS verdicts FROM d LEFT JOIN n ON d.r = n.r
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the owners, documents their repositories."""
    out = secrets.scan_secrets(table(spark, sf_dir, "documents"), owner=F.col("source"), repo=F.col("doc_id"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["name"] == k)).cast("long").alias(f"n_{k}")
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["verdict"]), ",").alias("verdicts"))


QUERIES["op12_secret_scan"] = op12_secret_scan


SQL["op13_conversation_trie"] = """
WITH RECURSIVE t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
k(c, s, i, crc) AS (SELECT DISTINCT c, c::VARCHAR, 0, 4294967295::BIGINT FROM t
    UNION ALL SELECT c, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(crc, ascii(substr(s, i // 9 + 1, 1))::BIGINT)
        WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END FROM k WHERE i < 9 * length(s)),
h AS (SELECT c, c - c % 100 AS b, xor(crc, 4294967295) % 6 AS h FROM k WHERE i = 9 * length(s)),
u AS (SELECT h.c, 0 AS own, t.i, x FROM h JOIN t ON t.c = b AND t.i <= h UNION ALL SELECT h.c, 1, t.i, x FROM h JOIN t ON t.c = h.c AND t.i > h),
l AS (SELECT h.c, coalesce(list(x ORDER BY own, i) FILTER (x IS NOT NULL), []) AS seq FROM h LEFT JOIN u ON u.c = h.c GROUP BY h.c),
p AS (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS depth FROM l),
n AS (SELECT depth, seq[1:depth] AS pre, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CASE WHEN len(seq) = depth THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM p GROUP BY depth, seq[1:depth]),
a AS (SELECT depth, pre, conv_id, n_convs, ends, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(pre[depth].t) END AS saved FROM n),
k2 AS (SELECT depth - 1 AS depth, pre[1:depth - 1] AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
b AS (SELECT a.*, coalesce(n_children, 0) AS n_children FROM a LEFT JOIN k2 ON a.depth = k2.depth AND a.pre = k2.pre),
e AS (SELECT pre[1:d] AS pre, d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM b) GROUP BY pre[1:d], d)
SELECT b.conv_id, b.depth, q.conv_id AS parent_conv_id, b.n_convs, b.n_children, e.n_leaves::BIGINT AS n_leaves,
    e.saved::BIGINT AS saved_tokens, sha256(b.ends) AS ends_sha256
FROM b JOIN e ON b.depth = e.depth AND b.pre = e.pre LEFT JOIN b q ON q.depth = b.depth - 1 AND q.pre = b.pre[1:b.depth - 1]
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations grafted on the first of each hundred ids, by up to five turns."""
    return prefix_trie.conversation_trie(
        table(spark, sf_dir, "conversations"), base=lambda c: c - c % 100,
        head=lambda c: F.crc32(c.cast("string").cast("binary")) % 6, most=5)


QUERIES["op13_conversation_trie"] = op13_conversation_trie
