"""The registered queries of this folder, with their SQL where SQL can say the same.

Every query reads whole tables and whole texts. The digest columns that the queries return are derived from the
operators' general outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgeline.llm import crossparse, digest_index, edits, factors, hosts, licences, logbilinear, mixing, pieces, simhash
from judgeline.llm.audit_queries import QUERIES as AUDIT_QUERIES
from judgeline.llm.audit_queries import SQL as AUDIT_SQL
from judgeline.llm.common import fold, table

QUERIES, SQL = dict(AUDIT_QUERIES), dict(AUDIT_SQL)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, links at 4 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places and labels; the score is the largest covered share of a template."""
    out = licences.scan_licences(table(spark, sf_dir, "documents"))
    spans = F.arrays_zip("labels", "starts", "exact")
    base = F.filter(spans, lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["starts"])
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda s: s["labels"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct("labels")), ",").alias("labels"),
        F.coalesce(F.array_max("shares"), F.lit(0.0)).alias("score"))


@query("""
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an index that starts empty."""
    return digest_index.exact_dedup(table(spark, sf_dir, "documents"), digest_index.DigestIndex(spark))


#: (verdict, host, path) as the query's contract gives them.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]

#: Labelled rows that the words of op6 are learned from, at most: the first by md5 of their id.
LABELLED = 20_000

_SHRUNK = """
{name}_s AS (SELECT sum(n)::DOUBLE AS n, sum(n::DOUBLE * n) AS nn, sum(prior * (1 - prior)) AS chance,
    sum(n * prior * (1 - prior)) AS n_chance, sum(n * pow(bad / n::DOUBLE - prior, 2)) AS spread FROM {name}_0),
{name}_b AS (SELECT n, n_chance, CASE WHEN n - nn / n > 0 THEN (spread - chance) / (n - nn / n) ELSE 0 END AS between_ FROM {name}_s),
{name}_k AS (SELECT CASE WHEN between_ > 0 THEN least(1000.0, greatest(2.0, n_chance / n / between_ - 1)) ELSE 1000.0 END AS k
    FROM {name}_b),
{name} AS (SELECT *, (bad + k * prior) / (n + k) AS rate FROM {name}_0, {name}_k)"""


@query("""
WITH p AS (
    SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN
        translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        ELSE '' END AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, html
    FROM pages),
e AS (SELECT text, max((coalesce(toxic, 0) = 1)::INTEGER) AS bad FROM documents
    JOIN (FROM labels WHERE doc_id IS NOT NULL ORDER BY md5(doc_id::VARCHAR), coalesce(toxic, 0) = 1 LIMIT 20000) USING (doc_id)
    WHERE text IS NOT NULL GROUP BY text),
ew AS (SELECT bad, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\p{L}+'))) AS word FROM e),
et AS (SELECT word, n, (a + 2.0::DOUBLE * m) / (n + 2) AS r FROM (SELECT word, sum(bad)::DOUBLE AS a, count(*)::DOUBLE AS n FROM ew GROUP BY word),
    (SELECT avg(bad) AS m FROM e)),
bw AS (SELECT word FROM et WHERE r - 3 * sqrt(r * (1 - r) / (n + 3)) > 0.5),
hw AS (SELECT html, unnest(list_distinct(regexp_extract_all(translate(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]*>', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\p{L}+'))) AS word
    FROM (SELECT DISTINCT html FROM pages)),
bh AS (SELECT DISTINCT html FROM hw SEMI JOIN bw USING (word)),
f AS (SELECT p.*, CASE
        WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
o AS (SELECT host, (CASE WHEN rule IS NULL THEN bh.html IS NOT NULL ELSE rule NOT IN ('com/', 'www.example.com/en/') END)::BIGINT AS bad
    FROM f LEFT JOIN bh ON f.html = bh.html),
c AS (SELECT h.host, array_to_string(list_slice(string_split(h.host, '.'), -2, -1), '.') AS domain,
        string_split(h.host, '.')[-1] AS suffix, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad
    FROM (SELECT DISTINCT host FROM p) h LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS bad FROM o GROUP BY host) USING (host)),
overall AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(n), 0), 0) AS prior0 FROM c),
s_0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior0) AS prior FROM c, overall WHERE n > 0 GROUP BY suffix),
""" + _SHRUNK.format(name="s") + """,
d_0 AS (SELECT x.*, s.rate AS prior FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM c WHERE n > 0
    GROUP BY domain, suffix) x JOIN s USING (suffix)),
""" + _SHRUNK.format(name="d") + """,
w AS (SELECT c.*, coalesce(d.rate, s.rate, prior0) AS prior FROM c LEFT JOIN d USING (domain) LEFT JOIN s ON s.suffix = c.suffix, overall),
h_0 AS (SELECT * FROM w WHERE n > 0),
""" + _SHRUNK.format(name="h") + """,
r AS (SELECT host, n, kk, (bad + kk * prior) / (n + kk) AS rate FROM w, (SELECT coalesce(max(k), 1000.0) AS kk FROM h_k)),
v AS (SELECT host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + kk + 1)) AS low FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block' WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(rate, 6) AS bad_rate
FROM f JOIN v USING (host)
""")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then host reputation: pages are bad by a rule's verdict, else by words that mark toxic documents."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    toxic = (F.coalesce("toxic", F.lit(0)) == 1).alias("bad")
    sample = labels.where("doc_id IS NOT NULL").select("doc_id", toxic).orderBy(
        F.md5(F.col("doc_id").cast("string").cast("binary")), "bad").limit(LABELLED)
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    outcomes = hosts.page_outcomes(pages, labelled, URL_RULES)
    out = hosts.filter_urls(pages, outcomes, URL_RULES)
    return out.withColumn("bad_rate", F.round("bad_rate", 6))


@query("""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
l AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS lev, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all FROM w),
b AS (SELECT *, coalesce(sum(cap) OVER x, 0) AS cap_before, coalesce(sum(w) OVER x, 0) AS w_before FROM l
    WINDOW x AS (ORDER BY lev, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, (total - cap_before) / (w_all - w_before) AS share FROM b),
c AS (SELECT coalesce(arg_min(share, lev), 0) AS common FROM h WHERE share <= lev),
t AS (SELECT source, source_size, CASE WHEN lev <= common THEN cap ELSE w * common END AS target FROM h, c),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(rate)::BIGINT AS whole, round((rate - floor(rate)) * 4294967296)::BIGINT AS lim FROM r),
z AS (SELECT q.*, i, ('0x' || substr(md5((i // 4)::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')), 1 + 8 * (i % 4)::BIGINT, 8))::BIGINT AS draw
    FROM q, range(32) x(i)),
m AS (SELECT source, i, abs(sum((whole + (draw < lim)::BIGINT) * size) - any_value(target)) AS miss FROM z GROUP BY source, i),
best AS (SELECT source, i FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, i) = 1)
SELECT doc_id, size, source_size, target, (whole + (draw < lim)::BIGINT) * size AS taken, whole + (draw < lim)::BIGINT AS copies
FROM z JOIN best ON z.source IS NOT DISTINCT FROM best.source AND z.i = best.i
""")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3 repeating over the sources."""
    return mixing.mix_plan(table(spark, sf_dir, "documents"), [1, 2, 3])


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts as digests."""
    out = pieces.encode_decode(table(spark, sf_dir, "documents"), piece_model_path())
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from ids whose crc32 is not 2 modulo 4."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    samples = crossparse.learn_samples(docs.where(~held_out))
    return crossparse.identify(docs, samples).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op10_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its edited text and the next document."""
    out = edits.fingerprints_with_next(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM p),
c AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM f WHERE low < doc_id),
x AS (SELECT doc_id, i, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i
    GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a smaller document has."""
    out = factors.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op9_log_bilinear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from ids whose crc32 is not 1 modulo 5."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 1
    model = logbilinear.learn(docs.where(~held_out))
    out = logbilinear.score(docs, model, "doc_id", "text", held_out.alias("held_out"))
    return out.withColumn("train_tokens", F.lit(model.total).cast("long"))
