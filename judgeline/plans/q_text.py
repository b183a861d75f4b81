"""Queries on text, chunk and label functions, requests and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from judgeline.functions import scoring as X
from judgeline.functions import text as T
from judgeline.operators import judging as G
from judgeline.plans import fixtures as fx
from judgeline.plans.q_tables import generated
from judgeline.plans.registry import query
from judgeline.plans.sqlparts import part, tokens

DOC = "SELECT CAST(doc_id AS VARCHAR) did, "


def _docs(name, sql, column):
    """A query that maps every document's whole text through one expression."""

    @query(name, "", DOC + sql + " FROM documents")
    def run(spark, sf):
        return fx.corpus(spark, sf).select("did", *(column() if isinstance(column(), list) else [column()]))


_docs("tokenize_ws", f"array_to_string({tokens('text')}, ' ') toks", lambda: F.array_join(T.tokenize_ws("text"), " ").alias("toks"))
_docs("tokenize_ws_cased", f"array_to_string({tokens('text', False)}, ' ') toks",
      lambda: F.array_join(T.tokenize_ws("text", lower=False), " ").alias("toks"))
_docs("tokenize_letters", "array_to_string(list_transform(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+'), lambda x: lower(x)), ' ') toks",
      lambda: F.array_join(T.tokenize_letters("text"), " ").alias("toks"))
NORM = "translate(lower(text), '¿?¡!,.:;', '        ')"
_docs("normalize_text", f"{NORM} norm", lambda: T.normalize_text("text").alias("norm"))
_docs("token_set_punct", rf"array_to_string(list_sort(list_distinct(list_filter(string_split_regex({NORM}, '\s+'), lambda x: x <> ''))), ' ') toks",
      lambda: F.array_join(F.sort_array(T.token_set_punct("text")), " ").alias("toks"))
_docs("strip_accents", "strip_accents(text) plain", lambda: T.strip_accents("text").alias("plain"))
_docs("normalize_token", "array_to_string(list_transform("
      + tokens("text") + ", lambda x: regexp_replace(strip_accents(lower(x)), '[^a-zA-Z]', '', 'g')), ' ') toks",
      lambda: F.array_join(F.transform(T.tokenize_ws("text"), T.normalize_token), " ").alias("toks"))
_docs("summary_budget", "CAST(least(512, greatest(128, floor(len(string_split(text, ' ')) * 0.08))) AS INT) budget",
      lambda: T.summary_budget("text").alias("budget"))
_docs("mandatory_terms", "array_to_string(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '|') terms",
      lambda: F.array_join(T.mandatory_terms("text"), "|").alias("terms"))
_docs("extract_numbers", "array_to_string(regexp_extract_all(text, '\\d+'), ',') numbers",
      lambda: F.array_join(T.extract_numbers("text"), ",").alias("numbers"))

CHUNK = """SELECT did || '__chunk' || i cid, did, CAST(i AS INT) idx, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') text FROM
    (SELECT did, w, unnest(range(CAST(ceil(len(w) / {step}) AS BIGINT))) i FROM (SELECT CAST(doc_id AS VARCHAR) did, {words} w FROM documents))"""


def _chunked(spark, sf, chunks, source=None):
    rows = (source if source is not None else fx.corpus(spark, sf)).select("did", F.posexplode(chunks).alias("idx", "text"))
    return rows.select(T.chunk_id("did", "idx").alias("cid"), "did", "idx", "text")


@query("chunk_sliding", "", CHUNK.format(step=32, size=64, words=tokens("text", False)))
def chunk_sliding(spark, sf):
    return _chunked(spark, sf, T.chunk_sliding("text", 64))


@query("chunk_sliding_stride", "", CHUNK.format(step=128, size=512, words=tokens("text", False)))
def chunk_sliding_stride(spark, sf):
    return _chunked(spark, sf, T.chunk_sliding("text", 512, 128))


@query("chunk_fixed", "", CHUNK.format(step=256, size=256, words="string_split(text, ' ')"))
def chunk_fixed(spark, sf):
    return _chunked(spark, sf, T.chunk_fixed("text", 256))


# Blank lines: the documents' single line breaks, doubled.
PARA = r"replace(text, chr(10), chr(10) || chr(10))"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
part("paras", "", f"""SELECT did, CAST(row_number() OVER (PARTITION BY did ORDER BY i) - 1 AS INT) idx, p text FROM (SELECT did, {STRIP.format('p')} p, i FROM
    (SELECT CAST(doc_id AS VARCHAR) did, unnest(string_split({PARA}, chr(10) || chr(10))) p, generate_subscripts(string_split({PARA}, chr(10) || chr(10)), 1) i
    FROM documents)) WHERE p <> ''""")


def paragraph_corpus(spark, sf):
    return fx.corpus(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query("chunk_paragraphs", "paras", "SELECT did || '__chunk' || idx cid, did, idx, text FROM paras")
def chunk_paragraphs(spark, sf):
    return _chunked(spark, sf, T.chunk_paragraphs("text"), paragraph_corpus(spark, sf))


@query("chunk_paragraph_pack", "", rf"""WITH RECURSIVE paras AS MATERIALIZED (SELECT did, row_number() OVER (PARTITION BY did ORDER BY i) n, p,
    len(list_filter(string_split_regex(p, '\s+'), lambda x: x <> '')) w FROM (SELECT did, {STRIP.format('p')} p, i FROM
    (SELECT CAST(doc_id AS VARCHAR) did, unnest(string_split({PARA}, chr(10) || chr(10))) p, generate_subscripts(string_split({PARA}, chr(10) || chr(10)), 1) i
    FROM documents)) WHERE p <> ''),
    walk AS (SELECT did, n, w, 0 g FROM paras WHERE n = 1 UNION ALL
    SELECT p.did, p.n, CASE WHEN walk.w + p.w <= 64 THEN walk.w + p.w ELSE p.w END, CASE WHEN walk.w + p.w <= 64 THEN g ELSE g + 1 END
    FROM walk JOIN paras p ON p.did = walk.did AND p.n = walk.n + 1)
    SELECT did || '__chunk' || g cid, did, g idx, string_agg(p, ' ' ORDER BY n) text FROM walk JOIN paras USING (did, n) GROUP BY did, g""")
def chunk_paragraph_pack(spark, sf):
    return _chunked(spark, sf, T.chunk_paragraph_pack("text", 64), paragraph_corpus(spark, sf))


@query("chunk_headers", "", rf"""SELECT did, coalesce(string_agg(printf('## CHUNK_%03d (words %d-%d)', i + 1, i * 256 + 1, least(i * 256 + 256, len(w))) || chr(10) || chr(10)
    || array_to_string(w[i * 256 + 1 : i * 256 + 256], ' '), chr(10) || chr(10) ORDER BY i), '') text FROM
    (SELECT did, w, unnest(range(CAST(ceil(len(w) / 256) AS BIGINT))) i FROM (SELECT CAST(doc_id AS VARCHAR) did, {tokens('text', False)} w FROM documents)) GROUP BY did""")
def chunk_headers(spark, sf):
    return fx.corpus(spark, sf).select("did", T.chunk_headers("text").alias("text"))


@query("doc_id_of_chunk", "", f"SELECT did || '__chunk' || i cid, did FROM (SELECT did, unnest(range(CAST(ceil(len(w) / 128) AS BIGINT))) i FROM (SELECT CAST(doc_id AS VARCHAR) did, {tokens('text', False)} w FROM documents))")
def doc_id_of_chunk(spark, sf):
    chunks = _chunked(spark, sf, T.chunk_sliding("text", 256)).select("cid")
    return chunks.select("cid", T.doc_id_of_chunk("cid").alias("did"))


@query("qid_parts", "gen", """SELECT qid, split_part(qid, '_', 1) base, list_last(string_split(qid, '_')) suffix, split_part(qid || ':' || query, ':', 1) topic FROM gen""")
def qid_parts(spark, sf):
    return generated(spark, sf).select(
        "qid", T.qid_base("qid").alias("base"), T.qid_suffix("qid").alias("suffix"),
        T.topic_number(F.concat_ws(":", "qid", "query")).alias("topic"))


@query("extract_articles", "", r"""SELECT CAST(page_id AS VARCHAR) did, array_to_string(regexp_extract_all('Art. ' || page_id || ', artículo 7 ' || html, '(?i)Art(?:[íi]culo)?\.?\s*(\d+)', 1), ',') articles FROM pages""")
def extract_articles(spark, sf):
    text = F.concat(F.lit("Art. "), F.col("page_id").cast("string"), F.lit(", artículo 7 "), F.col("html"))
    return fx.read(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("did"), F.array_join(T.extract_articles(text), ",").alias("articles"))


@query("extract_section", "", r"SELECT CAST(page_id AS VARCHAR) did, regexp_replace(regexp_extract(html, '(?is)<body>\s*[:-]?\s*(.+)', 1), '^\s+|\s+$', '', 'g') section FROM pages")
def extract_section(spark, sf):
    return fx.read(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("did"), T.extract_section("html", "<body>").alias("section"))


@query("parse_summary_sections", "", """SELECT doc_id, CAST(contains(text, 'Decisión' || chr(10)) AS INT) decision, CAST(contains(text, 'Hechos clave' || chr(10)) AS INT) facts,
    len(regexp_extract_all(text, 'AMBIGUO')) n_unclear FROM (SELECT doc_id, 'Decisión' || chr(10) || CASE WHEN quality = 1 THEN 'Hechos clave' || chr(10) ELSE 'AMBIGUO AMBIGUO' END || text AS text
    FROM documents JOIN labels USING (doc_id))""")
def parse_summary_sections(spark, sf):
    rows = fx.read(spark, sf, "documents").join(fx.read(spark, sf, "labels"), "doc_id").select("doc_id", F.concat(
        F.lit("Decisión\n"), F.when(F.col("quality") == 1, "Hechos clave\n").otherwise("AMBIGUO AMBIGUO"), "text").alias("text"))
    return rows.select("doc_id", *T.section_flags("text")).select(
        "doc_id", F.col("has_4").alias("decision"), F.col("has_1").alias("facts"), "n_unclear")


# --- labels and scores -----------------------------------------------------------------------------------------

NAMES = ["No relevante", "Parcialmente relevante", "Relevante", "Altamente relevante", "otro"]


@query("map_text_label", "gold", "SELECT qid, did, name, CASE WHEN name = 'otro' THEN 0 ELSE label END AS label FROM (SELECT qid, did, label, CASE WHEN label = 1 AND length(did) = 2 THEN 'otro' ELSE (['No relevante', 'Parcialmente relevante', 'Relevante', 'Altamente relevante'])[label + 1] END AS name FROM gold)")
def map_text_label(spark, sf):
    names = F.array(*[F.lit(n) for n in NAMES])
    name = F.when((F.col("label") == 1) & (F.length("did") == 2), "otro").otherwise(F.get(names, F.col("label")))
    return fx.gold(spark, sf).select("qid", "did", name.alias("name")).withColumn("label", X.map_text_label("name"))


part("lg", "vecs", "SELECT id, v l, unnest(range(1, len(v), 2)) i FROM vecs")
part("sm", "vecs", "SELECT id, v l, list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) p FROM vecs")


@query("head_scores", "lg", """SELECT id, i AS at, round(exp(l[i + 1] - greatest(l[i], l[i + 1])) / (exp(l[i] - greatest(l[i], l[i + 1])) + exp(l[i + 1] - greatest(l[i], l[i + 1]))), 6) p_binary,
    round(l[i + 1], 6) raw, round(l[i], 6) AS first, CAST(1 / (1 + exp(-l[i])) > 0.5 AS INT) sigmoid FROM lg""")
def head_scores(spark, sf):
    """All numbers of every vector, two by two, as the logits of a model with two classes or one."""
    rows = fx.vectors(spark, sf).select("id", F.transform("vec", lambda x: x.cast("double")).alias("v"))
    pairs = rows.select("id", "v", F.explode(F.sequence(F.lit(1), F.size("v") - 1, F.lit(2))).alias("at")).select(
        "id", "at", F.slice("v", F.col("at"), F.lit(2)).alias("l"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return pairs.select(
        "id", "at", r(X.head_score("l", "binary"), "p_binary"), r(X.head_score("l", "binary_raw"), "raw"),
        r(X.head_score("l", "first"), "first"), X.head_score("l", "sigmoid").alias("sigmoid"))


@query("head_scores_graded", "sm", """SELECT id, round(list_sum(list_transform(range(len(p)), lambda i: i * p[i + 1])), 6) expected, list_position(l, list_max(l)) - 1 argmax FROM sm""")
def head_scores_graded(spark, sf):
    """All numbers of every vector as the logits of a model with as many grades."""
    rows = fx.vectors(spark, sf).select("id", F.transform("vec", lambda x: x.cast("double")).alias("l"))
    return rows.select("id", F.round(X.head_score("l", "expected"), 6).alias("expected"), X.head_score("l", "argmax").alias("argmax"))


part("vocab", "dfs", "SELECT term, row_number() OVER (ORDER BY md5('v|' || term), term) + 2 tid FROM dfs")
part("ids", "vocab", f"""SELECT conv_id * 1000 + turn line, list(coalesce(tid, 2) ORDER BY i) ids FROM (SELECT conv_id, turn, unnest(w) t, generate_subscripts(w, 1) i FROM
    (SELECT conv_id, turn, {tokens('text')} w FROM conversations)) LEFT JOIN vocab ON term = t GROUP BY conv_id, turn""")


@query("pack_tokens", "ids", """SELECT line, array_to_string(x, ',') input_ids, array_to_string(list_transform(x, lambda t: CAST(t > 0 AS INT)), ',') attention_mask FROM
    (SELECT line, list_concat(list_append(ids[1:15], 1), list_transform(range(15 - least(len(ids), 15)), lambda z: 0)) x FROM ids)""")
def pack_tokens(spark, sf):
    """Turns of conversations as ids of the corpus vocabulary, packed to sixteen places."""
    from judgeline.operators.retrieve import corpus_stats
    from judgeline.operators.sizing import hash_key, number_by_hash
    words = corpus_stats(fx.corpus(spark, sf), T.tokenize_ws("text")).select("term", hash_key("v", F.col("term")).alias("h"))
    vocab = number_by_hash(words, "h", ["term"]).select("term", (F.col("rn") + 2).alias("tid"))
    line = (F.col("conv_id") * 1000 + F.col("turn")).alias("line")
    turns = fx.read(spark, sf, "conversations").select(line, F.posexplode(T.tokenize_ws("text")).alias("i", "term"))
    known = turns.join(vocab, "term", "left").withColumn("tid", F.coalesce("tid", F.lit(2)))  # 2: not in the vocabulary
    ids = known.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("i", "tid"))).alias("x"))
    packed = X.pack_tokens(F.transform("x", lambda e: e["tid"]), 16, eos=1)
    return ids.select("line", *[F.array_join(c, ",").alias(n) for n, c in packed.items()])


@query("length_stats", "", f"""SELECT kind, count(*) n, round(avg(words), 6) avg_words, min(words) min_words, max(words) max_words, round(avg(chars), 6) avg_chars FROM
    (SELECT 'doc' kind, len({tokens('text')}) words, length(text) chars FROM documents UNION ALL
    SELECT 'query', len({tokens('text')}), length(text) FROM benchmark) GROUP BY kind""")
def length_stats(spark, sf):
    texts = fx.corpus(spark, sf).select(F.lit("doc").alias("kind"), "text").unionByName(
        fx.queries(spark, sf).select(F.lit("query").alias("kind"), F.col("query").alias("text")))
    words = F.size(T.tokenize_ws("text"))
    return texts.select("kind", words.alias("w"), F.length("text").alias("c")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("w"), 6).alias("avg_words"), F.min("w").alias("min_words"),
        F.max("w").alias("max_words"), F.round(F.avg("c"), 6).alias("avg_chars"))


@query("length_ratio", "", f"SELECT CAST(doc_id AS VARCHAR) did, round(len(list_distinct({tokens('text')})) / nullif(len({tokens('text')}), 0), 6) ratio FROM documents")
def length_ratio(spark, sf):
    """Length of a shortened document (its distinct words) relative to the original."""
    words = T.tokenize_ws("text")
    return fx.corpus(spark, sf).select(
        "did", F.round(F.try_divide(F.size(F.array_distinct(words)), F.size(words)), 6).alias("ratio"))


# --- requests and responses ------------------------------------------------------------------------------------

PAIR_TEMPLATE = "QUERY: {query}\n\nDOCUMENT: {doc}\n\nIs the document relevant?"


def _fields(df):
    g = lambda p: F.get_json_object("value", p)
    return df.select(
        g("$.custom_id").alias("custom_id"), g("$.body.max_tokens").cast("int").alias("max_tokens"),
        g("$.body.messages[0].content").alias("m0"), g("$.body.messages[1].content").alias("m1"))


@query("render_pair_requests", "gold qs docs", """SELECT qid || '_' || did custom_id, 256 max_tokens, 'judge' m0,
    'QUERY: ' || query || chr(10) || chr(10) || 'DOCUMENT: ' || text || chr(10) || chr(10) || 'Is the document relevant?' m1
    FROM gold JOIN qs USING (qid) JOIN docs USING (did)""")
def render_pair_requests(spark, sf):
    return _fields(G.render_pair_requests(
        fx.gold(spark, sf), fx.queries(spark, sf), fx.corpus(spark, sf), PAIR_TEMPLATE, "judge"))


@query("render_doc_requests", "docs", """SELECT did custom_id, CAST(least(512, greatest(128, floor(len(string_split(text, ' ')) * 0.08))) AS INT) max_tokens,
    'sum' m0, 'SUMMARIZE: ' || text m1 FROM docs""")
def render_doc_requests(spark, sf):
    return _fields(G.render_doc_requests(fx.corpus(spark, sf), "SUMMARIZE: {doc}", "sum", T.summary_budget("text")))


@query("render_query_requests", "qs", "SELECT qid custom_id, 256 max_tokens, 'Rewrite: ' || query m0, NULL m1 FROM qs")
def render_query_requests(spark, sf):
    return _fields(G.render_query_requests(fx.queries(spark, sf), "Rewrite: {query}"))


def response_rows(spark, sf):
    """Answers to the predicted judgments: grade 1 is cut short, grade 0 has an unknown verdict for short document ids."""
    body = F.to_json(F.struct(
        F.when(F.col("label") >= 2, "yes").when(F.length("did") < 3, "maybe").otherwise("no").alias("relevant"),
        F.concat(F.lit('quote "'), F.col("did"), F.lit('"')).alias("evidence")))
    content = F.when(F.col("label") == 1, F.substr(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    return fx.pred(spark, sf).select(F.concat_ws("_", "qid", "did").alias("custom_id"), content.alias("content"))


@query("parse_relevance_responses", "pred", """SELECT qid, did, CAST(label >= 2 AS INT) AS label, 'quote "' || did || '"' evidence FROM pred
    WHERE label >= 2 OR (label = 0 AND length(did) >= 3)""")
def parse_relevance_responses(spark, sf):
    return G.parse_relevance_responses(response_rows(spark, sf))[0]


@query("rejected_responses", "pred", """SELECT qid || '_' || did custom_id, CASE label WHEN 1 THEN 'not json' ELSE 'no label' END reason FROM pred
    WHERE label = 1 OR (label = 0 AND length(did) < 3)""")
def rejected_responses(spark, sf):
    return G.parse_relevance_responses(response_rows(spark, sf))[1].select("custom_id", "reason")


part("gsent", "", "SELECT CAST(item_id AS VARCHAR) did, string_split(text, '. ') s FROM benchmark")


def _generated_rows(spark, sf):
    """Every benchmark text answers with its sentences as queries."""
    entries = F.transform(F.split("text", r"\. "), lambda s, i: F.struct(F.concat(F.lit("q"), i.cast("string")), s))
    return fx.read(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("did"), F.to_json(F.map_from_entries(entries)).alias("content"))


@query("parse_generated_queries", "gsent", """SELECT did || '_' || (['corta', 'compleja', 'pregunta'])[i] qid, s[i] query, did FROM
    (SELECT did, s, unnest([1, 2, 3]) i FROM gsent WHERE len(s) >= 3)""")
def parse_generated_queries(spark, sf):
    return G.parse_generated_queries(_generated_rows(spark, sf))[0]


@query("generated_query_qrels", "gsent", """SELECT did || '_' || (['corta', 'compleja', 'pregunta'])[i] qid, did, 1 AS label FROM
    (SELECT did, s, unnest([1, 2, 3]) i FROM gsent WHERE len(s) >= 3)""")
def generated_query_qrels(spark, sf):
    return G.parse_generated_queries(_generated_rows(spark, sf))[1]
