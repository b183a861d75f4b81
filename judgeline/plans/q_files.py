"""Queries on readers, writers, streaming and learning: derived tables go out in a file layout and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from judgeline.functions import plugins as U
from judgeline.functions.text import tokenize_ws
from judgeline.operators import agreement as A
from judgeline.operators import learning as L
from judgeline.operators import metrics as M
from judgeline.operators import registry as G
from judgeline.operators import retrieve as R
from judgeline.operators.pooling import training_groups as make_groups
from judgeline.operators.selection import binarize_adaptive
from judgeline.plans import fixtures as fx
from judgeline.plans.q_retrieval import shown
from judgeline.plans.q_text import response_rows
from judgeline.plans.q_training import mined
from judgeline.plans.registry import query
from judgeline.plans.sqlparts import part, tokens, topk
from judgeline.session import scratch_path, written
from judgeline.sources import readers as I
from judgeline.sources import writers as O
from judgeline.streaming import incremental as ST

# --- readers ---------------------------------------------------------------------------------------------------


@query("read_corpus_jsonl", "docs", "SELECT did, CASE WHEN source IS NULL THEN '' ELSE text END AS text FROM docs WHERE lang <> 'es'")
def read_corpus_jsonl(spark, sf):
    """French texts sit in ``contents``; Spanish lines are cut short and therefore skipped."""
    path = scratch_path(spark, "corpus-jsonl")
    key = F.when(F.col("lang") == "fr", "contents").otherwise("text")
    good = F.to_json(F.create_map(F.lit("id"), F.col("did"), key, F.col("text")))
    line = F.when(F.col("lang") == "es", F.concat(F.lit('{"id": "'), F.col("did"))).otherwise(good)
    blank = F.when(F.col("lang") == "de", F.concat(line, F.lit("\n"))).otherwise(line)
    fx.corpus(spark, sf).select(blank.alias("value")).write.text(path)
    return I.read_corpus_jsonl(spark, path).select("did", "text")


def _map_file(spark, sf):
    path = scratch_path(spark, "corpus-map")
    pair = F.expr("substring(to_json(map(did, text)), 2, length(to_json(map(did, text))) - 2)")
    fx.corpus(spark, sf).select(F.concat(F.lit("  "), pair, F.lit(",")).alias("value")).write.text(path)
    return I.read_corpus_json_map(spark, path, "pairs")


@query("read_corpus_json_map", "docs", "SELECT did, text FROM docs")
def read_corpus_json_map(spark, sf):
    return _map_file(spark, sf)


@query("read_corpus_json_object", "docs", "SELECT did, text FROM docs")
def read_corpus_json_object(spark, sf):
    """Files that each hold one object of several pairs, as collections are handed out."""
    path = scratch_path(spark, "corpus-object")
    pairs = F.map_from_entries(F.collect_list(F.struct("did", "text")))
    packs = fx.corpus(spark, sf).groupBy(F.pmod(F.xxhash64("did"), F.floor(F.xxhash64("source") % 7 + 50)).alias("p"), "source").agg(
        F.to_json(pairs).alias("value"))
    packs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return I.read_corpus_json_map(spark, path, "object")


@query("read_corpus_csv", "docs", "SELECT did, source title, text FROM docs")
def read_corpus_csv(spark, sf):
    path = scratch_path(spark, "corpus-csv")
    fx.corpus(spark, sf).select(F.col("did").alias("Codigo"), F.col("source").alias("Titulo"), "text").write.csv(
        path, header=True, escape='"', quoteAll=True)
    return I.read_corpus_csv(spark, path, title="Titulo")


@query("read_queries", "qs", r"SELECT qid, trim(regexp_replace(query, '[\t\n]', ' ', 'g')) query FROM qs")
def read_queries(spark, sf):
    path = scratch_path(spark, "queries")
    q = fx.queries(spark, sf).select("qid", F.regexp_replace("query", r"[\t\n]", " ").alias("query"))
    lines = F.inline(F.array(
        F.struct(F.concat_ws("\t", F.concat(F.lit(" "), "qid"), "query").alias("value")),
        F.struct(F.lit("topic_id\tQuery").alias("value")), F.struct(F.lit("\tno id").alias("value")),
        F.struct(F.col("qid").alias("value"))))
    q.select(lines).write.text(path)
    return I.read_queries(spark, path).select("qid", "query")


QRELS_SQL = "SELECT qid, did, label FROM gold"


def _qrels_file(spark, sf, lines):
    path = scratch_path(spark, "qrels")
    fx.gold(spark, sf).select(F.explode(F.array(*lines)).alias("value")).write.text(path)
    return path


@query("read_qrels_4", "gold", QRELS_SQL)
def read_qrels_4(spark, sf):
    """Every pair is written three times: with another grade, with the right one, with a broken one."""
    fields = lambda x: F.concat_ws("\t", "qid", F.lit("0"), "did", x)
    path = _qrels_file(spark, sf, [
        fields(F.lit("7")), fields(F.col("label").cast("string")), fields(F.lit("n/a"))])
    return I.read_qrels(spark, path).select("qid", "did", "label")


@query("read_qrels_3_header", "gold", QRELS_SQL)
def read_qrels_3_header(spark, sf):
    path = _qrels_file(spark, sf, [
        F.lit("docid\tquery_id\trelevance"), F.concat_ws("\t", "did", "qid", F.col("label").cast("string"))])
    return I.read_qrels(spark, path).select("qid", "did", "label")


@query("read_qrels_5", "gold", "SELECT qid, did, label, 'seen in ' || did evidence FROM gold")
def read_qrels_5(spark, sf):
    path = scratch_path(spark, "qrels5")
    O.write_qrels(fx.gold(spark, sf).withColumn("evidence", F.concat(F.lit("seen in "), "did")), path, layout=5)
    return I.read_qrels(spark, path).select("qid", "did", "label", "evidence")


@query("read_trec_run", "runs", "SELECT run_id, qid, did, rank, round(score, 4) score FROM runs WHERE rank <= 30")
def read_trec_run(spark, sf):
    path = scratch_path(spark, "trec")
    O.write_trec_run(fx.runs(spark, sf), path)
    return I.read_trec_run(spark, f"{path}/*").select("run_id", "qid", "did", "rank", F.round("score", 4).alias("score"))


@query("read_ranked_candidates", "run_b", "SELECT qid, did, CAST(rank AS INT) rank FROM run_b WHERE rank <= 30")
def read_ranked_candidates(spark, sf):
    path = scratch_path(spark, "ranked")
    O.write_ranked_list(fx.run_b(spark, sf), path)
    return I.read_ranked_candidates(spark, path)


@query("read_qid_list", "qs", "SELECT qid FROM qs")
def read_qid_list(spark, sf):
    path = scratch_path(spark, "qids")
    fx.queries(spark, sf).select(F.concat(F.lit(" "), "qid", F.lit("\n")).alias("value")).write.text(path)
    return I.read_qid_list(spark, path)


@query("read_annotation_export", "gold qs", """SELECT qid || ':' || query topic_id, did, (['No relevante', 'Parcialmente relevante', 'Relevante', 'Altamente relevante'])[label + 1] label_name
    FROM gold JOIN qs USING (qid)""")
def read_annotation_export(spark, sf):
    """One export file per judged topic and grade."""
    path = scratch_path(spark, "export")
    names = F.array(*[F.lit(n) for n in ("No relevante", "Parcialmente relevante", "Relevante", "Altamente relevante")])
    truth = F.struct(
        F.concat_ws(":", "qid", "query").alias("topic_id"), F.col("did").alias("id_report_hashed"),
        F.array(F.struct(F.get(names, F.col("label")).alias("label"))).alias("labels"))
    rows = fx.gold(spark, sf).join(fx.queries(spark, sf), "qid").groupBy("qid", "label").agg(F.collect_list(truth).alias("t"))
    export = F.struct(F.struct(F.col("t").alias("labels_ground_truths")).alias("groundtruths"))
    rows.select(F.to_json(export).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return I.read_annotation_export(spark, path).select("topic_id", "did", "label_name")


@query("read_batch_responses", "gold", "SELECT qid || '_' || did custom_id, CAST(label AS VARCHAR) content FROM gold")
def read_batch_responses(spark, sf):
    path = scratch_path(spark, "responses")
    choice = F.struct(F.struct(F.col("label").cast("string").alias("content")).alias("message"))
    envelope = F.struct(F.struct(F.array(choice).alias("choices")).alias("body"))
    fx.gold(spark, sf).select(F.concat_ws("_", "qid", "did").alias("custom_id"), envelope.alias("response")).write.json(path)
    return I.read_batch_responses(spark, path)


def _groups(spark, sf):
    return make_groups(mined(spark, sf), fx.queries(spark, sf), fx.corpus(spark, sf), 4, "P: ")


@query("read_train_groups", "blocks docs qs", """SELECT query, p.text positive, max(n.text) FILTER (slot = 1) negative_1, max(n.text) FILTER (slot = 2) negative_2,
    max(n.text) FILTER (slot = 3) negative_3, max(n.text) FILTER (slot = 4) negative_4
    FROM blocks b JOIN docs p ON p.did = b.positive JOIN docs n ON n.did = b.negative JOIN qs USING (qid) GROUP BY b.qid, b.positive, query, p.text""")
def read_train_groups(spark, sf):
    path = scratch_path(spark, "groups")
    O.write_train_groups_jsonl(_groups(spark, sf), path)
    return I.read_train_groups(spark, path)


@query("write_train_groups_jsonl", "blocks docs qs", """SELECT 'topic: ' || query query, p.text pos, string_agg(n.text, '||' ORDER BY slot) neg
    FROM blocks b JOIN docs p ON p.did = b.positive JOIN docs n ON n.did = b.negative JOIN qs USING (qid) GROUP BY b.qid, b.positive, query, p.text""")
def write_train_groups_jsonl(spark, sf):
    path = scratch_path(spark, "groups")
    O.write_train_groups_jsonl(_groups(spark, sf), path, query_prefix="topic: ")
    return spark.read.json(path).select("query", F.col("pos")[0].alias("pos"), F.array_join("neg", "||").alias("neg"))


@query("read_training_log", "", "SELECT row_number() OVER (ORDER BY event_id) step, value loss, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS DOUBLE) END grad_norm, 0.5 learning_rate, CAST(event_id AS DOUBLE) epoch FROM events")
def read_training_log(spark, sf):
    path = scratch_path(spark, "log")
    entry = F.concat(
        F.lit("step> {'loss': "), F.col("value").cast("string"),
        F.when(F.col("event_type") != "error", F.concat(F.lit(", 'grad_norm': "), F.col("user_id").cast("string"))).otherwise(""),
        F.lit(", 'learning_rate': 5e-1, 'epoch': "), F.col("event_id").cast("string"), F.lit("} done\nno entry"))
    fx.read(spark, sf, "events").orderBy("event_id").select(entry.alias("value")).write.text(path)
    return I.read_training_log(spark, path).drop("line_no")


@query("read_benchmark_tables", "run_a docs qs", """SELECT query, max(text) FILTER (rank = 1) positive, """ + ", ".join(
    f"max(text) FILTER (rank = {i + 1}) negative_{i}" for i in range(1, 40)) + " FROM run_a JOIN docs USING (did) JOIN qs USING (qid) GROUP BY qid, query")
def read_benchmark_tables(spark, sf):
    path, cache = scratch_path(spark, "wide"), scratch_path(spark, "wide-cache")
    texts = fx.run_a(spark, sf).join(fx.corpus(spark, sf), "did").join(fx.queries(spark, sf), "qid")
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("text")))
    texts.groupBy("qid", "query").agg(
        at(1).alias("positive"), *[at(i + 1).alias(f"negative_{i}") for i in range(1, 40)]).write.parquet(path)
    I.read_benchmark_tables(spark, path, cache)
    return I.read_benchmark_tables(spark, path, cache)


# --- writers ---------------------------------------------------------------------------------------------------


@query("write_trec_run", "runs", """SELECT run_id, qid || chr(9) || 'Q0' || chr(9) || did || chr(9) || rank || chr(9) || printf('%.4f', score) || chr(9) || run_id AS value
    FROM runs WHERE rank <= 30""")
def write_trec_run(spark, sf):
    path = scratch_path(spark, "trec")
    O.write_trec_run(fx.runs(spark, sf), path)
    return spark.read.text(path).select("run_id", "value")


@query("write_ranked_list", "run_a", "SELECT qid || chr(9) || did || chr(9) || rank AS value FROM run_a WHERE rank <= 30")
def write_ranked_list(spark, sf):
    path = scratch_path(spark, "ranked")
    O.write_ranked_list(fx.run_a(spark, sf).drop("rank"), path)
    return spark.read.text(path)


@query("run_wide", "run_b", """PIVOT (SELECT CAST(rank AS INT) AS rank, qid, did FROM run_b WHERE rank <= 30) ON qid USING max(did) GROUP BY rank""")
def run_wide(spark, sf):
    """One column per query of the run, whichever they are."""
    return O.run_wide(fx.run_b(spark, sf))


@query("write_qrels", "gold", "SELECT qid || chr(9) || '0' || chr(9) || did || chr(9) || label AS value FROM gold")
def write_qrels(spark, sf):
    path = scratch_path(spark, "qrels")
    O.write_qrels(fx.gold(spark, sf), path)
    return spark.read.text(path)


@query("write_eval_bundle", "gold gen docs", """SELECT 'corpus' part, did id, text v FROM docs UNION ALL SELECT 'queries', replace(qid, '_Q', '0000'), query FROM
    (SELECT CAST(item_id AS VARCHAR) || '_Q1' qid, text query, CAST(item_id AS VARCHAR) b FROM benchmark) WHERE b IN (SELECT qid FROM gold)
    UNION ALL SELECT 'qrels', qid || '00001', did FROM gold WHERE label IN (2, 3)""")
def write_eval_bundle(spark, sf):
    path = scratch_path(spark, "bundle")
    named = lambda d: d.withColumn("qid", F.concat("qid", F.lit("_Q1")))
    O.write_eval_bundle(fx.corpus(spark, sf), named(fx.queries(spark, sf)), named(fx.gold(spark, sf)), [2, 3], path)
    read = lambda name, i, v: spark.read.schema("id string, qid string, text string, docid string").json(
        f"{path}/{name}").select(F.lit(name).alias("part"), F.col(i).alias("id"), F.col(v).alias("v"))
    return read("corpus", "id", "text").union(read("queries", "id", "text")).union(read("qrels", "qid", "docid"))


@query("write_annotation_bundle", "run_a qs docs", """SELECT 'collection' part, did id, text v FROM docs UNION ALL SELECT 'topics', qid || ':' || query, query FROM qs UNION ALL
    SELECT 'run', qid || ':' || query, d FROM (SELECT qid, string_agg(did, ',' ORDER BY rank) d FROM run_a GROUP BY qid) JOIN qs USING (qid)""")
def write_annotation_bundle(spark, sf):
    path = scratch_path(spark, "annotation")
    O.write_annotation_bundle(fx.corpus(spark, sf), fx.queries(spark, sf), fx.run_a(spark, sf), path)
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    c = read("collection", "document_id string, text string").select(F.lit("collection").alias("part"), F.col("document_id").alias("id"), F.col("text").alias("v"))
    t = read("topics", "topic_id string, title string").select(F.lit("topics"), "topic_id", "title")
    r = read("run", "topic_id string, documents array<struct<document_id string>>").select(
        F.lit("run"), "topic_id", F.array_join("documents.document_id", ","))
    return c.union(t).union(r)


@query("append_rows", "gold pred", "SELECT qid, did, label FROM gold UNION ALL SELECT qid, did, label FROM pred")
def append_rows(spark, sf):
    path = scratch_path(spark, "append")
    O.append_rows(fx.gold(spark, sf), path)
    O.append_rows(fx.pred(spark, sf), path)
    return spark.read.schema("qid string, did string, label int").json(path)


@query("write_metric_table", "pq", "SELECT qid, " + ", ".join(
    f"""round(max({m}) FILTER (run_id = '{r}'), 6) "{m}[{r}]\"""" for m in ("map", "bpref", "judged_10") for r in "abc") + " FROM pq GROUP BY qid")
def write_metric_table(spark, sf):
    path = scratch_path(spark, "metrics")
    pq = M.query_metrics(fx.runs(spark, sf), fx.gold(spark, sf), ["map", "bpref", "judged@10"])
    O.write_metric_table(pq, path, ["a", "b", "c"])
    back = spark.read.csv(path, sep="\t", header=True)
    return back.select("qid", *[F.round(F.col(f"`{c}`").cast("double"), 6).alias(c) for c in back.columns if c != "qid"])


# --- streaming -------------------------------------------------------------------------------------------------


def _vector_files(spark, sf, name):
    """The vectors as several files, so that they arrive in several batches."""
    path = scratch_path(spark, name)
    fx.doc_vectors(spark, sf).repartition(4, "did").write.parquet(path)
    return path


@query("incremental_topk", "all_dot", f"SELECT qid, did, rank, round(score, 6) score FROM ({topk('all_dot', 10)})")
def incremental_topk(spark, sf):
    source, state = _vector_files(spark, sf, "vectors"), ST.RunState(spark, scratch_path(spark, "state"))
    queries = fx.query_vectors(spark, sf)
    schema = spark.read.parquet(source).schema
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = ST.incremental_topk(
        docs, lambda batch: R.knn_topk(queries, batch, k=10, skip_self=True), state, 10, scratch_path(spark, "checkpoint"))
    q.awaitTermination()
    return shown(state.latest())


@query("running_score_stats", "runs", """SELECT qid, count(*) n, round(avg(score), 6) mean, round(stddev_pop(score), 6) std, round(min(score), 6) min, round(max(score), 6) max
    FROM runs GROUP BY qid""")
def running_score_stats(spark, sf):
    source, out = scratch_path(spark, "scores"), scratch_path(spark, "stats")
    fx.runs(spark, sf).repartition(3, "run_id", "did").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    stats = ST.running_score_stats(stream)
    state = ST.SlotState(spark, out, stats.schema)
    ST.write_running(stats, state, scratch_path(spark, "checkpoint")).awaitTermination()
    stats = state.latest()
    return stats.select("qid", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


@query("append_stream", "", "SELECT event_id, event_type, value FROM events")
def append_stream(spark, sf):
    source, out = scratch_path(spark, "events"), scratch_path(spark, "appended")
    fx.read(spark, sf, "events").select("event_id", "event_type", "value").repartition(3, "event_id").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    ST.append_stream(stream, out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out)


# --- learning --------------------------------------------------------------------------------------------------

W = r"[\p{L}\p{N}_]{2,}"
part("tw", "", f"""SELECT kind, id, term, count(*) tf FROM (SELECT 'q' kind, CAST(item_id AS VARCHAR) id, unnest(regexp_extract_all(lower(text), '{W}')) term FROM benchmark
    UNION ALL SELECT 'd', CAST(doc_id AS VARCHAR), unnest(regexp_extract_all(lower(text), '{W}')) FROM documents) GROUP BY kind, id, term""")
part("tv", "tw", "SELECT term, count(*) df, sum(tf) cf FROM tw GROUP BY term")
part("tn", "", "SELECT (SELECT count(*) FROM benchmark) + (SELECT count(*) FROM documents) n")
TFIDF = """SELECT kind, id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY kind, id)), 6) weight FROM
    (SELECT kind, id, term, tf * (ln((n + 1) / (df + 1)) + 1) w FROM tw JOIN {v} USING (term), tn)"""


@query("tfidf_features", "tw tv tn", TFIDF.format(v="tv"))
def tfidf_features(spark, sf):
    out = L.tfidf_features(fx.queries(spark, sf), fx.corpus(spark, sf))
    return out.select("kind", "id", "term", F.round("weight", 6).alias("weight"))


part("tv1", "tv", "SELECT term, df FROM tv ORDER BY cf DESC, term LIMIT 1000")


@query("tfidf_features_capped", "tw tv1 tn", TFIDF.format(v="tv1"))
def tfidf_features_capped(spark, sf):
    """The vocabulary option: the thousand most frequent terms."""
    out = L.tfidf_features(fx.queries(spark, sf), fx.corpus(spark, sf), 1000)
    return out.select("kind", "id", "term", F.round("weight", 6).alias("weight"))


@query("class_weights", "gold", """SELECT label, n, round(w * c / sum(w) OVER (), 6) weight FROM (SELECT label, n, sqrt(sum(n) OVER () / (count(*) OVER () * n)) w, count(*) OVER () c
    FROM (SELECT label, count(*) n FROM gold GROUP BY label))""")
def class_weights(spark, sf):
    return L.class_weights(fx.gold(spark, sf), 0.5, classes=4, strict=False).select("label", "n", F.round("weight", 6).alias("weight"))


@query("positive_weight", "", "SELECT round(count_if(quality = 0) / count_if(quality = 1) * 0.16666, 6) positive_weight FROM labels")
def positive_weight(spark, sf):
    labels = fx.read(spark, sf, "labels").withColumnRenamed("quality", "label")
    return L.positive_weight(labels, damped=True).select(F.round("positive_weight", 6).alias("positive_weight"))


def _pairs(spark, sf):
    return binarize_adaptive(fx.gold(spark, sf))


part("bing", "gold", "SELECT qid, did, CAST(label >= 2 AS INT) AS label FROM gold")
part("ptw", "tw tv tn bing", f"""SELECT qid, did, label, side, term, weight FROM (SELECT qid, did, label, unnest(['q', 'd']) side FROM bing) p
    JOIN ({TFIDF.format(v="tv")}) f ON f.kind = p.side AND f.id = CASE p.side WHEN 'q' THEN p.qid ELSE p.did END""")


@query("pair_features", "ptw", "SELECT qid, did, label, side, term, weight FROM ptw")
def pair_features(spark, sf):
    """Both vectors of every judged pair, term by term, over the whole vocabulary."""
    features = L.tfidf_features(fx.queries(spark, sf), fx.corpus(spark, sf))
    return L.pair_terms(_pairs(spark, sf), features).select(
        "qid", "did", "label", "side", "term", F.round("weight", 6).alias("weight"))


def _trained(spark, sf):
    """(vectors, pairs with features, model): queries are split 8:1:1 into training, dev and test by their hash."""
    vectors = L.fit_text_vectors(fx.queries(spark, sf), fx.corpus(spark, sf))
    rows = L.pair_features(_pairs(spark, sf), fx.queries(spark, sf), fx.corpus(spark, sf), vectors)
    split = F.pmod(F.crc32(F.col("qid").cast("binary")), F.lit(10))
    rows = written(rows.withColumn("part", F.when(split == 8, "dev").when(split == 9, "test").otherwise("train")), "pair-vectors")
    of = lambda name: rows.where(F.col("part") == name)
    return vectors, rows, L.train_pair_classifier(of("train"), dev=of("dev"))


@query("train_pair_classifier")
def train_pair_classifier(spark, sf):
    """Probability and verdict for every pair, by part."""
    _, rows, model = _trained(spark, sf)
    return L.predict(model, rows).select("part", "qid", "did", "label", "score", "pred")


@query("classifier_report")
def classifier_report(spark, sf):
    """Confusion and class scores of training, dev and test pairs."""
    _, rows, model = _trained(spark, sf)
    return L.classifier_report(L.predict(model, rows), ["part"])


@query("rerank_with_model")
def rerank_with_model(spark, sf):
    """The 20 best of every query in the order of the classifier, with its scores."""
    vectors, _, model = _trained(spark, sf)
    return L.rerank_with_model(fx.run_a(spark, sf), fx.queries(spark, sf), fx.corpus(spark, sf), vectors, model, 20)


# --- plug-ins --------------------------------------------------------------------------------------------------


@query("plugin_chunker", "", f"""SELECT did || '__chunk' || i cid, array_to_string(list_reverse(w)[i * 100 + 1 : i * 100 + 100], ' ') text FROM
    (SELECT did, w, unnest(range(CAST(ceil(len(w) / 100) AS BIGINT))) i FROM (SELECT CAST(doc_id AS VARCHAR) did, {tokens('text', False)} w FROM documents))""")
def plugin_chunker(spark, sf):
    """A chunker of one's own: windows over the words in reverse."""
    from judgeline.functions.text import word_windows
    mine = lambda text, window: word_windows(F.reverse(tokenize_ws(text, lower=False)), window, window)
    return U.chunk_corpus(fx.corpus(spark, sf), mine, 100).select("cid", "text")


def _lengths():
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


@query("plugin_embedder", "", "SELECT CAST(doc_id AS VARCHAR) did, CAST(length(text) AS DOUBLE) a, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) b FROM documents")
def plugin_embedder(spark, sf):
    """A stand-in for a model: characters and spaces of a text."""
    rows = fx.corpus(spark, sf).select("did", U.embedder(_lengths)("text").alias("v"))
    return rows.select("did", F.col("v")[0].cast("double").alias("a"), F.col("v")[1].cast("double").alias("b"))


def _length_ratio():
    return lambda qs, ds: [len(q) / (1 + len(d)) for q, d in zip(qs, ds)]


part("pl_s", "run_a qs docs", "SELECT qid, did, length(query) / (1 + length(text)) s, score FROM run_a JOIN qs USING (qid) JOIN docs USING (did) WHERE rank <= 20")
part("pl_l", "run_a pl_s", "SELECT qid, mx - mn + 0.001 lift FROM (SELECT qid, max(score) mx FROM run_a GROUP BY qid) JOIN (SELECT qid, min(s) mn FROM pl_s GROUP BY qid) USING (qid)")


@query("plugin_scorer", "run_a pl_s pl_l", """SELECT a.qid, a.did, round(coalesce(s + lift, a.score), 6) score FROM run_a a LEFT JOIN pl_s p ON p.qid = a.qid AND p.did = a.did
    JOIN pl_l l ON l.qid = a.qid""")
def plugin_scorer(spark, sf):
    from judgeline.operators.fusion import rerank_topk
    out = rerank_topk(fx.run_a(spark, sf), fx.queries(spark, sf), fx.corpus(spark, sf), U.scorer(_length_ratio), k=20)
    return out.select("qid", "did", F.round("score", 6).alias("score"))


@query("plugin_metric", "pq", "SELECT run_id, qid, round(judged_10, 6) judged_10, round(bpref, 6) bpref FROM pq")
def plugin_metric(spark, sf):
    """A metric set registered by name."""
    M.register_metric_set("coverage", ("judged@10", "bpref"))
    out = M.evaluate(fx.runs(spark, sf), fx.gold(spark, sf), "coverage")
    return out.select("run_id", "qid", F.round("judged_10", 6).alias("judged_10"), F.round("bpref", 6).alias("bpref"))


part("reg_sparse", "tf qt docs qs", """SELECT qid, did, sum(1.0 / d.dl / q.dl) score FROM qt x JOIN tf USING (term)
    JOIN (SELECT did, len(toks) dl FROM docs) d USING (did) JOIN (SELECT qid, len(toks) dl FROM qs) q USING (qid) GROUP BY qid, did""")
part("reg_dense", "docs qs", f"""SELECT qid, did, (a * c + b * d) / (sqrt(a * a + b * b) * sqrt(c * c + d * d)) score FROM
    (SELECT qid, CAST(length(query) AS DOUBLE) a, CAST(length(query) - length(replace(query, ' ', '')) AS DOUBLE) b FROM qs),
    (SELECT did, CAST(length(text) AS DOUBLE) c, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) d FROM docs)""")
part("reg_fused", "run_a run_b run_c", """SELECT qid, did, sum(1.0 / (60 + rank)) / 3 score FROM (SELECT qid, did, rank FROM run_a UNION ALL
    SELECT qid, did, rank FROM run_b UNION ALL SELECT qid, did, rank FROM run_c) GROUP BY qid, did""")
REGISTRY = {"bm25": "run_a", "bm25_preset": "run_b", "token_recall": "run_c", "exact": "docs qs", "sparse": "reg_sparse docs qs",
            "dense": "reg_dense", "fused": "reg_fused", "bm25_chunked": "call"}
_REG_SQL = {
    "bm25": "SELECT qid, did, rank FROM run_a", "bm25_preset": "SELECT qid, did, rank FROM run_b",
    "token_recall": "SELECT qid, did, rank FROM run_c",
    "exact": f"SELECT qid, did, rank FROM ({topk('(SELECT qid, did, 1.0 score FROM qs JOIN docs ON contains(docs.text, qs.query))', 40)})",
    "sparse": f"SELECT qid, did, rank FROM ({topk('reg_sparse', 40)})", "dense": f"SELECT qid, did, rank FROM ({topk('reg_dense', 40)})",
    "fused": f"SELECT qid, did, rank FROM ({topk('reg_fused', 40)})",
    "bm25_chunked": f"SELECT qid, did, rank FROM ({topk('(SELECT qid, did, max(score) score FROM call GROUP BY qid, did)', 40)})",
}


@query("retriever_registry", "docs qs " + " ".join(dict.fromkeys(" ".join(REGISTRY.values()).split())) + " gold",
       " UNION ALL ".join(f"""SELECT '{n}' run_id, qid, count(*) n, CAST(sum(rank) AS BIGINT) ranks, count(*) FILTER (label >= 1) relevant
    FROM ({sql}) LEFT JOIN gold USING (qid, did) GROUP BY qid""" for n, sql in _REG_SQL.items()))
def retriever_registry(spark, sf):
    """Every named retriever, and a dense, a sparse and a fused one besides: lists and the judged documents in them."""
    weigh = lambda text: F.map_from_arrays(
        F.array_distinct(tokenize_ws(text)),
        F.array_repeat(F.try_divide(F.lit(1.0), F.size(tokenize_ws(text))), F.size(F.array_distinct(tokenize_ws(text)))))
    known = {**G.RETRIEVERS, "dense": G.dense(lambda text: U.embedder(_lengths)(text)), "sparse": G.sparse(weigh),
             "fused": G.fused(("bm25", "bm25_preset", "token_recall"), depth=40)}
    corpus, asked, gold = fx.corpus(spark, sf), fx.queries(spark, sf), fx.gold(spark, sf)
    out = None
    for name in REGISTRY:
        # one after the other: in one job their broadcasts would wait for each other's tasks
        run = written(known[name](corpus, asked, 40).select(F.lit(name).alias("run_id"), "qid", "did", "rank"), name)
        out = run if out is None else out.unionByName(run)
    return out.join(gold, ["qid", "did"], "left").groupBy("run_id", "qid").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("rank").cast("long")).alias("ranks"),
        F.count_if(F.col("label") >= 1).alias("relevant"))


@query("evaluate_retriever", "pq", """SELECT CASE run_id WHEN 'b' THEN 'bm25_preset' ELSE 'token_recall' END run_id, qid, round(map, 6) map, round(ndcg_cut_10, 6) ndcg_cut_10
    FROM pq WHERE run_id IN ('b', 'c')""")
def evaluate_retriever(spark, sf):
    parts = [G.evaluate_retriever(n, fx.corpus(spark, sf), fx.queries(spark, sf), fx.gold(spark, sf), k=40) for n in ("bm25_preset", "token_recall")]
    out = parts[0].unionByName(parts[1])
    return out.select("run_id", "qid", F.round("map", 6).alias("map"), F.round("ndcg_cut_10", 6).alias("ndcg_cut_10"))
