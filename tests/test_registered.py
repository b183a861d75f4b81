"""Registered queries against their SQL on the smallest data; the full set runs with ``python -m tools.check``."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from tools.check import TABLES, _rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()
SOME = [
    "bm25_run", "ndcg_exp", "classic_metrics", "fuse_runs_rrf", "pool_three_runs", "mine_negatives", "label_entropy",
    "bootstrap_ci", "chunk_sliding", "read_qrels_4", "incremental_topk", "running_score_stats", "ema", "knn_topk",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert _rows(df.columns, df.collect()) == _rows(cols, cur.fetchall())


def test_maxsim_run_asks_every_vector(spark, con):
    got = QUERIES["maxsim_run"](spark, SF)
    asked = {r[0] for r in con.execute("SELECT CAST(vec_id AS VARCHAR) FROM embeddings").fetchall()}
    rows = got.collect()
    assert asked and {r.qid for r in rows} == asked
    assert _rows(got.columns, rows) == _rows(["qid", "did", "rank", "score"], con.execute(
        f"SELECT qid, did, rank, score FROM ({SQL['maxsim_run']})").fetchall())


def test_class_weights_of_judgments_without_some_grades(spark, monkeypatch):
    from judgeline.plans import q_files

    gold = [("q", "a", 2), ("q", "b", 3), ("q", "c", 3), ("r", "a", 3)]
    monkeypatch.setattr(q_files.fx, "gold", lambda *_: spark.createDataFrame(gold, "qid string, did string, label int"))
    own = duckdb.connect()
    own.execute("CREATE TABLE gold AS SELECT * FROM (VALUES ('q', 'a', 2), ('q', 'b', 3), ('q', 'c', 3), ('r', 'a', 3)) t(qid, did, label)")
    got = QUERIES["class_weights"](spark, SF)
    want = own.execute(SQL["class_weights"][SQL["class_weights"].rindex("SELECT label, n, round(w * c"):])
    assert _rows(got.columns, got.collect()) == _rows([d[0] for d in want.description], want.fetchall())


def test_retriever_registry_of_a_corpus_with_a_blank_text(spark, monkeypatch):
    from judgeline.plans import q_files

    gold = q_files.fx.gold(spark, SF)
    corpus = q_files.fx.corpus(spark, SF)
    blank = spark.createDataFrame([("blank", " \n", "s", "en"), ("empty", "", "s", "en")], corpus.schema)
    monkeypatch.setattr(q_files.fx, "corpus", lambda *_: corpus.unionByName(blank))
    monkeypatch.setattr(q_files.fx, "gold", lambda *_: gold)
    got = {(r.run_id, r.qid): r.n for r in QUERIES["retriever_registry"](spark, SF).collect()}
    assert {run for run, _ in got} == set(q_files.REGISTRY) and all(n <= 40 for n in got.values())


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_model_based_queries_agree_with_each_other(spark):
    """The report is recounted from the verdicts, and the reranked lists are in the order of the scores."""
    pairs = QUERIES["train_pair_classifier"](spark, SF).collect()
    assert {r.part for r in pairs} <= {"train", "dev", "test"} and all((r.score > 0.5) == (r.pred == 1) for r in pairs)
    train = [r for r in pairs if r.part == "train"]
    mean = lambda g: sum(r.score for r in train if r.label == g) / max(1, sum(r.label == g for r in train))
    assert mean(1) > mean(0)
    for r in QUERIES["classifier_report"](spark, SF).collect():
        part = [p for p in pairs if p.part == r.part]
        own = [p for p in part if p.label == r.label]
        hit = sum(p.pred == r.label for p in own)
        assert (r.support, r.predicted_0, r.predicted_1) == (len(own), sum(p.pred == 0 for p in own), sum(p.pred == 1 for p in own))
        assert r.accuracy == pytest.approx(sum(p.pred == p.label for p in part) / len(part))
        said = sum(p.pred == r.label for p in part)
        assert r.precision == pytest.approx(hit / said if said else 0) and r.recall == pytest.approx(hit / len(own) if own else 0)
    lists = {}
    for r in QUERIES["rerank_with_model"](spark, SF).collect():
        lists.setdefault(r.qid, []).append((r["rank"], -round(r.score, 9), r.did))
    for rows in lists.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, len(rows) + 1)) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)
    known = {(p.qid, p.did): p.score for p in pairs}
    shared = [(known[q, d], -s) for q, rows in lists.items() for _, s, d in rows if (q, d) in known]
    assert shared and all(a == pytest.approx(b, abs=1e-8) for a, b in shared)
