"""Values worked out by hand, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from judgeline.operators import metrics as M
from judgeline.operators.retrieve import topk_run

RUN = "run_id string, qid string, did string, rank int, score double"
QRELS = "qid string, did string, label int"


def run_rows(qid, docs, run_id="r"):
    return [(run_id, qid, d, i + 1, 1.0 / (i + 1)) for i, d in enumerate(docs)]


@pytest.fixture
def small(table):
    run = table(RUN, run_rows("q", ["x", "a", "b", "c"]))
    qrels = table(QRELS, [("q", "a", 3), ("q", "b", 0), ("q", "c", 1)])
    return run, qrels


def test_hand_values(small):
    row = M.query_metrics(*small, ["ndcg_exp@10", "condensed_ndcg@10", "judged@10", "bpref", "ndcg_cut@10", "ndcg",
                                   "recip_rank", "map", "recall@10"]).head()
    ideal = 7 + 1 / math.log2(3)
    assert row.ndcg_exp_10 == pytest.approx((7 / math.log2(3) + 1 / math.log2(5)) / ideal)
    assert row.condensed_ndcg_10 == pytest.approx((7 + 1 / math.log2(4)) / ideal)
    assert row.judged_10 == pytest.approx(0.3)
    # Two relevant, one not: a has none above, c has one above, min(R, N) = 1.
    assert row.bpref == pytest.approx((1 + 0) / 2)
    linear = 3 + 1 / math.log2(3)
    assert row.ndcg_cut_10 == pytest.approx((3 / math.log2(3) + 1 / math.log2(5)) / linear)
    assert row.ndcg == pytest.approx(row.ndcg_cut_10)
    assert row.recip_rank == pytest.approx(0.5)
    assert row["map"] == pytest.approx((1 / 2 + 2 / 4) / 2)
    assert row.recall_10 == 1.0


def test_uncapped_bpref_may_be_negative(table):
    run = table(RUN, run_rows("q", ["n1", "n2", "n3", "r"]))
    qrels = table(QRELS, [("q", "n1", 0), ("q", "n2", 0), ("q", "n3", 0), ("q", "r", 1)])
    assert M.query_metrics(run, qrels, ["bpref"]).head().bpref == pytest.approx(-2.0)
    assert M.query_metrics(run, qrels, ["bpref"], cap_bpref=True).head().bpref == pytest.approx(0.0)


def test_query_without_judged_hits_scores_zero(table):
    run = table(RUN, run_rows("q", ["x", "y"]))
    qrels = table(QRELS, [("q", "a", 3), ("other", "a", 1)])
    rows = M.query_metrics(run, qrels, ["ndcg_exp@10", "map", "bpref", "judged@10"]).collect()
    assert [tuple(r) for r in rows] == [("r", "q", 0.0, 0.0, 0.0, 0.0)]


def test_ideal_ranking_is_one_and_condensed_equals_plain_when_all_judged(table):
    run = table(RUN, run_rows("q", ["a", "c", "b"]))
    qrels = table(QRELS, [("q", "a", 3), ("q", "b", 0), ("q", "c", 1)])
    row = M.query_metrics(run, qrels, ["ndcg_exp@10", "condensed_ndcg@10"]).head()
    assert row.ndcg_exp_10 == pytest.approx(1.0) and row.condensed_ndcg_10 == pytest.approx(1.0)


def test_running_counts_over_bucket_borders(table, monkeypatch):
    docs = [f"d{i:03d}" for i in range(50)]
    run = table(RUN, run_rows("q", docs))
    qrels = table(QRELS, [("q", d, 1 if i % 3 else 0) for i, d in enumerate(docs)])
    names = ["map", "bpref", "condensed_ndcg@20"]
    whole = M.query_metrics(run, qrels, names).head()
    monkeypatch.setattr(M, "RANK_BUCKET", 7)
    split = M.query_metrics(run, qrels, names).head()
    assert list(whole[2:]) == pytest.approx(list(split[2:]))


def test_ranks_without_rank_column_match_row_numbers(table):
    rows = [("r", f"q{i % 3}", f"d{i:02d}", None, float((i * 37) % 11)) for i in range(60)]
    run = table(RUN, rows).drop("rank")
    qrels = run.where(F.col("did") > "d10").select("qid", "did", F.lit(1).alias("label")).where("did not like '%3'")
    want = topk_run(run, 1000).join(qrels, ["qid", "did"]).select("qid", "did", "rank")
    got = M.judged_rows(run, qrels).select("qid", "did", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_official_mrr(table):
    ref = table(QRELS, [("1", "a", 1), ("2", "b", 0)])
    run = table(RUN, run_rows("1", ["x", "a"]) + run_rows("2", ["b"]))
    row = M.official_mrr(run, ref).head()
    assert row.mrr == pytest.approx(0.25) and row.queries_ranked == 2
    graded = table(QRELS, [("1", "a", 1), ("1", "x", 2)])
    assert M.official_mrr(run.where("qid = '1'"), graded).head().mrr == pytest.approx(1.0)


def test_tied_scores_share_their_gain(table):
    scored = table("qid string, did string, score double, label int", [("q", "a", 1.0, 2), ("q", "b", 1.0, 0)])
    mean = (1 + 1 / math.log2(3)) * 1.0
    assert M.tied_ndcg(scored, 10).head().ltr_ndcg_10 == pytest.approx(mean / 2)


def test_average_precision_and_pairs(table):
    scored = table("qid string, score double, label int", [("q", 4.0, 1), ("q", 3.0, 0), ("q", 2.0, 1), ("q", 1.0, 0)])
    assert M.average_precision(scored).head().average_precision == pytest.approx((1 + 2 / 3) / 2)
    graded = M.graded_pair_accuracy(scored).head()
    assert (graded.won, graded.n_pairs) == (3, 4)


def test_duplicates_are_reported(table):
    run = table(RUN, run_rows("q", ["a", "b", "a", "0", "0"]))
    assert [(r.did, r.n) for r in M.duplicate_run_rows(run).collect()] == [("a", 2)]


def test_partitioning_does_not_change_results(small):
    run, qrels = small
    names = ["ndcg_exp@10", "bpref", "map"]
    a = M.query_metrics(run, qrels, names).collect()
    b = M.query_metrics(run.repartition(5), qrels.repartition(3), names).collect()
    assert a == b
