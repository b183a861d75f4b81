"""The corpus pipeline on a small table with planted cases."""

import random
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from judgeline.llm.queries import piece_model_path

EN = "the of and to in is that it was for on are with as his they at be this have from or one had by word".split()
FR = "le la de et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont".split()


def prose(seed, n, words):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "ment", "ing", "s"]) for _ in range(n))


def test_stages_on_planted_cases(spark, tmp_path):
    rows = [(i, prose(i, 80, EN), "en", f"s{i % 3}", 1) for i in range(0, 60)]
    rows += [(i, prose(i, 80, FR), "fr", f"s{i % 3}", 1) for i in range(60, 120)]
    rows += [(200, None, None, None, None), (201, "12 34 !!", "en", "s1", 1), (202, "漢字仮名交じり文の例です" * 4, None, "s1", 1)]
    rows += [(300, rows[3][1], "en", "s2", 9), (301, rows[3][1], "en", "s2", 9)]
    near = rows[5][1].split()
    near[40] = "changed"
    rows += [(400, " ".join(near), "en", "s0", 1), (None, prose(999, 80, EN), "en", "s0", None), (500, prose(77, 30_000, EN), "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn(
        "row", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids, after = lambda df: sorted(r.doc_id for r in df.collect() if r.doc_id is not None), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        after[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert set(ids(after["language"])) == {r[0] for r in rows if r[0] is not None} - {200, 201, 202}
    assert after["language"].where("doc_id is null").count() == 1
    assert set(ids(after["exact_dedup"])) == set(ids(after["language"])) - {3, 300}
    assert set(ids(after["near_dedup"])) == set(ids(after["exact_dedup"])) - {400}
    assert set(ids(after["mix"])) <= set(ids(after["near_dedup"]))
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    texts = {r[0]: r[1] for r in rows}
    for r in after["tokens"].collect():
        want = model.encode(prose(999, 80, EN) if r.doc_id is None else texts[r.doc_id])
        assert r.ids == ",".join(map(str, want)) and r.n_tokens == len(want)
    assert Counter(ids(after["mix"])) == Counter(ids(after["tokens"]))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(ids(whole)) == Counter(ids(after["tokens"]))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
