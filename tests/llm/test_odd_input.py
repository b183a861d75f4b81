"""Bytes that are no UTF-8, clashing names, and language identification against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from judgeline.llm import crossparse, digest_index, minhash
from judgeline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in is that it was for on are with as his they at be this have from or one had by word".split()
DE = "der die das und ist nicht ein eine mit auf wir sie ich haben werden schon noch aber wenn weil nach".split()


def prose(seed, n, words):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "ung", "ing", "s"]) for _ in range(n))


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op5_sentencepiece", "op10_edit_fingerprints"])
def test_bytes_that_are_no_text(spark, tmp_path, name):
    rows = [(i, prose(i % 3, 40, EN), "en", "s", 1) for i in range(5)]
    broken = F.when(F.col("doc_id") > 2, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("20FFC3"))).cast("string"))
    spark.createDataFrame(rows, SCHEMA).withColumn("text", F.coalesce(broken, "text")).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in QUERIES[name](spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4]


CLASH = ["row", "sha", "id", "own", "digest", "keep", "ties", "_own", "_ties", "_digest", "_keep", "_id", "_mark", "mark", "lang_pred",
         "bits", "most", "score", "letter", "root", "first"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:4]])
def test_stages_leave_columns_of_any_name_alone(spark, stage):
    rows = [(i, prose(i % 6, 60, EN if i % 2 else DE), "en" if i % 2 else "de", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH])
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASH)


def test_equal_rows_stay_once(spark):
    docs = spark.createDataFrame([(1, "same text", "en", "s", 1)] * 3 + [(None, "same text", "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in digest_index.drop_copies(docs, digest_index.DigestIndex(spark)).collect()] == [1]
    assert [r.doc_id for r in minhash.drop_near(docs).collect()] == [1]


def test_samples_use_every_row_and_part(spark):
    """64 long rows per language: each gives its share, and not from its start alone."""
    rows = [(i, f"row{i:03d} " + " ".join(f"{i:03d}w{j}" for j in range(900)), "xx", "s", 1) for i in range(100)]
    (lang, data), = crossparse.learn_samples(spark.createDataFrame(rows, SCHEMA))
    share = crossparse.SAMPLE_BYTES // crossparse.ROWS_PER_LANG
    parts = data.split(b"\n")
    assert lang == "xx" and len(parts) == crossparse.ROWS_PER_LANG and len(data) <= crossparse.SAMPLE_BYTES
    assert all(len(p) == share - 1 for p in parts) and sum(p.startswith(b"row") for p in parts) < 4


def brute_rate(text, sample):
    """Phrases of the greedy parse, window by window, times the bits of a place, per byte."""
    n = 0
    for at in range(0, len(text), crossparse.WINDOW):
        state, n = b"", n + 1
        for i in range(at, min(at + crossparse.WINDOW, len(text))):
            c = text[i:i + 1]
            if state + c in sample:
                state += c
            else:
                n, state = n + 1, c if c in sample else b""
    return n * math.log2(max(2, len(sample))) / max(1, len(text))


def test_language_query_equals_brute_force(spark, tmp_path):
    rows = [(i, prose(i, 30 + i % 5 * 40, EN if i % 2 else DE), "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows += [(100, None, "en", "s", 1), (101, "12 34", "de", "s", 1), (102, "ein Wort", None, "s", 1), (102, "ein Wort", None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    samples = crossparse.learn_samples(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))
    assert [s for s, _ in samples] == ["de", "en"]
    texts = {r[0]: r[1] for r in rows}
    for r in QUERIES["op7_language_id"](spark, str(tmp_path)).collect():
        text = texts[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        rates = sorted((brute_rate(text.encode().lower(), data), lang) for lang, data in samples)
        assert r.lang_pred == rates[0][1] and r.score == pytest.approx(1 - rates[0][0] / rates[1][0])


def test_foreign_texts_go_and_related_prose_stays(spark):
    rows = [(i, prose(i, 60, EN if i % 2 else DE), "en" if i % 2 else "de", "s", 1) for i in range(80)]
    rng = random.Random(7)
    rows += [(200 + i, "".join(rng.choice("qxzjkvwbpfgy") for _ in range(200)), None, "s", 1) for i in range(5)]
    rows += [(300 + i, prose(1000 + i, 50, EN), None, "s", 1) for i in range(5)]
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {r[0] for r in rows} - {200 + i for i in range(5)}
