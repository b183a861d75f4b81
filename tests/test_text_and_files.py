import json
import random

import pytest
from pyspark.sql import functions as F

from judgeline.functions import scoring as X
from judgeline.functions import text as T
from judgeline.operators import judging as G
from judgeline.sources import readers as I
from judgeline.sources import writers as O


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).head()[0]


def test_chunks(spark):
    assert one(spark, "a b c d e", T.chunk_sliding("text", 4, 2)) == ["a b c d", "c d e", "e"]
    assert one(spark, "  ", T.chunk_sliding("text", 4, 2)) == []
    assert one(spark, "a b\n\nc d e\n\nf\n\n\n\ng h i j", T.chunk_paragraph_pack("text", 4)) == ["a b", "c d e f", "g h i j"]
    assert one(spark, "a b c", T.chunk_headers("text", 2)) == "## CHUNK_001 (words 1-2)\n\na b\n\n## CHUNK_002 (words 3-3)\n\nc"


@pytest.mark.parametrize("n,stride", [(1, 3), (9, 3), (10, 3), (11, 4)])
def test_number_of_chunks(spark, n, stride):
    assert len(one(spark, " ".join("w" * n), T.chunk_sliding("text", 5, stride))) == -(-n // stride)


def test_accents_and_tokens(spark):
    assert one(spark, "Ñandú é", T.strip_accents("text")) == "Nandu e"
    assert one(spark, "Ación-1", T.normalize_token("text")) == "acion"
    assert one(spark, "¿Qué? no, no", T.token_set_punct("text")) == ["qué", "no"]
    assert one(spark, "art. 12 y Artículo 5, ARTÍCULO 7", T.extract_articles("text")) == ["12", "5", "7"]
    assert one(spark, "x\nCITAS relevantes: 1, 2 ", T.extract_section("text", "Citas relevantes")) == "1, 2"
    assert one(spark, "none", T.extract_section("text", "Citas relevantes")) == ""


def test_labels_and_heads(spark):
    assert one(spark, "Relevante", X.map_text_label("text")) == 2
    assert one(spark, "?", X.map_text_label("text")) == 0
    with pytest.raises(Exception, match="unknown label"):
        one(spark, "?", X.map_text_label("text", strict=True))
    packed = X.pack_tokens(F.array(*map(F.lit, [5, 6, 7])), 3, eos=9)
    assert one(spark, "", packed["input_ids"]) == [5, 6, 9]
    assert one(spark, "", X.pack_tokens(F.array(F.lit(5)), 4, eos=9)["attention_mask"]) == [1, 1, 0, 0]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_corpus_files(spark, tmp_path):
    p = write(tmp_path / "c.jsonl", '{"id": 1, "text": "a"}\n\n{"id": "2", "contents": "b"}\n{broken\n{"id": 3}\n')
    assert rows(I.read_corpus_jsonl(spark, p).select("did", "text")) == [("1", "a"), ("2", "b"), ("3", "")]
    m = write(tmp_path / "m.json", json.dumps({"1": "a\nb", "2": 'say "x"'}, indent=2))
    assert rows(I.read_corpus_json_map(spark, m)) == [("1", "a\nb"), ("2", 'say "x"')]
    assert rows(I.read_corpus_json_map(spark, m, layout="pairs")) == [("1", "a\nb"), ("2", 'say "x"')]
    with pytest.raises(Exception, match="not a JSON object"):
        I.read_corpus_json_map(spark, write(tmp_path / "l.json", "[1, 2]")).collect()
    c = write(tmp_path / "c.csv", 'Codigo,text,Titulo\n1,"two\nlines, ""quoted""",t\n')
    assert rows(I.read_corpus_csv(spark, c, title="Titulo")) == [("1", "t", 'two\nlines, "quoted"')]


def test_query_files(spark, tmp_path):
    p = write(tmp_path / "q.tsv", "topic_id\tQuery\n 1\tone \n2\n\tnone\n3\tthree\tmore\n")
    assert rows(I.read_queries(spark, p).select("qid", "query")) == [("1", "one"), ("3", "three\tmore")]
    assert rows(I.read_queries(spark, p, header=True).select("qid")) == [("1",), ("3",)]
    assert I.read_queries(spark, p, header=False).count() == 3
    c = write(tmp_path / "q.csv", 'topic_id,Query\n7,"with, comma"\n')
    assert rows(I.read_queries(spark, c, sep=",").select("qid", "query")) == [("7", "with, comma")]


@pytest.mark.parametrize("text,want", [
    ("q\td\t1\nq\te\tx\nq\td\t2\n", [("q", "d", 2)]),
    ("q\t0\td\t1\nq\t0\te\t0\n", [("q", "d", 1), ("q", "e", 0)]),
    ("query_id\trun\tdocid\trel\nq\t0\td\t3\n", [("q", "d", 3)]),
    ("gain\tpid\tqid\n2\td\tq\n", [("q", "d", 2)]),
    ("q\t0\td\t1\tsome evidence\there\nq\t0\te\n", [("q", "d", 1)]),
])
def test_qrels_layouts(spark, tmp_path, text, want):
    p = write(tmp_path / "x.qrels", text)
    assert rows(I.read_qrels(spark, p).select("qid", "did", "label")) == want


def test_last_judgment_wins_across_splits(spark, tmp_path):
    rng = random.Random(7)
    lines = [(f"q{rng.randint(0, 4)}", f"d{rng.randint(0, 30)}", rng.randint(0, 3)) for _ in range(4000)]
    p = write(tmp_path / "big.tsv", "".join(f"{q}\t{d}\t{x}\n" for q, d, x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {(r.qid, r.did): r.label for r in I.read_qrels(spark, p).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(q, d): x for q, d, x in lines}


def test_runs_round_trip(spark, tmp_path):
    run = spark.createDataFrame(
        [("m", "q", f"d{i}", i + 1, 1.0 / (i + 1)) for i in range(40)], "run_id string, qid string, did string, rank int, score double")
    O.write_trec_run(run, str(tmp_path / "run"))
    back = I.read_trec_run(spark, str(tmp_path / "run" / "*"))
    assert back.count() == 30 and back.where("rank = 3").head().score == pytest.approx(0.3333)
    wide = O.run_wide(run, 5).orderBy("rank").collect()
    assert [r["q"] for r in wide] == [f"d{i}" for i in range(5)]
    p = write(tmp_path / "t.run", "q Q0 d 1 2.5 tag\nq Q0 short\n")
    assert I.read_trec_run(spark, p).count() == 1


def test_annotation_exports(spark, tmp_path):
    record = {"username": "ann", "topic_id": "3:Topic", "id_report": "77", "labels": [{"label": "Relevante"}]}
    p = write(tmp_path / "list.json", json.dumps([record, record]))
    assert rows(I.read_annotation_export(spark, p)) == [("ann", "3:Topic", "77", "Relevante")] * 2


def test_training_log(spark, tmp_path):
    p = write(tmp_path / "log", "x {'loss': 1.5, 'grad_norm': nan, 'learning_rate': 2e-05, 'epoch': 0.1}\nnothing\n"
              "{'loss': 0.5, 'epoch': 0.2} {'eval': 1}\n")
    got = I.read_training_log(spark, p).orderBy("step").collect()
    assert [(r.step, r.loss, r.learning_rate, r.epoch) for r in got] == [(1, 1.5, 2e-05, 0.1), (2, 0.5, None, 0.2)]


def test_responses(spark):
    r = spark.createDataFrame([
        ("1_2", '{"relevant":"yes","evidence":"e"}'), ("1_3", '{"relevant":"no"}'), ("1_4", '{"relevant":"maybe"}'),
        ("1_5", "{oops"), ("bad", '{"relevant":"yes"}')], "custom_id string, content string")
    good, bad = G.parse_relevance_responses(r)
    assert rows(good) == [("1", "2", 1, "e"), ("1", "3", 0, None)]
    assert rows(bad.select("custom_id", "reason")) == [("1_4", "no label"), ("1_5", "not json"), ("bad", "bad id")]
    g = spark.createDataFrame([("7", '{"a":"x","b":"y","c":"z","d":"w"}'), ("8", '{"a":"x"}'), ("9", "nope")], "did string, content string")
    queries, qrels = G.parse_generated_queries(g)
    assert rows(queries) == [("7_compleja", "y", "7"), ("7_corta", "x", "7"), ("7_pregunta", "z", "7")]
    assert qrels.count() == 3
    with pytest.raises(Exception, match="fewer than three"):
        G.parse_generated_queries(g, strict=True)[0].collect()


def test_templates_do_not_expand_filled_in_text(spark):
    df = spark.createDataFrame([("{doc}", "D")], "q string, d string")
    got = df.select(G.fill_template("Q {query} / {doc} {other}", {"query": F.col("q"), "doc": F.col("d")})).head()[0]
    assert got == "Q {doc} / D {other}"


# --- files read in byte ranges -----------------------------------------------------------------------------------

@pytest.fixture
def small_ranges(spark):
    """Files are cut every 64 bytes, which falls inside texts, escapes and line breaks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


TEXTS = [
    "", "plain", 'quoted "text" with, commas', "two\nlines", "three\n\n\"lines\"\nand a tab\t", "back\\slash \\\\ end\\", '\\"', '"',
    "é 😀 日本", "{[}] : , {", "x" * 300, ': "a"', "\r\n", "ends with \\", " lead and trail ",
]


@pytest.mark.parametrize("layout", [{"indent": None}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": True}])
def test_json_object_in_ranges(spark, tmp_path, small_ranges, layout):
    import json

    whole = {f"id {i}": t for i, t in enumerate(TEXTS)} | {'key "with" quotes\\': "v", "": "empty key"}
    other = {f"other{i}": "word " * i for i in range(40)}
    for name, data in (("a.json", whole), ("b.json", other), ("c.json", {})):
        (tmp_path / name).write_text(json.dumps(data, **{"ensure_ascii": False, **layout}), encoding="utf-8")
    got = I.read_corpus_json_map(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted((whole | other).items())
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_json_values_that_are_no_strings(spark, tmp_path, small_ranges):
    import json

    data = {"n": 1.5, "o": {"a": ["x, }", {"b": ":"}]}, "t": True, "s": "end"}
    (tmp_path / "a.json").write_text(json.dumps(data))
    got = {r.did: r.text for r in I.read_corpus_json_map(spark, str(tmp_path)).collect()}
    assert got["s"] == "end" and {k: json.loads(v) for k, v in got.items() if k != "s"} == {k: v for k, v in data.items() if k != "s"}


@pytest.mark.parametrize("text", ['["a", "b"]', '{"a": "b"', '{"a": "b}'])
def test_json_that_is_no_object_fails(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON object"):
        I.read_corpus_json_map(spark, str(tmp_path)).collect()


def test_csv_in_ranges(spark, tmp_path, small_ranges):
    import csv

    for name, low in (("a.csv", 0), ("b.csv", 100)):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n" if low else "\r\n", quoting=csv.QUOTE_MINIMAL)
            out.writerow(["Codigo", "text", "kind"])
            out.writerows([low + i, t, "k"] for i, t in enumerate(TEXTS))
    got = {r.did: r.text for r in I.read_corpus_csv(spark, str(tmp_path), keep=("kind",)).collect()}
    want = {str(low + i): t for low in (0, 100) for i, t in enumerate(TEXTS)}
    assert {k: v or "" for k, v in got.items()} == {k: v.strip() if v != "\r\n" and v.strip() == "" else v for k, v in want.items()}


def test_quoted_queries_with_line_breaks(spark, tmp_path, small_ranges):
    (tmp_path / "q.csv").write_text('qid,query\n1,"first\nline"\n2,"say ""hi"", then go"\n3,plain\n')
    got = [(r.qid, r["query"]) for r in I.read_queries(spark, str(tmp_path / "q.csv"), sep=",").orderBy("line_no").collect()]
    assert got == [("1", "first\nline"), ("2", 'say "hi", then go'), ("3", "plain")]
