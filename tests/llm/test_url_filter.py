"""URL filter: outcomes from pages, odd tables, and the query against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from judgeline.llm import hosts
from judgeline.llm.queries import QUERIES, URL_RULES

PAGES, LABELS, DOCUMENTS = "page_id long, url string, html string", "doc_id long, quality int, toxic int", "doc_id long, text string"
CLASH = ["host", "path", "rule", "bad", "word", "digest", "marked", "low", "rate", "n", "domain", "suffix", "words"]


@pytest.fixture
def folder(spark, tmp_path):
    def save(pages, labels, documents, extra=()):
        for name, rows, schema in (("pages", pages, PAGES), ("labels", labels, LABELS), ("documents", documents, DOCUMENTS)):
            df = spark.createDataFrame(rows, schema).select("*", *[F.lit(c).alias(c) for c in extra])
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save


GOOD = [f"plain words number{i} about garden and house" for i in range(60)]
BAD = [f"plain words number{i} about scoundrel garden" for i in range(60)]
TEACH = [(i, t) for i, t in enumerate(GOOD + BAD)]
MARKS = [(i, 1, int(i >= len(GOOD))) for i in range(len(TEACH))]


def test_bad_words_equal_brute_force(spark):
    rows = [(t, i >= len(GOOD)) for i, t in enumerate(GOOD + BAD)] + [(BAD[0], True)] * 50 + [(None, True), ("", False)]
    got = {r.word for r in hosts.bad_words(spark.createDataFrame(rows, "text string, bad boolean")).collect()}
    texts = {t: max(b for x, b in rows if x == t) for t, _ in rows if t is not None}
    prior, want = sum(texts.values()) / len(texts), set()
    for word in {w for t in texts for w in re.findall(r"[^\W\d_]+", t)}:
        held = [b for t, b in texts.items() if word in re.findall(r"[^\W\d_]+", t)]
        n = len(held)
        rate = (sum(held) + hosts.WEAKEST * prior) / (n + hosts.WEAKEST)
        if rate - hosts.WORD_DEVIATIONS * (rate * (1 - rate) / (n + hosts.WEAKEST + 1)) ** 0.5 > 0.5:
            want.add(word)
    assert got == want == {"scoundrel"}


def test_outcomes_are_those_of_rules_then_of_texts(spark):
    pages = [
        (1, "http://a.org/x", "<p>A SCOUNDREL</p>"), (2, "http://a.org/y", "<script>scoundrel</script><p title='scoundrel'>fine</p>"),
        (3, "http://b.net/es/1", "fine"), (4, "http://c.com/", "scoundrel"), (None, None, None), (1, "http://a.org/x", "<p>A SCOUNDREL</p>")]
    labelled = spark.createDataFrame([(t, i >= len(GOOD)) for i, t in enumerate(GOOD + BAD)], "text string, bad boolean")
    got = hosts.page_outcomes(spark.createDataFrame(pages, PAGES), labelled, URL_RULES).collect()
    assert sorted((r.host, r.bad) for r in got) == [("", 0), ("a.org", 0), ("a.org", 1), ("a.org", 1), ("b.net", 1), ("c.com", 0)]


def test_hosts_are_blocked_by_what_their_pages_say(spark, folder):
    pages = [(i, f"http://vile.org/{i}", "a scoundrel") for i in range(40)]
    pages += [(100 + i, f"http://kind.net/de/{i}", "a garden") for i in range(40)] + [(200, "http://new.kind.net/", "a scoundrel")]
    pages += [(300, "http://vile.org/x", None), (300, "http://vile.org/x", None), (None, None, None)]
    path = folder(pages, MARKS + [(None, 1, 1), (5000, 0, 1), (0, None, None)], TEACH + [(None, "scoundrel")], CLASH)
    got = QUERIES["op6_url_filter"](spark, path).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(p[0]) for p in pages)
    for r in got:
        assert r.verdict == ("block" if r.host == "vile.org" else "allow") and r.rule is None


@pytest.mark.parametrize("pages,labels", [([], MARKS), ([(1, "http://a.org/", "scoundrel"), (2, "http://x.net/fr/", "")], []), ([], [])])
def test_empty_tables(spark, folder, pages, labels):
    got = QUERIES["op6_url_filter"](spark, folder(pages, labels, TEACH if labels else [])).collect()
    assert {(r.page_id, r.verdict) for r in got} == ({(1, "allow"), (2, "block")} if pages else set())
