"""URL filter: explicit rules first, then empirical-Bayes host reputation (DataFrame functions only).

Outcomes come from the pages themselves: a page that a rule fits has that rule's verdict, any other is bad if its text
holds a word that labelled documents mark as bad. They are counted per host, and each count is shrunk towards its registered domain, that towards its
public suffix, and that towards all pages, by beta-binomial priors whose strengths are estimated from the counts. A
host is blocked when the lower bound of its posterior exceeds a threshold, so that few bad pages alone never block.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged like any
host. Hosts without outcomes get their domain's, suffix's or the overall rate. Repeated pages get equal verdicts.
Without any outcome every page that no rule blocks is allowed. A null html has no words; labels without a document, or
with a null mark, teach nothing bad. Empty tables give empty results, and other columns of a table are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgeline.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Prior strengths are kept within these bounds (pseudo pages).
WEAKEST, STRONGEST = 2.0, 1000.0
#: Lower bound: posterior mean less so many deviations.
DEVIATIONS = 1.645
#: Blocked when the lower bound of the bad share is above this.
BAD_SHARE = 0.5
#: A word is bad if the share of bad texts among those that hold it is above one half by so many deviations.
WORD_DEVIATIONS = 3.0
#: Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "com.mx", "co.za")


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. Rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def words_of(text: Column) -> Column:
    """Distinct runs of letters, A-Z lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"\p{L}+"), F.lit(0)))


def visible(html: Column) -> Column:
    """Text between the tags, without scripts and styles."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ")


def bad_words(labelled: DataFrame) -> DataFrame:
    """``word``: those whose texts are bad by the lower bound of their shrunk share; ``labelled`` has ``text, bad``.

    Equal texts count once, and as bad if any of them is. Counts are summed map-side.
    """
    distinct = written(
        labelled.where("text IS NOT NULL").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(
            F.max(F.col("bad").cast("int")).alias("bad"), F.first(words_of(F.col("text"))).alias("words")).drop("digest"),
        "labelled")
    prior = distinct.agg(F.avg("bad")).head()[0] or 0.0
    n = F.col("n")
    rate = (F.col("a") + WEAKEST * F.lit(float(prior))) / (n + WEAKEST)
    counts = distinct.select("bad", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("bad").alias("a"), F.count(F.lit(1)).alias("n")).withColumn("r", rate)
    low = F.col("r") - WORD_DEVIATIONS * F.sqrt(F.col("r") * (1 - F.col("r")) / (n + WEAKEST + 1))
    return counts.where(low > 0.5).select("word")


def page_outcomes(
    pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``host, bad`` for every page: its rule's verdict, else whether its text holds a bad word.

    Words stay beside the digest of their page, so that what is joined back is one digest per bad page.
    """
    html = F.col(f"`{html_col}`")
    digest = F.md5(html.cast("binary")).alias("digest")
    words = written(bad_words(labelled), "bad-words")
    marked = written(
        pages.select(digest, F.explode(words_of(visible(html))).alias("word")).join(words, "word", "left_semi")
        .select("digest").distinct().withColumn("marked", F.lit(1)), "bad-pages")
    url = F.col(f"`{url_col}`")
    rows = pages.select(host_of(url).alias("host"), path_of(url).alias("path"), digest)
    _, ruled = rule_of(F.col("host"), F.col("path"), rules)
    bad = F.coalesce((ruled == "block").cast("int"), "marked", F.lit(0))
    return rows.join(marked, "digest", "left").select("host", bad.alias("bad"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """Adds ``rate`` and ``k``: each group's share shrunk towards its ``prior`` with strength ``k``.

    The strength is estimated by moments: how far the shares spread around their priors beyond chance. One row of sums
    comes back to the driver.
    """
    prior = F.col("prior")
    n = F.col("n").cast("double")
    chance = prior * (1 - prior)
    s = groups.agg(
        F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(chance).alias("chance"), F.sum(n * chance).alias("n_chance"),
        F.sum(n * F.pow(F.col("bad") / n - prior, F.lit(2.0))).alias("spread")).head()
    k = STRONGEST
    if s["n"]:
        room = s["n"] - s["nn"] / s["n"]
        between = (s["spread"] - s["chance"]) / room if room > 0 else 0.0
        if between > 0:
            k = min(STRONGEST, max(WEAKEST, s["n_chance"] / s["n"] / between - 1))
    return groups.withColumn("k", F.lit(float(k))).withColumn("rate", (F.col("bad") + k * prior) / (n + k))


def host_reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, n, bad, rate, low``: posterior share of bad pages and its lower bound for every known host.

    ``hosts`` is distinct; hosts with outcomes only are known as well; ``outcomes`` has ``host, bad`` (0 or 1), one row per labelled page. Counts are summed
    map-side, so a hot host is one row per task.
    """
    seen = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    counts = written(
        hosts.select("host").join(seen, "host", "full").select(
            "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"),
            F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")), "host-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).head()
    overall = sums["bad"] / sums["n"] if sums["n"] else 0.0

    def groups(*keys):
        return counts.where("n > 0").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    suffixes = _shrunk(groups("suffix").withColumn("prior", F.lit(float(overall))))
    suffix_rates = suffixes.select("suffix", F.col("rate").alias("prior"))
    domains = _shrunk(groups("domain", "suffix").join(suffix_rates, "suffix"))
    domain_rates = domains.select("domain", F.col("rate").alias("domain_rate"))
    with_prior = counts.join(domain_rates, "domain", "left").join(suffix_rates, "suffix", "left").withColumn(
        "prior", F.coalesce("domain_rate", "prior", F.lit(float(overall))))
    k = _shrunk(with_prior.where("n > 0")).select("k").head()
    k = float(k["k"]) if k else STRONGEST
    rate = (F.col("bad") + k * F.col("prior")) / (F.col("n") + k)
    low = F.col("rate") - DEVIATIONS * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + k + 1))
    return with_prior.withColumn("rate", rate).withColumn("low", low).select("host", "n", "bad", "rate", "low")


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id",
    url_col: str = "url", bad_share: float = BAD_SHARE,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate`` for every page; ``outcomes``: ``host, bad``.

    A hot host is split by adaptive execution in the one join that pages take part in.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = written(host_reputation(rows.select("host").distinct(), outcomes), "hosts")
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("low") > bad_share, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, method).alias("verdict"),
        F.col("rate").alias("bad_rate"))
