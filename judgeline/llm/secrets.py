"""Secret scan by corpus-wide ownership frequency (DataFrame functions only).

Candidates are found by patterns. A candidate's value is hashed, and over the whole corpus the distinct repositories and
owners of every hash are counted. A value that many owners have is a copied example; one that a single owner has and
that looks like a key is live. Spans of the base kinds are always reported, with their verdict. Kinds that are too
common in harmless text to be reported by pattern alone (long opaque words) are reported only where they are live.

Texts stay where they are: one scan turns them into rows of matches with their distances, which are short.

Defined cases: a null text is the empty one; a null owner is an owner like any other. Repeated rows are scanned each,
and count once for their repository. Empty tables give no rows, and columns besides those named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgeline.llm.common import join_split
from judgeline.session import written

ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: kind: (pattern, group that is the value, fewest characters of the value). In the order of equal starts. A run with a
#: least length in the pattern is the run without it, where no shorter run could have taken part of it.
BASE = {
    "assign": (ASSIGN, 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
ADDED = {
    "private": ("-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]*", 0, 64),
    "signed": ("eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 32),
    "opaque": ("[A-Za-z0-9_-]{20,}", 0, 20),
}
KINDS = [*BASE, *ADDED]
#: Words that stand in place of a key.
STAND_INS = "(?i)example|sample|dummy|changeme|placeholder|your|xxxx|secret|test"


def looks_live(value: Column) -> Column:
    """Letters and digits, at least eight characters and six different ones, and no stand-in word."""
    return (
        (F.length(value) >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(STAND_INS)
        & (F.size(F.array_distinct(F.split(value, ""))) >= 6))


def _mixed(kind: Column, value: Column) -> Column:
    """Opaque words count only if they hold digits, small and capital letters."""
    return (kind != "opaque") | (value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]"))


def find_matches(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """``row, doc_id, owner, repo, kind, i, gap, match``: every match with the distance to the one before of its kind.

    A row without a match stands for each document that has none.
    """
    patterns = {**BASE, **ADDED}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), text.alias("text"))
    found = read.select("*", *[
        F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, (p, _, _) in patterns.items()])

    def pieces(number: int, kind: str) -> Column:
        matches = F.col(f"m_{kind}")
        gaps = F.transform(F.split("text", patterns[kind][0]), F.length)
        rows = F.transform(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda x, i: F.struct(
            F.lit(number).alias("kind"), i.alias("i"), x["g"].alias("gap"), x["m"].alias("match")))
        return F.when(F.size(matches) > 0, F.slice(rows, 1, F.size(matches))).otherwise(F.slice(rows, 1, 0))

    return found.select(
        "row", "doc_id", "owner", "repo", F.inline_outer(F.concat(*[pieces(i, k) for i, k in enumerate(KINDS)])))


def candidates(matches: DataFrame) -> DataFrame:
    """``row, doc_id, owner, repo, kind, start, end, hash, live``: places of candidate values, in code points.

    Ends are running sums of gaps and matches of a kind in a document.
    """
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match")
    placed = matches.where(F.col("match").isNotNull()).withColumn("end", F.sum(F.col("gap") + size).over(order).cast("long"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    least = reduce(
        lambda c, k: c.when(F.col("kind") == k[0], k[1]),
        list(enumerate(n for _, _, n in {**BASE, **ADDED}.values()))[1:], F.when(F.col("kind") == 0, BASE["assign"][2]))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    return placed.withColumn("value", value).where((F.length("value") >= least) & _mixed(name, F.col("value"))).select(
        "row", "doc_id", "owner", "repo", "kind", (F.col("end") - size).alias("start"), "end",
        F.sha2("value", 256).alias("hash"), looks_live(F.col("value")).alias("live"))


def ownership(found: DataFrame) -> DataFrame:
    """``hash, owners, repos, places``; counts are combined map-side at each of three levels."""
    by_repo = found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("places"))


def scan_secrets(
    docs: DataFrame, owner: Column, repo: Column, copied_owners: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (start, kind, end, name, verdict, owners, repos).

    A value is ``live`` if one owner has it and it looks like a key, an ``example`` if ``copied_owners`` owners or more
    have it or if it does not look like one, and ``shared`` in between. ``kind`` is the place of ``name`` in ``KINDS``.
    Values of a third of all places are dealt to many tasks, see ``join_split``.
    """
    matches = written(find_matches(docs, id_col, text_col, owner, repo), "matches")
    found = written(candidates(matches), "candidates")
    counts = written(ownership(found), "ownership")
    verdict = F.when((F.col("owners") >= copied_owners) | ~F.col("live"), "example").when(
        F.col("owners") == 1, "live").otherwise("shared")
    judged = join_split(found, counts, ["hash"], "row").withColumn("verdict", verdict).where(
        (F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", "end", name.alias("name"), "verdict", "owners", "repos").alias("span")
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    # An added span inside a base one says nothing new.
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    new = F.filter("spans", lambda s: (s["kind"] < len(BASE)) | ~F.exists(
        base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return matches.select("row", "doc_id").distinct().join(per_row, "row", "left").select(
        "doc_id", F.coalesce(new, none).alias("spans"))
