"""Which filter removes what, in every order of the filters: an audit by path counting on the subset lattice.

A state of the lattice is the set of filters already applied, an edge adds one filter to it, and an order of all
filters is a path from the empty state to the full one. What an edge removes depends on its state only: the documents
that pass every filter of the state and fail the new one. So documents are counted once per combination of failures,
removals are taken per edge, and everything else is read from edges: a step of an order is one edge, and a filter's
Shapley sum weighs each of its edges with the number of orders through it, which is the paths reaching its state
(forward) times the paths leaving the next one (backward).

Defined cases: a null text is the empty one, a null part the empty string. Rows that share an id are documents of their
own; a row without an id neither is a copy nor makes other rows copies. Of several label rows of an id, one with the
mark is enough. Empty tables give no rows, and columns besides those named are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgeline.session import written

#: Orders are listed in full, so that the number of filters is bounded: 7 filters have 35 280 steps.
MOST_FILTERS = 7
BLANKS = r"[\x20\x09-\x0D]+"


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, bit of the added filter, orders through the edge) for every edge of the lattice of ``n`` filters."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for bit in (1 << i for i in range(n) if not state >> i & 1):
            reach[state | bit] += reach[state]
    for state in reversed(range(full)):
        leave[state] = sum(leave[state | 1 << i] for i in range(n) if not state >> i & 1)
    return [
        (state, 1 << i, reach[state] * leave[state | 1 << i])
        for state in range(full) for i in range(n) if not state >> i & 1]


def orders(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, state, bit): the edges that every order of the filters walks along."""
    out = []
    for order in permutations(range(len(names))):
        state = 0
        for step, i in enumerate(order, 1):
            out.append(("".join(names[j] for j in order), step, state, 1 << i))
            state |= 1 << i
    return out


def failures(docs: DataFrame, copies: bool = True, id_col: str = "doc_id", text_col: str = "text", *more: Column):
    """One row per document: ``doc_id, fails`` (bits of A to D, and of E for copies) and the columns ``more``.

    A: under 100 words. B: fewer than 80 % of the words are distinct. C: over 10 % of the code points are A-Z. D: a
    character of ``#$%&*|``. E: the text of a smaller id. Texts do not move: copies are found by digest, and a row meets
    the first of its group by digest and id together, so that large groups of copies are spread over all tasks.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *more)
    kept = [c for c in read.columns if c not in ("doc_id", "text")]
    words = read.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    sized = words.withColumns({
        "n": F.size("words"), "d": F.size(F.array_distinct("words")), "chars": F.length("text"),
        "capitals": F.length(F.regexp_replace("text", "[^A-Z]+", ""))})
    tests = [
        F.col("n") < 100, F.col("d") * 100 < F.col("n") * 80, F.col("capitals") * 100 > F.col("chars") * 10,
        F.col("text").rlike("[#$%&*|]")]
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    rows = sized.select("doc_id", *kept, bits.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest"))
    if not copies:
        return rows.drop("digest")
    rows = written(rows, "failures")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", *kept, (F.col("fails") + F.when(copy, 1 << len(tests)).otherwise(0)).alias("fails"))


def audit(rows: DataFrame, names: list[str], part: str, fails: str, good: str, toxic: str) -> DataFrame:
    """One row per ``part``, order of the filters and step.

    ``fails`` holds one bit per filter of ``names``; ``good`` and ``toxic`` are 0 or 1. The rows are counted map-side per
    part and combination of failures; what follows has at most 2^n rows per part.
    """
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    spark = rows.sparkSession
    cells = rows.groupBy(F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(fails).alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(good).alias("g"), F.sum(toxic).alias("t"))
    edges = F.array(*[
        F.struct(F.lit(s).alias("state"), F.lit(b).alias("bit"), F.lit(w).alias("weight"))
        for s, b, w in lattice(len(names))])
    met = cells.select("*", F.inline(edges))
    m, state, bit = F.col("m"), F.col("state"), F.col("bit")
    hit, before = m.bitwiseAND(bit) != 0, m.bitwiseAND(state) != 0

    def total(when: Column, of: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0)).cast("long")

    per_edge = met.groupBy("part", "state", "bit", "weight").agg(
        total(~hit & ~before).alias("kept"), total(hit & ~before).alias("removed"), total(hit & before).alias("redundant"),
        total(m == bit).alias("unique_fails"), total(hit & ~before, "g").alias("good_lost"),
        total(hit & ~before, "t").alias("toxic_lost"))
    per_edge = written(per_edge, "edges")
    share = per_edge.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    walked = spark.createDataFrame(orders(names), "filter_order string, step int, state int, bit int")
    return per_edge.join(share, ["part", "bit"]).join(F.broadcast(walked), ["state", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def marks(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, good, toxic`` as 0 or 1, one row per labelled id."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).agg(
        one("quality").alias("good"), one("toxic").alias("toxic"))
