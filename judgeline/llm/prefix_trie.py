"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Sequences are told apart by the xor of hashes of (position, turn) in 128
bits, so that a prefix costs a running xor and no text ever moves. Turns are numbered within ranges of the sorted table,
whose offsets are then added up, so that a conversation of any length is spread over many tasks.

Subtree totals: in turn, unary chains are compressed (pointers jump to the chain's lower end, doubling their reach with
every join) and leaves are raked (their totals are added to their parents). At least half of all nodes go in each
such round. Contracted nodes keep the node that they point to and what lies between, and are re-expanded in reverse.

Defined cases: null role and text are empty, a null turn comes first, turns of equal number go by digest. Rows without a
conversation id belong to no conversation. Without conversations there is no node, not even the root. Columns besides
``conv_id, turn, role, text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgeline.llm.common import join_split
from judgeline.session import written

#: Ids whose texts are joined into one row for hashing: 2 to this power.
ID_BLOCK = 12


def _lanes(position: Column, digest: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at a position."""
    key = F.sha2(F.concat(position.cast("string"), F.lit(":"), F.hex(digest)), 256)
    return [F.conv(F.substring(key, at, 16), 16, -10).cast("long") for at in (1, 17)]


def turns(conversations: DataFrame) -> DataFrame:
    """``c, part, off, at, n, digest, chars``: numbered turns without their texts.

    ``part`` is a range of the table sorted by conversation and turn, ``off`` the conversation's turns in ranges before,
    ``at`` the place within the range from 1, ``n`` the conversation's turns.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.length(text).cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    ranges = written(rows.repartitionByRange("c", *order).withColumn("part", F.spark_partition_id()), "turns")
    per_part = ranges.groupBy("c", "part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "c", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("off"),
        F.sum("k").over(Window.partitionBy("c")).alias("n"))
    inside = Window.partitionBy("c", "part").orderBy(*order)
    return written(ranges.join(offsets, ["c", "part"]).select(
        "c", "part", "off", F.row_number().over(inside).cast("long").alias("at"), "n", "digest", "chars"), "numbered")


def grafted_paths(conversations: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most: int):
    """(paths, ends): every prefix of every rebuilt conversation, and the full sequence of each.

    A conversation ``c`` becomes the first ``head(c)`` (at most ``most``) turns of conversation ``base(c)``, as far as
    there are any, and its own turns after its first ``head(c)``. ``paths`` has ``c, depth, k0, k1`` (the prefix),
    ``p0, p1`` (the one shorter) and ``chars`` of the last text; ``ends`` has ``c, k0, k1``.
    """
    rows = turns(conversations)
    sizes = rows.where("off = 0 AND at = 1").select("c", "n")
    convs = sizes.withColumns({"b": base(F.col("c")), "h": head(F.col("c")).cast("long")})
    tops = rows.where(F.col("off") + F.col("at") <= most).select(
        F.col("c").alias("b"), (F.col("off") + F.col("at")).alias("depth"), "digest", "chars")
    l0, l1 = _lanes(F.col("depth"), F.col("digest"))
    by_depth = Window.partitionBy("b").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    tops = tops.withColumns({"l0": l0, "l1": l1}).withColumns(
        {f"k{i}": F.bit_xor(f"l{i}").over(by_depth) for i in (0, 1)}).withColumns(
        {f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"l{i}")) for i in (0, 1)})
    tops = written(tops.select("b", "depth", "k0", "k1", "p0", "p1", "chars"), "tops")
    taken = convs.join(tops, "b").where(F.col("depth") <= F.col("h"))
    # One row per conversation: the turns taken from its base, and their prefix.
    last = taken.groupBy("c").agg(F.max(F.struct("depth", "k0", "k1")).alias("t"))
    starts = written(convs.join(last, "c", "left").select(
        "c", "h", F.coalesce("t.depth", F.lit(0)).alias("m"), F.coalesce("t.k0", F.lit(0)).alias("b0"),
        F.coalesce("t.k1", F.lit(0)).alias("b1")), "starts")
    # The starts reach the turns by way of the ranges, of which a long conversation has many.
    ranges = rows.select("c", "part").distinct().join(starts, "c")
    own = rows.join(ranges, ["c", "part"]).where(F.col("off") + F.col("at") > F.col("h")).withColumn(
        "depth", F.col("off") + F.col("at") - F.col("h") + F.col("m"))
    l0, l1 = _lanes(F.col("depth"), F.col("digest"))
    own = written(own.select("c", "part", "depth", "chars", "b0", "b1", l0.alias("l0"), l1.alias("l1")), "own")
    sums = own.groupBy("c", "part").agg(F.bit_xor("l0").alias("x0"), F.bit_xor("l1").alias("x1"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("c", "part", "x0", "x1", *[
        F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"before{i}") for i in (0, 1)])
    inside = Window.partitionBy("c", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = own.join(sums, ["c", "part"]).withColumns({
        f"k{i}": reduce(Column.bitwiseXOR, [F.col(f"before{i}"), F.bit_xor(f"l{i}").over(inside)], F.col(f"b{i}"))
        for i in (0, 1)})
    cols = ["c", "depth", "k0", "k1", "p0", "p1", "chars"]
    paths = keyed.withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"l{i}")) for i in (0, 1)}).select(*cols).unionByName(
        taken.select(*cols))
    whole = sums.groupBy("c").agg(F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"))
    ends = starts.join(whole, "c", "left").select("c", *[
        F.col(f"b{i}").bitwiseXOR(F.coalesce(f"x{i}", F.lit(0))).alias(f"k{i}") for i in (0, 1)])
    return paths, written(ends, "ends")


def trie_nodes(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """``node, depth, k0, k1, p0, p1, chars, conv_id, n_convs, n_children``; members are counted map-side."""
    inner = paths.groupBy("depth", "k0", "k1").agg(
        F.min("p0").alias("p0"), F.min("p1").alias("p1"), F.min("chars").alias("chars"), F.min("c").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"))
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k0"), zero.alias("k1"), F.lit(None).cast("long").alias("p0"),
        F.lit(None).cast("long").alias("p1"), zero.alias("chars"), "conv_id", "n_convs")
    nodes = written(inner.select(*root.columns).unionByName(root), "nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(
        F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(kids, ["k0", "k1"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    return written(counted.withColumn("node", F.monotonically_increasing_id()), "nodes-numbered")


def link_parents(nodes: DataFrame) -> DataFrame:
    """Adds ``parent`` and ``parent_conv_id``; a node with very many children is dealt to many tasks."""
    up = nodes.select(
        F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = join_split(nodes.where("depth > 0"), up, ["p0", "p1"], "node")
    top = nodes.where("depth = 0").withColumns({
        "parent": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    return written(below.unionByName(top), "linked")


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """``node`` and the sums of ``values`` over its subtree, itself included; ``tree`` has ``node, parent`` and the values.

    ``acc_x`` is what a remaining node has gathered from itself and raked children, ``up_x`` what its parent gets on top of
    its total, from spliced chains in between.
    """
    acc, up, more = ([f"{p}_{v}" for v in values] for p in ("acc", "up", "more"))
    alive = written(tree.select(
        "node", "parent", *[F.col(v).alias(a) for v, a in zip(values, acc)], *[F.lit(0).cast("long").alias(u) for u in up]), "alive")
    rounds = []
    while alive.head() is not None:
        # Compress: chains of nodes with one child and a parent.
        only = alive.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            F.count(F.lit(1)).alias("kids"), F.min("node").alias("child"), *[F.min(u).alias(m) for u, m in zip(up, more)])
        state = written(alive.join(only, "node", "left"), "state")
        unary = (F.col("kids") == 1) & F.col("parent").isNotNull()
        chain = state.where(unary).select(
            "node", "parent", F.col("child").alias("to"), *up, *[(F.col(a) + F.col(m)).alias(a) for a, m in zip(acc, more)])
        inner = chain.select(F.col("node").alias("to"), F.lit(True).alias("open"))
        chain = written(chain.join(inner, "to", "left").withColumn("open", F.coalesce("open", F.lit(False))), "chain")
        while chain.where("open").head() is not None:
            next_ = chain.select(
                F.col("node").alias("to"), F.col("to").alias("to2"), F.col("open").alias("open2"),
                *[F.col(a).alias(f"{a}2") for a in acc])
            jumped = chain.where("open").join(next_, "to").select(
                "node", "parent", F.col("to2").alias("to"), F.col("open2").alias("open"), *up,
                *[(F.col(a) + F.col(f"{a}2")).alias(a) for a in acc])
            chain = written(chain.where("NOT open").select(*jumped.columns).unionByName(jumped), "chain")
        tops = chain.join(chain.select(F.col("node").alias("parent")), "parent", "left_anti").select(
            F.col("to").alias("node"), F.col("parent").alias("over"), *[(F.col(a) + F.col(u)).alias(m) for a, u, m in zip(acc, up, more)])
        rest = state.where(~F.coalesce(unary, F.lit(False))).drop(*more).join(tops, "node", "left").select(
            "node", F.coalesce("over", "parent").alias("parent"), "kids", *acc,
            *[F.when(F.col("over").isNotNull(), F.col(m)).otherwise(F.col(u)).alias(u) for u, m in zip(up, more)])
        # Rake: leaves hand their totals to their parents. Compressing keeps the number of children.
        rest = written(rest, "compressed")
        leaves = rest.where("kids IS NULL")
        given = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.col(a) + F.col(u)).alias(m) for a, u, m in zip(acc, up, more)])
        alive = written(rest.where("kids IS NOT NULL").join(given, "node", "left").select(
            "node", "parent", *[(F.col(a) + F.coalesce(F.col(m), F.lit(0))).alias(a) for a, m in zip(acc, more)], *up), "alive")
        rounds.append((chain, leaves))
    # Re-expand: a chain's node has its own share of the chain and the total of the node at the chain's end.
    totals = None
    for chain, leaves in reversed(rounds):
        done = leaves.select("node", *[F.col(a).alias(v) for a, v in zip(acc, values)])
        totals = done if totals is None else totals.unionByName(done)
        if chain.head() is not None:
            totals = written(totals, "totals")
            found = join_split(chain, totals.withColumnRenamed("node", "to"), ["to"], "node")
            totals = totals.unionByName(found.select("node", *[(F.col(a) + F.col(v)).alias(v) for a, v in zip(acc, values)]))
    if totals is None:
        return tree.select("node", *values)
    return written(totals, "totals")


def end_digests(ends: DataFrame) -> DataFrame:
    """``k0, k1, ends_sha256``: SHA-256 of the ids that end in a node, ascending and comma-joined.

    Ids are put into texts block by block in parallel; the digest, which has to read them in order, streams over one row
    per block and holds nothing but its state.
    """
    ids = F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string"))
    blocks = ends.groupBy("k0", "k1", F.shiftright("c", ID_BLOCK).alias("block")).agg(F.array_join(ids, ",").alias("ids"))
    sorted_ = blocks.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "block")

    def run(batches):
        import hashlib

        key, digest = None, None
        for batch in batches:
            out = []
            for k0, k1, ids in zip(*(batch.column(c).to_pylist() for c in ("k0", "k1", "ids"))):
                if (k0, k1) == key:
                    digest.update(b",")
                else:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (k0, k1), hashlib.sha256()
                digest.update(ids.encode())
            yield as_batch(out)
        if key:
            yield as_batch([(*key, digest.hexdigest())])

    def as_batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
            names=["k0", "k1", "ends_sha256"])

    return sorted_.mapInArrow(run, "k0 long, k1 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most: int):
    """One row per node, see the module; ``base`` and ``head`` rebuild the conversations, see ``grafted_paths``."""
    paths, ends = grafted_paths(conversations, base, head, most)
    tree = link_parents(trie_nodes(paths, ends))
    sums = subtree_sums(tree.select(
        "node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    return tree.join(sums, "node").join(end_digests(ends), ["k0", "k1"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
