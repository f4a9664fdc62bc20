"""Prefix trie of conversations: equal rebuilt conversations collapse into weighted sequences before any prefix is formed.

A turn at a place has a 128-bit hash, and a prefix the exclusive or of its turns' hashes.  That operation is associative, so a
long conversation is summed in blocks of turns and no task needs the whole of it; a node is a depth with such a hash.  Sequences
that are proper prefixes of others are found by an anti-join against the parents of nodes; what remains are the leaves.

Sums over subtrees need no walk.  For a node u at depth d, the bytes of all members' turns from d on are added per sequence.
The bytes of distinct nodes are added likewise, each at its least member: a sequence whose least conversation is the least
member of a node is that also for its own nodes below, so what it owns is the end of the sequence from its ``top`` on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common
from .ordered_hash import joined_sha256

#: Turns of a block; each group of ``GROUP`` conversations borrows the first turns of its first one, at most ``BORROWED`` - 1.
BLOCK, GROUP, BORROWED = 1024, 5, 9
NODE = ["depth", "x1", "x2"]


@dataclass(frozen=True)
class Trie:
    """``nodes``: depth, hash, conv_id, parent_conv_id and counts.  ``ends``: depth, hash and conv_id of every conversation.  ``sequences``: each
    distinct conversation with its weight and least member."""

    nodes: DataFrame
    ends: DataFrame
    sequences: DataFrame


def borrowed(conv: Column) -> Column:
    """How many turns of its group's first conversation a conversation begins with."""
    return (F.crc32(conv.cast("string").cast("binary")) % BORROWED).cast("bigint")


def _place(turns: DataFrame) -> DataFrame:
    """All turns in order, stored, with ``gid``: it grows with the order, its upper bits name the task that holds the turn."""
    order = ["conv", "turn", "role", "digest"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    gid = F.monotonically_increasing_id()
    return common.stored(ranged.select("conv", "role", "digest", "bytes", gid.alias("gid"), F.shiftright(gid, 33).alias("part")), "turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, p, e1, e2, bytes) of the rebuilt conversations, p from 1, and all conversations (conv)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.md5(text.cast("binary")).alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))
    placed = _place(turns)
    spans = placed.groupBy("conv", "part").agg(F.min("gid").alias("start"), F.count("*").alias("n"))
    by_part = Window.partitionBy("conv").orderBy("part")  # a conversation has as many rows here as tasks that hold it
    spans = spans.select("conv", "part", "start", F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                         F.sum("n").over(Window.partitionBy("conv")).alias("total"))
    spans = common.stored(spans, "spans")
    convs = spans.where(F.col("before") == 0).select("conv", "total", borrowed(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    lent = convs.select(F.col("conv").alias("base"), F.col("total").alias("lent"))
    convs = convs.join(lent, "base", "left").select("conv", "h", "base", F.least("h", F.coalesce("lent", F.lit(0))).alias("lead"))
    spans = spans.select("conv", "part", "start", "before").join(convs, "conv")
    numbered = placed.join(spans, ["conv", "part"]).withColumn("pos", F.col("gid") - F.col("start") + F.col("before") + 1)
    own = numbered.where(F.col("pos") > F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("p"), "role", "digest", "bytes")
    # at most eight turns for each of at most five conversations
    first = numbered.where((F.col("conv") == F.col("base")) & (F.col("pos") < BORROWED)).select("base", F.col("pos").alias("p"), "role", "digest", "bytes")
    taken = first.join(convs.select("conv", "h", "base"), "base").where(F.col("p") <= F.col("h")).select("conv", "p", "role", "digest", "bytes")
    rows = own.unionByName(taken).select(
        "conv", "p", F.xxhash64(F.lit(1), "p", "role", "digest").alias("e1"), F.xxhash64("digest", "role", "p", F.lit(2)).alias("e2"), "bytes",
        F.floor((F.col("p") - 1) / BLOCK).alias("block"))
    return common.stored(rows, "rebuilt"), convs.select("conv")


def _blocks(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(n - 1, F.lit(0)) / BLOCK)))


def trie(conversations: DataFrame) -> Trie:
    """The nodes of all rebuilt conversations.

    Turns are ordered by turn (null first), then by role and md5 of the text; repeated rows stay, each as a turn.  A null role
    or text is empty; rows without conv_id belong to no conversation.  ``c - c % 5`` has SQL's sign for negative ids.  A conversation may
    end up without turns and is then a member of the root alone.  An empty table has no conversation and no node.  Only
    conv_id, turn, role and text are read, so no other column's name can clash; texts of any length count whole.
    """
    rows, convs = rebuilt(conversations)
    sums = rows.groupBy("conv", "block").agg(
        F.bit_xor("e1").alias("e1"), F.bit_xor("e2").alias("e2"), F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    upto = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block of turns
    zero = F.lit(0).cast("bigint")
    sums = common.stored(sums.select("conv", "block", "e1", "e2", "bytes", "n", *(F.coalesce(f(c).over(upto), zero).alias(a) for f, c, a in (
        (F.bit_xor, "e1", "b1"), (F.bit_xor, "e2", "b2"), (F.sum, "bytes", "bb")))), "blocks")
    full = sums.groupBy("conv").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"), F.sum("bytes").alias("total"), F.sum("n").alias("depth"))
    ends = common.stored(convs.join(full, "conv", "left").select("conv", *(F.coalesce(c, zero).alias(c) for c in (*NODE, "total"))), "ends")
    sequences = common.stored(ends.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("weight"), F.max("total").alias("total")), "sequences")

    # prefixes of each distinct sequence, along its least member
    parts = sums.select("conv", "block", "b1", "b2", "bb").join(sequences.select("conv", "weight", "total"), "conv")
    inside = Window.partitionBy("conv", "block").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = rows.join(parts, ["conv", "block"]).select(
        "conv", "block", F.col("p").alias("depth"), "weight", "e1", "e2",
        F.col("b1").bitwiseXOR(F.bit_xor("e1").over(inside)).alias("x1"), F.col("b2").bitwiseXOR(F.bit_xor("e2").over(inside)).alias("x2"),
        (F.col("total") - F.col("bb") - F.sum("bytes").over(inside) + F.col("bytes")).alias("below"))
    prefixes = prefixes.select("conv", "block", "depth", "weight", "x1", "x2", F.col("x1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("e2")).alias("p2"), "below")
    roots = sequences.select("conv", zero.alias("block"), zero.alias("depth"), "weight", zero.alias("x1"), zero.alias("x2"), zero.alias("p1"), zero.alias("p2"), F.col("total").alias("below"))
    prefixes = common.stored(prefixes.unionByName(roots), "prefixes")

    nodes = common.stored(prefixes.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min_by("below", "conv").alias("below")), "nodes")
    parents = nodes.where(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    parents = common.stored(parents.agg(F.count("*").alias("n_children")), "parents")
    leaves = sequences.join(parents, NODE, "left_anti").select("conv", F.lit(1).alias("leaf"))
    tops = common.stored(nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("top"), F.min_by("below", "depth").alias("owned"), F.min_by("p1", "depth").alias("p1"), F.min_by("p2", "depth").alias("p2")), "tops")

    info = sequences.select("conv", "depth").join(tops.select("conv", "owned"), "conv", "left").join(leaves, "conv", "left")
    info = info.select("conv", _blocks(F.col("depth")).alias("block"), F.coalesce("owned", zero).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums_below = prefixes.join(info, ["conv", "block"]).groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.col("weight") * F.col("below") - F.least("below", "owned")).alias("saved_tokens"))

    # a node's parent has the same least member, but for the top of what a conversation owns; the root is one row
    root = nodes.where(F.col("depth") == 0).select("conv_id").first()
    turning = tops.where(F.col("top") > 1).select("conv", "top", (F.col("top") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    found = turning.join(nodes.select(*NODE, F.col("conv_id").alias("above")), NODE).select(F.col("conv").alias("conv_id"), F.col("top").alias("depth"), "above")
    first = F.lit(root.conv_id if root else None).cast("bigint")
    parent = F.when(F.col("depth") == 1, first).when(F.col("depth") > 1, F.coalesce("above", "conv_id"))
    out = nodes.select(*NODE, "conv_id", "n_convs").join(sums_below, NODE).join(parents, NODE, "left").join(found, ["conv_id", "depth"], "left")
    out = out.select(*NODE, "conv_id", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens")
    return Trie(out, ends.select(*NODE, F.col("conv").alias("conv_id")), sequences)


def digests(found: Trie) -> DataFrame:
    """The nodes with the hash of the conversations that end in each."""
    rows = found.ends.withColumn("name", F.col("conv_id").cast("string"))
    hashed = joined_sha256(rows, NODE, ["conv_id"], "name").withColumnRenamed("sha256", "ends_sha256")
    out = found.nodes.join(hashed, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
