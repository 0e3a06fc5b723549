"""Conversation prefix trie: what conversations share from their beginnings, as one row for each node.

A node is a sequence of first turns; its key is 128 bits, the exclusive or of a hash of each (place, role, text) in it. So keys
of all prefixes of a conversation come from a running sum, and parts of a long conversation are computed apart and put
together by their totals: nothing needs a conversation as a whole.

Mergeable partial tries: a conversation's prefixes are node rows of one member. Each partition combines its own rows to a table
of nodes before anything is dealt out (members add up, the smallest member stays), tables of the same slice of conversations
are merged by node, then those of all slices. So a node that a third of all conversations pass, the root above all, arrives
as a few rows. End lists are merged likewise: sorted stretches of ids are joined to pieces wherever they lie, and a node's pieces,
in order, run through one hash.

Bottom-up rollup in rounds that double: after round k a node holds the sums of its subtree down to 2 ** k levels, and the node
2 ** k levels above it, to which it adds. A trie of depth d takes log2(d) rounds, however long its chains are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, small

#: Turns of a conversation that are numbered and summed in one stretch.
STRETCH = 4096
#: Slices of conversations whose tries are merged first.
SLICES = 16
#: The root's key.
ROOT = 0
#: SHA-256 of nothing: the end list of a node where no conversation ends.
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text -> (conv_id, place, m1, m2, size): turns numbered from 1, as hashes of (role, text), and bytes of the text.

    Order: turn, null first, then the digest of role and text. Rows are dealt out by ranges of that order and numbered
    within them; each range adds what the ranges before hold of its conversation. Rows without conv_id are left out.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    told = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).where("conv_id is not null")
    dealt = materialize(told.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "digest").withColumn("part", F.spark_partition_id()), "trie-turns")
    held = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    split = materialize(held.groupBy("conv_id").agg(F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("part", "n"))).alias("sizes")).where("parts > 1"), "trie-split")
    # A conversation is in several ranges if it's long, or at their borders, so at most two short ones for each range.
    before = split.select("conv_id", F.posexplode("sizes").alias("k", "own"), "sizes").select(F.col("conv_id").alias("c"), F.col("own.part").alias("p"), F.aggregate(F.slice("sizes", 1, F.col("k")), F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("before"))
    number = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "digest"))
    own = dealt.withColumn("number", number)
    own = own.join(small(before, before.count()), (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    word = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    return own.select("conv_id", (F.col("number") + F.coalesce("before", F.lit(0))).alias("place"), word(1).alias("m1"), word(17).alias("m2"), "size")


def rebuilt_turns(turns: DataFrame, group: int, modulus: int) -> tuple[DataFrame, DataFrame]:
    """turns: as ordered_turns -> (conversations: conv_id, length; their turns: conv_id, depth, m1, m2, size).

    Conversation c begins with the first h turns of conversation c - c % group (all it has, if fewer; none if it's absent), followed by
    its own after its first h; h is the unsigned CRC-32 of c in decimal, modulo ``modulus``.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("long")
    plans = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("source"))
    plans = plans.join(sizes.select(F.col("conv_id").alias("source"), F.col("n").alias("there")), "source", "left")
    plans = plans.select("conv_id", "source", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("head"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("tail"))
    plans = materialize(plans, "trie-plans")
    some = small(plans, plans.count())
    lead = turns.where(F.col("place") < modulus).withColumnRenamed("conv_id", "source").join(some, "source").where("place <= head")
    rest = turns.join(some, "conv_id").where("place > h")
    both = lead.select("conv_id", F.col("place").alias("depth"), "m1", "m2", "size").unionByName(rest.select("conv_id", (F.col("place") - F.col("h") + F.col("head")).alias("depth"), "m1", "m2", "size"))
    return plans.select("conv_id", (F.col("head") + F.col("tail")).alias("length")), both


def prefixes(turns: DataFrame) -> DataFrame:
    """turns: conv_id, depth, m1, m2, size -> (conv_id, depth, size, k1, k2, p1, p2): the key of each prefix and of the one before it."""
    own = turns.select("conv_id", "depth", "size", F.floor(F.col("depth") / STRETCH).alias("stretch"), F.xxhash64("depth", "m1", "m2").alias("x1"), F.xxhash64("m2", "depth", "m1").alias("x2"))
    order = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    run = own.select("conv_id", "depth", "size", "stretch", "x1", "x2", F.bit_xor("x1").over(order).alias("r1"), F.bit_xor("x2").over(order).alias("r2"))
    # Only conversations that go on beyond a stretch have anything to carry over.
    longer = own.where(F.col("stretch") > 0).select("conv_id").distinct()
    totals = own.join(longer, "conv_id", "left_semi").groupBy("conv_id", "stretch").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(totals.select("conv_id", "stretch", F.bit_xor("t1").over(earlier).alias("c1"), F.bit_xor("t2").over(earlier).alias("c2")).where("stretch > 0"), "trie-carried")
    run = run.join(small(carried, carried.count()), ["conv_id", "stretch"], "left")
    key = lambda k: F.col(f"r{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0)))
    return run.select("conv_id", "depth", "size", key(1).alias("k1"), key(2).alias("k2"), key(1).bitwiseXOR(F.col("x1")).alias("p1"), key(2).bitwiseXOR(F.col("x2")).alias("p2"))


def merged(tries: DataFrame, *also: str) -> DataFrame:
    """Node tables as one: members added up, the smallest kept; what follows from the key is the same in all."""
    return tries.groupBy("k1", "k2", *also).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("size").alias("size"))


def end_digests(ends: DataFrame) -> DataFrame:
    """ends: k1, k2, conv_id -> (k1, k2, ends_sha256): SHA-256 of the node's ids, ascending, comma-joined."""

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        return np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = starts(batch)
                ids = batch.column(2)
                whole = pa.ListArray.from_arrays(pa.array(np.append(at, batch.num_rows), pa.int32()), pc.cast(ids, pa.string()))
                first = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(first), batch.column(1).take(first), ids.take(first), pc.binary_join(whole, ",")], names=["k1", "k2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            keys, digests = [], []
            for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if (a, b) == now:
                    h.update(b",")
                else:
                    if now is not None:
                        keys.append(now)
                        digests.append(h.hexdigest())
                    now, h = (a, b), hashlib.sha256()
                h.update(ids.as_buffer())
            yield told(keys, digests)
        if now is not None:
            yield told([now], [h.hexdigest()])

    def told(keys: list[tuple[int, int]], digests: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(digests, pa.string())], names=["k1", "k2", "ends_sha256"])

    dealt = lean(ends).select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = dealt.mapInArrow(joined, "k1 long, k2 long, first long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, n: int) -> DataFrame:
    """nodes: k1, k2, a1, a2 (parent's key; null: none), leaves, saved -> (k1, k2, leaves, saved) summed over each node's subtree."""
    while True:
        gain = nodes.where("a1 is not null").groupBy(F.col("a1").alias("g1"), F.col("a2").alias("g2")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("extra"))
        above = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        after = nodes.join(small(gain, n), (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left")
        after = after.join(small(above, n), (F.col("a1") == F.col("u1")) & (F.col("a2") == F.col("u2")), "left")
        plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
        nodes = materialize(after.select("k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), plus("leaves", "more"), plus("saved", "extra")), "trie-rolled")
        if not nodes.where("a1 is not null").limit(1).count():
            return nodes.select("k1", "k2", "leaves", "saved")


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """conversations: conv_id, length; turns: conv_id, depth (1 to length, each once), m1, m2, size -> a row for each node (see prefix_trie)."""
    paths = materialize(prefixes(turns), "trie-prefixes")
    one = F.lit(1).cast("long").alias("n_convs")
    zero = lambda name: F.lit(ROOT).cast("long").alias(name)
    none = lambda name: F.lit(None).cast("long").alias(name)
    roots = conversations.select("conv_id", zero("depth"), zero("size"), zero("k1"), zero("k2"), none("p1"), none("p2"), one)
    rows = paths.select("conv_id", F.col("depth").cast("long").alias("depth"), "size", "k1", "k2", "p1", "p2", one).unionByName(roots)
    parts = merged(rows.withColumn("slice", F.pmod(F.xxhash64("conv_id"), F.lit(SLICES))), "slice")
    nodes = materialize(merged(parts.drop("slice")), "trie-nodes")
    n = nodes.count()
    last = conversations.select("conv_id", "length")
    ends = paths.select("conv_id", "depth", "k1", "k2").join(last, "conv_id").where(F.col("depth") == F.col("length")).select("k1", "k2", "conv_id")
    ends = ends.unionByName(last.where(F.col("length") == 0).select(zero("k1"), zero("k2"), "conv_id"))

    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(small(children, n), (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left").drop("g1", "g2").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = nodes.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(small(parents, n), (F.col("p1") == F.col("g1")) & (F.col("p2") == F.col("g2")), "left").drop("g1", "g2")
    nodes = materialize(nodes, "trie-nodes")
    own = nodes.select("k1", "k2", F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    sums = rolled_up(own, n)
    out = nodes.join(small(sums, n), ["k1", "k2"]).join(end_digests(ends), ["k1", "k2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def prefix_trie(rows: DataFrame, group: int = 5, modulus: int = 9) -> DataFrame:
    """rows: conv_id, turn, role, text -> conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Conversations are rebuilt first (rebuilt_turns). Null role or text is empty; null turns come first; turns of one number, repeated
    rows too, each count, in the order of their digests; rows without conv_id are left out; very long texts are hashed whole;
    an empty table gives an empty trie, without a root, as no conversation is a member; other columns are dropped, whatever
    their names.
    """
    ordered = materialize(ordered_turns(rows), "trie-ordered")
    conversations, turns = rebuilt_turns(ordered, group, modulus)
    return trie(conversations, turns)
