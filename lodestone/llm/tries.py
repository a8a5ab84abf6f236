"""Prefix trie of conversations by smallest-member ownership.

Every sequence of first turns is a node and belongs to the smallest conversation that starts with it. The smallest member of a node is also
that of its nodes further down that hold it, so each conversation owns a suffix of its own path, known by where it begins. Then one
grouping by prefix gives all sums over subtrees: a member adds the tokens of its path from the node down, less those of nodes that it
owns, and its flags for a child and for a leaf of its own. No node meets another but its parent, and nothing walks the trie.

A prefix is named by its depth and two 64-bit values, each the exclusive or of hashes of (place, role, text) of its turns. Such names can be
put together from blocks of a path, so neither a conversation of any length nor a prefix that all share is held by one task: paths are cut
into blocks of ``BLOCK`` turns, groupings are summed before they are shuffled, and the lists of ids that end at a node are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import looked_up, written

#: Turns of a path that are windowed together.
BLOCK = 4096
#: Ids joined into one row before the rows of a node are hashed in order.
_PACKED = 8192
_KEY = ["depth", "a", "b"]


def ordered(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Written ``conv, pos, t1, t2, n_bytes`` of every message: its place in its conversation from 1, hashes of role and text, bytes of the text.

    Messages are in order of turn (null first), then role, then text, which ties only need; null roles and texts are empty; rows of a null
    conversation are in none and left out. The order comes from ranges of rows, so a conversation may lie in many tasks.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = messages.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.octet_length(empty(role)).alias("n_role"), F.concat(empty(role), F.lit("\0"), empty(text)).alias("said"),
    )
    # Bounds of ranges are gathered from a sample: a beginning of what was said is enough for them, and agrees with the whole order.
    rows = rows.repartitionByRange("conv", "turn", F.substring("said", 1, 64)).sortWithinPartitions("conv", "turn", "said")
    rows = rows.select(
        "conv", F.monotonically_increasing_id().alias("m"), F.xxhash64(F.lit(1), "n_role", "said").alias("t1"),
        F.xxhash64(F.lit(2), "said", "n_role").alias("t2"), (F.octet_length("said") - F.col("n_role") - 1).cast("long").alias("n_bytes"),
    )
    rows = written(rows, "turns").withColumn("part", F.shiftright("m", 33))
    spans = rows.groupBy("conv", "part").agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv", "part", (F.col("least") - F.coalesce(F.sum("n").over(earlier), F.lit(0)) - 1).alias("base"))
    placed = rows.join(spans, ["conv", "part"]).select("conv", (F.col("m") - F.col("base")).alias("pos"), "t1", "t2", "n_bytes")
    return written(placed, "places")


def block(place: Column) -> Column:
    return F.floor(place / BLOCK)


def _paths(path: DataFrame, convs: DataFrame) -> DataFrame:
    """Written ``conv, block, depth, a, b, up_a, up_b, upto, below, size`` of every place of every path, the root included: the names of the
    prefix and of its parent, bytes of the turns before its last, bytes from its last turn down, turns of the whole path."""
    named = path.select("conv", "depth", F.xxhash64(F.lit(1), "depth", "t1", "t2").alias("a"), F.xxhash64(F.lit(2), "t2", "depth", "t1").alias("b"), "n_bytes")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv").distinct().select("conv", *[zero.alias(c) for c in ("depth", "a", "b", "n_bytes")])
    named = named.unionByName(roots).withColumn("block", block(F.col("depth")))
    inner = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = named.select("conv", "block", "depth", "n_bytes", "a", "b", F.bit_xor("a").over(inner).alias("ia"), F.bit_xor("b").over(inner).alias("ib"), F.sum("n_bytes").over(inner).alias("i"))
    blocks = named.groupBy("conv", "block").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("n_bytes").alias("x"), F.max("depth").alias("deepest"))
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv", "block", F.coalesce(F.bit_xor("xa").over(earlier), zero).alias("oa"), F.coalesce(F.bit_xor("xb").over(earlier), zero).alias("ob"),
        F.coalesce(F.sum("x").over(earlier), zero).alias("o"), F.sum("x").over(whole).alias("total"), F.max("deepest").over(whole).alias("size"),
    )
    both = lambda c: F.col(f"i{c}").bitwiseXOR(F.col(f"o{c}"))
    before = F.col("o") + F.col("i") - F.col("n_bytes")
    rows = rows.join(blocks, ["conv", "block"]).select(
        "conv", "block", "depth", both("a").alias("a"), both("b").alias("b"), both("a").bitwiseXOR(F.col("a")).alias("up_a"), both("b").bitwiseXOR(F.col("b")).alias("up_b"),
        before.alias("upto"), (F.col("total") - before).alias("below"), "size",
    )
    return written(rows, "paths")


def _digests(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256`` of ``ends(depth, a, b, conv)``: ids ascending and comma-joined, hashed as they stream by."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            ids = batch.column(3).to_pylist()
            cuts = [i for i in range(len(ids)) if i % _PACKED == 0 or keys[i] != keys[i - 1]]
            lists = [",".join(map(str, ids[i:j])) for i, j in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            columns = [*([keys[i][k] for i in cuts] for k in range(3)), [ids[i] for i in cuts]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(lists, pa.string())], names=[*_KEY, "least", "ids"])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in done], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in done], pa.string())], names=[*_KEY, "ends_sha256"])

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True)
            for *at, ids in rows:
                if at == key:
                    sha.update(b",")
                else:
                    if sha:
                        done.append((key, sha.hexdigest()))
                    key, sha = at, hashlib.sha256()
                sha.update(ids.encode())
            if len(done) >= 10_000:
                yield out()
                done = []
        if sha:
            done.append((key, sha.hexdigest()))
        if done:
            yield out()

    rows = ends.select(*_KEY, "conv").repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    lists = rows.mapInArrow(packed, "depth long, a long, b long, least long, ids string")
    return lists.repartition(*_KEY).sortWithinPartitions(*_KEY, "least").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def nodes(path: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the trie.

    ``path(conv, depth, t1, t2, n_bytes)`` has a row for each turn, depths from 1 without gaps; ``convs(conv)`` names all conversations, those without
    turns too, which are members of the root alone. ``conv_id`` is the smallest member and tells a node together with its depth. No conversation: no node.
    """
    rows = _paths(path, convs)
    held = rows.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("deepest"), F.min("upto").alias("upto")
    )
    held = written(held, "owned")
    # Where the owned suffix of a conversation begins, the bytes before it, and whether its last node has no child.
    firsts = held.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("since"), F.min_by("upto", "depth").alias("before"), F.bool_or(F.col("deepest") == F.col("depth")).alias("leaf")
    )
    # A row for each block of a path, so that the next join is as even as the blocks are.
    marks = rows.select("conv", "block").distinct().join(firsts, "conv")
    marked = rows.join(marks, ["conv", "block"], "left")
    owns = lambda d: F.coalesce(F.col("since") <= d, F.lit(False)) & (d <= F.col("size"))
    owned = F.when(owns(F.col("depth")), F.col("below")).when(F.col("since").isNotNull(), F.col("below") + F.col("upto") - F.col("before")).otherwise(0)
    sums = marked.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(owns(F.col("depth") + 1)).alias("n_children"),
        F.count_if(F.col("leaf")).alias("n_leaves"), F.sum(F.col("below") - owned).alias("saved_tokens"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"),
    )
    parent = held.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), "n_convs")
    places = held.agg(F.sum("n_convs")).first()[0] or 0
    linked = looked_up(written(sums, "sums").withColumnRenamed("n_convs", "n"), parent, ["depth", "up_a", "up_b"], "n_convs", places)
    digests = _digests(rows.where("depth = size"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = linked.join(digests, _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def trie(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the conversations as they stand (see ``ordered`` and ``nodes``)."""
    turns = ordered(messages, conv, turn, role, text)
    return nodes(turns.withColumnRenamed("pos", "depth"), turns.select("conv"))
