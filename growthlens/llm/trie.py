"""Prefix trie over conversations with vertical bitmaps.

Conversations are cut into shards of at most ``SHARD`` neighbouring ids and bands of ``BAND`` positions. A shard
indexes (position, turn) to bitsets of its conversations; depth-first, a parent's bitset intersected with the
postings of the next position yields its children, the population count their members, the intersection with
the bitset of the conversations that are over the end list. Shards give one row per node of their own, which are
added up by the node's key. A key is the XOR of 128-bit hashes of (position, turn), one per position, so a band
needs nothing of the bands before it but one key per conversation: neither a conversation nor a group of copies
that holds a third of all rows meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import ship_by_value

#: Conversations of a shard, positions of a band.
SHARD, BAND = 1024, 64
#: Conversations of a block share the first turns of its first one; at most HEAD of them.
BLOCK, HEAD = 20, 3

KEY = ["k1", "k2"]
_LOCAL = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, conv_id bigint, n bigint, words bigint, ends array<bigint>"
_EMPTY = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first one of its block."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)


# ----------------------------------------------------------------- positions


def _count_along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation within one sorted stretch."""
    last, n = None, 0
    for batch in batches:
        ids = batch.column(1).to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        sizes = np.diff(np.r_[starts, len(ids)])
        number = np.arange(1, len(ids) + 1) - np.repeat(starts, sizes)
        if ids[0] == last:
            number[: sizes[0]] += n
        last, n = ids[-1], int(number[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], [*batch.schema.names, "here"])


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` of (conv_id, turn, role, text_hash, words), a written table, with ``pos``, 1.. along each conversation.

    Rows are range-partitioned by conversation and order, so a long conversation lies in many partitions; one row
    per partition carries the count of the conversation that goes on in the next one.
    """
    spark = turns.sparkSession
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text_hash"), F.col("row")]
    given = turns.withColumn("row", F.monotonically_increasing_id())  # tells equal rows apart
    ranged = given.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().alias("part"), "conv_id", "role", "text_hash", "words")
    ddl = "part int, conv_id bigint, role string, text_hash string, words bigint, here bigint"
    rows = cut_lineage(ranged.mapInArrow(_count_along, ddl))
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "here")).alias("last"))
    ends = ends.select("part", "first", F.col("last.conv_id").alias("conv_id"), F.col("last.here").alias("n"))
    along = Window.orderBy("part")  # one row of numbers per partition
    ends = ends.withColumn("run", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")))
    before = F.struct(F.lag("conv_id").over(along).alias("conv_id"), F.lag("run").over(along).alias("run"))
    carried = ends.withColumn("before", before).filter("before.conv_id = first")
    carried = cut_lineage(carried.select("part", F.col("first").alias("conv_id"), F.col("before.run").alias("carried")))
    rows = rows.join(carried, ["part", "conv_id"], "left")
    return rows.select("conv_id", "role", "text_hash", "words", (F.col("here") + F.coalesce("carried", F.lit(0))).alias("pos"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, k1, k2, words``: the first turns of the block's first conversation, then the own ones after them."""
    h = shared_turns(F.col("conv_id"))
    block = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("block")
    rows = numbered(turns)
    rows = cut_lineage(rows.select("conv_id", "pos", "role", "text_hash", "words", h.alias("h"), block))
    head = rows.filter(f"conv_id = block AND pos <= {HEAD}").select("block", "pos", "role", "text_hash", "words")
    convs = rows.filter("pos = 1").select("conv_id", "h", "block")
    taken = convs.join(head, "block").filter("pos <= h").select("conv_id", "pos", "role", "text_hash", "words")
    length = head.groupBy("block").agg(F.count("*").alias("length"))
    own = rows.filter("pos > h").join(length, "block", "left")
    own = own.withColumn("pos", F.expr("pos - h + least(h, coalesce(length, 0))")).select(*taken.columns)
    both = taken.unionByName(own)
    key = lambda seed: F.xxhash64(F.lit(seed), "pos", "role", "text_hash", F.lit(-seed))
    return both.select("conv_id", "pos", key(1).alias("k1"), key(2).alias("k2"), "words")


# ----------------------------------------------------------------- one shard


class Shard:
    """Vertical bitmaps of some conversations over one band of positions."""

    def __init__(self, band: int):
        self.top = band * BAND
        self.convs: list[int] = []
        self.starts: dict[tuple[int, int], int] = {}
        self.turns: list[list[tuple[int, int, int]]] = []
        self.postings: dict[tuple[int, int, int], int] = {}
        self.on: list[int] = [0] * (BAND + 1)
        self.over: list[int] = [0] * (BAND + 1)

    def add(self, conv_id: int, start: tuple[int, int], ends_here: bool, turns: list[tuple[int, int, int]]) -> None:
        bit = 1 << len(self.convs)
        self.convs.append(conv_id)
        self.turns.append(turns)
        self.starts[start] = self.starts.get(start, 0) | bit
        for i, (a, b, _) in enumerate(turns):
            self.postings[i, a, b] = self.postings.get((i, a, b), 0) | bit
            self.on[i] |= bit
        if ends_here:
            self.over[len(turns)] |= bit

    def members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.convs[low.bit_length() - 1])
            bits ^= low
        return out

    def nodes(self) -> Iterator[tuple]:
        """Rows of ``_LOCAL``; a node that an earlier band ends with is given there."""
        stack = []
        for (a, b), bits in self.starts.items():
            stack.append((a, b, 0, bits))
            if not self.top:
                yield 0, 0, None, None, 0, self.convs[(bits & -bits).bit_length() - 1], bits.bit_count(), 0, self.members(bits & self.over[0])
        while stack:
            a, b, depth, bits = stack.pop()
            rest = bits & self.on[depth] if depth < BAND else 0
            while rest:
                first = (rest & -rest).bit_length() - 1
                x, y, words = self.turns[first][depth]
                child = bits & self.postings[depth, x, y]
                rest &= ~child
                yield (a ^ x, b ^ y, a, b, self.top + depth + 1, self.convs[first], child.bit_count(), words,
                       self.members(child & self.over[depth + 1]))
                stack.append((a ^ x, b ^ y, depth + 1, child))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a stretch sorted by (band, conv_id, pos) into shards; pos 0 opens a conversation."""

    def packed(shard: Shard) -> pa.RecordBatch:
        cols = list(zip(*shard.nodes()))
        kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _LOCAL.split(", ")])

    shard, at, opened = None, None, None
    for batch in batches:
        for band, conv_id, pos, a, b, words, last in zip(*[c.to_pylist() for c in batch.columns]):
            if pos:
                opened[3].append((a, b, words))
                continue
            if opened:
                shard.add(*opened)
            if shard is not None and (band != at or len(shard.convs) == SHARD):
                yield packed(shard)
                shard = None
            if shard is None:
                shard, at = Shard(band), band
            opened = (conv_id, (a, b), last, [])
    if opened:
        shard.add(*opened)
        yield packed(shard)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each key, in the order of rows; ids pass through and are not kept."""
    at, state = None, None
    for batch in batches:
        done = []
        for a, b, ends in zip(*[c.to_pylist() for c in batch.columns]):
            text = ",".join(map(str, ends))
            if (a, b) == at:
                state.update(f",{text}".encode())
            else:
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (a, b), hashlib.sha256(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*KEY, "ends_sha256"])
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], [*KEY, "ends_sha256"])


# ----------------------------------------------------------------- the trie


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. Turns stand by ``turn``, NULL first; turns with one number by role, then by the
    MD5 of the text, and equal rows follow each other. NULL roles and texts are empty; rows without a conv_id belong
    to no conversation and are left out; ``%`` keeps the sign of a negative id. An empty table has no node, not even a
    root. Other columns are ignored. The digest of an end list is one chain by definition: a node's ids pass through one
    task as sorted lists of at most ``SHARD``, never all at once.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("bigint")
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.md5(text.cast("binary")).alias("text_hash"), words.alias("words"),
    )
    turns = cut_lineage(turns)
    rows = cut_lineage(rebuilt(turns).withColumn("band", F.expr(f"CAST((pos - 1) div {BAND} AS INT)")))
    # per conversation and band: the key of all that stands before it; a conversation without turns has its first band
    none = [F.lit(0).cast("bigint").alias(c) for c in ("k1", "k2", "n")]
    opened = rows.select("conv_id", "band", "k1", "k2", F.lit(1).cast("bigint").alias("n"))
    opened = opened.unionByName(turns.select("conv_id").distinct().select("conv_id", F.lit(0).alias("band"), *none))
    opened = opened.groupBy("conv_id", "band").agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"))
    along = Window.partitionBy("conv_id").orderBy("band")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    start = lambda k: F.coalesce(F.bit_xor(k).over(before), F.lit(0)).alias(k)
    opened = cut_lineage(opened.select("conv_id", "band", start("k1"), start("k2"), F.lead("band").over(along).isNull().alias("last")))

    stream = opened.select("band", "conv_id", F.lit(0).cast("bigint").alias("pos"), "k1", "k2", F.lit(0).cast("bigint").alias("words"), "last")
    stream = stream.unionByName(rows.select("band", "conv_id", "pos", "k1", "k2", "words", F.lit(False).alias("last")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = stream.repartitionByRange(n, "band", "conv_id").sortWithinPartitions("band", "conv_id", "pos").mapInArrow(_walk, _LOCAL)
    local = cut_lineage(local)
    nodes = cut_lineage(local.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.sum("n").alias("n_convs"), F.max("words").alias("words"), F.sum(F.size("ends")).alias("n_ends"),
    ))

    by_parent = nodes.filter("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.join(by_parent, KEY).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    listed = local.filter(F.size("ends") > 0).select(*KEY, "ends")
    listed = listed.repartition(n, *KEY).sortWithinPartitions(*KEY, F.col("ends")[0]).mapInArrow(_digests, "k1 bigint, k2 bigint, ends_sha256 string")
    out = nodes.join(_subtrees(nodes, rows, opened), KEY, "left").join(by_parent, KEY, "left").join(listed, KEY, "left")
    out = out.join(cut_lineage(parents), ["p1", "p2"], "left")  # a table, so that the join may split a node with very many children
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("bigint").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def _subtrees(nodes: DataFrame, rows: DataFrame, opened: DataFrame) -> DataFrame:
    """``k1, k2, n_leaves, saved_tokens`` of every node with two members and more; all others have one leaf and save nothing.

    A node is owned by its smallest member. What lies below a node is owned by its members, at its depth and further
    down, so members add up what they own from there on: running sums per (conversation, band), added by key.
    """
    owners = nodes.groupBy("conv_id").agg(
        F.min(F.when(F.col("n_convs") == 1, F.col("depth"))).alias("alone"), F.max((F.col("n_ends") == F.col("n_convs")).cast("int")).alias("leaf")
    )
    saved = nodes.filter("n_convs > 1 AND words > 0").select("conv_id", F.col("depth").alias("pos"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    kept = rows.select("conv_id", "band", "pos", "k1", "k2").join(owners, "conv_id", "left").filter("alone IS NULL OR pos < alone")
    kept = kept.join(saved, ["conv_id", "pos"], "left").withColumn("saved", F.coalesce("saved", F.lit(0)))
    tops = opened.filter("band = 0").select("conv_id", "band", F.lit(0).cast("bigint").alias("pos"), "k1", "k2")
    tops = tops.join(owners, "conv_id", "left").filter("alone IS NULL OR alone > 0").withColumn("saved", F.lit(0).cast("bigint"))
    kept = cut_lineage(kept.select(*tops.columns).unionByName(tops))
    later = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = kept.groupBy("conv_id", "band").agg(F.sum("saved").alias("here"))
    bands = bands.select("conv_id", "band", F.coalesce(F.sum("here").over(later), F.lit(0)).alias("later"))
    bands = bands.join(opened.select("conv_id", "band", F.col("k1").alias("s1"), F.col("k2").alias("s2")), ["conv_id", "band"])
    up = Window.partitionBy("conv_id", "band").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("conv_id", "band").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    path = kept.select(
        "conv_id", "band", F.bit_xor("k1").over(up).alias("u1"), F.bit_xor("k2").over(up).alias("u2"), F.sum("saved").over(down).alias("rest"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
    ).join(bands, ["conv_id", "band"])
    path = path.select(F.expr("u1 ^ s1").alias("k1"), F.expr("u2 ^ s2").alias("k2"), "leaf", (F.col("rest") + F.col("later")).alias("rest"))
    return path.groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("rest").alias("saved_tokens"))


ship_by_value(__name__)
