"""Prefix trie against brute force: long and absent conversations, copies, NULLs, ties, repeated rows, an empty table."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from growthlens.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, k1 string, pos string, band string, depth int"


def by_brute_force(rows):
    mine = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            mine[conv].append((turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in mine.items()}
    members = defaultdict(list)
    length = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(abs(c) % 20 * (1 if c > 0 else -1))
        turns = own.get(first, [])[:h] + own[c][h:]
        length[c] = len(turns)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in children[p])
        ends = ",".join(str(c) for c in members[p] if length[c] == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str)
    assert got == by_brute_force(rows)
    return got


@pytest.mark.parametrize("shard,band", [(3, 2), (1024, 64)])
def test_trie_equals_brute_force(spark, monkeypatch, shard, band):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "BAND", band)
    rng = random.Random(7)
    rows = []
    for c in range(60):
        rows += [(c, t, rng.choice("au"), rng.choice(["hello there", "x y\tz", "one", "more words here"])) for t in range(rng.randrange(1, 8))]
    rows += [(c, t, "u", f"copy {t}") for c in range(60, 90) for t in range(9)]  # copies
    rows += [(777, t, "u", f"turn number {t}") for t in range(40)] + [(778, t, "u", f"turn number {t}") for t in range(41)]  # long, base absent
    rows += [(-7, 1, "u", "below zero"), (-20, 1, None, None), (None, 1, "u", "nobody's")]
    rows += [(100, None, "u", "first"), (100, 5, "u", "b"), (100, 5, "a", "c"), (100, 5, "a", "c"), (100, 5, "a", "a"), (101, None, None, "")]
    rows += [(200, 1, "u", "  "), (201, 1, "u", "ä b c " * 3000), (225, 1, "u", "only one"), (321, 3, "u", "gone")]
    got = check(spark, rows)
    assert sum(r[2] is None for r in got) == 1


def test_one_conversation_and_none(spark):
    assert len(check(spark, [(5, 1, "u", "a b"), (5, 2, "u", "c")])) >= 1
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "a", "", "", "", 1)], SCHEMA)).count() == 0


def test_a_long_conversation_is_numbered_over_many_partitions(spark):
    rows = spark.range(5000).select(
        F.lit(1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("u").alias("role"),
        F.lit("same").alias("text_hash"), F.lit(1).cast("long").alias("words"),
    )
    other = rows.limit(7).withColumn("conv_id", F.lit(2).cast("long"))
    got = trie.numbered(trie.cut_lineage(rows.unionByName(other).repartition(4)))
    assert sorted(r.pos for r in got.filter("conv_id = 1").collect()) == list(range(1, 5001))
    assert sorted(r.pos for r in got.filter("conv_id = 2").collect()) == list(range(1, 8))
    assert got.filter("conv_id = 1").select(F.spark_partition_id()).distinct().count() > 1
