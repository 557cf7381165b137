"""Row numbers, running sums and prefix ranks against plain windows and brute force; hot keys, ties, NULLs, empty tables."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from growthlens.plans import ranges


def test_numbers_and_sums_equal_a_window(spark):
    rng = random.Random(1)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"k{i % 7}", 1 if i % 2 else i, i, rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, day int, no int, v int")
    w = Window.partitionBy("key").orderBy("day", "no")
    want = df.select("no", F.row_number().over(w).cast("long"), F.sum("v").over(w)).collect()
    got = ranges.running(df, ["key"], ["day", "no"], {"n": F.lit(1), "s": F.col("v")})
    assert sorted(map(tuple, got.select("no", "n", "s").collect())) == sorted(map(tuple, want))
    assert ranges.ranged(df.filter("key = 'hot'"), ["key"], ["day", "no"]).select("__part").distinct().count() == 4
    whole = ranges.numbered(df, [], [F.desc("no")], "n")
    assert all(r.n == 3000 - r.no for r in whole.collect())
    assert ranges.numbered(df.limit(0), ["key"], ["no"], "n").count() == 0


@pytest.mark.parametrize("leaf,fanout", [(4, 3), (64, 16)])
def test_prefix_ranks_equal_brute_force(spark, monkeypatch, leaf, fanout):
    monkeypatch.setattr(ranges, "LEAF", leaf)
    monkeypatch.setattr(ranges, "FANOUT", fanout)
    rng = random.Random(2)
    rows = [("hot" if i % 4 else None if i % 8 else "k", rng.randrange(5), i, rng.choice([None, 0, 0, 1, 5, rng.randrange(40)])) for i in range(700)]
    got = ranges.prefix_ranks(spark.createDataFrame(rows, "key string, day int, no int, v int"), "key", ["day", "no"], "v", "less", "n").collect()
    assert len(got) == 700
    for r in got:
        mine = [x for x in rows if x[0] == r.key and (x[1], x[2]) < (r.day, r.no)]
        assert r.n == len(mine) + 1
        assert r.less == sum(x[3] is not None and r.v is not None and x[3] < r.v for x in mine)
    assert ranges.prefix_ranks(spark.createDataFrame([], "key string, day int, no int, v int"), "key", ["day", "no"], "v", "less", "n").count() == 0
