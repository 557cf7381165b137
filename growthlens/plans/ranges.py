"""Row numbers and ranks along an order, in ranges of the data itself.

Ranges come from a range partitioning of the rows by their keys and order, so they hold about equally many
rows whatever the values: a key, a month or a single value with all rows is many ranges. One row of counts per range and key
carries the numbers on from range to range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .groups import unroll

#: Rows of a leaf, whose ranks are counted within an array, and children of a node above.
LEAF, FANOUT = 64, 16


def _ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` with ``__part``, its range by keys and order, as a table (bounds are drawn anew whenever a plan runs).

    A table also goes in, as the bounds are drawn from the rows in a pass of their own.
    """
    parts = cut_lineage(df).repartitionByRange(_ranges(df), *[F.col(k) for k in keys], *_columns(order))
    return cut_lineage(parts.withColumn("__part", F.spark_partition_id()))


def _columns(order: list) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def running(df: DataFrame, keys: list[str], order: list, values: dict[str, Column]) -> DataFrame:
    """Inclusive running sums of whole numbers along the order of each key (over everything without keys).

    Equal to a window over the key when the order is total. A range's own sums are taken in a window of the range,
    those of the ranges before it from one row per range and key.
    """
    parts = ranged(df.select("*", *[v.cast("bigint").alias(f"__v_{n}") for n, v in values.items()]), keys, order)
    totals = parts.groupBy("__part", *keys).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("__part").alias("__q"), *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in values],
    )
    upto = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parts.select("*", *[F.sum(f"__v_{n}").over(upto).alias(f"__r_{n}") for n in values])
    same = F.col("__part") == F.col("__q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = rows.join(carried, same)
    return joined.select(*df.columns, *[(F.col(f"__r_{n}") + F.col(f"__c_{n}")).alias(n) for n in values])


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Row numbers 1, 2, ... per key (over everything without keys)."""
    return running(df, keys, order, {name: F.lit(1)})


def prefix_ranks(df: DataFrame, key: str, order: list, value: str, less: str, number: str) -> DataFrame:
    """Per row: its ``number`` along the order of its key, and how many earlier rows of the key have a smaller value.

    Earlier rows fall into the blocks of a tree over the row numbers: the rows before within the leaf, and, level by
    level, the children before within the node. In a leaf an array of its values is counted; in a node the
    rows are run through in the order of their values with one counter per child, in ranges of the values, so a large node is
    many tasks. Values are whole numbers or anything else with an order; a NULL value is not smaller than any.
    """
    rows = cut_lineage(numbered(df, [key], order, number).withColumn("__p", F.col(number) - 1))
    longest = rows.agg(F.max("__p")).first()[0]
    if longest is None:
        return rows.select(*df.columns, number, F.lit(0).cast("bigint").alias(less))
    leaf = F.expr(f"__p div {LEAF}")
    leaves = rows.groupBy(key, leaf.alias("__leaf")).agg(F.sort_array(F.collect_list(F.struct("__p", F.col(value).alias("v")))).alias("__vs"))
    smaller = F.filter("__vs", lambda x: (x["__p"] < F.col("__own")["__p"]) & (x["v"] < F.col("__own")["v"]))
    own = unroll(leaves, [key, "__vs"], F.col("__vs"), "__own")
    counts = [own.select(key, F.col("__own.__p").alias("__p"), F.size(smaller).cast("bigint").alias("__n"))]
    spans, span = [], LEAF
    while span <= longest:
        spans.append(span)
        span *= FANOUT
    if spans:
        places = [F.struct(F.lit(x).alias("__span"), F.expr(f"__p div {x * FANOUT}").alias("__node"), F.expr(f"(__p div {x}) % {FANOUT}").alias("__child")) for x in spans]
        at = rows.select(key, "__p", F.col(value).alias("__v"), F.inline(F.array(*places))).filter("__v IS NOT NULL")
        # children are counted at their own rows, so at a row the sum over the children before is what lies below its value;
        # of equal values the later child comes first and counts none of the others
        order = ["__v", F.desc("__child"), "__p"]
        found = running(at, [key, "__span", "__node"], order, {f"__b{i}": F.col("__child") == i for i in range(FANOUT - 1)})
        before = F.element_at(
            F.array(F.lit(0).cast("bigint"), *[sum((F.col(f"__b{j}") for j in range(1, i + 1)), F.col("__b0")) for i in range(FANOUT - 1)]),
            F.col("__child").cast("int") + 1,
        )
        counts.append(found.select(key, "__p", before.alias("__n")))
    every = counts[0].unionByName(counts[1]) if spans else counts[0]
    every = every.groupBy(F.col(key).alias("__key"), F.col("__p").alias("__q")).agg(F.sum("__n").alias(less))
    joined = rows.join(every, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__p") == F.col("__q")))
    return joined.select(*df.columns, number, less)
