"""Ordered computations per key that stay parallel when one key is very large.

A plain window ``PARTITION BY key ORDER BY t`` puts a whole key into one task. These helpers
partition by ``(key, time bucket)`` instead, summarise every bucket to one row with a
map-side combined aggregate, run the window over the summaries only, and join the carried
value back. ``bucket`` must not decrease along the order. Results equal the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_B = "__bucket"


def _local(keys, order):
    return Window.partitionBy(*keys, _B).orderBy(*order)


def _across(keys):
    return Window.partitionBy(*keys).orderBy(_B)


def previous(df: DataFrame, keys, order, bucket: Column, values: dict[str, str]) -> DataFrame:
    """Add the previous row's values per key. ``values`` maps new names to source columns."""
    b = df.withColumn(_B, bucket)
    packed = F.struct(*[F.col(src).alias(name) for name, src in values.items()])
    last = b.groupBy(*keys, _B).agg(F.max_by(packed, F.struct(*order)).alias("__last"))
    carry = last.select(*keys, _B, F.lag("__last").over(_across(keys)).alias("__carry"))
    rows = b.withColumn("__prev", F.lag(packed).over(_local(keys, order)))
    joined = rows.join(carry, [*keys, _B], "left").withColumn("__prev", F.coalesce("__prev", "__carry"))
    return joined.select(*df.columns, *[F.col(f"__prev.{name}").alias(name) for name in values])


def running_sums(df: DataFrame, keys, order, bucket: Column, values: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums (whole numbers) along the order of each key."""
    b = df.withColumn(_B, bucket).select("*", *[v.cast("bigint").alias(f"__v_{n}") for n, v in values.items()])
    totals = b.groupBy(*keys, _B).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, _B, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in values]
    )
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = b.select("*", *[F.sum(f"__v_{n}").over(upto).alias(f"__r_{n}") for n in values])
    joined = rows.join(carry, [*keys, _B], "inner")
    return joined.select(*df.columns, *[(F.col(f"__r_{n}") + F.col(f"__c_{n}")).alias(n) for n in values])


def running_sum(df: DataFrame, keys, order, bucket: Column, value: Column, name: str) -> DataFrame:
    return running_sums(df, keys, order, bucket, {name: value})


def row_numbers(df: DataFrame, keys, order, bucket: Column, name: str) -> DataFrame:
    """Exact row numbers 1..n per key (or over everything when ``keys`` is empty)."""
    return running_sum(df, keys, order, bucket, F.lit(1), name)


def last_known(df: DataFrame, keys, order, bucket: Column, value: str, name: str) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row (as-of fill)."""
    b = df.withColumn(_B, bucket)
    last = b.groupBy(*keys, _B).agg(
        F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct(*order)))
        .alias("__last")
    )
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, _B, F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = b.withColumn("__cur", F.last(value, ignorenulls=True).over(upto))
    joined = rows.join(carry, [*keys, _B], "left")
    return joined.select(*df.columns, F.coalesce("__cur", "__carry").alias(name))
